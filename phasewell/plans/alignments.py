"""Alignments that orders stand for, and the queries of the two passes over them.

An order is a read of one of three chromosomes, with one of three CIGAR shapes; its priority is the sample. Every
37th position has two alleles, some bases are wrong or unknown. Nations are genes. The SQL twins take the
bases of a read from its shape by arithmetic, without CIGAR, sequence or qualities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calling, chain, features, pileup
from ..sources.shared import written
from .catalog import het_sql, query, r6
from .proxies import table

TILE = 500
SPAN = 3000
LIMITS = {"depth": 8, "alt": 3, "het": 0.5}
CIGARS = ([(0, 60)], [(4, 3), (0, 20), (2, 2), (0, 18), (3, 40), (0, 20)], [(0, 25), (1, 2), (0, 30)])
LENGTHS = (60, 61, 57)


def letter(code: Column) -> Column:
    return F.substring(F.lit("ACGT"), (code % 4).cast("int") + 1, F.lit(1))


def reference_code(p: Column) -> Column:
    return (p * 7 + F.floor(p / 3)) % 4


def base_of(k: Column, p: Column) -> Column:
    code = reference_code(p)
    het = (p % 37 == 5) & (F.floor(k / 2) % 2 == 0)
    code = F.when(het, code + 1).when((k * 31 + p * 17) % 97 == 0, code + 2).otherwise(code)
    return F.when((k + p) % 211 == 0, "N").otherwise(letter(code))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind = F.col("k"), F.col("k") % 3
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("k"), F.col("o_orderpriority").alias("sample"), F.concat(F.lit("chr"), (F.col("o_custkey") % 3).cast("string")).alias("chrom"))
    own = own.withColumn("pos", k * 7919 % SPAN)
    cigars = [F.array(*[F.struct(F.lit(op).alias("op"), F.lit(n).alias("len")) for op, n in c]) for c in CIGARS]
    pick = lambda xs: F.when(kind == 0, xs[0]).when(kind == 1, xs[1]).otherwise(xs[2])
    at = lambda q: F.when(kind == 0, q).when(kind == 1, F.when(q < 3, None).when(q < 23, q - 3).when(q < 41, q - 1).otherwise(q + 39)).otherwise(F.when(q < 25, q).when(q < 27, None).otherwise(q - 2))
    places = F.sequence(F.lit(0), pick([F.lit(n - 1) for n in LENGTHS]))
    name = F.concat(F.lit("m/"), k.cast("string"), F.lit("/ccs"), F.when(k % 4 == 0, "_7").otherwise(""))
    flag = F.when(k % 17 == 0, 256).when(k % 5 == 0, 16).otherwise(0)
    return own.select(
        "sample", "chrom", "pos", "k", name.alias("qname"), flag.alias("flag"), F.when(k % 13 == 0, 10).otherwise(60).alias("mapq"), pick(cigars).alias("cigar"),
        F.array_join(F.transform(places, lambda q: F.coalesce(base_of(k, F.col("pos") + at(q)), F.lit("T"))), "").alias("seq"), F.transform(places, lambda q: (3 + (k * 11 + q * 7) % 38).cast("int")).alias("qual"),
    )


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.floor(F.col("n_nationkey") / 3) * 330).cast("bigint")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("geneID"), F.concat(F.lit("chr"), (F.col("n_nationkey") % 3).cast("string")).alias("geneChr"), start.alias("geneStart"), (start + 300).alias("geneEnd"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference of each chromosome that a gene lies on."""
    chroms = genes(spark, sf_dir).select(F.col("geneChr").alias("chrom")).distinct()
    at = chroms.withColumn("start", F.explode(F.sequence(*[F.lit(x).cast("bigint") for x in (0, SPAN + TILE, TILE)])))
    return at.withColumn("seq", F.array_join(F.transform(F.sequence(F.col("start"), F.col("start") + TILE - 1), lambda p: letter(reference_code(p))), ""))


def called(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    reads, regions = written(alignments(spark, sf_dir)), genes(spark, sf_dir)
    mapped = reads.where("k % 10 <> 9").join(regions.withColumnRenamed("geneChr", "chrom"), "chrom").select("sample", "geneID", F.col("qname").alias("Read"))
    return calling.call_sites(reads, regions, tiles(spark, sf_dir), TILE, mapped, **LIMITS)


SQL_READ_BASES = f"""o AS (SELECT o_orderkey::BIGINT AS k, o_orderpriority AS sm, 'chr' || (o_custkey % 3) AS chrom, o_orderkey::BIGINT * 7919 % {SPAN} AS pos, o_orderkey % 3 AS kind FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 10 <> 9 AND o_orderkey % 13 <> 0),
q AS (SELECT *, unnest(range(CASE kind WHEN 0 THEN {LENGTHS[0]} WHEN 1 THEN {LENGTHS[1]} ELSE {LENGTHS[2]} END)) AS q FROM o),
u AS (SELECT *, pos + CASE kind WHEN 0 THEN q WHEN 1 THEN CASE WHEN q < 3 THEN NULL WHEN q < 23 THEN q - 3 WHEN q < 41 THEN q - 1 ELSE q + 39 END ELSE CASE WHEN q < 25 THEN q WHEN q < 27 THEN NULL ELSE q - 2 END END AS p FROM q),
c AS (SELECT *, (p * 7 + p // 3) % 4 AS rc FROM u WHERE p IS NOT NULL), gn AS (SELECT n_name AS gene, 'chr' || (n_nationkey % 3) AS chrom, n_nationkey // 3 * 330 AS gs FROM nation),
z AS (SELECT gene, c.chrom, sm, k, q, p, 'ACGT'[rc + 1] AS ref, CASE WHEN (k + p) % 211 = 0 THEN 'N' ELSE 'ACGT'[(rc + CASE WHEN p % 37 = 5 AND k // 2 % 2 = 0 THEN 1 WHEN (k * 31 + p * 17) % 97 = 0 THEN 2 ELSE 0 END) % 4 + 1] END AS base, 3 + (k * 11 + q * 7) % 38 AS bq,
least(q, CASE kind WHEN 0 THEN {LENGTHS[0]} WHEN 1 THEN {LENGTHS[1]} ELSE {LENGTHS[2]} END - 1 - q) < 3 AS near, CASE kind WHEN 0 THEN {LENGTHS[0]} WHEN 1 THEN {LENGTHS[1]} ELSE {LENGTHS[2]} END AS len FROM c JOIN gn ON c.chrom = gn.chrom AND p BETWEEN gs AND gs + 300),
s1 AS (SELECT gene, chrom, sm, p, ref, count(*) FILTER (base = ref OR NOT near) AS depth, count(*) FILTER (base <> ref AND NOT near) AS alt_count FROM z WHERE bq >= 5 AND base <> 'N' GROUP BY ALL),
s2 AS (SELECT * FROM s1 WHERE depth >= {LIMITS['depth']} AND alt_count > {LIMITS['alt']} AND {het_sql(0.01, 0.6, 0.1, 0.3)} >= {LIMITS['het'] * 0.8 / 0.99!r}),
ob AS (SELECT DISTINCT z.gene, z.chrom, z.p, z.ref, k, q, base, bq, len FROM z SEMI JOIN s2 USING (gene, chrom, sm, p) WHERE bq >= 5 AND NOT (base <> ref AND near)),
de AS (SELECT s2.gene, s2.chrom, s2.p, count(*) AS n FROM (SELECT *, unnest([pos + 20, pos + 21]) AS p FROM o WHERE kind = 1) x JOIN s2 ON x.chrom = s2.chrom AND x.sm = s2.sm AND x.p = s2.p GROUP BY ALL),
js AS (SELECT gene, chrom, p, ref, sum(depth)::BIGINT AS depth, sum(alt_count)::BIGINT AS alt_count FROM s2 GROUP BY ALL)"""


@query(f'WITH {SQL_READ_BASES} SELECT js.gene AS "geneID", js.chrom, js.p AS pos, ref, depth, alt_count, round(alt_count / depth, 6) AS alt_frac, round({het_sql(0.01, 0.6, 0.1, 0.3)}, 6) AS het_prob, coalesce(n, 0) AS del_count FROM js LEFT JOIN de ON (js.gene, js.chrom, js.p) = (de.gene, de.chrom, de.p)')
def two_pass_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of all samples from alignments."""
    sites = called(spark, sf_dir)[0]
    return sites.select("geneID", "chrom", "pos", "ref", "depth", "alt_count", r6("alt_frac").alias("alt_frac"), r6("het_prob").alias("het_prob"), "del_count")


@query(f"WITH {SQL_READ_BASES} SELECT gene AS \"geneID\", chrom, p AS pos, ref, 'm/' || k || '/ccs' AS \"Read\", q AS qpos, base, bq AS baseq, 60 AS mapq, len AS read_len, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS is_reverse FROM ob")
def site_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pass two sees at each sample's sites, united."""
    return called(spark, sf_dir)[1]


@query(f"""WITH {SQL_READ_BASES}, v AS (SELECT gene, chrom, p, base, count(*) AS n, avg(power(10.0, -bq / 10)) AS err FROM ob WHERE base <> ref GROUP BY ALL), al AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY gene, chrom, p ORDER BY n DESC, err, base) = 1)
SELECT ob.gene AS "geneID", ob.chrom, ob.p AS pos, 'm/' || k || '/ccs' AS "Read", CASE WHEN ob.base = ref THEN 0 WHEN ob.base = al.base THEN 1 ELSE 2 END AS r, round(power(10.0, -bq / 10), 6) AS pi FROM ob JOIN al ON (ob.gene, ob.chrom, ob.p) = (al.gene, al.chrom, al.p)""")
def alignments_to_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From alignments to the input of the fit."""
    sites, seen = called(spark, sf_dir)
    return calling.em_table(sites, seen).select("geneID", "chrom", "pos", "Read", F.col("r").cast("int").alias("r"), r6("pi").alias("pi"))


SQL_FEATURES = f"""{SQL_READ_BASES}, v AS (SELECT gene, chrom, p, base, count(*) AS n, avg(power(10.0, -bq / 10)) AS err FROM ob WHERE base <> ref GROUP BY ALL), al AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY gene, chrom, p ORDER BY n DESC, err, base) = 1),
a1 AS (SELECT js.*, al.base AS alt, coalesce(de.n, 0) AS dels FROM js JOIN al ON (js.gene, js.chrom, js.p) = (al.gene, al.chrom, al.p) LEFT JOIN de ON (js.gene, js.chrom, js.p) = (de.gene, de.chrom, de.p)),
a2 AS (SELECT a1.gene, a1.chrom, a1.p, any_value(a1.ref) AS ref, any_value(alt) AS alt, any_value(dels) AS dels, any_value({het_sql(0.01, 0.6, 0.1, 0.3, 'a1.depth', 'a1.alt_count')}) AS het_prob, count(*) AS depth, count(*) FILTER (ob.base = alt) AS alt_count, avg(bq) FILTER (ob.base = alt) AS qa, avg(bq) FILTER (ob.base = a1.ref) AS qr,
  list(ob.base) FILTER (ob.base <> a1.ref) AS bad, avg(q / (len - 1)) FILTER (ob.base = alt) AS pm, stddev_pop(q / (len - 1)) FILTER (ob.base = alt) AS ps, count(*) FILTER (ob.base = a1.ref AND k % 5 <> 0) + 1 AS rf, count(*) FILTER (ob.base = a1.ref AND k % 5 = 0) + 1 AS rr, count(*) FILTER (ob.base = alt AND k % 5 <> 0) + 1 AS af, count(*) FILTER (ob.base = alt AND k % 5 = 0) + 1 AS ar
  FROM a1 JOIN ob ON (a1.gene, a1.chrom, a1.p) = (ob.gene, ob.chrom, ob.p) WHERE ob.base <> 'N' GROUP BY a1.gene, a1.chrom, a1.p),
a3 AS (SELECT *, rpad(array_to_string(list_transform(range(greatest(0, p - 5), p + 6), lambda x: 'ACGT'[(x * 7 + x // 3) % 4 + 1]), ''), 11, 'N') AS win, p - greatest(0, p - 5) AS idx FROM a2),
ft AS (SELECT gene, chrom, p, depth, alt_count, het_prob, 60.0::DOUBLE AS mean_mapq, coalesce(qa, 0) AS mean_bq_alt, coalesce(qr, 0) AS mean_bq_ref, len(list_filter(['A', 'C', 'G', 'T'], lambda b: len(list_filter(bad, lambda y: y = b)) >= 2)) AS n_distinct_alt, coalesce(pm, 0.5) AS alt_pos_on_read_mean, coalesce(ps, 0) AS alt_pos_on_read_std,
  ln(rf * ar / (rr * af) + rr * af / (rf * ar)) + ln(least(rf, rr) / greatest(rf, rr)) - ln(least(af, ar) / greatest(af, ar)) AS strand_sor, dels / (depth + dels) AS del_frac, len(list_filter(string_split(win, ''), lambda b: b IN ('G', 'C'))) / 11 AS gc_content_11bp, list_max(list_transform(regexp_extract_all(win, 'A+|C+|G+|T+|N+'), lambda r: length(r))) AS homopolymer_len,
  CASE WHEN idx > 0 AND alt IN (win[idx], win[idx + 2]) THEN 1 ELSE 0 END AS creates_homopolymer, CASE WHEN idx > 0 AND win[idx] IN ('A', 'T') AND win[idx + 2] IN ('A', 'T') THEN 1 ELSE 0 END AS flanking_is_AT, CASE WHEN ref || alt IN ('AG', 'GA', 'CT', 'TC') THEN 1 ELSE 0 END AS is_transition FROM a3)"""
DOUBLES = ["het_prob", "mean_mapq", "mean_bq_alt", "mean_bq_ref", "alt_pos_on_read_mean", "alt_pos_on_read_std", "strand_sor", "del_frac", "gc_content_11bp"]
WHOLE = ["depth", "alt_count", "n_distinct_alt", "homopolymer_len", "creates_homopolymer", "flanking_is_AT", "is_transition"]


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites, seen = called(spark, sf_dir)
    seen = written(seen)
    named = sites.join(pileup.alt_vote(seen, calling.SITE).select(*calling.SITE, "alt"), calling.SITE)
    return features.site_features(named, seen, tiles(spark, sf_dir), TILE)


@query(f'WITH {SQL_FEATURES} SELECT gene AS "geneID", chrom, p AS pos, {", ".join(f"{c}::BIGINT AS {c}" for c in WHOLE)}, {", ".join(f"round({c}, 6)::DOUBLE AS {c}" for c in DOUBLES)}, CASE WHEN homopolymer_len >= 5 THEN 1 ELSE 0 END::BIGINT AS is_homopolymer_ge5 FROM ft')
def site_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 17 features of each site, context across tiles."""
    f = featured(spark, sf_dir)
    return f.select("geneID", "chrom", "pos", *[F.col(c).cast("bigint").alias(c) for c in (*WHOLE, "is_homopolymer_ge5")], *[r6(c).alias(c) for c in DOUBLES])


#: A plain scorer for the query: much depth and even alleles speak for a site, a strand bias and repeats against it.
WEIGHTS, BIAS = {"depth": 0.02, "alt_count": 0.05, "strand_sor": -1.5, "homopolymer_len": -0.4, "mean_bq_alt": 0.05}, -0.5


@query(f'WITH {SQL_FEATURES}, sc AS (SELECT gene, chrom, p, 1 / (1 + exp(-({BIAS} + {" + ".join(f"{c} * {w}" for c, w in WEIGHTS.items())}))) AS s FROM ft) SELECT gene AS "geneID", chrom, p AS pos, round(s, 6) AS score FROM sc WHERE s >= 0.5')
def scored_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites that a pluggable scorer keeps."""
    scored = features.scored_sites(featured(spark, sf_dir), features.Logistic(WEIGHTS, BIAS), ["geneID"])
    return features.hard_filter(scored, 0.5).select("geneID", "chrom", "pos", r6("score").alias("score"))


LIMIT = chain.Limits(alt=6, depth=16, het=0.9, per_kilobase=60.0, run=3, alt_stretch=40, cluster=2, cluster_window=37, alt_cluster=22)
#: Windows of the reference around a position, and whether its letter lies in a run of ``run`` or more.
SQL_STRETCH = f"list_max(list_transform(range(0, {LIMIT.run}), lambda d: CASE WHEN p - d >= greatest(0, p - {LIMIT.flank}) AND len(list_distinct(list_transform(range(p - d, p - d + {LIMIT.run}), lambda x: (x * 7 + x // 3) % 4))) = 1 THEN 1 ELSE 0 END)) = 1"


@query(f"""WITH {SQL_READ_BASES}, v AS (SELECT gene, chrom, p, base, count(*) AS n, avg(power(10.0, -bq / 10)) AS err FROM ob WHERE base <> ref GROUP BY ALL), al AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY gene, chrom, p ORDER BY n DESC, err, base) = 1),
d1 AS (SELECT * FROM js WHERE alt_count > {LIMIT.alt} AND depth >= {LIMIT.depth}), cd AS (SELECT ob.gene, ob.chrom, ob.p, CASE WHEN ob.base = ob.ref THEN 0 WHEN ob.base = al.base THEN 1 ELSE 2 END AS r, least(.5, greatest(.001, power(10.0, -bq / 10))) AS pi FROM ob JOIN al ON (ob.gene, ob.chrom, ob.p) = (al.gene, al.chrom, al.p)),
qs AS (SELECT gene, chrom, p, sum(CASE WHEN r = 0 THEN ln(1 - pi) ELSE ln(pi) END) + ln(.6) AS l0, count(*) * ln(.5) + ln(.1) AS l1, sum(CASE WHEN r = 1 THEN ln(1 - pi) ELSE ln(pi) END) + ln(.3) AS l2 FROM cd WHERE r < 2 GROUP BY gene, chrom, p),
q1 AS (SELECT d1.*, round(exp(l1 - greatest(l0, l1, l2)) / (exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2))), 9) AS het FROM d1 JOIN qs ON (d1.gene, d1.chrom, d1.p) = (qs.gene, qs.chrom, qs.p)),
b1 AS (SELECT *, max(het) OVER (PARTITION BY gene) AS best FROM q1), t1 AS (SELECT gene, max(t) AS t FROM (SELECT DISTINCT gene, best FROM b1), (SELECT unnest([0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5]) AS t) WHERE t <= best GROUP BY gene),
h1 AS (SELECT b1.* FROM b1 JOIN t1 USING (gene) WHERE het >= t QUALIFY row_number() OVER (PARTITION BY gene ORDER BY het DESC, p) <= ceil({LIMIT.per_kilobase} * 120 / 1000)),
r1 AS (SELECT * FROM h1 WHERE NOT ({SQL_STRETCH}) OR alt_count >= {LIMIT.alt_stretch}), e1 AS (SELECT r1.* FROM r1 JOIN al ON (r1.gene, r1.chrom, r1.p) = (al.gene, al.chrom, al.p) WHERE NOT (r1.ref = 'A' AND al.base = 'G' AND r1.p % 2 = 0)),
c1 AS (SELECT *, coalesce(lead(p) OVER w - p <= {LIMIT.cluster_window}, false) OR coalesce(p - lag(p) OVER w <= {LIMIT.cluster_window}, false) AS near FROM e1 WINDOW w AS (PARTITION BY gene ORDER BY p)), k1 AS (SELECT * FROM c1 WHERE NOT near OR alt_count >= {LIMIT.alt_cluster}),
n1 AS (SELECT k1.* FROM k1 JOIN (SELECT DISTINCT gene, gs FROM gn) g USING (gene) WHERE NOT (p >= gs + 40 AND p < gs + 70))
SELECT step, gene AS "geneID", chrom, p AS pos FROM (SELECT 'depth' AS step, gene, chrom, p FROM d1 UNION ALL SELECT 'quality', gene, chrom, p FROM d1 UNION ALL SELECT 'het', gene, chrom, p FROM h1 UNION ALL SELECT 'stretch', gene, chrom, p FROM r1 UNION ALL SELECT 'editing', gene, chrom, p FROM e1 UNION ALL SELECT 'cluster', gene, chrom, p FROM k1 UNION ALL SELECT 'novel', gene, chrom, p FROM n1)""")
def filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sites each step of the chain leaves."""
    sites, seen = called(spark, sf_dir)
    sites, seen = written(sites), written(seen)
    regions = genes(spark, sf_dir)
    exons = regions.select("geneID", F.col("geneStart").alias("s"), (F.col("geneStart") + 120).alias("e"))
    novel = regions.select("geneID", (F.col("geneStart") + 40).alias("s"), (F.col("geneStart") + 70).alias("e"))
    edits = sites.where("ref = 'A' AND pos % 2 = 0").select("chrom", "pos", "ref", F.lit("G").alias("alt")).distinct()
    rounded = chain.chained_filters(sites, seen, exons, LIMIT, tiles=tiles(spark, sf_dir), tile=TILE, edits=edits, novel=novel)
    out = None
    for step, df in rounded.items():
        own = df.select(F.lit(step).alias("step"), "geneID", "chrom", "pos")
        out = own if out is None else out.unionByName(own)
    return out
