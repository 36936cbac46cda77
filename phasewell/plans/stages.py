"""Queries of the chained stages over the driver's tables, with their SQL twins.

Sub-exons of an isoform come from parts: brand is the gene, type the transcript, type and the first word of
the name the isoform; sizes give places, so that many events meet at a position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tests_of_fit
from ..operators import assembly, downstream, fit, observed, phasing, switching, validation
from ..sources import matrices
from ..sources.shared import written
from .catalog import SQL_BOUNDS, SQL_FIXED, codes, fixed, query, r6, scored_codes
from .proxies import SQL_BASES, SQL_WEIGHTS, bases, parts, table, weights

TRANSCRIPT = "^[A-Z]+"


def isoform() -> Column:
    return F.concat_ws(" ", "p_type", F.split("p_name", " ")[0])


def sub_exons(spark: SparkSession, sf_dir: str, gene: Column | None = None) -> DataFrame:
    start = F.col("p_size") * 30
    length = F.when(F.col("p_partkey") % 3 == 0, 30 * (1 + F.col("p_partkey") % 2)).otherwise(7 + F.col("p_partkey") % 11)
    return table(spark, sf_dir, "part").select((F.col("p_brand") if gene is None else gene).alias("geneID"), isoform().alias("Isoform"), start.cast("bigint").alias("s"), (start + length).cast("bigint").alias("e"))


def isoform_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping rows by the finer isoforms of this module."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), isoform().alias("Isoform"))
    return weights(spark, sf_dir).drop("Isoform").join(names, "pos")


SQL_EXONS = """ex AS (SELECT DISTINCT p_brand AS gene, p_type || ' ' || split_part(p_name, ' ', 1) AS iso, (p_size * 30)::BIGINT AS s, (p_size * 30 + CASE WHEN p_partkey % 3 = 0 THEN 30 * (1 + p_partkey % 2) ELSE 7 + p_partkey % 11 END)::BIGINT AS e FROM part),
ju AS (SELECT gene, iso, e AS s, lead(s) OVER (PARTITION BY gene, iso ORDER BY s, e) AS n FROM ex),
ev AS (SELECT gene, iso, 'exon' AS t, s, e FROM ex UNION SELECT gene, iso, 'junction', s, n FROM ju WHERE n IS NOT NULL),
ge AS (SELECT DISTINCT gene, t, s, e FROM ev WHERE t = 'exon' AND e - s >= 5 OR t = 'junction' AND s <> e)"""


@query(f"""WITH {SQL_EXONS}, st AS (SELECT gene, split_part(iso, ' ', 1) AS tr, iso, t, s, e FROM ev), n AS (SELECT gene, tr, count(DISTINCT iso) AS n FROM st WHERE t = 'exon' GROUP BY ALL),
r AS (SELECT *, max(e) OVER (PARTITION BY gene, tr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT DISTINCT gene, tr, s, e FROM st WHERE t = 'exon')),
i AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY gene, tr ORDER BY s, e) AS k FROM r),
a AS (SELECT gene, tr, t, s, e FROM st UNION SELECT gene, tr, 'merged', min(s), max(e) FROM i GROUP BY gene, tr, k)
SELECT gene AS "geneID", tr AS transcript, n AS n_isoforms, t AS event_type, s, e FROM a JOIN n USING (gene, tr)""")
def transcript_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2, A32, P24."""
    return switching.transcript_structures(switching.isoform_events(sub_exons(spark, sf_dir)), TRANSCRIPT)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = downstream.isoform_counts(weights(spark, sf_dir), ["geneID", "CellType"])
    return downstream.switching_pair(t.withColumn("transcript", switching.transcript_of(F.col("Isoform"), TRANSCRIPT)), ["geneID", "CellType"])


SQL_PAIRS = f"""{SQL_WEIGHTS}, {SQL_EXONS}, h AS (SELECT gene, ct, split_part(iso, ' ', 1) AS tr, sum(a) AS a, sum(b) AS b FROM w GROUP BY ALL), d AS (SELECT gene, ct, tr, round(b / sum(b) OVER g - a / sum(a) OVER g, 9) AS d FROM h WINDOW g AS (PARTITION BY gene, ct)),
pr AS (SELECT gene, ct, arg_min(tr, (d, tr)) AS dn, arg_max(tr, (d, tr)) AS up FROM d GROUP BY ALL HAVING arg_min(tr, (d, tr)) <> arg_max(tr, (d, tr)))"""
SQL_SHARED = f"""{SQL_PAIRS}, st AS (SELECT DISTINCT gene, split_part(iso, ' ', 1) AS tr, t, s, e FROM ev), sd AS (SELECT gene, ct, 'a' AS side, dn AS tr FROM pr UNION ALL SELECT gene, ct, 'b', up FROM pr), own AS (SELECT gene, ct, side, t, s, e FROM sd JOIN st USING (gene, tr)),
sh AS (SELECT gene, ct, t, s, e FROM own WHERE side = 'a' INTERSECT SELECT gene, ct, t, s, e FROM own WHERE side = 'b'), pl AS (SELECT *, s AS p FROM own UNION SELECT *, e AS p FROM own),
eb AS (SELECT gene, ct, p FROM pl WHERE t = 'exon' AND side = 'a' INTERSECT SELECT gene, ct, p FROM pl WHERE t = 'exon' AND side = 'b'),
k AS (SELECT DISTINCT gene, ct, p FROM (SELECT pl.gene, pl.ct, side, p, count(*) AS n, count(sh.t) AS nb FROM pl LEFT JOIN sh ON (pl.gene, pl.ct, pl.t, pl.s, pl.e) = (sh.gene, sh.ct, sh.t, sh.s, sh.e) GROUP BY ALL) WHERE (nb > 0 AND nb < n OR n = 1 AND nb = 0) AND (gene, ct, p) IN (SELECT gene, ct, p FROM eb)),
fr AS (SELECT gene, ct, t, s, e FROM pr JOIN ge USING (gene) EXCEPT SELECT gene, ct, t, s, e FROM sh)"""
SQL_REACHED = f"""{SQL_SHARED}, ed AS (SELECT gene, ct, s AS u, e AS v FROM fr UNION SELECT gene, ct, e, s FROM fr),
re AS (SELECT gene, ct, p FROM k UNION SELECT re.gene, re.ct, ed.v FROM re JOIN ed ON re.gene = ed.gene AND re.ct = ed.ct AND re.p = ed.u), bo AS (SELECT gene, ct, t, s, e FROM fr WHERE (gene, ct, s) IN (SELECT gene, ct, p FROM re))"""


@query(f'WITH {SQL_SHARED} SELECT gene AS "geneID", ct AS "CellType", p AS pos FROM k')
def switching_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: boundaries at which the two transcripts of a pair partly agree."""
    structures = switching.transcript_structures(switching.isoform_events(sub_exons(spark, sf_dir)), TRANSCRIPT)
    return switching.switching_boundaries(structures, pairs(spark, sf_dir).where("down <> up"), ["geneID", "CellType"])[0]


def boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = switching.isoform_events(sub_exons(spark, sf_dir))
    structures = switching.transcript_structures(events, TRANSCRIPT)
    return switching.boundary_events(structures, switching.gene_events(events), pairs(spark, sf_dir), ["geneID", "CellType"])


@query(f'WITH RECURSIVE {SQL_REACHED} SELECT gene AS "geneID", ct AS "CellType", t AS event_type, s, e FROM bo')
def switching_boundary_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on switching boundaries and all that touch them."""
    return boundary(spark, sf_dir)


SQL_TESTED = """i AS (SELECT gene, ct, p_type || ' ' || split_part(p_name, ' ', 1) AS iso, sum(a) AS a, sum(b) AS b FROM w JOIN part ON pos = p_partkey GROUP BY ALL), pv AS (SELECT i.gene, ct, t, s, e, sum(a) AS pa, sum(b) AS pb FROM i JOIN ev USING (gene, iso) WHERE (i.gene, t, s, e) IN (SELECT gene, t, s, e FROM ge) GROUP BY ALL), tt AS (SELECT gene, ct, sum(a) AS ta, sum(b) AS tb FROM i GROUP BY ALL),
x AS (SELECT gene, ct, t, s, e, round(pa, 6) AS pa, round(pb, 6) AS pb, round(ta - pa, 6) AS aa, round(tb - pb, 6) AS ab FROM pv JOIN tt USING (gene, ct)),
y AS (SELECT *, round(exp(-(pa + aa + pb + ab) * power(pa * ab - aa * pb, 2) / ((pa + aa) * (pb + ab) * (pa + pb) * (aa + ab)) / 2), 9) AS p FROM x WHERE round(pa + aa + pb + ab, 6) >= 10 AND least(pa, aa, pb, ab) >= 1),
z AS (SELECT *, row_number() OVER (PARTITION BY gene, ct ORDER BY p, t, s, e) AS rk, count(*) OVER (PARTITION BY gene, ct) AS m FROM y),
q AS (SELECT *, round(least(1.0, min(p * m / rk) OVER (PARTITION BY gene, ct ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 6) AS adj FROM z)"""


def tested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an even-tailed p of their 2 x 2 table, adjusted among the events of a gene."""
    w = isoform_weights(spark, sf_dir)
    events = switching.isoform_events(sub_exons(spark, sf_dir))
    events = events.join(switching.gene_events(events), ["geneID", *switching.EVENT], "left_semi")
    by = ["geneID", "CellType"]
    t = downstream.event_weights(downstream.isoform_counts(w, by), events, by)
    t = downstream.event_tests(t.withColumns({f"hap{h}_{x}": r6(f"hap{h}_{x}") for h in "AB" for x in ("present", "absent")}))
    t = t.withColumn("p", F.round(tests_of_fit.chi2_sf_even(F.col("chi2"), F.lit(2)), 9))
    return tests_of_fit.bh_fdr(t, "p", "p_value_adj", by, switching.EVENT).select(*by, *switching.EVENT, r6("p_value_adj").alias("p_value_adj"))


@query(f"""WITH RECURSIVE {SQL_REACHED}, {SQL_TESTED} SELECT mode, gene AS "geneID", ct AS "CellType", t AS event_type, s, e, adj AS p_value_adj FROM (
SELECT 'all_events' AS mode, * FROM q UNION ALL SELECT 'fdr_events', * FROM q WHERE adj <= 0.3 UNION ALL SELECT 'switching_events', * FROM q WHERE (gene, ct, t, s, e) IN (SELECT gene, ct, t, s, e FROM bo))""")
def event_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three selections of tested events."""
    events = tested_events(spark, sf_dir)
    kept = [switching.filter_events(events, m, 0.3, boundary(spark, sf_dir) if m == "switching_events" else None).withColumn("mode", F.lit(m)) for m in ("all_events", "fdr_events", "switching_events")]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


def maker() -> Column:
    """A coarser gene, of which a read has several blocks."""
    return F.concat(F.lit("M"), (F.col("p_partkey") % 5).cast("string"))


def read_blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(reads, blocks): an order is a read of each maker (its parts by number) that it has; each part gives a stretch that is aligned."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), maker().alias("maker"), "p_size"), "l_partkey")
    start = (F.col("p_size") * 30 - F.col("l_quantity").cast("bigint") % 30).cast("bigint")
    own = line.select(F.col("maker").alias("geneID"), F.col("l_orderkey").alias("Read"), start.alias("s"), (start + 40 + F.col("l_quantity").cast("bigint")).alias("e"), "l_discount")
    reads = own.groupBy("geneID", "Read").agg(F.round(F.max("l_discount") * 10 + 0.0, 6).alias("hat_I")).withColumn("hat_I_B", F.round(1 - F.col("hat_I"), 6))
    merged = downstream.merged_intervals(own, ["geneID", "Read"])
    blocks = merged.groupBy("geneID", "Read").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("blocks"))
    gaps = F.transform(F.sequence(F.lit(1), F.size("blocks") - 1), lambda i: F.struct(F.col("blocks")[i - 1]["e"].alias("s"), F.col("blocks")[i]["s"].alias("e")))
    return reads, blocks.withColumn("introns", F.when(F.size("blocks") > 1, gaps).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>")))


MAKER = "('M' || p_partkey % 5)"
SQL_READS = f"""{SQL_EXONS.replace('p_brand', MAKER)}, ow AS (SELECT {MAKER} AS gene, l_orderkey AS rd, (p_size * 30 - l_quantity::BIGINT % 30)::BIGINT AS s, (p_size * 30 - l_quantity::BIGINT % 30)::BIGINT + 40 + l_quantity::BIGINT AS e, l_discount FROM lineitem JOIN part ON l_partkey = p_partkey),
rw AS (SELECT gene, rd, round(max(l_discount) * 10 + 0.0, 6)::DOUBLE AS a FROM ow GROUP BY ALL), rb AS (SELECT *, max(e) OVER (PARTITION BY gene, rd ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT DISTINCT gene, rd, s, e FROM ow)),
bl AS (SELECT gene, rd, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY gene, rd ORDER BY s, e) AS k FROM rb) GROUP BY gene, rd, k),
bs AS (SELECT *, lead(s) OVER (PARTITION BY gene, rd ORDER BY s) AS nx, min(s) OVER (PARTITION BY gene, rd) AS lo, max(e) OVER (PARTITION BY gene, rd) AS hi FROM bl)"""


@query(f"""WITH {SQL_READS}, j AS (SELECT ge.gene, ge.t, ge.s, ge.e, bs.rd, any_value(lo) AS lo, any_value(hi) AS hi, sum(greatest(0, least(bs.e, ge.e) - greatest(bs.s, ge.s))) AS bp, sum(greatest(0, least(bs.e, ge.s) - greatest(bs.s, ge.s - 20))) AS lf, sum(greatest(0, least(bs.e, ge.e + 20) - greatest(bs.s, ge.e))) AS rf,
coalesce(bool_or(bs.e <= ge.s AND nx >= ge.e), false) AS sw, coalesce(bool_or(abs(bs.e - ge.s) <= 20 AND abs(nx - ge.e) <= 20), false) AS mt FROM ge JOIN bs USING (gene) GROUP BY ALL),
v AS (SELECT j.*, a, 1 - a AS b, CASE WHEN t = 'exon' THEN CASE WHEN bp >= greatest(1, least(20, floor((e - s) * 0.3))) THEN 'i' WHEN lo >= s OR hi <= e THEN 'u' WHEN sw THEN 's' ELSE 'u' END ELSE CASE WHEN lf < 20 OR rf < 20 THEN 'u' WHEN mt THEN 'i' ELSE 's' END END AS w FROM j JOIN rw USING (gene, rd))
SELECT gene AS "geneID", t AS event_type, s, e, {", ".join(f"round(coalesce(sum({c}) FILTER (w = '{x[0]}'), 0), 4) AS " + f'"obs_{h}_{x}"' for h, c in (("A", "a"), ("B", "b")) for x in ("include", "skip", "unobserved"))} FROM v GROUP BY gene, t, s, e""")
def observed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twin judges every read of a gene against every event."""
    reads, blocks = read_blocks(spark, sf_dir)
    events = switching.gene_events(switching.isoform_events(sub_exons(spark, sf_dir, maker())))
    out = observed.observed_events(reads, blocks, events, ["geneID"])
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c.startswith("obs_")})


def sql_sf_one(x: str) -> str:
    """Upper tail of chi-square with one degree of freedom: series and continued fraction of erfc."""
    z, down = f"sqrt(({x}) / 2)", "list_transform(range(80, 0, -1), lambda i: i::DOUBLE)"
    series = f"{z} * list_reduce(list_prepend(1.0::DOUBLE, {down}), lambda t, i: 1 + ({x}) / (2 * i + 1) * t)"
    fraction = f"list_reduce(list_prepend({z}::DOUBLE, {down}), lambda t, i: {z} + i / 2 / t)"
    return f"CASE WHEN ({x}) <= 0 THEN 1.0 WHEN {z} < 2.5 THEN 1 - 2 / sqrt(pi()) * exp(-({x}) / 2) * {series} ELSE exp(-({x}) / 2) / sqrt(pi()) / {fraction} END"


SQL_LOGLIK = "sum(greatest(l1 + ln({a}), l0 + ln(1 - {a})) + ln(exp(l1 + ln({a}) - greatest(l1 + ln({a}), l0 + ln(1 - {a}))) + exp(l0 + ln(1 - {a}) - greatest(l1 + ln({a}), l0 + ln(1 - {a})))))"


@query(f"""WITH {SQL_FIXED}, g AS (SELECT gene, {SQL_LOGLIK.format(a=0.4)} AS la, {SQL_LOGLIK.format(a=0.5)} AS ln FROM l GROUP BY gene), t AS (SELECT *, greatest(0.0, 2 * (la - ln)) AS x FROM g)
SELECT gene AS "geneID", round(la, 4) AS ll_alt, round(ln, 4) AS ll_null, round(x, 4) AS lrt_stat, round({sql_sf_one("x")}, 6) AS p_value FROM t""")
def fixed_sites_lrt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood ratio of two shares of haplotype A for given sites, with its p."""
    c, s = fixed(spark, sf_dir)
    obs, genes = fit.observations(c, ["geneID"]), c.select("geneID").distinct()
    at = lambda a: fit.loglik(obs, s, genes, ["geneID"], F.lit(a))
    out = fit.likelihood_ratio(at(0.4), at(0.5), ["geneID"])
    return out.select("geneID", *[F.round(x, 4).alias(x) for x in ("ll_alt", "ll_null", "lrt_stat")], r6("p_value").alias("p_value"))


@query()
def em_fit_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All genes fitted by aggregations, with the test of even shares; no SQL twin for its rounds."""
    return fit.fit_bulk(scored_codes(spark, sf_dir), ["geneID"])[2]


@query()
def em_fit_cell_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares by cell type for sites frozen from the one-task fit of each gene; no SQL twin for its rounds."""
    c = written(scored_codes(spark, sf_dir))
    _, sites = phasing.phase_genes(c, ["geneID"])
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("CellType"))
    reads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("Read"), "o_custkey").join(cells, "o_custkey").select("Read", "CellType")
    return fit.fit_cell_types(c.join(reads, "Read"), sites, ["geneID"])[1]


def raw_links(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """Variants at sizes of parts, with the events of the gene that begin there or one size on."""
    sites = parts(spark, sf_dir).select("geneID", "size").distinct()
    near = sites.withColumn("_k", F.explode(F.array(F.col("size"), F.col("size") + 1)))
    own = switching.gene_events(events).withColumn("_k", F.floor(F.col("s") / 30))
    pos = (F.col("size") * 30 + 3).cast("bigint")
    alt = F.when(F.col("size") % 11 != 0, "G")
    return near.join(own, ["geneID", "_k"]).select("geneID", *switching.EVENT, F.lit("c").alias("chrom"), pos.alias("snv_pos"), F.lit("A").alias("snv_ref"), alt.alias("snv_alt"))


@query(f"""WITH {SQL_BASES}, {SQL_WEIGHTS}, {SQL_EXONS}, al AS (SELECT gene, p_size * 30 + 3 AS pos, rd, arg_max(CASE base WHEN 'N' THEN 'A' WHEN 'A' THEN 'G' ELSE 'T' END, (nth, CASE base WHEN 'N' THEN 'A' WHEN 'A' THEN 'G' ELSE 'T' END)) AS al FROM bases JOIN part ON pos = p_partkey GROUP BY ALL),
ri AS (SELECT DISTINCT gene, rd, p_type || ' ' || split_part(p_name, ' ', 1) AS iso FROM w JOIN part ON pos = p_partkey), st AS (SELECT DISTINCT p_brand AS gene, p_size AS k FROM part),
pr AS (SELECT gene, t, s, e, k * 30 + 3 AS pos, t = 'exon' AND k * 30 + 3 BETWEEN s AND e AS intra FROM st JOIN ge USING (gene) WHERE s // 30 IN (k, k + 1) AND k % 11 <> 0),
nl AS (SELECT gene, t, s, e, k * 30 + 3 AS pos FROM st JOIN ge USING (gene) WHERE s // 30 IN (k, k + 1) AND k % 11 = 0),
m AS (SELECT pr.gene, pr.t, pr.s, pr.e, pr.pos, al.rd, al, bool_and(ev.iso IS NOT NULL) AS ya, bool_or(ev.iso IS NOT NULL) AS yo FROM pr JOIN al USING (gene, pos) JOIN ri USING (gene, rd) LEFT JOIN ev ON (ev.gene, ev.iso, ev.t, ev.s, ev.e) = (pr.gene, ri.iso, pr.t, pr.s, pr.e) WHERE NOT intra GROUP BY ALL),
n AS (SELECT gene, t, s, e, pos, count(*) FILTER (al = 'A' AND ya) AS rp, count(*) FILTER (al = 'A' AND NOT ya) AS ra, count(*) FILTER (al = 'G' AND ya) AS ap, count(*) FILTER (al = 'G' AND NOT ya) AS aa FROM m WHERE ya = yo GROUP BY ALL
UNION ALL SELECT gene, t, s, e, pos, count(*) FILTER (al = 'A'), 0, count(*) FILTER (al = 'G'), 0 FROM pr JOIN al USING (gene, pos) WHERE intra GROUP BY ALL),
f AS (SELECT gene, t, s, e, pos, intra, coalesce(rp, 0) AS rp, coalesce(ra, 0) AS ra, coalesce(ap, 0) AS ap, coalesce(aa, 0) AS aa FROM pr LEFT JOIN n USING (gene, t, s, e, pos)),
x AS (SELECT *, CASE WHEN NOT intra AND rp + ra + ap + aa >= 10 THEN (rp + ra + ap + aa) * power(rp::DOUBLE * aa - ra::DOUBLE * ap, 2) / nullif((rp + ra)::DOUBLE * (ap + aa) * (rp + ap) * (ra + aa), 0) END AS x2 FROM f),
p AS (SELECT *, CASE WHEN intra THEN CASE WHEN rp + ap >= 10 THEN least(1.0, 2 * list_sum(list_transform(range(0, least(rp, ap) + 1), lambda i: exp(lgamma(rp + ap + 1) - lgamma(i + 1) - lgamma(rp + ap - i + 1) - (rp + ap) * ln(2.0))))) END WHEN x2 IS NOT NULL THEN {sql_sf_one("x2")} END AS p FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY p, t, s, e, pos) AS rk, count(*) OVER (PARTITION BY gene) AS cn FROM p WHERE p IS NOT NULL),
b AS (SELECT gene, t, s, e, pos, least(1.0, min(p * cn / rk) OVER (PARTITION BY gene ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS adj FROM r)
SELECT p.gene AS "geneID", p.t AS event_type, p.s, p.e, p.pos AS snv_pos, 'G' AS snv_alt, rp AS raw_ref_present, ra AS raw_ref_absent, ap AS raw_alt_present, aa AS raw_alt_absent, round(x2, 4) AS raw_chi2, round(p, 6) AS raw_p_value, CASE WHEN intra THEN 'binomial_intra_event' ELSE 'chi2_cross_event' END AS raw_test_type, round(adj, 6) AS raw_p_value_adj
FROM p LEFT JOIN b ON (p.gene, p.t, p.s, p.e, p.pos) = (b.gene, b.t, b.s, b.e, b.pos) UNION ALL SELECT gene, t, s, e, pos, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nl""")
def raw_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants near events on raw reads, exact inside an exon."""
    events = switching.isoform_events(sub_exons(spark, sf_dir))
    sizes = parts(spark, sf_dir).select("pos", F.col("size"))
    acgt = F.when(F.col("base") == "N", "A").when(F.col("base") == "A", "G").otherwise("T")
    seen = bases(spark, sf_dir).join(sizes, "pos").select("geneID", F.lit("c").alias("chrom"), (F.col("size") * 30 + 3).cast("bigint").alias("pos"), "Read", acgt.alias("base"), "nth")
    isoforms = isoform_weights(spark, sf_dir).select("geneID", "Read", "Isoform").distinct()
    out = validation.raw_validation(raw_links(spark, sf_dir, events), validation.read_alleles(seen, ["nth", "base"]), isoforms, events)
    return out.drop("chrom", "snv_ref").withColumns({"raw_chi2": F.round("raw_chi2", 4), "raw_p_value": r6("raw_p_value"), "raw_p_value_adj": r6("raw_p_value_adj")})


def event_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(events, pairs, raw, gene_snv) with values that follow from sizes and places; some variants have no base, no test or no context."""
    found = switching.isoform_events(sub_exons(spark, sf_dir))
    renamed = {"s": "event_start", "e": "event_end"}
    s, e, k = F.col("event_start"), F.col("event_end"), F.col("k")
    events = switching.gene_events(found).withColumnsRenamed(renamed).withColumns({"geneName": F.lower("geneID"), "geneChr": F.when(e % 13 != 0, "c"), "hapA_present": (s % 7).cast("double"), "hapA_absent": (e % 5).cast("double"), "hapB_present": (e % 7).cast("double"), "hapB_absent": (s % 5).cast("double"), "chi2": (s % 11).cast("double"), "p_value": 1.0 / (1 + s % 11), "p_value_adj": F.lit(1.0)})
    links = raw_links(spark, sf_dir, found).withColumnsRenamed(renamed).withColumn("k", F.floor(F.col("snv_pos") / 30))
    pairs = links.withColumns({"snv_hap": F.when(k % 2 == 0, "A").otherwise("B"), "h_A": k / 50.0, "hat_Z_prob_revised": 1 - k / 60.0, "exonic_distance": F.abs(F.col("snv_pos") - s), "genomic_distance": F.abs(F.col("snv_pos") - e)})
    raw = links.where("k % 3 <> 0").withColumns({"raw_ref_present": k, "raw_ref_absent": F.when(k % 5 != 0, k + 1), "raw_alt_present": k * 2, "raw_alt_absent": F.lit(3).cast("bigint"), "raw_p_value": 1.0 / k, "raw_test_type": F.lit("t")})
    n = F.substring("geneID", 7, 3).cast("bigint")
    gene_snv = parts(spark, sf_dir).select("geneID", F.col("size").cast("bigint").alias("k")).distinct().where(n % 6 != 0).withColumns({"snv_pos": k * 30 + 3, "snv_ref": F.lit("A"), "snv_alt": F.when(k % 11 != 0, "G"), "n_reads": n * 10, "gene_major_hap": F.when(n % 2 == 0, "A").otherwise("B"), "es_ase": n / 8.0, "snvID": F.when(k % 4 == 0, F.concat(F.lit("id"), k.cast("string"))), "snv_expr_direction": F.when(k % 2 == 0, "+").otherwise("-")})
    return events, pairs, raw, gene_snv


@query(f"""WITH {SQL_EXONS}, st AS (SELECT DISTINCT p_brand AS gene, p_size::BIGINT AS k FROM part), li AS (SELECT gene, t, s, e, k, k * 30 + 3 AS pos, CASE WHEN k % 11 <> 0 THEN 'G' END AS alt FROM st JOIN ge USING (gene) WHERE s // 30 IN (k, k + 1)),
gx AS (SELECT gene, n * 10 AS n_reads, CASE WHEN n % 2 = 0 THEN 'A' ELSE 'B' END AS mh, n / 8.0 AS ase FROM (SELECT DISTINCT gene, substr(gene, 7)::BIGINT AS n FROM st) WHERE n % 6 <> 0),
x AS (SELECT ge.*, li.k, pos, alt, CASE WHEN pos IS NOT NULL THEN 'A' END AS rf, round_even(CASE WHEN s % 7 + e % 5 > 0 THEN (s % 7) / (s % 7 + e % 5) END, 4) AS fa, round_even(CASE WHEN e % 7 + s % 5 > 0 THEN (e % 7) / (e % 7 + s % 5) END, 4) AS fb, CASE WHEN e % 13 <> 0 THEN 'c' END AS chr FROM ge LEFT JOIN li USING (gene, t, s, e)),
y AS (SELECT x.*, gx.n_reads, mh, ase, CASE WHEN fa > fb THEN 'A' WHEN fa <= fb THEN 'B' END AS pf, CASE WHEN k % 2 = 0 THEN 'A' WHEN k % 2 = 1 THEN 'B' END AS hp, coalesce(k % 3 <> 0, false) AS rw, gx.gene IS NOT NULL AS cx FROM x LEFT JOIN gx USING (gene))
SELECT gene AS "geneID", lower(gene) AS "geneName", t || ':' || s || '-' || e AS "eventID", e - s AS event_length, n_reads, mh AS gene_major_hap, round(ase, 6) AS es_ase, round(fa, 4) AS event_inclusion_frac_A, round(fb, 4) AS event_inclusion_frac_B, pf AS event_pref_hap, CASE WHEN pf = mh THEN 'major' WHEN pf <> mh THEN 'minor' END AS event_pref_major_minor,
(s % 11)::DOUBLE AS event_chi2, count(pos) OVER (PARTITION BY gene, t, s, e) AS linked_snv_count, pos IS NOT NULL AND row_number() OVER (PARTITION BY gene, t, s, e, pos IS NULL ORDER BY abs(pos - s), abs(pos - e), pos) = 1 AS is_nearest_snv_for_event,
CASE WHEN pos IS NULL THEN NULL WHEN cx AND k % 4 = 0 THEN 'id' || k ELSE chr || ':' || pos || ':A:' || alt END AS "snvID", pos AS snv_pos, alt AS snv_alt, CASE WHEN pos IS NOT NULL AND cx THEN CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END END AS snv_expr_direction, CASE WHEN hp = pf THEN 'promotes_event' WHEN hp <> pf THEN 'reduces_event' END AS snv_event_direction,
rw AS raw_validation_available, CASE WHEN rw THEN k * 3 + 3 + CASE WHEN k % 5 <> 0 THEN k + 1 ELSE 0 END END AS raw_total_reads, CASE WHEN rw THEN 't' END AS raw_test_type FROM y""")
def event_snv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with variants, tests and context; missing alternatives meet missing ones."""
    out = assembly.event_snv(*event_parts(spark, sf_dir), "s", "Bulk")
    kept = ["geneID", "geneName", "eventID", "event_length", "n_reads", "gene_major_hap", "event_inclusion_frac_A", "event_inclusion_frac_B", "event_pref_hap", "event_pref_major_minor", "event_chi2", "linked_snv_count", "is_nearest_snv_for_event", "snvID", "snv_pos", "snv_alt", "snv_expr_direction", "snv_event_direction", "raw_validation_available", "raw_total_reads", "raw_test_type"]
    return out.select(*kept, r6("es_ase").alias("es_ase"))


@query(f"""WITH {SQL_WEIGHTS}, l AS (SELECT gene, cell, iso, ph, unnest([{{'h': 'hapA', 'v': a}}, {{'h': 'hapB', 'v': b}}], recursive := true) FROM w),
r AS (SELECT 'gene' AS tag, cell, gene || '_' || h AS f, v FROM l UNION ALL SELECT 'transcript', cell, gene || '_' || iso || '_' || h, v FROM l UNION ALL SELECT 'gene_phasable', cell, gene || '_' || h, v FROM l WHERE ph = 1 UNION ALL SELECT 'transcript_phasable', cell, gene || '_' || iso || '_' || h, v FROM l WHERE ph = 1),
t AS (SELECT tag, cell, f, round(sum(v), 6) AS v FROM r GROUP BY ALL HAVING round(sum(v), 6) <> 0)
SELECT tag, cell AS "Cell", f AS feature, dense_rank() OVER (PARTITION BY tag ORDER BY cell) AS i, dense_rank() OVER (PARTITION BY tag ORDER BY f) AS j, v AS value FROM t""")
def count_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the four count matrices with their dense numbers."""
    counts = downstream.isoform_counts(weights(spark, sf_dir), ["geneID", "Cell"]).withColumnRenamed("geneID", "geneName")
    counts = counts.withColumns({c: r6(c) for c in ("hapA", "hapB", "hapA_phasable", "hapB_phasable")})
    triples = written(matrices.count_triples(counts).withColumn("value", r6("value")).where("value <> 0"))
    out = None
    for tag in matrices.TAGS:
        own = triples.where(F.col("tag") == tag)
        named = own.join(matrices.numbered(own, "Cell", "i"), "Cell").join(matrices.numbered(own, "feature", "j"), "feature")
        out = named if out is None else out.unionByName(named)
    return out.select("tag", "Cell", "feature", "i", "j", "value")


@query(f"""WITH {SQL_BOUNDS}, ef AS (SELECT gene, n, np, major, round((l + h) / 2, 6) AS es, substr(gene, 7)::BIGINT AS g FROM al WHERE ct = 'Bulk' AND substr(gene, 7)::BIGINT % 4 <> 0),
v AS (SELECT p_brand AS gene, p_partkey AS pos, CASE WHEN p_partkey % 6 <> 0 THEN 'G' END AS alt, p_size AS depth, CASE WHEN p_partkey % 10 <> 0 THEN (p_partkey % 21) / 20.0 END AS h FROM part),
x AS (SELECT v.*, n, np, major, es, CASE g % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS pf, CASE WHEN g % 5 <> 0 THEN g / 10.0 END AS et, CASE WHEN h > .5 THEN 'A' ELSE 'B' END AS hp FROM v LEFT JOIN ef USING (gene))
SELECT gene AS "geneID", 'c:' || pos || ':A:' || alt AS "snvID", pos AS snv_pos, alt AS snv_alt, depth AS snv_depth_bulk, n AS n_reads, np AS n_reads_phasable, major AS gene_major_hap, hp AS snv_hap, hp <> major AS snv_on_minor_hap, CASE WHEN hp = major THEN '+' WHEN hp <> major THEN '-' END AS snv_expr_direction,
round(CASE WHEN hp = major THEN es WHEN hp <> major THEN -es END, 6) AS snv_es_ase_signed, pf AS dominant_isoform_pref_hap, CASE WHEN hp = pf THEN '+' WHEN hp <> pf THEN '-' END AS snv_astu_direction, round(CASE WHEN hp = pf THEN et WHEN hp <> pf THEN -et END, 6) AS snv_es_astu_signed FROM x""")
def gene_snv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants with the effects of their gene, signed by the allele's haplotype."""
    p, g = table(spark, sf_dir, "part"), F.substring("geneID", 7, 3).cast("bigint")
    b = downstream.allelic_bounds(downstream.with_bulk(weights(spark, sf_dir)), ["geneID", "CellType"]).where("CellType = 'Bulk'").where(g % 4 != 0)
    effects = b.select("geneID", "n_reads", "n_reads_phasable", F.col("major_hap").alias("gene_major_hap"), r6((F.col("alpha_hat_low") + F.col("alpha_hat_high")) / 2).alias("es_ase"), F.when(g % 3 == 0, "A").when(g % 3 == 1, "B").alias("dominant_isoform_pref_hap"), F.when(g % 5 != 0, g / 10.0).alias("es_astu"))
    k = F.col("p_partkey")
    variants = p.select(F.col("p_brand").alias("geneID"), F.lit("c").alias("chrom"), k.alias("pos"), F.lit("A").alias("ref"), F.when(k % 6 != 0, "G").alias("alt"), F.col("p_size").alias("depth"), F.when(k % 10 != 0, (k % 21) / 20.0).alias("h_A"))
    out = assembly.gene_snv(variants, effects, "s", "Bulk")
    return out.select("geneID", "snvID", "snv_pos", "snv_alt", "snv_depth_bulk", "n_reads", "n_reads_phasable", "gene_major_hap", "snv_hap", "snv_on_minor_hap", "snv_expr_direction", r6("snv_es_ase_signed").alias("snv_es_ase_signed"), "dominant_isoform_pref_hap", "snv_astu_direction", r6("snv_es_astu_signed").alias("snv_es_astu_signed"))
