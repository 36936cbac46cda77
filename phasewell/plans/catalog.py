"""The queries over the driver's tables, with their SQL twins.

Each query calls the library's operators on tables in proxy roles (``proxies``); doubles are rounded
to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import alleles, tests_of_fit
from ..operators import downstream, phasing, pileup
from .proxies import SQL_BASES, SQL_WEIGHTS, bases, parts, table, weights

FLAGSHIP = "balance_fdr"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


SQL_COUNTS = f"{SQL_BASES}, c AS (SELECT gene, pos, count(*) FILTER (base = 'N') AS ref_count, count(*) FILTER (base <> 'N') AS alt_count, count(*) AS depth FROM bases GROUP BY gene, pos HAVING count(*) FILTER (base <> 'N') > 0)"


def het_sql(e: float, het: float, ref: float, alt: float, d: str = "depth", n: str = "alt_count") -> str:
    a, b, c = f"ln({het!r}) + {d} * ln(0.5)", f"ln({ref!r}) + ({d} - {n}) * ln({1 - e!r}) + {n} * ln({e!r})", f"ln({alt!r}) + ({d} - {n}) * ln({e!r}) + {n} * ln({1 - e!r})"
    return f"1 / (1 + exp(({b}) - ({a})) + exp(({c}) - ({a})))"


def site_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.pileup_counts(bases(spark, sf_dir), ["geneID", "pos"])


@query(f"WITH {SQL_COUNTS} SELECT gene AS \"geneID\", pos, ref_count, alt_count, depth, round(alt_count / depth, 6) AS alt_frac FROM c WHERE depth >= 20 AND alt_count > 10")
def pileup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, F1, F2."""
    c = pileup.candidates(site_counts(spark, sf_dir), het=-1)
    return c.select("geneID", "pos", "ref_count", "alt_count", "depth", r6("alt_frac").alias("alt_frac"))


@query(f"WITH {SQL_COUNTS} SELECT gene AS \"geneID\", pos, round({het_sql(0.01, 0.6, 0.1, 0.3)}, 6) AS het_prob FROM c WHERE depth >= 20 AND alt_count > 5 AND {het_sql(0.01, 0.6, 0.1, 0.3)} >= 0.4 * 0.8 / 0.99")
def het_posterior_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6, F3, F4."""
    return pileup.candidates(site_counts(spark, sf_dir), alt=5, het=0.4).select("geneID", "pos", r6("het_prob").alias("het_prob"))


@query(f"""WITH {SQL_COUNTS}, x AS (SELECT *, (ref_count - alt_count) * (ref_count - alt_count) / depth AS chi2 FROM c WHERE depth >= 20 AND alt_count > 5),
r AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY exp(-chi2 / 2), pos) AS rk, count(*) OVER (PARTITION BY gene) AS m FROM x)
SELECT gene AS "geneID", pos, depth, round({het_sql(0.01, 0.6, 0.1, 0.3)}, 6) AS het_prob, round(chi2, 6) AS chi2,
round(least(1.0, min(exp(-chi2 / 2) * m / rk) OVER (PARTITION BY gene ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 6) AS p_adjusted FROM r""")
def balance_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: A1, F2, P6, M12's statistic with an even tail, W1."""
    c = pileup.candidates(site_counts(spark, sf_dir), alt=5, het=-1)
    d = F.col("ref_count") - F.col("alt_count")
    x = c.withColumn("chi2", d * d / F.col("depth")).withColumn("p", tests_of_fit.chi2_sf_even(F.col("chi2"), F.lit(2)))
    out = tests_of_fit.bh_fdr(x, "p", "p_adjusted", ["geneID"], ["pos"])
    return out.select("geneID", "pos", "depth", r6("het_prob").alias("het_prob"), r6("chi2").alias("chi2"), r6("p_adjusted").alias("p_adjusted"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EM input; of a read's rows with the same line number at a site the first in the table counts."""
    b = bases(spark, sf_dir)
    return pileup.em_input(b, pileup.alt_vote(b, ["geneID", "pos"]), ["geneID", "pos"], [c for c in ("nth", "file", "row") if c in b.columns])


SQL_VOTE = f"{SQL_BASES}, v AS (SELECT gene, pos, base, count(*) AS votes, avg(power(10.0, -q / 10)) AS err FROM bases WHERE base <> 'N' GROUP BY ALL), a AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY gene, pos ORDER BY votes DESC, err, base) = 1)"
SQL_CODES = f"{SQL_VOTE}, o AS (SELECT * FROM bases QUALIFY row_number() OVER (PARTITION BY gene, pos, rd ORDER BY nth) = 1), e AS (SELECT gene, pos, rd, CASE WHEN o.base = 'N' THEN 0 WHEN o.base = a.base THEN 1 ELSE 2 END AS r, least(1.0, power(10.0, -q / 10)) AS pi FROM o JOIN a USING (gene, pos))"


@query(f'WITH {SQL_VOTE} SELECT gene AS "geneID", pos, base AS alt, votes, round(err, 6) AS mean_error FROM a')
def alt_vote_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6, A7."""
    return pileup.alt_vote(bases(spark, sf_dir), ["geneID", "pos"]).select("geneID", "pos", "alt", "votes", r6("mean_error").alias("mean_error"))


@query(f'WITH {SQL_CODES} SELECT gene AS "geneID", pos, rd AS "Read", r::INTEGER AS r, round(pi, 6) AS pi FROM e')
def em_input_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8, P5, M1."""
    return codes(spark, sf_dir).select("geneID", "pos", "Read", F.col("r").cast("int").alias("r"), r6("pi").alias("pi"))


@query(f"""WITH {SQL_CODES}, s AS (SELECT gene, pos, sum(CASE WHEN r = 0 THEN ln(1 - least(.5, greatest(.001, pi))) ELSE ln(least(.5, greatest(.001, pi))) END) + ln(.6) AS l0, count(*) * ln(.5) + ln(.1) AS l1,
sum(CASE WHEN r = 1 THEN ln(1 - least(.5, greatest(.001, pi))) ELSE ln(least(.5, greatest(.001, pi))) END) + ln(.3) AS l2 FROM e WHERE r < 2 GROUP BY gene, pos)
SELECT gene AS "geneID", pos, round(exp(l1 - greatest(l0, l1, l2)) / (exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2))), 6) AS het_prob FROM s""")
def per_read_bq_het(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9."""
    return phasing.quality_het_posterior(codes(spark, sf_dir), ["geneID", "pos"]).select("geneID", "pos", r6("het_prob").alias("het_prob"))


@query(f"""WITH {SQL_CODES}, n AS (SELECT gene, count(DISTINCT rd) AS nr FROM e GROUP BY gene), k AS (SELECT *, least(1 - 1e-12, greatest(1e-12, pi)) AS x FROM e WHERE r < 2),
s AS (SELECT gene, pos, count(*) AS d, sum(CASE WHEN r = 0 THEN ln(1 - x) ELSE ln(x) END) AS a0, sum(CASE WHEN r = 1 THEN ln(1 - x) ELSE ln(x) END) AS a2 FROM k GROUP BY gene, pos),
t AS (SELECT gene, pos, f * a0 + ln(.4) AS l0, f * d * ln(.5) + ln(.2) AS l1, f * a2 + ln(.4) AS l2 FROM (SELECT s.*, least(1.0, greatest(1e-4, d / nr)) AS f FROM s JOIN n USING (gene)))
SELECT gene AS "geneID", pos, round(exp(l1 - greatest(l0, l1, l2)) / (exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2))), 6) AS p_het FROM t""")
def p_het_coverage_shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    return phasing.coverage_het_posterior(codes(spark, sf_dir), ["geneID", "pos"], ["geneID"]).select("geneID", "pos", r6("p_het").alias("p_het"))


@query(f"""WITH {SQL_CODES} SELECT gene AS "geneID", count(*) AS seen, count(DISTINCT rd) AS n_reads, count(DISTINCT pos) AS n_snvs, round(1 - count(*) / (count(DISTINCT rd) * count(DISTINCT pos)), 6) AS gamma FROM e GROUP BY gene""")
def missing_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    c = codes(spark, sf_dir).withColumnRenamed("pos", "snv_id")
    return phasing.missing_share(c, ["geneID"]).withColumn("gamma", r6("gamma"))


@query(f"""WITH {SQL_BASES}, g AS (SELECT bases.*, n_regionkey AS sample FROM bases JOIN orders ON rd = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
c AS (SELECT sample, gene, pos, count(*) AS depth, count(*) FILTER (base <> 'N') AS alt_count FROM g GROUP BY ALL HAVING count(*) >= 5 AND count(*) FILTER (base <> 'N') > 2),
j AS (SELECT gene, pos, sum(depth)::BIGINT AS depth, sum(alt_count)::BIGINT AS alt_count FROM c GROUP BY gene, pos)
SELECT gene AS "geneID", pos, depth, alt_count, round(alt_count / depth, 6) AS alt_frac, round({het_sql(0.01, 0.6, 0.1, 0.3)}, 6) AS het_prob FROM j""")
def joint_sample_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: each sample is thresholded before the sum."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("Read"), "o_custkey")
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    sample = orders.join(cust, "o_custkey").join(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("sample")), "n_nationkey")
    per = pileup.candidates(pileup.pileup_counts(bases(spark, sf_dir).join(sample, "Read"), ["sample", "geneID", "pos"]), 5, 2, -1)
    return pileup.joint_sites(per, ["geneID", "pos"]).select("geneID", "pos", "depth", "alt_count", r6("alt_frac").alias("alt_frac"), r6("het_prob").alias("het_prob"))


SQL_SITES = f"{SQL_COUNTS}, s AS (SELECT *, {het_sql(0.01, 0.6, 0.1, 0.3)} AS het FROM c WHERE depth >= 20 AND alt_count > 10)"


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.candidates(site_counts(spark, sf_dir), het=-1)


@query(f"""WITH {SQL_SITES}, m AS (SELECT *, coalesce(lead(pos, 2) OVER (PARTITION BY gene ORDER BY pos) - pos <= 150, false) AS st FROM s),
f AS (SELECT *, max(st::INT) OVER (PARTITION BY gene ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS inn FROM m) SELECT gene AS "geneID", pos FROM f WHERE inn = 0 OR alt_count >= 25""")
def variant_cluster_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8, W6."""
    return pileup.variant_clusters(sites(spark, sf_dir), ["geneID"], 3, 150, 25).select("geneID", "pos")


@query(f"""WITH {SQL_SITES}, b AS (SELECT *, max(het) OVER (PARTITION BY gene) AS best FROM s), l AS (SELECT b.*, t.t FROM b JOIN (SELECT gene, max(t) AS t FROM (SELECT DISTINCT gene, best FROM b), (SELECT unnest([0.99, 0.94, 0.89, 0.84, 0.79, 0.74, 0.69, 0.64, 0.59, 0.54]) AS t) WHERE t <= best GROUP BY gene) t USING (gene))
SELECT gene AS "geneID", pos, round(het, 6) AS het_prob FROM l WHERE het >= t QUALIFY row_number() OVER (PARTITION BY gene ORDER BY het DESC, pos) <= 7""")
def het_fallback_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5, W7."""
    return pileup.het_fallback(sites(spark, sf_dir).withColumn("most", F.lit(7)), ["geneID"], "most").select("geneID", "pos", r6("het_prob").alias("het_prob"))


@query(f"""WITH {SQL_SITES}, r AS (SELECT *, count(*) OVER g AS n, count(*) FILTER (alt_frac < .6) OVER g AS l, row_number() OVER (PARTITION BY gene ORDER BY alt_frac, pos) AS rk FROM (SELECT *, round(alt_count / depth, 6) AS alt_frac FROM s) WINDOW g AS (PARTITION BY gene))
SELECT gene AS "geneID", pos, alt_frac FROM r WHERE rk > least(n, greatest(0, ceil((l - .25 * n) / .75)))""")
def pruning_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13."""
    return pileup.prune_by_score(sites(spark, sf_dir).withColumn("score", r6("alt_frac")), ["geneID"], low=0.6, share=0.25).select("geneID", "pos", F.col("score").alias("alt_frac"))


@query(f"WITH {SQL_SITES} SELECT gene AS \"geneID\", pos FROM s WHERE pos NOT IN (SELECT s_suppkey FROM supplier)")
def editing_site_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7, J12."""
    known = table(spark, sf_dir, "supplier").select(F.lit("c").alias("chrom"), F.col("s_suppkey").alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt"))
    s = sites(spark, sf_dir).withColumns({"chrom": F.lit("c"), "ref": F.lit("A"), "alt": F.lit("G")})
    return pileup.editing_sites(s, known).select("geneID", "pos")


@query("""WITH x AS (SELECT p_brand AS gene, p_partkey AS s, p_partkey + p_size AS e FROM part) SELECT a.gene AS "geneID", a.s AS s, sum(greatest(0, least(a.e, b.e) - greatest(a.s, b.s)))::BIGINT AS bp FROM x a JOIN x b ON a.gene = b.gene GROUP BY ALL""")
def range_overlap_bp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4, J7."""
    x = parts(spark, sf_dir).select("geneID", F.col("pos").alias("s"), (F.col("pos") + F.col("size")).alias("e"))
    return downstream.overlap_sums(x, x, ["geneID"]).select("geneID", "s", "bp")


@query("""WITH x AS (SELECT DISTINCT p_brand AS gene, p_partkey AS s, p_partkey + p_size AS e FROM part WHERE p_size > 0), r AS (SELECT *, max(e) OVER (PARTITION BY gene ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM x),
i AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m + 10 THEN 1 ELSE 0 END) OVER (PARTITION BY gene ORDER BY s, e) AS k FROM r) SELECT gene AS "geneID", min(s) AS s, max(e) AS e FROM i GROUP BY gene, k""")
def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P24."""
    x = parts(spark, sf_dir).select("geneID", F.col("pos").alias("s"), (F.col("pos") + F.col("size")).alias("e"))
    return downstream.merged_intervals(x, ["geneID"], 10)


@query("""WITH x AS (SELECT DISTINCT p_brand AS gene, p_type AS iso, p_partkey AS s, p_partkey + p_size AS e FROM part), l AS (SELECT *, lead(s) OVER (PARTITION BY gene, iso ORDER BY s, e) AS acc FROM x) SELECT gene AS "geneID", iso AS "Isoform", e AS donor, acc AS acceptor FROM l WHERE acc > e""")
def adjacent_pairs_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A31, A32."""
    x = parts(spark, sf_dir).select("geneID", "Isoform", F.col("pos").alias("s"), (F.col("pos") + F.col("size")).alias("e"))
    return downstream.junctions(x, ["geneID", "Isoform"])


@query("""WITH e AS (SELECT p_brand AS gene, p_partkey AS s, p_partkey + p_size AS e FROM part), r AS (SELECT * FROM e WHERE (e - s) % 3 <> 0), n AS (SELECT * FROM e EXCEPT SELECT * FROM r),
g AS (SELECT gene, max(e) - min(s) AS span FROM e GROUP BY gene), t AS (SELECT g.gene, span - coalesce((SELECT sum(e - s) FROM r WHERE r.gene = g.gene), 0) AS intron, (SELECT sum(e - s) FROM n WHERE n.gene = g.gene) AS novel FROM g),
k AS (SELECT gene FROM t WHERE intron > 0 AND novel / intron > .25) SELECT gene AS "geneID", s, e FROM n WHERE gene IN (SELECT gene FROM k)""")
def novel_interval_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9, A30, U3."""
    e = parts(spark, sf_dir).select("geneID", F.col("pos").alias("s"), (F.col("pos") + F.col("size")).alias("e"))
    genes = e.groupBy("geneID").agg(F.min("s").alias("geneStart"), F.max("e").alias("geneEnd"))
    return pileup.novel_intervals(e, e.where("(e - s) % 3 <> 0"), genes)


SQL_FIXED = f"""{SQL_CODES}, f AS (SELECT e.*, (pos % 7) / 6.0 AS h, 0.5 + (pos % 5) / 10.0 AS m FROM e),
p AS (SELECT *, CASE r WHEN 0 THEN h * pi / 3 + (1 - h) * (1 - pi) WHEN 1 THEN h * (1 - pi) + (1 - h) * pi / 3 ELSE 2 * pi / 3 END AS e1, CASE r WHEN 0 THEN (1 - h) * pi / 3 + h * (1 - pi) WHEN 1 THEN (1 - h) * (1 - pi) + h * pi / 3 ELSE 2 * pi / 3 END AS e0, CASE r WHEN 0 THEN 1 - pi WHEN 1 THEN pi / 3 ELSE 2 * pi / 3 END AS no FROM f),
l AS (SELECT gene, rd, sum(ln(greatest(1e-300, m * .5 * e1 + (1 - m) * no))) AS l1, sum(ln(greatest(1e-300, m * .5 * e0 + (1 - m) * no))) AS l0 FROM p GROUP BY gene, rd)"""


def fixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = codes(spark, sf_dir).withColumnRenamed("pos", "snv_id")
    s = c.select("geneID", "snv_id").distinct().select("geneID", "snv_id", ((F.col("snv_id") % 7) / 6.0).alias("h_A"), (0.5 + (F.col("snv_id") % 5) / 10.0).alias("h_m"))
    return c, s


@query(f'WITH {SQL_FIXED} SELECT gene AS "geneID", rd AS "Read", round(1 / (1 + exp((l0 + ln(.6)) - (l1 + ln(.4)))), 6) AS "hat_I" FROM l')
def estep_read_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, P7-P9."""
    c, s = fixed(spark, sf_dir)
    return phasing.read_posterior(c, s, F.lit(0.4), ["geneID"]).withColumn("hat_I", r6("hat_I"))


@query(f"WITH {SQL_FIXED} SELECT gene AS \"geneID\", round(sum(greatest(l1 + ln(.4), l0 + ln(.6)) + ln(exp(l1 + ln(.4) - greatest(l1 + ln(.4), l0 + ln(.6))) + exp(l0 + ln(.6) - greatest(l1 + ln(.4), l0 + ln(.6))))), 4) AS loglik FROM l GROUP BY gene")
def observed_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8, M11."""
    c, s = fixed(spark, sf_dir)
    return phasing.observed_loglik(c, s, F.lit(0.4), ["geneID"]).withColumn("loglik", F.round("loglik", 4))


SQL_ISO = f"{SQL_WEIGHTS}, i AS (SELECT gene, ct, iso, sum(a) AS a, sum(b) AS b FROM (SELECT gene, ct, iso, a, b FROM w UNION ALL SELECT gene, 'Bulk', iso, a, b FROM w) GROUP BY ALL)"


def isoforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return downstream.isoform_counts(downstream.with_bulk(weights(spark, sf_dir)), ["geneID", "CellType"])


@query(f"""WITH {SQL_WEIGHTS} SELECT gene AS "geneID", cell AS "Cell", iso AS "Isoform", round(sum(a), 6) AS "hapA", round(sum(b), 6) AS "hapB", round(sum(CASE WHEN ph = 1 THEN a ELSE 0 END), 6) AS "hapA_phasable", round(sum(CASE WHEN ph = 1 THEN b ELSE 0 END), 6) AS "hapB_phasable" FROM w GROUP BY ALL""")
def iso_hap_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13, J1, A18 (long form)."""
    c = downstream.isoform_counts(weights(spark, sf_dir), ["geneID", "Cell"])
    return c.select("geneID", "Cell", "Isoform", *[r6(x).alias(x) for x in ("hapA", "hapB", "hapA_phasable", "hapB_phasable")])


@query(f'WITH {SQL_ISO} SELECT gene AS "geneID", ct AS "CellType", round(sum(a), 6) AS "hapA", round(sum(b), 6) AS "hapB" FROM i GROUP BY ALL')
def celltype_bulk_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, A17, Bulk beside cell types."""
    c = downstream.gene_counts(isoforms(spark, sf_dir), ["geneID", "CellType"])
    return c.select("geneID", "CellType", r6("hapA").alias("hapA"), r6("hapB").alias("hapB"))


SQL_POOL = f"{SQL_ISO}, k AS (SELECT *, round(a, 6) / nullif(sum(round(a, 6)) OVER g, 0) >= .17 OR round(b, 6) / nullif(sum(round(b, 6)) OVER g, 0) >= .17 AS ok FROM i WINDOW g AS (PARTITION BY gene, ct)), o AS (SELECT gene, ct, CASE WHEN coalesce(ok, false) THEN iso ELSE '_Other' END AS iso, sum(round(a, 6)) AS a, sum(round(b, 6)) AS b FROM k GROUP BY ALL)"


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = isoforms(spark, sf_dir).withColumns({"hapA": r6("hapA"), "hapB": r6("hapB")})
    return downstream.pooled_isoforms(c, ["geneID", "CellType"], share=0.17)


@query(f'WITH {SQL_POOL} SELECT gene AS "geneID", ct AS "CellType", iso AS "Isoform", round(a, 6) AS "hapA", round(b, 6) AS "hapB" FROM o')
def isoform_bucket_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    return pooled(spark, sf_dir).select("geneID", "CellType", "Isoform", r6("hapA").alias("hapA"), r6("hapB").alias("hapB"))


@query(f"""WITH {SQL_POOL}, t AS (SELECT *, sum(a) OVER g AS ta, sum(b) OVER g AS tb FROM o WINDOW g AS (PARTITION BY gene, ct)), x AS (SELECT gene, ct, count(*) AS k, sum(power(a - (a + b) * ta / (ta + tb), 2) / ((a + b) * ta / (ta + tb) + 1e-12) + power(b - (a + b) * tb / (ta + tb), 2) / ((a + b) * tb / (ta + tb) + 1e-12)) AS x FROM t GROUP BY ALL)
SELECT gene AS "geneID", ct AS "CellType", CASE WHEN k >= 2 THEN round(x, 6) END AS chi2, CASE WHEN k >= 2 THEN k - 1 END AS df FROM x""")
def kx2_chisq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M12."""
    return tests_of_fit.chi2_kx2(pooled(spark, sf_dir), ["geneID", "CellType"]).select("geneID", "CellType", r6("chi2").alias("chi2"), "df")


@query()
def kx2_chisq_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M12 with p-values of any df and FDR (C7, W1): no SQL twin, DuckDB has no erfc."""
    x = tests_of_fit.chi2_kx2(pooled(spark, sf_dir), ["geneID", "CellType"])
    return tests_of_fit.bh_fdr(x, "p_value", "p_adjusted", ["CellType"], ["geneID"])


@query(f"""WITH {SQL_POOL}, r AS (SELECT *, sum(a) OVER g AS ta, sum(b) OVER g AS tb, count(*) OVER g AS n, row_number() OVER (PARTITION BY gene, ct ORDER BY round(a + b, 4) DESC, iso = '_Other', iso) AS rk FROM o WINDOW g AS (PARTITION BY gene, ct)),
f AS (SELECT *, (a + 2) / (ta + 2 * sqrt(n)) AS fa, (b + 2) / (tb + 2 * sqrt(n)) AS fb FROM r WHERE rk = 1 AND ta > 0 AND tb > 0)
SELECT gene AS "geneID", ct AS "CellType", iso AS dominant_isoform, round(fa, 6) AS "fracA", round(fb, 6) AS "fracB", round(log2(greatest(fa, fb) / least(fa, fb)), 6) AS es_astu FROM f""")
def dominant_isoform_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22."""
    e = downstream.astu_effect(pooled(spark, sf_dir).withColumn("k", F.lit(2.0)), ["geneID", "CellType"])
    return e.select("geneID", "CellType", "dominant_isoform", r6("fracA").alias("fracA"), r6("fracB").alias("fracB"), r6("es_astu").alias("es_astu"))


SQL_BOUNDS = f"""{SQL_WEIGHTS}, z AS (SELECT gene, ct, a, b, ph FROM w UNION ALL SELECT gene, 'Bulk', a, b, ph FROM w), y AS (SELECT gene, ct, avg(CASE WHEN ph = 1 THEN a ELSE 0 END) AS lo, avg(CASE WHEN ph = 1 THEN a ELSE 1 END) AS hi, round(avg(a), 9) AS ma, round(avg(b), 9) AS mb, count(*) AS n, count(*) FILTER (ph = 1) AS np FROM z GROUP BY ALL),
al AS (SELECT gene, ct, n, np, CASE WHEN mb >= ma THEN 'B' ELSE 'A' END AS major, CASE WHEN mb >= ma THEN lo ELSE 1 - hi END AS l, CASE WHEN mb >= ma THEN hi ELSE 1 - lo END AS h FROM y)"""


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return downstream.allelic_bounds(downstream.with_bulk(weights(spark, sf_dir)), ["geneID", "CellType"])


@query(f'WITH {SQL_BOUNDS} SELECT gene AS "geneID", ct AS "CellType", n AS n_reads, np AS n_reads_phasable, major AS major_hap, round(l, 6) AS alpha_hat_low, round(h, 6) AS alpha_hat_high FROM al')
def allelic_bounds_major_hap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15, A16."""
    return bounds(spark, sf_dir).withColumns({c: r6(c) for c in ("alpha_hat_low", "alpha_hat_high")})


@query(f"""WITH {SQL_BOUNDS}, k AS (SELECT greatest(1.0, median(n) * .05) AS k FROM al WHERE ct = 'Bulk'), m AS (SELECT *, (l + h) / 2 AS x FROM al, k) SELECT gene AS "geneID", ct AS "CellType", round(k, 6) AS k, round(log2((n - n * x + k) / greatest(n * x + k, k)), 3) AS es_ase FROM m""")
def shrinkage_effect_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20, A21, P20."""
    b = bounds(spark, sf_dir).withColumn("sample", F.lit("s"))
    x = b.join(F.broadcast(downstream.shrinkage_k(b, ["sample"])), "sample")  # one row per sample
    n, low, high, k = (F.col(c) for c in ("n_reads", "alpha_hat_low", "alpha_hat_high", "k"))
    mean = (low + high) / 2
    exact = F.log2((n - n * mean + k) / F.greatest(n * mean + k, k))
    return x.withColumn("four", downstream.ase_effect(n, low, high, mean, k)).where("four IS NOT NULL").select("geneID", "CellType", r6("k").alias("k"), F.round(exact, 3).alias("es_ase"))


@query("""WITH s AS (SELECT p_brand AS gene, p_partkey AS id, (p_partkey % 21) / 20.0 AS h, (p_size % 11) / 10.0 AS m FROM part), e AS (SELECT *, CASE WHEN h <= 0 OR h >= 1 THEN 0 ELSE -(h * log2(h) + (1 - h) * log2(1 - h)) END AS en FROM s), z AS (SELECT *, round(m * (1 - en), 4) AS rev FROM e)
SELECT gene AS "geneID", id AS snv_id, count(*) OVER (PARTITION BY gene) AS gene_n_snvs_called, CASE WHEN h > .5 THEN 'A' ELSE 'B' END AS snv_hap FROM z WHERE rev >= .495 AND round(rev * 100 - .01) >= 50""")
def snv_entropy_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14, A19, F23, P27."""
    s = table(spark, sf_dir, "part").select(F.col("p_brand").alias("geneID"), F.col("p_partkey").alias("snv_id"), ((F.col("p_partkey") % 21) / 20.0).alias("h_A"), ((F.col("p_size") % 11) / 10.0).alias("h_m"))
    return downstream.refine_snvs(s, ["geneID"]).select("geneID", "snv_id", "gene_n_snvs_called", "snv_hap")


SQL_EV = f"""{SQL_ISO}, ev AS (SELECT DISTINCT p_brand AS gene, p_type AS iso, p_size AS s, p_size + 5 AS e FROM part), pr AS (SELECT i.gene, ct, s, e, sum(a) AS pa, sum(b) AS pb FROM i JOIN ev ON i.gene = ev.gene AND i.iso = ev.iso GROUP BY ALL), tt AS (SELECT gene, ct, sum(a) AS ta, sum(b) AS tb FROM i GROUP BY ALL),
x AS (SELECT pr.*, ta - pa AS aa, tb - pb AS ab FROM pr JOIN tt USING (gene, ct))"""


@query(f"""WITH {SQL_EV} SELECT gene AS "geneID", ct AS "CellType", s, e, round(pa, 4) AS present_a, round(ab, 4) AS absent_b, round((pa + aa + pb + ab) * power(pa * ab - aa * pb, 2) / ((pa + aa) * (pb + ab) * (pa + pb) * (aa + ab)), 4) AS chi2 FROM x WHERE round(pa + aa + pb + ab, 6) >= 10 AND round(least(pa, aa, pb, ab), 6) >= 1""")
def event_2x2_chisq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M15, F21, A23, J13, C11."""
    ev = table(spark, sf_dir, "part").select(F.col("p_brand").alias("geneID"), F.col("p_type").alias("Isoform"), F.lit("exon").alias("event_type"), F.col("p_size").alias("s"), (F.col("p_size") + 5).alias("e")).distinct()
    w = downstream.event_weights(isoforms(spark, sf_dir), ev, ["geneID", "CellType"])
    w = w.withColumns({f"hap{h}_{x}": r6(f"hap{h}_{x}") for h in "AB" for x in ("present", "absent")})
    t = downstream.event_tests(w)
    return t.select("geneID", "CellType", "s", "e", F.round("hapA_present", 4).alias("present_a"), F.round("hapB_absent", 4).alias("absent_b"), F.round("chi2", 4).alias("chi2"))


@query("""WITH k AS (SELECT l_partkey AS pos, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS k FROM lineitem GROUP BY 1 HAVING count(*) >= 10), t AS (SELECT pos, n, k, unnest(range(0, least(k, n - k) + 1)) AS i FROM k)
SELECT pos, n, k, round(least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0)))), 6) AS p FROM t GROUP BY pos, n, k""")
def binom_half_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M16."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("pos")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("k")).where("n >= 10")
    return c.select("pos", "n", "k", r6(tests_of_fit.binomial_half(F.col("k"), F.col("n"))).alias("p"))


@query("""WITH e AS (SELECT p_brand AS gene, p_partkey AS s, p_partkey + 20 AS e FROM part WHERE p_size > 45), x AS (SELECT p_brand AS gene, p_partkey * 60 AS s, p_partkey * 60 + p_size AS e FROM part WHERE p_size > 25),
n AS (SELECT p_brand AS gene, p_partkey AS pos FROM part WHERE p_size < 5), ats AS (SELECT gene, p, sum(greatest(0, least(p - s, e - s))) AS v FROM (SELECT gene, s AS p FROM e UNION SELECT gene, e FROM e UNION SELECT gene, pos FROM n) q JOIN x USING (gene) GROUP BY gene, p),
d AS (SELECT e.gene, e.s, e.e, n.pos, CASE WHEN n.pos BETWEEN e.s AND e.e THEN 0 ELSE least(abs(a.v - b.v), abs(a.v - c.v)) END AS d FROM e JOIN n USING (gene) JOIN ats a ON a.gene = e.gene AND a.p = n.pos JOIN ats b ON b.gene = e.gene AND b.p = e.s JOIN ats c ON c.gene = e.gene AND c.p = e.e)
SELECT gene AS "geneID", s, e, pos, d::BIGINT AS exonic_distance, count(*) OVER (PARTITION BY gene, s, e) AS linked_snv_count,
row_number() OVER (PARTITION BY gene, s, e ORDER BY d, CASE WHEN pos BETWEEN s AND e THEN 0 ELSE least(abs(pos - s), abs(pos - e)) END, pos) = 1 AS is_nearest FROM d WHERE d <= 50""")
def exonic_distance_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16, J8, W4, W5, C12."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("geneID"), F.col("p_partkey").alias("pos"), "p_size").withColumn("chrom", F.lit("c"))
    ev = p.where("p_size > 45").select("geneID", "chrom", F.lit("exon").alias("event_type"), F.col("pos").alias("s"), (F.col("pos") + 20).alias("e"))
    ex = p.where("p_size > 25").select("geneID", (F.col("pos") * 60).alias("s"), (F.col("pos") * 60 + F.col("p_size")).alias("e"))
    s = p.where("p_size < 5").withColumns({"ref": F.lit("A"), "alt": F.lit("G")})
    return downstream.link_snvs(s, ev, ex).select("geneID", "s", "e", "pos", "exonic_distance", "linked_snv_count", "is_nearest")


@query(f"""WITH {SQL_WEIGHTS}, h AS (SELECT gene, iso, ct, sum(a) AS a, sum(b) AS b FROM w GROUP BY ALL), d AS (SELECT gene, ct, iso, round(b / sum(b) OVER g - a / sum(a) OVER g, 9) AS d FROM h WINDOW g AS (PARTITION BY gene, ct))
SELECT gene AS "geneID", ct AS "CellType", arg_min(iso, (d, iso)) AS down, arg_max(iso, (d, iso)) AS up, round(min(d), 6) AS down_delta, round(max(d), 6) AS up_delta FROM d GROUP BY ALL""")
def switching_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A28."""
    t = downstream.isoform_counts(weights(spark, sf_dir), ["geneID", "CellType"]).withColumnRenamed("Isoform", "transcript")
    return downstream.switching_pair(t, ["geneID", "CellType"]).withColumns({"down_delta": r6("down_delta"), "up_delta": r6("up_delta")})


@query("""SELECT p_brand AS gene, p_type AS ct, p_size AS v FROM (SELECT DISTINCT p_brand, p_type, p_size FROM part) WHERE (p_brand, p_type) NOT IN (SELECT p_brand, p_type FROM part WHERE p_size = 7)
UNION ALL SELECT DISTINCT p_brand, p_type, p_size + 1000 FROM part WHERE p_size = 7""")
def subset_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6, J15."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("gene"), F.col("p_type").alias("ct"), F.col("p_size").alias("v")).distinct()
    return downstream.upsert(p, p.where("v = 7").withColumn("v", F.col("v") + 1000), ["gene", "ct"])


@query("""SELECT DISTINCT p_brand AS gene, p_type AS ct FROM part EXCEPT SELECT p_brand, p_type FROM part WHERE p_size = 7""")
def audit_missing_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands and types without a part of one size."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("gene"), F.col("p_type").alias("ct"), "p_size")
    return downstream.missing(p, p.where("p_size = 7"), ["gene", "ct"])


@query("""WITH RECURSIVE m AS (SELECT p_brand AS gene, p_size AS w, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part WHERE p_size < 8),
t AS (SELECT p_brand AS gene, sum(CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN p_partkey % 3 = 1 THEN p_size ELSE 0 END)::DOUBLE AS b FROM part WHERE p_size > 45 GROUP BY 1),
f AS (SELECT gene, a, b, 0::BIGINT AS k FROM t UNION ALL SELECT f.gene, CASE WHEN x.on_a THEN f.a + m.w ELSE f.a END, CASE WHEN x.on_a THEN f.b ELSE f.b + m.w END, m.k FROM f JOIN m ON m.gene = f.gene AND m.k = f.k + 1,
LATERAL (SELECT CASE WHEN f.b = 0 AND f.a = 0 THEN true WHEN f.b = 0 THEN true WHEN f.a = 0 THEN false WHEN f.a = f.b THEN true ELSE m.w / (f.a + m.w) > m.w / (f.b + m.w) END AS on_a) x)
SELECT gene AS "geneID", a, b FROM f QUALIFY row_number() OVER (PARTITION BY gene ORDER BY k DESC) = 1""")
def most_imbalanced_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M13."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("geneID"), F.col("p_partkey").alias("pos"), F.col("p_size").alias("w"))
    part = lambda r: F.sum(F.when(F.col("pos") % 3 == r, F.col("w")).otherwise(0)).cast("double")
    totals = p.where("w > 45").groupBy("geneID").agg(part(0).alias("totalA"), part(1).alias("totalB"))
    items = p.where("w < 8").groupBy("geneID").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]).alias("missing"))
    out = downstream.most_imbalanced(totals.join(items, "geneID", "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<int>"))))
    return out.select("geneID", F.col("_imbalance.a").alias("a"), F.col("_imbalance.b").alias("b"))


@query(f"""WITH {SQL_WEIGHTS}, al AS (SELECT DISTINCT gene, rd, CASE WHEN l_returnflag = 'N' THEN 0 WHEN l_returnflag = 'A' THEN 1 ELSE 2 END AS r FROM w JOIN lineitem ON l_orderkey = rd AND l_partkey = pos), me AS (SELECT DISTINCT gene, rd, iso IN ('ECONOMY', 'PROMO') OR pos % 2 = 0 AS has FROM w),
g AS (SELECT gene, rd, r FROM al JOIN me USING (gene, rd) GROUP BY ALL HAVING bool_and(has) = bool_or(has)), q AS (SELECT g.*, (SELECT bool_and(has) FROM me WHERE me.gene = g.gene AND me.rd = g.rd) AS has FROM g)
SELECT gene AS "geneID", count(*) FILTER (r = 0 AND has) AS ref_present, count(*) FILTER (r = 0 AND NOT has) AS ref_absent, count(*) FILTER (r = 1 AND has) AS alt_present, count(*) FILTER (r = 1 AND NOT has) AS alt_absent FROM q GROUP BY gene""")
def raw_allele_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25, J17, C13."""
    w = weights(spark, sf_dir)
    flag = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("Read"), F.col("l_partkey").alias("pos"), flag.alias("r"))
    al = w.join(line, ["Read", "pos"]).select("geneID", "Read", "r").distinct()
    me = w.select("geneID", "Read", (F.col("Isoform").isin("ECONOMY", "PROMO") | (F.col("pos") % 2 == 0)).alias("has")).distinct()
    return downstream.raw_allele_events(al, me, ["geneID"]).select("geneID", "ref_present", "ref_absent", "alt_present", "alt_absent")


def scored_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EM input with the share of alternative codes as the score of a site: a window over rows that are dealt by site already."""
    site = Window.partitionBy("geneID", "pos")
    score = F.count_if(F.col("r") == 1).over(site) / F.count(F.lit(1)).over(site)
    return codes(spark, sf_dir).select("geneID", F.col("Read").cast("string").alias("Read"), F.col("pos").cast("string").alias("snv_id"), "r", "pi", score.alias("score"))


@query()
def em_phase_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haplotypes by EM."""
    return phasing.phase_genes(scored_codes(spark, sf_dir).withColumnRenamed("geneID", "gene"), ["gene"])[1]


@query("""SELECT event_id, regexp_replace('m/' || user_id || '/ccs_' || event_id, '(/ccs)_[0-9]+$', '\\1') AS read_name, regexp_extract(props, '"([a-z_]+)"', 1) AS attribute FROM events""")
def read_name_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, S18's attribute pattern."""
    e = table(spark, sf_dir, "events")
    name = F.concat(F.lit("m/"), F.col("user_id"), F.lit("/ccs_"), F.col("event_id"))
    return e.select("event_id", alleles.canonical_read_name(name).alias("read_name"), F.regexp_extract("props", '"([a-z_]+)"', 1).alias("attribute"))
