"""Statistics as columns and windows: chi-square, exact binomial, FDR."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chi2_2x2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Pearson's statistic of a 2 x 2 table without continuity correction (M15), NULL on an empty margin."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    return (a + b + c + d) * F.pow(a * d - b * c, F.lit(2.0)) / F.nullif(margins, F.lit(0.0))


def erfc(z: Column, terms: int = 80) -> Column:
    """Complementary error function of z >= 0: the power series below 2.5, the continued fraction above."""
    down = F.sequence(F.lit(terms), F.lit(1))
    square = z * z
    series = z * F.aggregate(down, F.lit(1.0), lambda t, i: 1 + 2 * square / (2 * i + 1) * t)
    fraction = F.aggregate(down, z, lambda t, i: z + i / 2 / t)
    root = math.sqrt(math.pi)
    return F.when(z < 2.5, 1 - 2 / root * F.exp(-square) * series).otherwise(F.exp(-square) / root / fraction)


def chi2_sf_one(x: Column) -> Column:
    """P-value of a chi-square statistic with one degree of freedom; 1 below 0."""
    return F.when(x <= 0, 1.0).when(F.isnan(x), F.lit(None)).otherwise(erfc(F.sqrt(x.cast("double") / 2)))


def chi2_sf(x: Column, df: Column | int) -> Column:
    """P-value of a chi-square statistic with integer df: finite sums, for odd df beside erfc."""
    x, df = x.cast("double"), F.lit(df) if isinstance(df, int) else df
    state = F.struct((F.sqrt(2 * x / math.pi) * F.exp(-x / 2)).alias("t"), F.lit(0.0).alias("s"))
    step = lambda s, i: F.struct((s["t"] * x / (2 * i + 3)).alias("t"), (s["s"] + s["t"]).alias("s"))
    more = F.when(df >= 3, F.sequence(F.lit(0), ((df - 3) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    odd = chi2_sf_one(x) + F.aggregate(more, state, step, lambda s: s["s"])
    value = F.when(df % 2 == 0, chi2_sf_even(x, df)).otherwise(odd)
    known = x.isNotNull() & ~F.isnan(x) & (df >= 1)
    return F.when(known, F.when(x <= 0, 1.0).otherwise(F.least(F.lit(1.0), value)))


def chi2_sf_even(x: Column, df: Column) -> Column:
    """The same for even df only, as a finite sum of columns."""
    state = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(s: Column, i: Column) -> Column:
        t = s["t"] * x / 2 / i
        return F.struct(t.alias("t"), (s["s"] + t).alias("s"))

    terms = F.when(df >= 4, F.sequence(F.lit(1), (df / 2 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.exp(-x / 2) * F.aggregate(terms, state, step, lambda s: s["s"])


def binomial_half(k: Column, n: Column) -> Column:
    """Two-sided exact test of k successes in n fair tosses (M16): twice the smaller tail, capped.

    Terms are built by recurrence from 2^-n in logarithms, so n may be large.
    """
    low = F.least(k, n - k)
    state = F.struct((-n * F.log(F.lit(2.0))).alias("lp"), F.exp(-n * F.log(F.lit(2.0))).alias("s"))

    def step(s: Column, i: Column) -> Column:
        lp = s["lp"] + F.log((n - i + 1) / i)
        return F.struct(lp.alias("lp"), (s["s"] + F.exp(lp)).alias("s"))

    steps = F.when(low >= 1, F.sequence(F.lit(1).cast("bigint"), low.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.least(F.lit(1.0), 2 * F.aggregate(steps, state, step, lambda s: s["s"]))


def bh_fdr(df: DataFrame, p: str, out: str, by: list[str], tie: list[str]) -> DataFrame:
    """Benjamini-Hochberg over the rows of each group with a p-value (W1-W3); others keep NULL.

    ``tie`` orders equal p-values, so that the result is a function of the rows.
    """
    known = F.when(F.col(p).isNotNull(), F.lit(1)).otherwise(F.lit(0)).alias("has")
    group = Window.partitionBy(*by, known)
    ranked = df.withColumn("_rank", F.row_number().over(group.orderBy(F.col(p).asc_nulls_last(), *tie))).withColumn("_m", F.count(p).over(group))
    raw = F.when(F.col(p).isNotNull(), F.col(p) * F.col("_m") / F.col("_rank"))
    down = group.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("_raw", raw).withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_raw").over(down)))).drop("_rank", "_m", "_raw")


def chi2_kx2(df: DataFrame, by: list[str], a: str = "hapA", b: str = "hapB") -> DataFrame:
    """K x 2 table per group (M12): statistic, degrees of freedom, p; NULL below two rows."""
    group = Window.partitionBy(*by)
    rows = df.withColumn("_ta", F.sum(a).over(group)).withColumn("_tb", F.sum(b).over(group))
    total = F.col("_ta") + F.col("_tb")
    part = lambda x, t: F.pow(F.col(x) - (F.col(a) + F.col(b)) * F.col(t) / total, F.lit(2.0)) / ((F.col(a) + F.col(b)) * F.col(t) / total + 1e-12)
    out = rows.where(total > 0).groupBy(*by).agg(F.sum(part(a, "_ta") + part(b, "_tb")).alias("_x"), F.count(F.lit(1)).alias("k"))
    return out.select(*by, F.when(F.col("k") >= 2, F.col("_x")).alias("chi2"), F.when(F.col("k") >= 2, F.col("k") - 1).alias("df")).withColumn("p_value", chi2_sf(F.col("chi2"), F.col("df")))
