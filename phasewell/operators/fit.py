"""Expectation-maximisation of haplotypes as alternating aggregations (M1-M11), a gene split over all tasks.

Observations stay a long table (gene, Read, snv_id, r, pi) that is read, never gathered: reads come from an
aggregation over their sites, sites from aggregations over their reads. Parameters are narrow tables, one
row per site and per gene, written after each round into the shared folder. Genes that stand still leave the
rounds. What a task holds is bounded by links of a gene's sites (start of the phase), never by its reads.

``phasing.phased`` fits a gene in one task, which is faster for genes that fit there; both give the same
numbers (within 1e-6). ``fit_bulk`` and ``fit_cell_types`` take groups of up to ``IN_TASK`` observations that
way, and the others by rounds.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tests_of_fit import chi2_sf_one
from ..sources.shared import written
from .phasing import DENSE, FLOOR, _first_phase, first_phase_linked, frozen_shares, least_side, phased, steering, with_names

#: Points at which a derivative is taken in one pass, and passes: the place of its zero within 8 ** -9.
POINTS = 7
PASSES = 9
#: Observations of a group that one task takes: some 400 bytes each.
IN_TASK = 2_000_000


def observations(codes: DataFrame, gene: list[str]) -> DataFrame:
    """One row per gene, read and site that has a code: the largest code, then error, where there are several."""
    best = codes.where("r >= 0").groupBy(*gene, "Read", "snv_id").agg(F.max(F.struct("r", "pi")).alias("o"))
    return best.select(*gene, "Read", "snv_id", F.col("o.r").alias("r"), F.col("o.pi").cast("double").alias("pi"))


def starting_sites(obs: DataFrame, scores: DataFrame, gene: list[str], seed: int = 42, scored: bool = False) -> DataFrame:
    """(gene, snv_id, h_A, h_m) of the sites that steer a gene's phase.

    Sites that are alternative on the same reads are counted by a join; a task then splits the linked
    sites of one gene.
    """
    keep = scores.groupBy(*gene).applyInPandas(lambda pdf: steering_rows(pdf, scored), scores.select(*gene, "snv_id", "score").schema)
    keep = written(keep)
    alt = obs.where("r = 1").join(keep.select(*gene, "snv_id"), [*gene, "snv_id"]).select(*gene, "Read", "snv_id")
    other = alt.withColumnRenamed("snv_id", "with")
    together = alt.join(other, [*gene, "Read"]).where(F.col("snv_id") < F.col("with")).groupBy(*gene, "snv_id", "with").agg(F.count(F.lit(1)).alias("n"))

    def start(_: tuple, sites: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        own = sites.assign(name=sites["snv_id"].astype(str)).sort_values("name").reset_index(drop=True)
        at = pd.Series(own.index, own["snv_id"])
        i, j = at.reindex(pairs["snv_id"]).to_numpy(), at.reindex(pairs["with"]).to_numpy()
        rng, n = np.random.default_rng(seed), pairs["n"].to_numpy(float)
        if len(own) <= DENSE:
            m = np.zeros((len(own), len(own)))
            m[i, j] = m[j, i] = n
            h = _first_phase(m, rng)
        else:
            h = first_phase_linked(np.tile(np.arange(len(n)), 2), np.append(i, j), n, len(own), rng)
        return own.assign(h_A=h, h_m=own["score"].clip(1e-6, 1 - 1e-6))[[*gene, "snv_id", "h_A", "h_m"]]

    kinds = ", ".join(f"`{c}` {keep.schema[c].dataType.simpleString()}" for c in [*gene, "snv_id"])
    return keep.groupBy(*gene).cogroup(together.groupBy(*gene)).applyInPandas(start, f"{kinds}, h_A double, h_m double")


def steering_rows(pdf: pd.DataFrame, scored: bool) -> pd.DataFrame:
    """The rows of one gene's sites that steer."""
    own = pdf.assign(name=pdf["snv_id"].astype(str)).sort_values("name")
    return own[steering(own["score"].to_numpy(float), scored)].drop(columns="name")


def _floor(c: Column) -> Column:
    return F.greatest(F.lit(FLOOR), c)


def _parts() -> dict[str, Column]:
    """base1, base0 and slope: on haplotype A a code has probability base1 + slope h, on B base0 - slope h; noise: off both."""
    r, e = F.col("r"), F.col("pi")
    alt, other = r == 1, ~r.isin(0, 1)
    low, up, rest = e / 3, 1 - e, 2 * e / 3
    return {
        "base1": F.when(other, rest).when(alt, low).otherwise(up),
        "base0": F.when(other, rest).when(alt, up).otherwise(low),
        "slope": F.when(other, 0.0).otherwise((1 - 4 * e / 3) * F.when(alt, 1.0).otherwise(-1.0)),
        "noise": F.when(other, rest).when(alt, low).otherwise(up),
    }


def read_sides(obs: DataFrame, sites: DataFrame, gene: list[str]) -> DataFrame:
    """(gene, Read, l1, l0): log-likelihoods of a read's codes on either haplotype (M3, M8)."""
    x = obs.join(sites.select(*gene, "snv_id", "h_A", "h_m"), [*gene, "snv_id"]).withColumns(_parts())
    step, sure, off = F.col("slope") * F.col("h_A"), F.col("h_m") * 0.5, (1 - F.col("h_m")) * F.col("noise")
    return x.groupBy(*gene, "Read").agg(F.sum(F.log(_floor(sure * (F.col("base1") + step) + off))).alias("l1"), F.sum(F.log(_floor(sure * (F.col("base0") - step) + off))).alias("l0"))


def _with_alpha(sides: DataFrame, genes: DataFrame, gene: list[str], alpha: Column) -> DataFrame:
    """hat, the probability of haplotype A, and a read's log-likelihood."""
    a, b = F.col("l1") + F.log(_floor(alpha)), F.col("l0") + F.log(_floor(1 - alpha))
    top = F.greatest(a, b)
    apart = F.least(F.lit(700.0), F.greatest(F.lit(-700.0), b - a))
    return sides.join(genes, gene).select(*gene, "Read", (1 / (1 + F.exp(apart))).alias("hat"), (top + F.log(F.exp(a - top) + F.exp(b - top))).alias("ll"))


def loglik(obs: DataFrame, sites: DataFrame, genes: DataFrame, gene: list[str], alpha: Column) -> DataFrame:
    """(gene, loglik): observed log-likelihood of the reads (M8)."""
    return _with_alpha(read_sides(obs, sites, gene), genes, gene, alpha).groupBy(*gene).agg(F.sum("ll").alias("loglik"))


def _chance(at: Column) -> Column:
    """Probability of a code when A's share is ``at``: affine in it (c0, c1), noise beside."""
    return F.col("z") * 0.5 * (F.col("c0") + F.col("c1") * at) + (1 - F.col("z")) * F.col("noise")


def _narrowed(told: DataFrame, sites: DataFrame, key: list[str]) -> DataFrame:
    """sites with [lo, hi] cut to the part that holds the zero of the derivative, which falls with h (M4)."""
    at = lambda k: f"lo + (hi - lo) * {k} / {POINTS + 1}"
    slope = lambda k: f"sum(z * 0.5 * c1 / greatest({FLOOR!r}, z * 0.5 * (c0 + c1 * ({at(k)})) + (1 - z) * noise))"
    rest = [f"first({c}) as {c}" for c in sites.columns if c not in key]
    slopes = ", ".join(slope(k) for k in range(1, POINTS + 1))
    up = told.join(sites, key).groupBy(*key).agg(*map(F.expr, [f"size(filter(array({slopes}), x -> x > 0)) as n", *rest]))
    return up.selectExpr(*[c for c in sites.columns if c not in ("lo", "hi")], f"{at('n')} as lo", f"{at('(n + 1)')} as hi")


def fit(obs: DataFrame, start: DataFrame, gene: list[str], *, max_iter: int = 50, tol: float = 1e-3, fixed_alpha: Column | None = None, frozen: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sites, genes) after the rounds (M4-M7, M9).

    sites: gene, snv_id, h_A, h_m and those of the round before (old_h_A, old_h_m), which the last E-step
    saw; genes: gene, alpha, old_alpha, q, rounds, done. A gene ends when no parameter moves by ``tol``, or
    the expected log-likelihood doesn't (M5). ``fixed_alpha``, of the gene's columns, holds alpha where it
    isn't NULL. With ``frozen`` only alpha is fitted, for sites of another fit (M7): their markers count
    as sure or not in the expected log-likelihood.
    """
    key = [*gene, "snv_id"]
    own = written(start.select(*key, "h_A", "h_m", F.col("h_A").alias("old_h_A"), F.col("h_m").alias("old_h_m")))
    obs = written(obs.join(own.select(*key), key))
    fixed = (F.lit(None) if fixed_alpha is None else fixed_alpha).cast("double").alias("fixed")
    first = obs.select(*gene).distinct().select(*gene, fixed).withColumn("alpha", F.coalesce("fixed", F.lit(0.5)))
    genes = written(first.select("*", F.col("alpha").alias("old_alpha"), F.lit(float("inf")).alias("q"), F.lit(0).alias("rounds"), F.lit(False).alias("done")))
    fixed_sides = written(read_sides(obs, own, gene)) if frozen else None
    ended: list[tuple[DataFrame, DataFrame]] = []
    for n in range(1, max_iter + 1):
        alone = genes.select(*gene)
        now = obs if n == 1 else obs.join(alone, gene, "left_semi")
        sides = read_sides(now, own, gene) if fixed_sides is None else fixed_sides.join(alone, gene, "left_semi")
        reads = _with_alpha(sides, genes.select(*gene, "alpha"), gene, F.col("alpha")).join(now.groupBy(*gene, "Read").agg((1 / F.count(F.lit(1))).alias("share")), [*gene, "Read"])
        told = now.withColumns(_parts()).join(reads, [*gene, "Read"])
        told = written(told.selectExpr(*key, "hat * base1 + (1 - hat) * base0 as c0", "slope * (2 * hat - 1) as c1", "noise", "hat * share as hat", "share"))
        if frozen:
            new = own.selectExpr(*key, "h_A", "h_m", "h_A as old_h_A", "h_m as old_h_m", "cast(h_m > 0.5 as double) as z")
        else:
            marks = told.join(own.select(*key, "h_A"), key).groupBy(*key).agg(F.expr(f"sum(ln(0.5 * greatest({FLOOR!r}, c0 + c1 * h_A)) - ln(greatest({FLOOR!r}, noise))) as odds"))
            odds = f"least(700, greatest(-700, odds + ln(greatest({FLOOR!r}, h_m)) - ln(greatest({FLOOR!r}, 1 - h_m))))"
            new = own.join(marks, key).selectExpr(*key, "h_A as old_h_A", "h_m as old_h_m", f"1 / (1 + exp(-{odds})) as z", "0.0D as lo", "1.0D as hi")
            for _ in range(PASSES):
                new = _narrowed(told, new, key)
            new = written(new.selectExpr(*key, "(lo + hi) / 2 as h_A", "z as h_m", "old_h_A", "old_h_m", "z"))
        seen = told.join(new.select(*key, "h_A", "z"), key).groupBy(*gene).agg((-F.sum(F.log(_floor(_chance(F.col("h_A")))))).alias("new_q"), (F.sum("hat") / F.sum("share")).alias("mean_hat"))
        moved = new.groupBy(*gene).agg(F.expr("max(greatest(abs(h_A - old_h_A), abs(h_m - old_h_m))) as moved"))
        after = genes.join(seen, gene).join(moved, gene).withColumn("next", F.coalesce("fixed", "mean_hat"))
        after = written(after.selectExpr(*gene, "fixed", "next as alpha", "alpha as old_alpha", "new_q as q", f"{n} as rounds", f"{n == max_iter} or greatest(moved, abs(next - alpha)) < {tol!r} or abs(new_q - q) < {tol!r} as done"))
        ended.append((new.drop("z"), after.where("done")))
        genes = after.where("NOT done")
        own = new.drop("z").join(genes.select(*gene), gene, "left_semi")
        if genes.isEmpty():
            break
    ends = [(s.join(g.select(*gene), gene, "left_semi"), g) for s, g in ended]
    return written(reduce(DataFrame.unionByName, [s for s, _ in ends])), written(reduce(DataFrame.unionByName, [g for _, g in ends]))


def posteriors(obs: DataFrame, sites: DataFrame, genes: DataFrame, gene: list[str]) -> DataFrame:
    """(gene, Read, hat): what the last E-step of a fit said of each read."""
    before = sites.select(*gene, "snv_id", F.col("old_h_A").alias("h_A"), F.col("old_h_m").alias("h_m"))
    return _with_alpha(read_sides(obs, before, gene), genes.select(*gene, "old_alpha"), gene, F.col("old_alpha")).drop("ll")


def likelihood_ratio(alt: DataFrame, null: DataFrame, gene: list[str]) -> DataFrame:
    """(gene, ll_alt, ll_null, lrt_stat, p_value) of two tables (gene, loglik)."""
    return with_ratio(alt.withColumnRenamed("loglik", "ll_alt").join(null.withColumnRenamed("loglik", "ll_null"), gene))


def with_ratio(both: DataFrame) -> DataFrame:
    """lrt_stat and p_value beside ll_alt and ll_null."""
    return both.withColumn("lrt_stat", F.greatest(F.lit(0.0), 2 * (F.col("ll_alt") - F.col("ll_null")))).withColumn("p_value", chi2_sf_one(F.col("lrt_stat")))


def parted(rows: DataFrame, by: list[str], most: int) -> tuple[DataFrame | None, DataFrame | None]:
    """rows, a table, of the groups of up to ``most`` rows, and of those with more; None where there are none."""
    sizes = written(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")))
    has = sizes.agg(F.count_if(F.col("n") <= most), F.count_if(F.col("n") > most)).first()
    if not has[1]:
        return rows, None
    large = sizes.where(F.col("n") > most).select(*by)
    return rows.join(large, by, "left_anti") if has[0] else None, rows.join(large, by, "left_semi")


def united(parts: list[tuple[DataFrame, ...]], codes: DataFrame) -> tuple[DataFrame, ...]:
    """The tables of all parts, names of reads and sites as in codes."""
    whole = [reduce(DataFrame.unionByName, same) for same in zip(*parts, strict=True)]
    return tuple(x.withColumns({c: F.col(c).cast(codes.schema[c].dataType) for c in ("Read", "snv_id") if c in x.columns}) for x in whole)


def fit_bulk(codes: DataFrame, gene: list[str], in_task: int = IN_TASK, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reads, sites, genes) of all genes: fit, null with alpha one half, ratio test (C5's fit, M9, M10).

    codes: gene, Read, snv_id, r, pi and score. Genes of up to ``in_task`` rows are fitted in a task each.
    """
    small, large = parted(written(with_names(codes, gene, "score")), gene, in_task)
    parts = [] if large is None else [fit_by_rounds(large, gene, **options)]
    if small is not None:
        reads, sites, genes = (phased(small, gene, kind, **options).where("told") for kind in ("read", "site", "gene"))
        genes = with_ratio(genes.select(*gene, least_side("alpha").alias("alpha_hat"), F.col("rounds").cast("int").alias("rounds"), "ll_alt", "ll_null"))
        parts.append((reads.select(*gene, F.col("id").alias("Read"), F.col("a").alias("hat")), sites.select(*gene, F.col("id").alias("snv_id"), F.col("a").alias("h_A"), F.col("b").alias("h_m")), genes))
    return united(parts, codes)


def fit_by_rounds(codes: DataFrame, gene: list[str], **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``fit_bulk`` of genes of any size."""
    scores = codes.groupBy(*gene, "snv_id").agg(F.max("score").cast("double").alias("score"))
    single = written(observations(codes, gene))
    both, by = F.explode(F.array(F.lit("alt"), F.lit("null"))).alias("model"), [*gene, "model"]
    start = starting_sites(single, scores, gene).select("*", both)
    obs = single.select("*", both)
    sites, genes = fit(obs, start, by, fixed_alpha=F.when(F.col("model") == "null", 0.5), **options)
    likely = loglik(obs, sites, genes.select(*by, "alpha"), by, F.col("alpha"))
    of = lambda df, m: df.where(F.col("model") == m).drop("model")
    test = likelihood_ratio(of(likely, "alt"), of(likely, "null"), gene)
    genes, sites = of(genes, "alt"), of(sites, "alt")
    out = genes.select(*gene, F.least(F.col("alpha"), 1 - F.col("alpha")).alias("alpha_hat"), "rounds").join(test, gene)
    return posteriors(single, sites, genes, gene), sites.select(*gene, "snv_id", "h_A", "h_m"), out


def fit_cell_types(codes: DataFrame, bulk: DataFrame, gene: list[str], cell_type: str = "CellType", in_task: int = IN_TASK, **options) -> tuple[DataFrame, DataFrame]:
    """(reads, genes) by cell type, with sites frozen from the bulk fit.

    codes carry the cell type; bulk: gene, snv_id, h_A, h_m. Groups of up to ``in_task`` rows at known
    sites are fitted in a task each.
    """
    by = [*gene, cell_type]
    known = bulk.where("h_m > 0").select(*gene, F.col("snv_id").cast("string").alias("snv_id"), "h_A", "h_m")
    small, large = parted(written(with_names(codes.where("r >= 0"), by).join(known, [*gene, "snv_id"])), by, in_task)
    parts = [] if large is None else [cell_types_by_rounds(large, by, **options)]
    if small is not None:
        reads, genes = (frozen_shares(small, by, kind, **options) for kind in ("read", "gene"))
        genes = genes.select(*by, least_side("alpha").alias("alpha_hat"), F.col("rounds").cast("int").alias("rounds"), "ll_alt", "ll_null")
        parts.append((reads.select(*by, F.col("id").alias("Read"), F.col("a").alias("hat")), with_ratio(genes)))
    return united(parts, codes)


def cell_types_by_rounds(codes: DataFrame, by: list[str], **options) -> tuple[DataFrame, DataFrame]:
    """``fit_cell_types`` of groups of any size, from codes with the h_A and h_m of their sites."""
    obs = written(observations(codes, by))
    sites = written(codes.select(*by, "snv_id", "h_A", "h_m").distinct())
    fitted, genes = fit(obs, sites, by, frozen=True, **options)
    alone = genes.select(*by, "alpha")
    half = genes.select(*by, F.lit(0.5).alias("alpha"))
    test = likelihood_ratio(loglik(obs, sites, alone, by, F.col("alpha")), loglik(obs, sites, half, by, F.col("alpha")), by)
    return posteriors(obs, fitted, genes, by), genes.select(*by, least_side("alpha").alias("alpha_hat"), "rounds").join(test, by)
