"""Seventeen features of a site, a scorer over them, and the filters that follow.

Features come from one aggregation over a site's observations; sequence context from the one or two tiles of
the reference that its window lies in, joined on tiles and put together again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import gc_share, is_transition, longest_run

SITE = ["geneID", "chrom", "pos"]
#: Fixed order of the features.
FEATURES = [
    "depth", "alt_count", "het_prob", "mean_mapq", "mean_bq_alt", "mean_bq_ref", "n_distinct_alt", "alt_pos_on_read_mean", "alt_pos_on_read_std",
    "strand_sor", "del_frac", "gc_content_11bp", "homopolymer_len", "is_homopolymer_ge5", "creates_homopolymer", "flanking_is_AT", "is_transition",
]
#: Bases on either side of a site, and the run that counts as a homopolymer.
FLANK, RUN = 5, 5


def sequence_window(sites: DataFrame, tiles: DataFrame, tile: int, flank: int = FLANK) -> DataFrame:
    """(chrom, pos, window, at): the reference from ``flank`` bases before each site to as many after.

    ``at`` is the site's place in it, from 0. Windows are cut short where the reference begins or ends.
    """
    low, high = F.greatest(F.lit(0).cast("bigint"), F.col("pos") - flank), F.col("pos") + flank + 1
    wanted = sites.select("chrom", "pos").distinct().withColumns({"_lo": low, "_hi": high})
    parts = wanted.withColumn("start", F.explode(F.sequence((F.floor(F.col("_lo") / tile) * tile).cast("bigint"), (F.floor((F.col("_hi") - 1) / tile) * tile).cast("bigint"), F.lit(tile).cast("bigint"))))
    met = parts.join(tiles.select("chrom", "start", "seq"), ["chrom", "start"])
    begin = F.greatest("_lo", "start")
    piece = F.substring("seq", (begin - F.col("start") + 1).cast("int"), (F.col("_hi") - begin).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", piece.alias("piece")))), lambda x: x["piece"]), "")  # two pieces at most, where tiles are longer than windows
    return met.groupBy("chrom", "pos", "_lo").agg(F.upper(joined).alias("window")).select("chrom", "pos", "window", (F.col("pos") - F.col("_lo")).alias("at"))


def observed_features(sites: DataFrame, observed: DataFrame) -> DataFrame:
    """Counts and moments of a site's observations, zeros where it has none."""
    own = observed.drop("ref").join(sites.select(*SITE, "ref", "alt"), SITE).withColumn("base", F.upper("base")).where(F.col("base").isin("A", "C", "G", "T"))
    is_alt, is_ref = F.col("base") == F.col("alt"), F.col("base") == F.col("ref")
    place = F.when(is_alt & (F.col("read_len") > 1), F.col("qpos") / F.greatest(F.col("read_len") - 1, F.lit(1)))
    others = [(F.count_if((F.col("base") == b) & ~is_ref) >= 2).cast("int") for b in "ACGT"]
    strand = lambda kind, rev: F.count_if(kind & (F.col("is_reverse") == rev))
    return own.groupBy(*SITE).agg(
        F.count(F.lit(1)).alias("depth"), F.count_if(is_alt).alias("alt_count"), F.avg("mapq").alias("mean_mapq"), F.avg(F.when(is_alt, F.col("baseq"))).alias("mean_bq_alt"), F.avg(F.when(is_ref, F.col("baseq"))).alias("mean_bq_ref"),
        (others[0] + others[1] + others[2] + others[3]).alias("n_distinct_alt"), F.avg(place).alias("alt_pos_on_read_mean"), F.stddev_pop(place).alias("alt_pos_on_read_std"),
        strand(is_ref, 0).alias("_rf"), strand(is_ref, 1).alias("_rr"), strand(is_alt, 0).alias("_af"), strand(is_alt, 1).alias("_ar"),
    )


def site_features(sites: DataFrame, observed: DataFrame, tiles: DataFrame | None = None, tile: int = 0) -> DataFrame:
    """sites (geneID, chrom, pos, ref, alt, het_prob, del_count) with the 17 features as columns.

    Without a reference, or for sites outside it, context is neutral: GC 0.5, runs of 1, no flags.
    """
    counted = observed_features(sites, observed)
    filled = sites.drop("depth", "alt_count").join(counted, SITE, "left")
    zero = lambda c, x: F.coalesce(F.col(c).cast("double"), F.lit(x))
    rf, rr, af, ar = (F.coalesce(F.col(c), F.lit(0)) + 1 for c in ("_rf", "_rr", "_af", "_ar"))
    odds = rf * ar / (rr * af)
    symmetric = F.log(odds + 1 / odds) + F.log(F.least(rf, rr) / F.greatest(rf, rr)) - F.log(F.least(af, ar) / F.greatest(af, ar))
    depth, deleted = F.coalesce("depth", F.lit(0)), F.coalesce("del_count", F.lit(0))
    out = filled.withColumns(
        {
            "depth": depth, "alt_count": F.coalesce("alt_count", F.lit(0)), "mean_mapq": zero("mean_mapq", 0.0), "mean_bq_alt": zero("mean_bq_alt", 0.0), "mean_bq_ref": zero("mean_bq_ref", 0.0),
            "n_distinct_alt": F.coalesce("n_distinct_alt", F.lit(0)), "alt_pos_on_read_mean": zero("alt_pos_on_read_mean", 0.5), "alt_pos_on_read_std": zero("alt_pos_on_read_std", 0.0),
            "strand_sor": symmetric, "del_frac": F.coalesce(F.try_divide(deleted, depth + deleted), F.lit(0.0)), "is_transition": is_transition(F.col("ref"), F.col("alt")).cast("int"),
        }
    ).drop("_rf", "_rr", "_af", "_ar")
    if tiles is None:
        return out.withColumns({"gc_content_11bp": F.lit(0.5), "homopolymer_len": F.lit(1), "is_homopolymer_ge5": F.lit(0), "creates_homopolymer": F.lit(0), "flanking_is_AT": F.lit(0)})
    near = out.join(sequence_window(sites, tiles, tile), ["chrom", "pos"], "left")
    padded, at = F.rpad("window", 2 * FLANK + 1, "N"), F.col("at").cast("int")
    before, after = F.substring(padded, at, F.lit(1)), F.substring(padded, at + 2, F.lit(1))
    inside = (at > 0) & (at < F.char_length(padded) - 1)
    flag = lambda c: F.when(inside & c, 1).otherwise(0)
    near = near.withColumns({"gc_content_11bp": F.coalesce(gc_share(padded), F.lit(0.5)), "homopolymer_len": F.coalesce(longest_run(padded), F.lit(1))})
    near = near.withColumns({"is_homopolymer_ge5": (F.col("homopolymer_len") >= RUN).cast("int"), "creates_homopolymer": flag(F.col("alt").isin(before, after)), "flanking_is_AT": flag(before.isin("A", "T") & after.isin("A", "T"))})
    return near.drop("window", "at")


def scored_sites(features: DataFrame, scorer: Callable[[pd.DataFrame], np.ndarray], gene: list[str]) -> DataFrame:
    """features with ``score``, the scorer's probability that a site is real.

    The scorer takes the 17 columns of a batch and is sent to each executor once. It isn't asked about
    genes with a site that no read shows: their scores are NULL.
    """
    held = features.sparkSession.sparkContext.broadcast(scorer)

    def probability(x: pd.DataFrame) -> pd.Series:
        return pd.Series(np.asarray(held.value(x[FEATURES].astype(float)), float))

    score = F.pandas_udf(probability, "double")(F.struct(*FEATURES))
    bare = F.bool_or(F.col("depth") == 0).over(Window.partitionBy(*gene))
    return features.withColumn("_bare", bare).withColumn("score", score).withColumn("score", F.when(~F.col("_bare"), F.col("score"))).drop("_bare")


def hard_filter(scored: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Sites whose score reaches the threshold, and all sites that weren't scored."""
    return scored.where(F.col("score").isNull() | (F.col("score") >= threshold))


@dataclass(frozen=True)
class Logistic:
    """A plain scorer: the logistic function of a weighted sum of features."""

    weights: dict[str, float]
    bias: float

    def __call__(self, x: pd.DataFrame) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum(x[c].to_numpy(float) * v for c, v in self.weights.items()))))
