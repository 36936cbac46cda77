"""The filters of a gene's sites in their order, from calls to what is fitted.

Each step is a DataFrame of the step before; rules for one gene (steps of the threshold, the best sites by
exon length, genes that a scorer skips) are windows over its sites, so all genes go through one plan. The
observations are read once, for qualities and features.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import in_repeat
from . import features, phasing, pileup
from .calling import SITE, em_table


@dataclass(frozen=True)
class Limits:
    """What a site needs. Defaults are fixed values of the surveyed settings."""

    alt: int = 10
    depth: int = 20
    het: float = 0.99
    fallback: bool = True
    per_kilobase: float = 6.6
    kmer: int = 1
    run: int = 5
    flank: int = 20
    alt_stretch: int = 50
    cluster: int = 3
    cluster_window: int = 20
    alt_cluster: int = 150
    hard: float = 0.05
    prune_low: float = 0.1
    prune_share: float = 1.0


def read_quality(sites: DataFrame, codes: DataFrame) -> DataFrame:
    """sites with het_prob from the qualities of their reads (A9); sites that no read codes keep theirs."""
    told = phasing.quality_het_posterior(codes, SITE).withColumnRenamed("het_prob", "_het")
    return sites.join(told, SITE, "left").withColumn("het_prob", F.coalesce("_het", "het_prob")).drop("_het")


def het_step(sites: DataFrame, exons: DataFrame, limits: Limits) -> DataFrame:
    """Sites above the threshold (F4), or by gene those above the first threshold that leaves one, the best first, as many as its exons are long."""
    if limits.het < 0:
        return sites
    if not limits.fallback:
        return pileup.het_filter(sites, ["geneID"], limits.het)
    length = exons.groupBy("geneID").agg(F.ceil(limits.per_kilobase * F.sum(F.col("e") - F.col("s")) / 1000).alias("_most"))
    own = sites.join(length, "geneID", "left").withColumn("_most", F.coalesce("_most", F.lit(0)))
    return pileup.het_fallback(own, ["geneID"], "_most", limits.het).drop("_most")


def stretch_step(sites: DataFrame, tiles: DataFrame, tile: int, limits: Limits) -> DataFrame:
    """Sites outside repeats, and well supported ones inside (F6); sites beyond the reference stay."""
    window = features.sequence_window(sites, tiles, tile, limits.flank)
    near = sites.join(window, ["chrom", "pos"], "left")
    inside = F.coalesce(in_repeat(F.col("window"), F.col("at").cast("int"), limits.kmer, limits.run), F.lit(False))
    return near.where(~inside | (F.col("alt_count") >= limits.alt_stretch)).drop("window", "at")


def chained_filters(
    sites: DataFrame, observed: DataFrame, exons: DataFrame, limits: Limits = Limits(), *, tiles: DataFrame | None = None, tile: int = 0, edits: DataFrame | None = None,
    novel: DataFrame | None = None, confidence: DataFrame | None = None, scorer: Callable | None = None,
) -> dict[str, DataFrame]:
    """Survivors by step, in order; the last is what is fitted.

    sites: geneID, chrom, pos, ref, alt_count, depth, het_prob (and del_count); observed: observations of
    ``calling``; exons: geneID, s, e. A list of trusted sites (``confidence``: chrom, pos and perhaps ref, more
    columns come along) takes the place of all later steps. Steps without their table are left out.
    """
    steps = {"depth": sites.where((F.col("alt_count") > limits.alt) & (F.col("depth") >= limits.depth))}
    codes = em_table(steps["depth"], observed)
    now = steps["quality"] = read_quality(steps["depth"], codes)
    if confidence is not None:
        keys = [c for c in ("chrom", "pos", "ref") if c in confidence.columns]
        steps["trusted"] = now.join(confidence.select(*keys, *[c for c in confidence.columns if c not in now.columns]), keys)
        return steps
    now = steps["het"] = het_step(now, exons, limits)
    if tiles is not None:
        now = steps["stretch"] = stretch_step(now, tiles, tile, limits)
    alts = pileup.alt_vote(observed, SITE).select(*SITE, "alt")
    now = now.join(alts, SITE, "left")
    if edits is not None:
        now = steps["editing"] = pileup.editing_sites(now, edits)
    now = steps["cluster"] = pileup.variant_clusters(now, ["geneID"], limits.cluster, limits.cluster_window, limits.alt_cluster)
    if novel is not None:
        now = steps["novel"] = pileup.outside_intervals(now, novel)
    if scorer is not None:
        full = features.site_features(now, observed, tiles, tile)
        now = steps["scored"] = features.hard_filter(features.scored_sites(full, scorer, ["geneID"]), limits.hard)
        if limits.prune_share < 1:
            known = pileup.prune_by_score(now.where("score IS NOT NULL"), ["geneID"], "score", limits.prune_low, limits.prune_share)
            steps["pruned"] = known.unionByName(now.where("score IS NULL"))
    return steps
