"""Isoform switching: transcript structures, boundaries between two of them, events there.

Events are rows (geneID, event_type, s, e). What one gene's graph of touching events reaches is found for
all genes at once, by joins on positions, so a gene with many events is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .downstream import junctions, merged_intervals

EVENT = ["event_type", "s", "e"]
#: Fixed value: how transcript names are found in isoform names.
TRANSCRIPT = r"ENST\d+"
#: Fixed value: shorter exons are no events of a gene.
MIN_EXON = 5


def transcript_of(name: Column, pattern: str = TRANSCRIPT) -> Column:
    """The transcript that an isoform's name holds, NULL if none."""
    return F.nullif(F.regexp_extract(name, f"({pattern})", 1), F.lit(""))


def junction_index(gtf_exons: DataFrame) -> DataFrame:
    """Annotated junctions (geneID, Isoform, s, e) of the transcripts of a GTF's exon rows."""
    exons = gtf_exons.where("geneID IS NOT NULL AND transcript IS NOT NULL").select("geneID", F.col("transcript").alias("Isoform"), "s", "e")
    return junctions(exons, ["geneID", "Isoform"]).select("geneID", "Isoform", F.col("donor").alias("s"), F.col("acceptor").alias("e"))


def isoform_events(exons: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(geneID, Isoform, event_type, s, e) from the sub-exons of isoforms.

    Junctions are the annotated ones of an isoform where ``index`` knows its gene, else the gaps between
    neighbouring sub-exons, gaps of no length among them.
    """
    own = exons.select("geneID", "Isoform", "s", "e").distinct()
    after = F.lead("s").over(Window.partitionBy("geneID", "Isoform").orderBy("s", "e"))
    gaps = own.select("geneID", "Isoform", F.col("e").alias("s"), after.alias("e")).where("e IS NOT NULL")
    if index is not None:
        gaps = gaps.join(index.select("geneID").distinct(), "geneID", "left_anti")
        gaps = gaps.unionByName(index.join(own.select("geneID", "Isoform").distinct(), ["geneID", "Isoform"], "left_semi").select("geneID", "Isoform", "s", "e"))
    kind = lambda d, name: d.select("geneID", "Isoform", F.lit(name).alias("event_type"), "s", "e")
    return kind(own, "exon").unionByName(kind(gaps, "junction")).distinct()


def gene_events(events: DataFrame) -> DataFrame:
    """The distinct events of a gene, without tiny exons and empty junctions."""
    counts = F.when(F.col("event_type") == "exon", F.col("e") - F.col("s") >= MIN_EXON).otherwise(F.col("s") != F.col("e"))
    return events.where(counts).select("geneID", *EVENT).distinct()


def transcript_structures(events: DataFrame, pattern: str = TRANSCRIPT) -> DataFrame:
    """Events of all isoforms of a transcript, and as ``merged`` its exons joined where they meet.

    Columns: geneID, transcript, n_isoforms, event_type, s, e.
    """
    named = events.withColumn("transcript", transcript_of(F.col("Isoform"), pattern)).where("transcript IS NOT NULL")
    by = ["geneID", "transcript"]
    isoforms = named.where("event_type = 'exon'").groupBy(*by).agg(F.countDistinct("Isoform").alias("n_isoforms"))
    merged = merged_intervals(named.where("event_type = 'exon'"), by).withColumn("event_type", F.lit("merged"))
    rows = named.select(*by, *EVENT).distinct().unionByName(merged.select(*by, *EVENT))
    return rows.join(isoforms, by)


def switching_boundaries(structures: DataFrame, pairs: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(boundaries, shared events) of the pairs ``down`` and ``up`` of each group (U4).

    A boundary is a start or end of exons of both transcripts at which one of them has some events that
    the other has and some that it hasn't, or a single event that the other hasn't.
    """
    sides = pairs.select(*by, F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("down").alias("transcript")), F.struct(F.lit("b").alias("side"), F.col("up").alias("transcript")))).alias("t")).select(*by, "t.*")
    own = sides.join(structures.where("event_type <> 'merged'").select("geneID", "transcript", *EVENT).distinct(), ["geneID", "transcript"])
    seen = own.groupBy(*by, *EVENT).agg(F.collect_set("side").alias("sides")).withColumn("both", F.size("sides") == 2)
    places = seen.withColumn("side", F.explode("sides")).withColumn("pos", F.explode(F.array_distinct(F.array("s", "e"))))
    at = places.groupBy(*by, "pos", "side").agg(F.count(F.lit(1)).alias("n"), F.count_if("both").alias("n_both"), F.bool_or(F.col("event_type") == "exon").alias("exon"))
    told = ((F.col("n_both") > 0) & (F.col("n_both") < F.col("n"))) | ((F.col("n") == 1) & (F.col("n_both") == 0))
    kept = at.groupBy(*by, "pos").agg(F.count_if("exon").alias("exons"), F.bool_or(told).alias("told")).where("exons = 2 AND told")
    return kept.select(*by, "pos"), seen.where("both").select(*by, *EVENT)


def touching(events: DataFrame, by: list[str], max_rounds: int = 64) -> DataFrame:
    """(by, pos, label): positions that chains of events (s, e) connect share a label, their smallest one.

    Each round takes the smallest label among neighbours and then that label's own label, so chains
    along a gene halve with every round; rounds end when no label changes.
    """
    edges = written(events.select(*by, "s", "e").distinct())
    both = edges.unionByName(edges.select(*by, F.col("e").alias("s"), F.col("s").alias("e")))
    labels = written(both.groupBy(*by, F.col("s").alias("pos")).agg(F.min(F.least("s", "e")).alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("pos", "e"), [*by, "e"]).groupBy(*by, F.col("s").alias("pos")).agg(F.min("label").alias("near"))
        closer = labels.join(near, [*by, "pos"]).select(*by, "pos", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(*by, F.col("pos").alias("label"), F.col("label").alias("further"))
        after = written(closer.join(jump, [*by, "label"], "left").select(*by, "pos", "old", F.least("label", "further").alias("label")))
        changed = not after.where("old <> label").isEmpty()
        labels = after.drop("old")
        if not changed:
            return labels
    raise RuntimeError(f"labels of touching events still change after {max_rounds} rounds")


def boundary_events(structures: DataFrame, events: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """Events of a gene on the switching boundaries of a pair, and all that touch those (G1).

    events: geneID, event_type, s, e; pairs: by (geneID among them), down and up. Events that both
    transcripts have are left out, and nothing is reached through them.
    """
    pairs = pairs.where("down <> up")
    boundaries, shared = switching_boundaries(structures, pairs, by)
    boundaries = written(boundaries)
    free = written(pairs.select(*by).distinct().join(boundaries.select(*by).distinct(), by, "left_semi").join(events, "geneID").join(shared, [*by, *EVENT], "left_anti").select(*by, *EVENT))
    labels = touching(free, by)
    reached = labels.join(boundaries, [*by, "pos"], "left_semi").select(*by, "label").distinct()
    places = labels.join(reached, [*by, "label"], "left_semi").select(*by, F.col("pos").alias("s"))
    return free.join(places, [*by, "s"], "left_semi").select(*by, *EVENT)


def significant_genes(summary: DataFrame, threshold: float = 0.05, by: tuple[str, ...] = ("geneID", "CellType")) -> DataFrame:
    """Genes whose isoform usage differs between haplotypes: adjusted p at most ``threshold``."""
    return summary.where(F.col("p_value_isoform_adj") <= threshold).select(*by).distinct()


def filter_events(events: DataFrame, mode: str, fdr: float = 0.05, boundary: DataFrame | None = None, by: tuple[str, ...] = ("geneID", "CellType")) -> DataFrame:
    """Events by mode (F20): ``all_events``, ``fdr_events`` (p_value_adj at most fdr) or ``switching_events``."""
    if mode == "all_events":
        return events
    if mode == "fdr_events":
        return events.where(F.col("p_value_adj") <= fdr)
    if mode != "switching_events" or boundary is None:
        raise ValueError(f"unknown mode of events, or no boundary events for it: {mode}")
    return events.join(boundary, [*by, *EVENT], "left_semi")
