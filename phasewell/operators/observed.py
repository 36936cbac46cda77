"""What alignments say of exon and junction events (A24, J6, P17), without pairing reads and events.

Reads of the same blocks and introns count together. Of those, only what an event can see is kept apart: runs
of blocks that one exon can reach, pairs of blocks that can hold the flanks of one junction, and introns by
the exons that they can swallow. Each distinct one is judged once, against the events in its bins, and its
weight goes into the sums of events where it is judged. Who says nothing of an event is the rest of the total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import EVENT_OVERLAP, EVENT_SHARE, JUNCTION_FLANK, JUNCTION_SLACK, merge_intervals, overlap, overlap_bp
from ..sources.shared import written
from .switching import EVENT

#: Positions in a bin for blocks, and for introns.
WIDTH, LONG = 128, 8192


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor((end - 1) / width)))


def _sums() -> list[Column]:
    return [F.sum("a").alias("a"), F.sum("b").alias("b")]


def block_shapes(reads: DataFrame, blocks: DataFrame, gene: list[str]) -> DataFrame:
    """(gene, blocks, introns, a, b): weights of the reads of the same alignment; blocks are NULL where a read has none."""
    once = reads.groupBy(*gene, "Read").agg(F.min("hat_I").alias("a"), F.min("hat_I_B").alias("b"))
    known = once.join(blocks.select("geneID", "Read", "blocks", "introns"), ["geneID", "Read"], "left")
    return known.groupBy(*gene, "blocks", "introns").agg(*_sums())


def _exon_includes(shapes: DataFrame, exons: DataFrame, gene: list[str]) -> DataFrame:
    """Runs of blocks whose gaps a gene's longest exon could bridge, against the exons that they meet."""
    reach = exons.groupBy("geneID").agg(F.max(F.col("e") - F.col("s")).alias("_reach"))
    u = F.col("u")
    begins = F.filter(F.sequence(F.lit(0), F.size(u) - 1), lambda i: (i == 0) | (F.get(u, i)["s"] - F.get(u, i - 1)["e"] >= F.col("_reach")))
    near = shapes.join(F.broadcast(reach), "geneID").withColumn("_begins", begins)  # one row per gene
    runs = F.transform("_begins", lambda x, k: F.slice(u, x + 1, F.coalesce(F.get("_begins", k + 1), F.size(u)) - x))
    run = near.select(*gene, "a", "b", F.explode(F.when(F.size(u) == 1, F.array(u)).otherwise(runs)).alias("run")).groupBy(*gene, "run").agg(*_sums())
    # a run reports an exon with its first block that meets it
    block = run.select(*gene, "run", "a", "b", F.posexplode("run").alias("k", "x"))
    block = block.select(*gene, F.when(F.size("run") > 1, F.col("run")).alias("run"), "a", "b", F.col("x.s").alias("bs"), F.col("x.e").alias("be"), F.when(F.col("k") > 0, F.get("run", F.col("k") - 1)["e"]).alias("before"))
    met = block.withColumn("_bin", _bins(F.col("bs"), F.col("be"), WIDTH)).join(exons.withColumn("_bin", _bins(F.col("s"), F.col("e"), WIDTH)), ["geneID", "_bin"])
    met = met.where("bs < e AND be > s AND (before IS NULL OR before <= s)").where(F.col("_bin") == F.floor(F.greatest("bs", "s") / WIDTH))
    s, e = F.col("s"), F.col("e")
    bp = F.when(F.col("run").isNull(), overlap(F.col("bs"), F.col("be"), s, e)).otherwise(overlap_bp(s, e, F.col("run")))
    need = F.greatest(F.lit(1), F.least(F.lit(EVENT_OVERLAP), F.floor((e - s) * EVENT_SHARE)))
    return met.where(bp >= need).select(*gene, *EVENT, F.lit("include").alias("said"), "a", "b")


def _junction_votes(shapes: DataFrame, junctions: DataFrame, gene: list[str]) -> DataFrame:
    """Pairs of blocks (or one twice) that can hold the left and the right flank of a gene's junctions, against those."""
    span = F.col("e") - F.col("s")
    reach = junctions.groupBy("geneID").agg(F.min(span).alias("_least"), F.max(span).alias("_most"))
    near = shapes.join(F.broadcast(reach), "geneID")  # one row per gene
    long = F.filter("u", lambda x: x["e"] - x["s"] >= JUNCTION_FLANK)
    fits = lambda x: lambda y: (y["s"] - x["e"] <= F.col("_most")) & (y["e"] - x["s"] - 2 * JUNCTION_FLANK >= F.col("_least"))
    both = F.flatten(F.transform("_long", lambda x: F.transform(F.filter("_long", fits(x)), lambda y: F.struct(x["s"].alias("ls"), x["e"].alias("le"), y["s"].alias("rs"), y["e"].alias("re")))))
    pair = near.withColumn("_long", long).where(F.size("_long") > 0).select(*gene, "a", "b", "introns", F.explode(both).alias("p")).select(*gene, "a", "b", "introns", "p.*")
    # an intron that matches a junction lies between the blocks of its flanks
    between = F.when(F.col("le") <= F.col("rs"), F.filter("introns", lambda x: (x["s"] >= F.col("le")) & (x["e"] <= F.col("rs"))))
    pair = pair.withColumn("between", between).groupBy(*gene, "ls", "le", "rs", "re", "between").agg(*_sums())
    met = pair.withColumn("_bin", _bins(F.col("ls") + JUNCTION_FLANK, F.col("le") + 1, WIDTH)).join(junctions.withColumn("_bin", F.floor(F.col("s") / WIDTH)), ["geneID", "_bin"])
    met = met.where(f"ls <= s - {JUNCTION_FLANK} AND s <= le AND rs <= e AND e + {JUNCTION_FLANK} <= re")
    close = lambda x: (F.abs(x["s"] - F.col("s")) <= JUNCTION_SLACK) & (F.abs(x["e"] - F.col("e")) <= JUNCTION_SLACK)
    return met.select(*gene, *EVENT, F.when(F.exists("between", close), "include").otherwise("skip").alias("said"), "a", "b")


def _nearest(asked: DataFrame, marks: DataFrame, after: bool) -> DataFrame:
    """(geneID, p, to): for each asked place p of a gene the nearest mark at or after (or at or before) it; no row where there is none."""
    rows = asked.withColumn("_mark", F.lit(False)).unionByName(marks.withColumn("_mark", F.lit(True)))
    order = Window.partitionBy("geneID").orderBy("p")
    order = order.rangeBetween(Window.currentRow, Window.unboundedFollowing) if after else order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(F.col("_mark"), F.col("p"))
    return rows.withColumn("to", (F.min(mark) if after else F.max(mark)).over(order)).where("NOT _mark AND to IS NOT NULL").select("geneID", "p", "to")


def _exon_skips(shapes: DataFrame, exons: DataFrame, gene: list[str]) -> DataFrame:
    """Introns inside their read by the first exon start and the last exon end in them, against the exons between."""
    first, last = F.array_min(F.transform("blocks", lambda x: x["s"])), F.array_max(F.transform("blocks", lambda x: x["e"]))
    inner = shapes.where(F.size("introns") > 0).select(*gene, "a", "b", F.explode(F.filter("introns", lambda x: (first < x["s"]) & (last > x["e"]))).alias("i"))
    introns = written(inner.groupBy(*gene, F.col("i.s").alias("is"), F.col("i.e").alias("ie")).agg(*_sums()))
    place = lambda df, c: df.select("geneID", F.col(c).alias("p")).distinct()
    starts = _nearest(place(introns, "is"), place(exons, "s"), True).withColumnsRenamed({"p": "is", "to": "lo"})
    ends = _nearest(place(introns, "ie"), place(exons, "e"), False).withColumnsRenamed({"p": "ie", "to": "hi"})
    classes = introns.join(starts, ["geneID", "is"]).join(ends, ["geneID", "ie"]).groupBy(*gene, "lo", "hi").agg(*_sums())
    met = classes.withColumn("_bin", _bins(F.col("lo"), F.greatest("hi", F.col("lo") + 1), LONG)).join(exons.withColumn("_bin", F.floor(F.col("s") / LONG)), ["geneID", "_bin"])
    return met.where("lo <= s AND hi >= e").select(*gene, *EVENT, F.lit("skip").alias("said"), "a", "b")


def observed_events(reads: DataFrame, blocks: DataFrame, events: DataFrame, gene: list[str]) -> DataFrame:
    """(gene, event, obs_A_include ... obs_B_unobserved): haplotype weights by what reads say.

    reads: gene, Read, hat_I, hat_I_B, where a read counts once however many isoforms it has; blocks:
    geneID, Read, blocks, introns (arrays of s, e; blocks are disjoint, introns lie between them), one row
    per read. Reads without blocks are unobserved everywhere. Events: geneID, event_type, s, e.
    """
    events = events.select("geneID", *EVENT).distinct()
    exons, junctions = events.where("event_type = 'exon'"), events.where("event_type = 'junction'")
    shapes = written(block_shapes(reads, blocks, gene))
    known = shapes.withColumn("u", F.when(F.size("blocks") == 1, F.filter("blocks", lambda x: x["e"] > x["s"])).otherwise(merge_intervals(F.col("blocks")))).where(F.size("u") > 0)
    said = _exon_includes(known, exons, gene).unionByName(_junction_votes(known, junctions, gene)).unionByName(_exon_skips(shapes, exons, gene))
    part = lambda w, x: F.sum(F.when(F.col("said") == x, F.col(w)).otherwise(0.0))
    told = said.groupBy(*gene, *EVENT).agg(*[part(w, x).alias(f"obs_{h}_{x}") for h, w in (("A", "a"), ("B", "b")) for x in ("include", "skip")])
    total = shapes.groupBy(*gene).agg(F.sum("a").alias("_A"), F.sum("b").alias("_B"))
    out = total.join(events, "geneID").join(told, [*gene, *EVENT], "left").fillna(0.0, [f"obs_{h}_{x}" for h in "AB" for x in ("include", "skip")])
    rest = {f"obs_{h}_unobserved": F.greatest(F.lit(0.0), F.col(f"_{h}") - F.col(f"obs_{h}_include") - F.col(f"obs_{h}_skip")) for h in "AB"}
    return out.withColumns(rest).select(*gene, *EVENT, *[f"obs_{h}_{x}" for h in "AB" for x in ("include", "skip", "unobserved")])
