"""From phased reads to imbalance tables.

CellType is a column, with ``Bulk`` beside the cell types: one plan for all samples and types.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alleles import legacy_text, refined_marker, snv_haplotype
from ..functions.tests_of_fit import chi2_2x2, chi2_sf

BULK = "Bulk"


def with_bulk(df: DataFrame, column: str = "CellType") -> DataFrame:
    """Every row once as Bulk and once under its cell type, if it has one."""
    return df.withColumn(column, F.explode(F.array_compact(F.array(F.lit(BULK), F.col(column)))))


def read_weights(mapping: DataFrame, phased: DataFrame, gene: list[str]) -> DataFrame:
    """Mapping rows with the haplotype weights of their reads (J1); unphased reads keep NULL."""
    return mapping.join(phased, [*gene, "Read"], "left")


def isoform_counts(rows: DataFrame, by: list[str], isoform: str = "Isoform") -> DataFrame:
    """Haplotype weights per cell and isoform, all reads and phasable ones."""
    only = lambda c: F.sum(F.when(F.col("reads_phasable") == 1, F.col(c)).otherwise(0.0))
    return rows.groupBy(*by, isoform).agg(F.sum("hat_I").alias("hapA"), F.sum("hat_I_B").alias("hapB"), only("hat_I").alias("hapA_phasable"), only("hat_I_B").alias("hapB_phasable"))


def gene_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """Row sums over isoforms."""
    return counts.groupBy(*by).agg(F.sum("hapA").alias("hapA"), F.sum("hapB").alias("hapB"))


def triples(counts: DataFrame, value: str) -> DataFrame:
    """Non-zero cells only."""
    return counts.where(F.col(value) != 0)


def pooled_isoforms(counts: DataFrame, by: list[str], isoform: str = "Isoform", share: float = 0.1, pool_novel: bool = False, prefix: str | None = None) -> DataFrame:
    """Isoforms with enough of either haplotype, the rest as Other, novel ones as Novel if asked.

    With ``prefix``, a column of ``by``, pooled rows are named ``<prefix>_Other`` and ``<prefix>_Novel``.
    """
    label = lambda x: F.concat(F.col(prefix), F.lit(x)) if prefix else F.lit(x)
    kept = counts.where(~F.lower(F.col(isoform)).contains("uncategorized"))
    name = F.when(F.lower(F.col(isoform)).contains("novel"), label("_Novel")).otherwise(F.col(isoform)) if pool_novel else F.col(isoform)
    once = kept.withColumn(isoform, name).groupBy(*by, isoform).agg(F.sum("hapA").alias("hapA"), F.sum("hapB").alias("hapB"))
    group = Window.partitionBy(*by)
    part = lambda c: F.col(c) / F.nullif(F.sum(c).over(group), F.lit(0.0))
    enough = F.coalesce(part("hapA") >= share, F.lit(False)) | F.coalesce(part("hapB") >= share, F.lit(False))
    marked = once.withColumn("_keep", enough)
    return marked.withColumn(isoform, F.when(F.col("_keep"), F.col(isoform)).otherwise(label("_Other"))).groupBy(*by, isoform).agg(F.sum("hapA").alias("hapA"), F.sum("hapB").alias("hapB"))


def most_imbalanced(tables: DataFrame, items: str = "missing", a: str = "totalA", b: str = "totalB") -> DataFrame:
    """Give each missing isoform in order to the haplotype of which it would be the larger share.

    ``items`` is an ordered array of weights; zero weights are passed over. Against an empty other
    side a share counts as infinite; ties go to the larger total, then to A. ``_imbalance`` has the
    totals (a, b) and ``rows``, what each isoform adds to either side, for the test on the table.
    """
    none = F.expr("cast(array() as array<struct<a:double,b:double>>)")
    zero = F.struct(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"), none.alias("rows"))

    def step(s: Column, w: Column) -> Column:
        share = lambda own, other: F.when(other > 0, w / (own + w)).otherwise(F.lit(float("inf")))
        to_a, to_b = share(s["a"], s["b"]), share(s["b"], s["a"])
        on_a = (to_a > to_b) | ((to_a == to_b) & (s["a"] >= s["b"]))
        row = F.struct(F.when(on_a, w).otherwise(0.0).alias("a"), F.when(on_a, 0.0).otherwise(w).alias("b"))
        moved = F.struct((s["a"] + row["a"]).alias("a"), (s["b"] + row["b"]).alias("b"), F.concat(s["rows"], F.array(row)).alias("rows"))
        return F.when(w == 0, s).otherwise(moved)

    weights = F.transform(items, lambda w: w.cast("double"))
    return tables.withColumn("_imbalance", F.aggregate(weights, zero, step))


def p_bounds(*p: Column) -> tuple[Column, Column]:
    """(highest, lowest) of several p-values, NULLs aside."""
    return F.greatest(*p), F.least(*p)


def allelic_bounds(reads: DataFrame, by: list[str]) -> DataFrame:
    """Phasability bounds of the share of haplotype A, mapped to the minor haplotype."""
    on = F.col("reads_phasable") == 1
    b = reads.groupBy(*by).agg(F.avg(F.when(on, F.col("hat_I")).otherwise(0.0)).alias("low_A"), F.avg(F.when(on, F.col("hat_I")).otherwise(1.0)).alias("high_A"), F.avg("hat_I").alias("mean_A"), F.avg("hat_I_B").alias("mean_B"), F.count(F.lit(1)).alias("n_reads"), F.count_if(on).alias("n_reads_phasable"))
    major_b = F.col("mean_B") >= F.col("mean_A")
    return b.select(*by, "n_reads", "n_reads_phasable", F.when(major_b, "B").otherwise("A").alias("major_hap"), F.when(major_b, F.col("low_A")).otherwise(1 - F.col("high_A")).alias("alpha_hat_low"), F.when(major_b, F.col("high_A")).otherwise(1 - F.col("low_A")).alias("alpha_hat_high"))


def shrinkage_k(summary: DataFrame, by: list[str], reads: str = "n_reads") -> DataFrame:
    """max(1, 5 % of the median of Bulk reads) per sample."""
    k = summary.where(F.col("CellType") == BULK).groupBy(*by).agg(F.median(reads).alias("_median"))
    return k.select(*by, F.greatest(F.lit(1.0), F.coalesce(F.col("_median") * 0.05, F.lit(1.0))).alias("k"))


def ase_effect(n: Column, low: Column, high: Column, alpha: Column, k: Column) -> Column:
    """Shrunk log ratio of major to minor haplotype reads, four digits."""
    mean = F.coalesce((low + high) / 2, alpha)
    minor, major = n * mean + k, n - n * mean + k
    return F.bround(F.log2(major / F.greatest(minor, k)), 4)


def astu_effect(tables: DataFrame, by: list[str], k: str = "k", isoform: str = "Isoform") -> DataFrame:
    """Dominant isoform and its shrunk usage ratio between haplotypes.

    The dominant isoform has the largest sum; ties go to the first by name, with Other last.
    """
    group = Window.partitionBy(*by)
    order = [F.col(isoform).endswith("_Other"), F.col(isoform)]
    t = tables.withColumn("_a", F.sum("hapA").over(group)).withColumn("_b", F.sum("hapB").over(group)).withColumn("_n", F.count(F.lit(1)).over(group))
    t = t.where("_a > 0 AND _b > 0").withColumn("_r", F.row_number().over(group.orderBy((F.col("hapA") + F.col("hapB")).desc(), *order)))
    frac = lambda x, total: (F.col(x) + F.col(k)) / (F.col(total) + F.col(k) * F.sqrt("_n"))
    one = t.where("_r = 1").withColumn("fracA", frac("hapA", "_a")).withColumn("fracB", frac("hapB", "_b"))
    return one.select(*by, F.col(isoform).alias("dominant_isoform"), "fracA", "fracB", F.when(F.col("fracA") >= F.col("fracB"), "A").otherwise("B").alias("pref_hap"), F.log2(F.greatest("fracA", "fracB") / F.least("fracA", "fracB")).alias("es_astu"))


def refine_snvs(sites: DataFrame, gene: list[str], at_least: float = 0.5) -> DataFrame:
    """Confident sites by entropy-discounted marker probability, with their number per gene."""
    kept = sites.withColumn("hat_Z_prob_revised", refined_marker(F.col("h_m"), F.col("h_A"))).where(F.col("hat_Z_prob_revised") >= at_least)
    return kept.withColumn("gene_n_snvs_called", F.count(F.lit(1)).over(Window.partitionBy(*gene))).withColumn("snv_hap", snv_haplotype(F.col("h_A")))


def event_weights(isoforms: DataFrame, events: DataFrame, by: list[str], isoform: str = "Isoform") -> DataFrame:
    """Haplotype weights with and without each event.

    Weights are summed per isoform first, so that the join costs isoforms x their events.
    """
    per = isoforms.groupBy(*by, isoform).agg(F.sum("hapA").alias("a"), F.sum("hapB").alias("b"))
    total = per.groupBy(*by).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    keys = [c for c in by if c in events.columns]
    present = per.join(events, [*keys, isoform]).groupBy(*by, "event_type", "s", "e").agg(F.sum("a").alias("hapA_present"), F.sum("b").alias("hapB_present"))
    return present.join(total, by).withColumn("hapA_absent", F.col("ta") - F.col("hapA_present")).withColumn("hapB_absent", F.col("tb") - F.col("hapB_present")).drop("ta", "tb")


def event_tests(weights: DataFrame, min_reads: float = 10) -> DataFrame:
    """2 x 2 test of events with enough weight in all cells."""
    cells = [F.col(f"hap{h}_{s}") for h in "AB" for s in ("present", "absent")]
    total = cells[0] + cells[1] + cells[2] + cells[3]
    kept = weights.where((total >= min_reads) & (F.least(*cells) >= 1))
    chi = chi2_2x2(*cells)
    return kept.withColumn("chi2", chi).withColumn("event_p_value", chi2_sf(F.col("chi2"), 1))


def link_snvs(sites: DataFrame, events: DataFrame, exons: DataFrame, distance: int = 50) -> DataFrame:
    """Sites near events in spliced coordinates (J8, P16), nearest first and counted.

    Each distinct position is spliced once; events then meet the sites in the spliced bins, ``distance``
    wide, that they and their surroundings cover, so that hardly a pair is made that isn't kept.
    """
    own = exons.select("geneID", "s", "e").distinct()
    width = max(distance, 1)
    places = reduce(DataFrame.unionByName, [d.select("geneID", F.col(c).alias("_p")) for d, c in ((events, "s"), (events, "e"), (sites, "pos"))])
    spliced = covered_before(places, own, ["geneID"]).join(own.select("geneID").distinct(), "geneID", "left_semi")
    at = {c: spliced.select("geneID", F.col("_p").alias(c), F.col("_f").alias(f"_at_{c}")) for c in ("s", "e", "pos")}
    low, high = (F.floor((f("_at_s", "_at_e") + x) / width) for f, x in ((F.least, -distance), (F.greatest, distance)))
    binned = events.join(at["s"], ["geneID", "s"]).join(at["e"], ["geneID", "e"]).withColumn("_bin", F.explode(F.sequence(low, high)))
    found = sites.select("geneID", "chrom", "pos", "ref", "alt").join(at["pos"], ["geneID", "pos"]).withColumn("_bin", F.floor(F.col("_at_pos") / width))
    inside = F.col("pos").between(F.col("s"), F.col("e"))
    apart = F.least(*[F.abs(F.col("_at_pos") - F.col(f"_at_{c}")) for c in ("s", "e")])
    pairs = binned.join(found, ["geneID", "chrom", "_bin"]).withColumn("exonic_distance", F.when(inside, F.lit(0).cast("bigint")).otherwise(apart))
    near = pairs.where(F.col("exonic_distance") <= distance).drop("_bin", "_at_s", "_at_e", "_at_pos")
    genomic = F.when(inside, 0).otherwise(F.least(F.abs(F.col("pos") - F.col("s")), F.abs(F.col("pos") - F.col("e"))))
    event = Window.partitionBy("geneID", "chrom", "event_type", "s", "e")
    ranked = near.withColumn("genomic_distance", genomic).withColumn("linked_snv_count", F.count("pos").over(event))
    return ranked.withColumn("is_nearest", F.row_number().over(event.orderBy("exonic_distance", "genomic_distance", "pos")) == 1)


def raw_allele_events(alleles: DataFrame, membership: DataFrame, by: list[str]) -> DataFrame:
    """Allele x event counts of reads whose isoforms all agree on the event."""
    agreed = alleles.join(membership, ["geneID", "Read"]).groupBy(*by, "Read", "r").agg(F.bool_and("has").alias("all_in"), F.bool_or("has").alias("any_in")).where("all_in = any_in")
    n = lambda r, x: F.count_if((F.col("r") == r) & (F.col("all_in") == F.lit(x)))
    counts = agreed.groupBy(*by).agg(n(0, True).alias("ref_present"), n(0, False).alias("ref_absent"), n(1, True).alias("alt_present"), n(1, False).alias("alt_absent"))
    return counts.withColumn("raw_chi2", chi2_2x2(F.col("ref_present"), F.col("ref_absent"), F.col("alt_present"), F.col("alt_absent")))


def switching_pair(tables: DataFrame, by: list[str], transcript: str = "transcript") -> DataFrame:
    """The transcripts that lose and gain most usage between haplotypes; ties by name."""
    once = tables.groupBy(*by, transcript).agg(F.sum("hapA").alias("a"), F.sum("hapB").alias("b"))
    group = Window.partitionBy(*by)
    share = lambda c: F.col(c) / F.nullif(F.sum(c).over(group), F.lit(0.0))
    delta = once.withColumn("delta", F.round(share("b") - share("a"), 9)).where("delta IS NOT NULL")
    pick = F.struct("delta", transcript)
    return delta.groupBy(*by).agg(F.min(pick).alias("lo"), F.max(pick).alias("hi")).select(*by, F.col(f"lo.{transcript}").alias("down"), F.col("lo.delta").alias("down_delta"), F.col(f"hi.{transcript}").alias("up"), F.col("hi.delta").alias("up_delta"))


def junctions(exons: DataFrame, by: list[str]) -> DataFrame:
    """Gaps between neighbouring exons of a transcript."""
    order = Window.partitionBy(*by).orderBy("s", "e")
    pairs = exons.select(*by, "s", "e").distinct().withColumn("acceptor", F.lead("s").over(order))
    return pairs.where("acceptor > e").select(*by, F.col("e").alias("donor"), "acceptor")


def event_maps(isoform_exons: DataFrame, minimum: int = 5) -> DataFrame:
    """Exon and junction events of each isoform."""
    exon = isoform_exons.where(F.col("e") - F.col("s") >= minimum).select("geneID", "Isoform", F.lit("exon").alias("event_type"), "s", "e")
    gap = junctions(isoform_exons, ["geneID", "Isoform"]).select("geneID", "Isoform", F.lit("junction").alias("event_type"), F.col("donor").alias("s"), F.col("acceptor").alias("e"))
    return exon.unionByName(gap).distinct()


def gene_events(fallback: DataFrame, annotated: DataFrame) -> DataFrame:
    """Events with annotated junctions where a gene has them, else the fallback's."""
    named = annotated.select("geneID").distinct()
    exons = fallback.where("event_type = 'exon'")
    own = fallback.where("event_type = 'junction'").join(named, "geneID", "left_anti")
    return exons.unionByName(own).unionByName(annotated)


def merged_intervals(df: DataFrame, by: list[str], gap: int = 0) -> DataFrame:
    """Overlapping intervals of a group as one (P24), as gaps and islands over rows."""
    order = Window.partitionBy(*by).orderBy("s", "e")
    clean = df.where("e > s").select(*by, "s", "e").distinct()
    reach = clean.withColumn("_reach", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    new = reach.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("s") > F.col("_reach") + gap), 1).otherwise(0))
    island = new.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island")


def covered_before(places: DataFrame, intervals: DataFrame, by: list[str], width: int = 65_536) -> DataFrame:
    """Each distinct place (by, _p) with ``_f``, the bases of the group's intervals (s, e) before it.

    Running sums over end points, taken within ranges of ``width`` positions and carried over one
    narrow row per range; no pairs are made. Overlapping intervals count each.
    """
    point = lambda d, c, sign: d.select(*by, F.col(c).cast("bigint").alias("_p"), F.lit(sign).alias("_n"))
    clean = intervals.where("e > s")
    ends = point(clean, "s", 1).unionByName(point(clean, "e", -1)).unionByName(point(places, "_p", 0))
    points = ends.groupBy(*by, "_p").agg(F.sum("_n").alias("_n")).withColumn("_range", F.floor(F.col("_p") / width)).withColumn("_m", F.col("_n") * F.col("_p"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = points.groupBy(*by, "_range").agg(F.sum("_n").alias("_n"), F.sum("_m").alias("_m"))
    carried = ranges.select(*by, "_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("_n", "_m")])
    inside = Window.partitionBy(*by, "_range").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    run = points.withColumns({c: F.sum(c).over(inside) for c in ("_n", "_m")}).join(carried, [*by, "_range"])
    return run.select(*by, "_p", (F.col("_p") * (F.col("_n") + F.col("_n0")) - F.col("_m") - F.col("_m0")).alias("_f"))


def overlap_sums(df: DataFrame, others: DataFrame, by: list[str], width: int = 65_536) -> DataFrame:
    """df (by, s, e) with ``bp``, the bases it shares with all intervals of others in its group."""
    places = df.select(*by, F.col("s").alias("_p")).unionByName(df.select(*by, F.col("e").alias("_p")))
    covered = covered_before(places, others, by, width)
    low, high = (covered.withColumnsRenamed({"_p": c, "_f": f"_f_{c}"}) for c in ("s", "e"))
    typed = df.withColumns({c: F.col(c).cast("bigint") for c in ("s", "e")})
    return typed.join(low, [*by, "s"]).join(high, [*by, "e"]).withColumn("bp", F.greatest(F.lit(0), F.col("_f_e") - F.col("_f_s"))).drop("_f_s", "_f_e")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing without the keys of new, and new."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def missing(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a step should have and hasn't."""
    return expected.select(*keys).distinct().join(found.select(*keys).distinct(), keys, "left_anti")


def collapse_suffixes(df: DataFrame, names: list[str]) -> DataFrame:
    """Merge ``x``/``y`` column pairs of an old join; rows whose values disagree go."""
    out = df
    for n in names:
        x, y = f"{n}_x", f"{n}_y"
        if x in out.columns and y in out.columns:
            out = out.where(legacy_text(F.col(x)) == legacy_text(F.col(y))).withColumn(n, F.coalesce(x, y)).drop(x, y)
        elif x in out.columns:
            out = out.withColumnRenamed(x, n)
    return out
