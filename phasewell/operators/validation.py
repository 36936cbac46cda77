"""Variants near events, tested on raw reads: allele x event tables, exact or chi-square, FDR per gene.

Reads collapse early: alleles of a site are counted per set of isoforms, and events meet those few sets, so
that no row stands for a read and an event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tests_of_fit import bh_fdr, binomial_half, chi2_2x2, chi2_sf_one
from .switching import EVENT

SITE = ["geneID", "chrom", "pos"]
#: Fixed value: reads that a test needs.
MIN_READS = 10
COUNTS = ["raw_ref_present", "raw_ref_absent", "raw_alt_present", "raw_alt_absent"]


def read_alleles(observed: DataFrame, order: list[str]) -> DataFrame:
    """(geneID, chrom, pos, Read, allele): of several bases of a read at a site the last by ``order`` counts."""
    known = observed.withColumn("base", F.upper("base")).where(F.col("base").isin("A", "C", "G", "T"))
    return known.groupBy(*SITE, "Read").agg(F.max_by("base", F.struct(*order)).alias("allele"))


def _columns(gene: str, links: DataFrame) -> list[str]:
    return [gene, *EVENT, "chrom", "snv_pos", "snv_ref", "snv_alt", *[c for c in ("CellType",) if c in links.columns]]


def raw_validation(links: DataFrame, alleles: DataFrame, read_isoforms: DataFrame, events: DataFrame) -> DataFrame:
    """links with counts, statistic, p and adjusted p from raw reads; rows are kept, duplicates too.

    links: geneID, event_type, s, e, chrom, snv_pos, snv_ref, snv_alt, and CellType where reads are to be
    taken by cell type; alleles: ``read_alleles``; read_isoforms: geneID, Read, Isoform (and CellType);
    events: geneID, Isoform, event_type, s, e. A variant inside an exon event can't be missing from reads
    that have it, so there alleles are tested against one half; elsewhere reads whose isoforms agree on the
    event fill a 2 x 2 table. Variants without a base as alternative, and genes without events, get NULLs.
    """
    typed = "CellType" in links.columns
    cell = ["CellType"] if typed else []
    key = _columns("geneID", links)
    base = F.upper("snv_alt").isin("A", "C", "G", "T")
    pairs = links.select(*key).distinct().where(base).join(events.select("geneID").distinct(), "geneID", "left_semi")
    pairs = pairs.withColumn("intra", (F.col("event_type") == "exon") & F.col("snv_pos").between(F.col("s"), F.col("e")))
    sets = read_isoforms.groupBy(*cell, "geneID", "Read").agg(F.array_sort(F.collect_set("Isoform")).alias("isoforms"))  # at most a gene's isoforms
    site = [*cell, *SITE]
    tallies = alleles.join(sets, ["geneID", "Read"]).groupBy(*site, "allele", "isoforms").agg(F.count(F.lit(1)).alias("n"))
    having = events.groupBy("geneID", *EVENT).agg(F.collect_set("Isoform").alias("having"))
    met = pairs.where("NOT intra").join(having, ["geneID", *EVENT], "left").withColumn("pos", F.col("snv_pos")).join(tallies, site)
    shared = F.size(F.array_intersect("isoforms", F.coalesce("having", F.array().cast("array<string>"))))
    told = met.withColumn("present", F.when(shared == F.size("isoforms"), True).when(shared == 0, False)).where("present IS NOT NULL")

    def count(allele: str, present: bool | None) -> Column:
        own = F.col("allele") == F.upper(allele)
        return F.sum(F.when(own if present is None else own & (F.col("present") == F.lit(present)), F.col("n")).otherwise(0))

    across = told.groupBy(*key).agg(*[count(a, p).alias(c) for c, (a, p) in zip(COUNTS, (("snv_ref", True), ("snv_ref", False), ("snv_alt", True), ("snv_alt", False)), strict=True)])
    if typed:
        alleles = alleles.join(read_isoforms.select(*cell, "geneID", "Read").distinct(), ["geneID", "Read"])
    per_site = alleles.groupBy(*site, "allele").agg(F.count(F.lit(1)).alias("n"))
    inside = pairs.where("intra").withColumn("pos", F.col("snv_pos")).join(per_site, site).groupBy(*key).agg(count("snv_ref", None).alias(COUNTS[0]), count("snv_alt", None).alias(COUNTS[2]))
    counted = across.unionByName(inside, allowMissingColumns=True)
    full = pairs.alias("p").join(counted.alias("c"), [F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}")) for c in key], "left").select("p.*", *[F.coalesce(F.col(f"c.{c}"), F.lit(0).cast("bigint")).alias(c) for c in COUNTS])
    rp, ra, ap, aa = (F.col(c) for c in COUNTS)
    chi = F.when(rp + ra + ap + aa >= MIN_READS, chi2_2x2(rp, ra, ap, aa))  # NULL on an empty margin
    full = full.withColumn("raw_chi2", F.when(~F.col("intra"), chi))
    exact = F.when(rp + ap >= MIN_READS, binomial_half(ap, rp + ap))
    p = F.when(F.col("intra"), exact).otherwise(chi2_sf_one(F.col("raw_chi2")))
    kind = F.when(F.col("intra"), "binomial_intra_event").otherwise("chi2_cross_event")
    full = full.withColumns({"raw_p_value": p, "raw_test_type": kind}).drop("intra")
    out = links.alias("l").join(full.alias("f"), [F.col(f"l.{c}").eqNullSafe(F.col(f"f.{c}")) for c in key], "left")
    out = out.select("l.*", *[f"f.{c}" for c in (*COUNTS, "raw_chi2", "raw_p_value", "raw_test_type")])
    return bh_fdr(out, "raw_p_value", "raw_p_value_adj", [*cell, "geneID"], [*EVENT, "snv_pos"])
