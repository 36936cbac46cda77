"""From alignments of all samples to sites, their observations and EM input, in two passes.

Pass one counts bases: exploded rows are counted by site and base where they are read, before the reference
is joined, so that only counts are shuffled. Pass two doesn't explode again: the CIGAR pieces of reads meet
the few sites that pass one has kept in narrow bins of the reference, and give one row per site that they
cover. Thresholds hold for each sample; sites are then summed and observations united over samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alleles import canonical_read_name
from ..sources.shared import written
from .pileup import alt_vote, bases_at, candidates, em_input, explode_bases, joint_sites, pieces, primary, reads_in_genes, with_reference

SITE = ["geneID", "chrom", "pos"]
#: What tells two observations of a site apart, fixed: read, place in it, base, qualities, length, strand.
OBSERVED = ["Read", "qpos", "base", "baseq", "mapq", "read_len", "is_reverse"]
#: Positions of the reference in a bin.
WIDTH = 128


def near_end(ends: int) -> Column:
    """Whether a base lies within ``ends`` bases of an end of its read."""
    return (F.lit(ends) > 0) & (F.col("read_len") > 0) & (F.least(F.col("qpos"), F.col("read_len") - 1 - F.col("qpos")) < ends)


def gene_reads(alignments: DataFrame, genes: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Primary alignments with each gene that they overlap, both ends of its region in.

    With ``allowed`` (sample, geneID, Read) only reads that are assigned to the gene, by canonical names.
    """
    reads = reads_in_genes(primary(alignments), genes.withColumn("geneEnd", F.col("geneEnd") + 1)).withColumn("qname", canonical_read_name(F.col("qname")))
    if allowed is None:
        return reads
    names = allowed.select("sample", "geneID", canonical_read_name(F.col("Read")).alias("qname")).distinct()
    return reads.join(names, ["sample", "geneID", "qname"], "left_semi")


def count_sites(reads: DataFrame, genes: DataFrame, tiles: DataFrame, tile: int, min_baseq: int = 5, min_mapq: int = 20, ends: int = 3) -> DataFrame:
    """Pass one: (sample, geneID, chrom, pos, ref, depth, ref_count, alt_count, alt_frac) (F1, A1).

    Mismatches near a read's end don't count, matches there do.
    """
    bases = explode_bases(reads).where(~F.col("is_del") & (F.col("baseq") >= min_baseq) & (F.col("mapq") >= min_mapq) & F.col("base").isin("A", "C", "G", "T"))
    counted = bases.groupBy("sample", *SITE, "base", near_end(ends).alias("near")).agg(F.count(F.lit(1)).alias("n"))
    told = with_reference(counted, tiles, tile)
    match = F.col("base") == F.col("ref")
    part = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    sums = told.groupBy("sample", *SITE, "ref").agg(part(match).alias("ref_count"), part(~match & ~F.col("near")).alias("alt_count")).where("alt_count > 0")
    inside = genes.select("geneID", "geneStart", "geneEnd")
    depth = F.col("ref_count") + F.col("alt_count")
    return sums.join(inside, "geneID").where(F.col("pos").between(F.col("geneStart"), F.col("geneEnd"))).drop("geneStart", "geneEnd").withColumn("depth", depth).withColumn("alt_frac", F.col("alt_count") / depth)


def observe_sites(reads: DataFrame, sites: DataFrame, min_baseq: int = 5, min_mapq: int = 20, ends: int = 3) -> tuple[DataFrame, DataFrame]:
    """Pass two: (observations, deletions) at a sample's own sites (A2, A4).

    Observations are united over samples: rows equal in ``OBSERVED`` are one. Deletions count whatever
    their quality.
    """
    cut = pieces(reads).where(F.col("mapq") >= min_mapq)
    binned = cut.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("p") / WIDTH), F.floor((F.col("p") + F.col("n") - 1) / WIDTH))))
    wanted = sites.select("sample", *SITE, "ref").withColumn("_bin", F.floor(F.col("pos") / WIDTH)).withColumnRenamed("pos", "_at")
    met = binned.join(wanted, ["sample", "geneID", "chrom", "_bin"]).where("_at >= p AND _at < p + n")
    seen = bases_at(met, F.col("_at") - F.col("p"), "ref")
    deletions = seen.where("is_del").groupBy(*SITE).agg(F.count(F.lit(1)).alias("del_count"))
    kept = seen.where(~F.col("is_del") & (F.col("baseq") >= min_baseq) & ~((F.col("base") != F.col("ref")) & near_end(ends)))
    return kept.select(*SITE, "ref", *OBSERVED).distinct(), deletions


def call_sites(alignments: DataFrame, genes: DataFrame, tiles: DataFrame, tile: int, allowed: DataFrame | None = None, *, depth: int = 20, alt: int = 10, het: float = 0.99, min_baseq: int = 5, min_mapq: int = 20, ends: int = 3) -> tuple[DataFrame, DataFrame]:
    """(sites, observations) of all samples together.

    sites: geneID, chrom, pos, ref, depth, alt_count, alt_frac, het_prob, del_count, from what each
    sample's own thresholds let through.
    """
    reads = gene_reads(alignments, genes, allowed)
    per = written(candidates(count_sites(reads, genes, tiles, tile, min_baseq, min_mapq, ends), depth, alt, het))
    observed, deletions = observe_sites(reads, per, min_baseq, min_mapq, ends)
    sites = joint_sites(per, [*SITE, "ref"]).join(deletions, SITE, "left")
    return sites.withColumn("del_count", F.coalesce("del_count", F.lit(0).cast("bigint"))), observed


def em_table(sites: DataFrame, observed: DataFrame) -> DataFrame:
    """EM input of the sites (A6-A8, M1): geneID, chrom, pos, Read, r, pi; a read's first observation by place and base counts."""
    own = observed.join(sites.select(*SITE), SITE, "left_semi")
    return em_input(own, alt_vote(own, SITE), SITE, ["qpos", "base", "baseq", "mapq"])
