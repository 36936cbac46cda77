"""Sources (S1-S4, S13, S17-S19, S21, S25, S26) as DataFrames with explicit schemas.

Alignments, gene structures and editing sites are read as Parquet or JSON: serialised Python objects
from others are never loaded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.alleles import canonical_read_name

MAPPING = "Read string, geneName string, geneID string, geneChr string, Isoform string, Cell string, Umi string, Keep int"
GENES = "geneID string, geneName string, geneChr string, geneStart bigint, geneEnd bigint, exons array<struct<s:bigint,e:bigint>>, isoforms map<string,array<int>>"
ALIGNMENTS = "sample string, qname string, chrom string, pos bigint, flag int, mapq int, cigar array<struct<op:int,len:int>>, seq string, qual array<int>"


def read_mapping(spark: SparkSession, path: str, sample: str) -> DataFrame:
    """Kept rows of a read mapping, names normalised (S1, S2); the file has a header."""
    raw = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    have = [f"`{c.split()[0]}`" if c.split()[0] in raw.columns else "null" for c in MAPPING.split(", ")]
    rows = raw.selectExpr(*[f"try_cast({h} as {c.split()[1]}) as {c.split()[0]}" for h, c in zip(have, MAPPING.split(", "), strict=True)])
    return rows.where("Keep = 1").withColumn("Read", canonical_read_name(F.col("Read"))).withColumn("sample", F.lit(sample))


def read_cells(mapping: DataFrame) -> DataFrame:
    """One cell per read and gene: the first by cell and molecule."""
    order = Window.partitionBy("sample", "geneID", "Read").orderBy(F.col("Cell").asc_nulls_last(), F.col("Umi").asc_nulls_last())
    return mapping.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("sample", "geneID", "Read", "Cell")


def read_isoforms(mapping: DataFrame) -> DataFrame:
    """Distinct reads and isoforms (S3)."""
    return mapping.select("sample", "geneID", "Read", "Isoform").distinct()


def hap_assignment(phased: DataFrame) -> DataFrame:
    """Haplotype of phasable reads."""
    return phased.where("reads_phasable = 1").withColumn("hap", F.when(F.col("hat_I") > 0.5, "hapA").otherwise("hapB"))


def gene_structures(spark: SparkSession, path: str) -> DataFrame:
    """Gene structures from Parquet or JSON lines."""
    reader = spark.read.schema(GENES)
    return reader.json(path) if ".json" in path else reader.parquet(path)


def exons(genes: DataFrame) -> DataFrame:
    return genes.select("geneID", F.posexplode("exons").alias("idx", "x")).select("geneID", "idx", "x.s", "x.e")


def isoform_exons(genes: DataFrame) -> DataFrame:
    listed = genes.select("geneID", "exons", F.explode("isoforms").alias("Isoform", "idxs")).select("geneID", "exons", "Isoform", F.explode("idxs").alias("idx"))
    return listed.select("geneID", "Isoform", "idx", F.get("exons", F.col("idx"))["s"].alias("s"), F.get("exons", F.col("idx"))["e"].alias("e"))


def cell_types(spark: SparkSession, path: str, sample: str | None = None) -> DataFrame:
    """Cell, CellType; rows of one sample where the file names samples."""
    df = spark.read.csv(path, header=True)
    if sample is not None and "Sample" in df.columns:
        df = df.where(F.col("Sample") == sample)
    return df.select("Cell", "CellType").na.drop()


def gtf_exons(spark: SparkSession, path: str) -> DataFrame:
    """Exon rows of a GTF file, 0-based (S18): geneID, geneName, transcript, chrom, strand, s, e."""
    f = F.split("value", "\t")
    attr = lambda k: F.nullif(F.regexp_extract(f[8], rf'(?:^|[ ;]){k} "([^"]*)"', 1), F.lit(""))
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).where((F.size(f) >= 9) & (f[2] == "exon"))
    return rows.select(attr("gene_id").alias("geneID"), attr("gene_name").alias("geneName"), attr("transcript_id").alias("transcript"), f[0].alias("chrom"), f[6].alias("strand"), (f[3].cast("bigint") - 1).alias("s"), f[4].cast("bigint").alias("e")).where("e > s")


def gtf_gene(gtf: DataFrame, name: str) -> DataFrame:
    """Region, strand and transcripts of a gene by name."""
    return gtf.where(F.col("geneName") == name).groupBy("geneName", "chrom", "strand").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.array_sort(F.collect_set("transcript")).alias("transcripts"))


def reference_tiles(spark: SparkSession, path: str, tile: int = 10_000) -> DataFrame:
    """Fixed tiles of a FASTA file (S13, D4): chrom, start, seq.

    Records are split by Spark's text reader at '>', one chromosome per row, and cut at once.
    """
    records = spark.read.option("lineSep", ">").text(path).where(F.col("value") != "")
    parts = records.select(F.regexp_extract("value", r"^(\S+)", 1).alias("chrom"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\s", "").alias("s"))
    at = parts.withColumn("start", F.explode(F.sequence(F.lit(0), F.floor((F.char_length("s") - 1) / tile).cast("int"))))
    first = F.col("start") * tile
    return at.select("chrom", first.cast("bigint").alias("start"), F.substring("s", first.cast("int") + 1, F.lit(tile)).alias("seq"))


def editing_sites(spark: SparkSession, path: str) -> DataFrame:
    """Known RNA-editing sites (S17): chrom, pos (0-based), ref, alt."""
    return spark.read.schema("chrom string, pos bigint, ref string, alt string").parquet(path)


def gene_subset(spark: SparkSession, listed: str) -> DataFrame:
    """Gene ids from a comma-separated list, or from a text file of one per line."""
    if "," in listed or "/" not in listed:
        return spark.createDataFrame([(x.strip(),) for x in listed.split(",") if x.strip()], "geneID string")
    return spark.read.text(listed).select(F.trim("value").alias("geneID")).where("geneID <> ''").distinct()
