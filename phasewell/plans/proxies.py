"""Roles that the driver's tables play for the operators of this library.

gene = brand, site = part, read = order, allele = return flag (N reference, A alternative, R other),
base quality = quantity, haplotype weight = ten times the discount, isoform = part type,
cell type = market segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("geneID"), F.col("p_type").alias("Isoform"), F.col("p_size").alias("size"))


def places(df: DataFrame) -> list[Column]:
    """What tells the rows of a table of files apart, in their order: the file's name, if there are several, and the row's number there."""
    row = F.col("_metadata.row_index").alias("row")
    return [row] if len(df.inputFiles()) == 1 else [F.col("_metadata.file_path").alias("file"), row]


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed bases: pos, geneID, Read, base, ref, baseq, nth, and the row's place in its table: row, or file and row."""
    base = F.when(F.col("l_returnflag") == "N", "N").otherwise(F.col("l_returnflag"))
    items = table(spark, sf_dir, "lineitem")
    line = items.select(F.col("l_partkey").alias("pos"), F.col("l_orderkey").alias("Read"), base.alias("base"), F.lit("N").alias("ref"), F.col("l_quantity").alias("baseq"), F.col("l_linenumber").alias("nth"), *places(items))
    return line.join(parts(spark, sf_dir).select("pos", "geneID"), "pos")


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping rows with haplotype weights: geneID, Isoform, Read, Cell, CellType, hat_I, hat_I_B, reads_phasable."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pos"), F.col("l_orderkey").alias("Read"), F.round(F.col("l_discount") * 10 + 0.0, 6).alias("hat_I"), (F.col("l_linestatus") == "F").cast("int").alias("reads_phasable"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("Read"), F.col("o_custkey").alias("Cell"))
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("Cell"), F.col("c_mktsegment").alias("CellType"))
    rows = line.join(parts(spark, sf_dir), "pos").join(orders, "Read").join(cells, "Cell")
    return rows.select("geneID", "Isoform", "Read", "Cell", "CellType", "hat_I", F.round(1 - F.col("hat_I"), 6).alias("hat_I_B"), "reads_phasable", "pos")


#: The same roles in SQL, as common table expressions.
SQL_BASES = "bases AS (SELECT p_partkey AS pos, p_brand AS gene, l_orderkey AS rd, l_returnflag AS base, l_quantity AS q, l_linenumber AS nth FROM lineitem JOIN part ON l_partkey = p_partkey)"
SQL_WEIGHTS = """w AS (SELECT p_brand AS gene, p_type AS iso, l_orderkey AS rd, o_custkey AS cell, c_mktsegment AS ct, round(l_discount * 10 + 0.0, 6) AS a, round(1 - round(l_discount * 10 + 0.0, 6), 6) AS b, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS ph, p_partkey AS pos
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
