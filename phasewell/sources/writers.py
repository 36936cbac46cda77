"""Sinks (K2, K4, K5, K7, K9): partitioned tables and sparse count matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alleles import file_label
from ..operators.downstream import with_bulk


def write_results(df: DataFrame, path: str, by: list[str]) -> None:
    """One table partitioned by sample and the like, instead of a file for each gene (K2, K5, K7)."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def numbered(df: DataFrame, column: str, out: str) -> DataFrame:
    """Dense numbers from 1 of a column's distinct values, in order (K4).

    Values are counted per leading hash range first, so no task orders all of them.
    """
    values = df.select(column).distinct().withColumn("_b", F.substring(F.md5(F.col(column).cast("string")), 1, 3))
    sizes = values.groupBy("_b").count()
    before = sizes.withColumn("_base", F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 4096 rows at most
    return values.withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy(column))).join(F.broadcast(before), "_b").select(column, (F.col("_base") + F.col("_n")).alias(out))


def matrix_market(counts: DataFrame, path: str, row: str, column: str, value: str) -> None:
    """Non-zero cells as MatrixMarket body lines, with the two index tables beside them (K4)."""
    cells = counts.where(F.col(value) != 0)
    rows, columns = numbered(cells, row, "_i"), numbered(cells, column, "_j")
    lines = cells.join(rows, row).join(columns, column).select(F.concat_ws(" ", F.col("_i"), F.col("_j"), F.col(value).cast("string")).alias("value"))
    lines.write.mode("overwrite").text(f"{path}/matrix")
    rows.write.mode("overwrite").csv(f"{path}/rows", header=True)
    columns.write.mode("overwrite").csv(f"{path}/columns", header=True)


def split_by_haplotype(reads: DataFrame, path: str) -> None:
    """Reads of each haplotype under Bulk and under their cell type (K8, K9)."""
    named = with_bulk(reads).withColumn("CellType", file_label(F.col("CellType")))
    named.write.mode("overwrite").partitionBy("CellType", "hap").parquet(path)
