"""Count matrices of cells x features as MatrixMarket text, for all cells and by cell type.

Matrices stay long tables. Names get dense numbers from a sort by ranges: a name's number is its place in its
range after the sizes of the ranges before it, so no task orders all names. The parts of a written matrix,
one after another, are one MatrixMarket file: its header stands in the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.alleles import file_label
from ..operators.downstream import BULK
from .shared import written

#: Fixed first line of a sparse real matrix.
HEADER = "%%MatrixMarket matrix coordinate real general"
TAGS = ("gene", "transcript", "gene_phasable", "transcript_phasable")


def cell_types(cells: DataFrame) -> list[str]:
    """Bulk, then the cell types in order (A27); a handful of names."""
    return [BULK, *[r[0] for r in cells.where("CellType IS NOT NULL").select("CellType").distinct().orderBy("CellType").collect()]]


def numbered(names: DataFrame, column: str, out: str) -> DataFrame:
    """(column, out): numbers from 1 of the distinct names, in their order."""
    ranged = names.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column)
    at = written(ranged.select(column, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_nth")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = at.groupBy("_part").count().withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0)))  # a row per partition
    return at.join(F.broadcast(bases.select("_part", "_base")), "_part").select(column, (F.col("_base") + F.col("_nth") + 1).alias(out))


def count_triples(counts: DataFrame) -> DataFrame:
    """(tag, Cell, feature, value) of all four matrices without zeros, from counts by gene, cell and isoform.

    counts: geneName, Cell, Isoform, hapA, hapB, hapA_phasable, hapB_phasable. Features are named gene_hapA and
    gene_isoform_hapA.
    """
    cell = lambda tag, name, h, value: F.struct(F.lit(tag).alias("tag"), F.concat_ws("_", *name, F.lit(h)).alias("feature"), F.col(value).alias("value"))
    gene, both = [F.col("geneName")], [F.col("geneName"), F.col("Isoform")]
    each = [cell(f"{level}{suffix}", name, h, f"{h}{suffix}") for level, name in (("gene", gene), ("transcript", both)) for suffix in ("", "_phasable") for h in ("hapA", "hapB")]
    rows = counts.select("Cell", F.explode(F.array(*each)).alias("x")).select("Cell", "x.*")
    return rows.groupBy("tag", "Cell", "feature").agg(F.sum("value").alias("value")).where("value <> 0")


def write_matrix(cells: DataFrame, path: str, rows: DataFrame, columns: DataFrame) -> None:
    """cells (Cell, feature, value) as MatrixMarket under path/matrix, with names and numbers in path/rows, path/columns."""
    body = cells.join(rows, "Cell").join(columns, "feature").select(F.lit(2).alias("k"), "i", "j", F.concat_ws(" ", "i", "j", F.col("value").cast("string")).alias("value"))
    kinds = [d.select(F.lit(n).alias("n")) for d, n in ((rows, "r"), (columns, "c"), (cells, "v"))]
    count = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).agg(*[F.count_if(F.col("n") == n).alias(f"n_{n}") for n in "rcv"])
    zero = F.lit(0).cast("bigint")
    head = count.select(F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit(HEADER).alias("value")), F.struct(F.lit(1).alias("k"), F.concat_ws(" ", "n_r", "n_c", "n_v").alias("value")))).alias("x")).select("x.k", zero.alias("i"), zero.alias("j"), "x.value")
    ordered = head.unionByName(body).repartitionByRange("k", "i", "j").sortWithinPartitions("k", "i", "j")
    ordered.select("value").write.mode("overwrite").text(f"{path}/matrix")
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    columns.write.mode("overwrite").parquet(f"{path}/columns")


def write_count_matrices(counts: DataFrame, path: str, cells: DataFrame | None = None) -> list[str]:
    """All matrices of a sample, count_mat_gene and the like; with ``cells`` (Cell, CellType) each type's as well.

    A cell type's matrix has its own cells, in the order of all, and all features. Gives the names written.
    """
    triples = written(count_triples(counts))
    names = []
    for tag in TAGS:
        own = triples.where(F.col("tag") == tag).select("Cell", "feature", "value")
        if own.isEmpty():
            continue
        rows, columns = written(numbered(own, "Cell", "i")), written(numbered(own, "feature", "j"))
        write_matrix(own, f"{path}/count_mat_{tag}", rows, columns)
        names.append(f"count_mat_{tag}")
        for kind in cell_types(cells)[1:] if cells is not None else []:
            some = rows.join(cells.where(F.col("CellType") == kind).select("Cell").distinct(), "Cell", "left_semi").select("Cell")
            if not some.isEmpty():
                label = cells.sparkSession.range(1).select(file_label(F.lit(kind))).first()[0]
                write_matrix(own.join(some, "Cell", "left_semi"), f"{path}/count_mat_{tag}_ct_{label}", numbered(some, "Cell", "i"), columns)
                names.append(f"count_mat_{tag}_ct_{label}")
    return names


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(Cell, feature, value) of a written matrix."""
    lines = spark.read.text(f"{path}/matrix").where(~F.col("value").startswith("%")).withColumn("_f", F.split("value", " "))
    rows, columns = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/columns")
    # the line of sizes has whole numbers only, a cell's value is a double with a point or exponent
    body = lines.where(F.col("_f")[2].rlike("[.E]")).select(F.col("_f")[0].cast("bigint").alias("i"), F.col("_f")[1].cast("bigint").alias("j"), F.col("_f")[2].cast("double").alias("value"))
    return body.join(rows, "i").join(columns, "j").select("Cell", "feature", "value")
