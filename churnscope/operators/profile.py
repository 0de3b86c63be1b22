"""Dataset profile (row count, columns) and the ordered head preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def profile(df: DataFrame) -> DataFrame:
    """One row: ``rows``, ``n_columns``, ``columns`` (comma-joined, in table order).

    The column list is schema metadata known on the driver; only the count
    runs as a job (a partial count per task plus one merge).
    """
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.lit(",".join(df.columns)).alias("columns"))


def preview(df: DataFrame, n: int = 5, order_by: str | None = "CustomerID") -> DataFrame:
    """First ``n`` rows; an explicit order makes "first" well defined in Spark.

    ``orderBy(..).limit(n)`` plans as a per-task top-n and a merge of n rows
    per task, never a full sort.
    """
    if order_by:
        df = df.orderBy(F.col(f"`{order_by}`").asc_nulls_last())
    return df.limit(n)


def preview_files(spark: SparkSession, path: str, n: int = 5, fmt: str = "parquet") -> DataFrame:
    """First ``n`` rows as they stand in the files: by file name, then place.

    Only the beginning is read: the first block of the first file, and as many
    further files (doubling) as it takes to find ``n`` rows.  ``fmt`` is
    ``parquet`` or ``csv`` (with a header, every column text); places come
    from the reader, so no order of rows or tasks is assumed.
    """
    reader = spark.read.option("header", True).option("escape", '"') if fmt == "csv" else spark.read
    table = reader.format(fmt).load(path)
    files = sorted(table.inputFiles())
    cols = [F.col(f"`{c}`") for c in table.columns]

    def begins(some: list[str], blocks: bool) -> DataFrame:
        df = reader.format(fmt).schema(table.schema).load(some)
        if blocks:
            df = df.where(F.col("_metadata.file_block_start") == 0)
        # A text file's rows come in order within a block.
        place = F.col("_metadata.row_index") if fmt == "parquet" else F.monotonically_increasing_id()
        df = df.select(*cols, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                       place.alias("_place"))
        return df.orderBy("_file", "_block", "_place").limit(n)

    # The first block of one file, then whole files.
    tries = [(files[:1], True)] + [(files[:1 << i], False) for i in range(len(files).bit_length() + 1)]
    for some, blocks in tries if files else []:
        head = begins(some, blocks)
        if len(some) == len(files) and not blocks or len(head.select("_place").take(n)) == n:
            return head.drop("_file", "_block", "_place")
    return table.limit(n)
