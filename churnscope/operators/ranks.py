"""Ranks of all rows over a range-partitioned sort.

A window without a partition key would bring every row into one task.  Here
the rows are sorted globally and written, each with its place in its sorted
partition; one row of figures per partition (rows, different keys, first and
last key) is summed up over the partitions, and a tie that crosses partition
edges is carried from the partition in which it starts.  A key that a third of
the rows share is therefore spread over many partitions.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.session import checkpoint_dir

# monotonically_increasing_id holds the partition above, the row's place in it below this bit.
PLACE_BITS = 33


def write_again(df: DataFrame, kind: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them again."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), kind, uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """Rows with their place in the global order, 1, 2, 3, ...

    ``order`` should tell all rows apart (the written row's own position is
    its last key here, so that equal rows spread too).  The input is written
    once, sorted, and written again; no row passes the driver or a single task.
    """
    rows = write_again(df, "unranked")
    spot = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    placed = rows.select("*", *[c.alias(f"_spot{i}") for i, c in enumerate(spot)])
    placed = placed.orderBy(*order, "_spot0", "_spot1").drop("_spot0", "_spot1")
    placed = write_again(placed.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumns({"_part": F.shiftright("_id", PLACE_BITS),
                                 "_place": F.col("_id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    # One row per sorted partition: as many as the session's shuffle width at most.
    out = placed.join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.col("_offset") + F.col("_place") + 1).drop("_id", "_part", "_place", "_offset")


def ranked(df: DataFrame, key: str, ties: list[Column], tiles: int = 100) -> DataFrame:
    """Add ``row_number``, ``rank``, ``dense_rank``, ``percent_rank`` and
    ``tile`` (1 to ``tiles``) of the rows by ``key``, descending, nulls last.

    Rows with one key share ``rank``, ``dense_rank`` and ``percent_rank``, as
    SQL's windows have it; ``ties`` orders them for ``row_number`` and
    ``tile``.  An empty table stays empty.
    """
    rows = numbered(df, [F.col(key).desc_nulls_last(), *ties])
    rows = write_again(rows, "numbered")
    # A tile of consecutive numbers is one task's share of the ties' search.
    total = rows.count()
    width = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    step = max(1, -(-total // width))
    cut = rows.withColumn("_cut", F.floor((F.col("row_number") - 1) / F.lit(step)))
    along = Window.partitionBy("_cut").orderBy("row_number")
    fresh = F.coalesce(~F.col(key).eqNullSafe(F.lag(key).over(along)) | (F.lag("row_number").over(along).isNull()),
                       F.lit(True))
    cut = cut.withColumn("_fresh", fresh)
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumns({"_start": F.max(F.when(F.col("_fresh"), F.col("row_number"))).over(so_far),
                           "_dense": F.sum(F.col("_fresh").cast("long")).over(so_far)})
    # Figures of each share, one row; then the carry over the shares.
    shares = cut.groupBy("_cut").agg(
        F.min_by(F.struct(F.col(key).alias("k")), "row_number").alias("head"),
        F.max_by(F.struct(F.col(key).alias("k")), "row_number").alias("tail"),
        F.max("_dense").alias("keys"), F.max("_start").alias("last_start"))
    order = Window.orderBy("_cut")
    goes_on = F.coalesce(F.col("head.k").eqNullSafe(F.lag("tail.k").over(order)) & F.lag("_cut").over(order).isNotNull(),
                         F.lit(False))
    shares = shares.withColumn("_goes_on", goes_on)
    shares = shares.withColumn("_own", F.when(~(F.col("_goes_on") & (F.col("keys") == 1)), F.col("last_start")))
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select(
        "_cut", "_goes_on", F.last("_own", ignorenulls=True).over(past).alias("_carried"),
        (F.coalesce(F.sum("keys").over(past), F.lit(0))
         - F.sum(F.col("_goes_on").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("_keys_before"))
    out = cut.join(F.broadcast(shares), "_cut")
    n = F.lit(total).cast("long")
    rank = F.when((F.col("_dense") == 1) & F.col("_goes_on"), F.col("_carried")).otherwise(F.col("_start"))
    big, size = F.lit(total % tiles).cast("long"), F.lit(total // tiles).cast("long")
    at = F.col("row_number") - 1
    edge = big * (size + 1)
    tile = F.when(at < edge, F.floor(at / (size + 1))).otherwise(
        big + F.floor((at - edge) / F.greatest(size, F.lit(1)))) + 1
    return (out.withColumns({"rank": rank, "dense_rank": F.col("_keys_before") + F.col("_dense"),
                             "tile": tile.cast("long")})
            .withColumn("percent_rank", F.when(n > 1, (F.col("rank") - 1) / (n - 1)).otherwise(F.lit(0.0)))
            .drop("_cut", "_fresh", "_start", "_dense", "_goes_on", "_carried", "_keys_before"))
