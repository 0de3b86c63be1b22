"""Helpers of the operators: column picking, the shared folder, written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TOPMOST = -(1 << 63)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """The named columns, cast; found by exact name, so further columns whose
    names differ in case only do no harm.  A missing column is null."""
    at = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[(F.col(f"_{at[c]}") if c in at else F.lit(None)).cast(t).alias(c)
                          for c, t in types.items()])


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Where that is unset (tests in
    local mode) a temporary one is made; elsewhere that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="llm-checkpoint-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, bound: int = 50_000) -> DataFrame:
    """A join side: broadcast if its counted rows are within ``bound``, else
    left to a shuffled join (whose skewed keys adaptive execution splits)."""
    return F.broadcast(df) if rows <= bound else df


def unit_hash(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) from the row's values, the same in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 53)) / F.lit(float(1 << 53))


def below(bounds: list[int], x: Column) -> Column:
    """How many of the sorted bounds are below x, by binary search."""
    if not bounds:
        return F.lit(0)
    arr = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0),
                       lambda pos, step: F.when(F.get(arr, pos + step - 1) < x, pos + step).otherwise(pos))
