"""What was coerced: the most frequent rejected texts of each role, exactly.

Counting every different text would shuffle them all.  Instead rejected texts
are first counted by hash bucket, a table of bounded size whatever the data.
A text is no more frequent than its bucket, so: the texts of the ``k`` fullest
buckets give a count that the ``k`` most frequent texts reach at least, and
only buckets with that many rows can hold one of them.  Their texts are then
counted exactly.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnscope.functions import parse_date
from churnscope.functions.cleaning import fits_long, int_text, money_text, parse_text
from churnscope.operators.preprocess import map_columns
from churnscope.operators.ranks import write_again
from churnscope.roles import INT_ROLES, MONEY_ROLES

BUCKETS = 1 << 16


def rejected(raw: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Rows ``role, text``: every non-null text that a numeric role turned into
    zero or the signup date into ``NaT``."""
    df = map_columns(raw, mapping, keep_other=False)
    roles = [*MONEY_ROLES, *INT_ROLES, "SignupDate"]
    df = df.select(*[F.col(r).cast("string").alias(r) for r in roles])
    df = df.withColumns({f"{r}__txt": money_text(r) if r in MONEY_ROLES else int_text(r) for r in roles[:-1]})
    df = df.withColumns({f"{r}__num": parse_text(F.col(f"{r}__txt")) for r in roles[:-1]})
    bad = {r: F.col(f"{r}__num").isNull() | (~fits_long(F.col(f"{r}__num")) if r in INT_ROLES else F.lit(False)) for r in roles[:-1]}
    bad["SignupDate"] = parse_date("SignupDate").isNull()
    kept = df.select(*[F.when(bad[r], F.col(r)).alias(r) for r in roles])
    return kept.unpivot([], roles, "role", "text").where("text IS NOT NULL")


def most_frequent(texts: DataFrame, k: int, buckets: int = BUCKETS) -> DataFrame:
    """Rows ``role, text, count, rank``: the ``k`` most frequent texts of each
    role with their exact counts; equal counts by text.

    ``buckets`` bounds the first table only.  Where all texts are about
    equally frequent, all buckets remain and every text is counted.
    """
    texts = write_again(texts.withColumn("bucket", F.pmod(F.xxhash64("role", "text"), F.lit(buckets))), "rejects")
    # At most ``buckets`` rows per role.
    full = write_again(texts.groupBy("role", "bucket").agg(F.count(F.lit(1)).alias("n")), "reject-buckets")
    order = Window.partitionBy("role").orderBy(F.desc("n"), "bucket")
    first = full.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    found = texts.join(F.broadcast(first.select("role", "bucket")), ["role", "bucket"]).groupBy("role", "text").agg(F.count(F.lit(1)).alias("n"))
    by_count = Window.partitionBy("role").orderBy(F.desc("n"))
    reached = (found.withColumn("place", F.row_number().over(by_count)).where(F.col("place") == k)
               .select("role", F.col("n").alias("reached")))
    # A role with fewer than k texts so far keeps all its buckets.
    able = (full.join(F.broadcast(reached), "role", "left").where(F.col("n") >= F.coalesce("reached", F.lit(0))).select("role", "bucket"))
    counts = texts.join(F.broadcast(able), ["role", "bucket"]).groupBy("role", "text").agg(F.count(F.lit(1)).alias("count"))
    ranked = Window.partitionBy("role").orderBy(F.desc("count"), "text")
    return (counts.withColumn("rank", F.row_number().over(ranked).cast("long")).where(F.col("rank") <= k)
            .select("role", "text", "count", "rank"))


def rejected_texts(raw: DataFrame, mapping: Mapping[str, str] | None = None, k: int = 10) -> DataFrame:
    """The ``k`` most frequent rejected texts of each role; see :func:`most_frequent`."""
    return most_frequent(rejected(raw, mapping), k)
