"""ID search through a trigram index.

The dataset is written in the order of its IDs, in blocks of a fixed number of
rows; beside it stand the postings: which blocks hold an ID with a given three
characters in a row.  A search takes the trigrams that any match must have,
finds the blocks that hold them all, reads those blocks only (Parquet's block
statistics skip the rest) and verifies every row with the search itself.
Terms without a required trigram scan everything, as before.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.operators.filters import id_search
from churnscope.operators.ranks import numbered
from churnscope.sources.versions import announce, current, new_version

#: Rows of a block, and blocks named in a read (more are found by a join).
BLOCK_ROWS = 20_000
MOST_BLOCKS = 5_000
_BLOCK = "_search_block"


def folded(c: Column) -> Column:
    """Letters that match regardless of case become one; four letters beyond
    ASCII match an ASCII letter (dotted and dotless i, long s, Kelvin sign)."""
    return F.lower(F.translate(c, "\u0130\u0131\u017f\u212a", "iisk"))


def trigrams(c: Column) -> Column:
    """Different runs of three ASCII characters in a folded text."""
    text = folded(c)
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1)))
    grams = F.transform(starts, lambda i: F.substring(text, i, F.lit(3)))
    return F.array_distinct(F.filter(grams, lambda g: g.rlike("^[\\x00-\\x7F]{3}$")))


def required_text(term: str, literal: bool) -> list[str]:
    """Texts that every match of the term holds; for a regular expression only
    its plain characters outside of groups, classes and choices."""
    if literal:
        return [term]
    runs, run, depth, i = [], "", 0, 0
    while i < len(term):
        c = term[i]
        if c == "\\":
            after = term[i + 1:i + 2]
            if after in ("Q", "E", "") or after.isdigit():
                return []
            plain = after if not after.isalnum() else None
            c, i = plain, i + 1
        elif c == "[":
            end = term.find("]", i + 2)
            if end < 0 or "[" in term[i + 1:end] or "&&" in term[i:end]:
                return []
            c, i = None, end
        elif c == "(":
            depth, c = depth + 1, None
        elif c == ")":
            depth, c = depth - 1, None
        elif c == "|" and depth == 0:
            return []
        elif c in ".^$|":
            c = None
        elif c in "?*+{":
            if c == "{":
                end = term.find("}", i)
                if end < 0:
                    return []
                i = end
            # What is repeated may be missing, or stand more than once.
            run, c = run[:-1], None
        if c is None or depth:
            runs.append(run)
            run = ""
        else:
            run += c
        i += 1
    return [r for r in [*runs, run] if r]


def write_indexed(df: DataFrame, path: str, column: str = "CustomerID", block_rows: int = BLOCK_ROWS) -> None:
    """Write a dataset in the order of its IDs with the postings of its blocks."""
    spark = df.sparkSession
    version = new_version(spark, path)
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    rows = numbered(df, [F.col(f"`{column}`").asc_nulls_first(), spread], "_nth")
    rows = rows.withColumn(_BLOCK, F.floor((F.col("_nth") - 1) / F.lit(block_rows)))
    # Neighbouring blocks share files; the reader's statistics part them.
    rows.repartitionByRange(F.col(_BLOCK)).sortWithinPartitions("_nth").drop("_nth").write.option(
        "parquet.block.size", 8 << 20).parquet(os.path.join(version, "rows"))
    stored = spark.read.parquet(os.path.join(version, "rows"))
    (stored.select(_BLOCK, F.explode(trigrams(F.col(f"`{column}`").cast("string"))).alias("gram")).distinct()
     .repartitionByRange("gram", _BLOCK).sortWithinPartitions("gram").write.parquet(os.path.join(version, "postings")))
    announce(spark, path, version)


@dataclass(frozen=True)
class Found:
    """The rows that match, and the rows read for them (before verification)."""

    rows: DataFrame
    read: DataFrame


def search(spark: SparkSession, path: str, term: str | None, column: str = "CustomerID", literal: bool = False) -> Found:
    """The dataset's rows whose ID matches, as :func:`filters.id_search` has it.

    Block numbers reach the driver, ``MOST_BLOCKS`` at most; where more blocks
    qualify they are joined instead.
    """
    version = current(spark, path)
    if version is None:
        raise LookupError(f"no indexed dataset at {path}")
    table = spark.read.parquet(os.path.join(version, "rows"))
    texts = required_text(term, literal) if term else []
    # The grams are made as the index makes them.
    grams = sorted(g for r in spark.createDataFrame([(t,) for t in texts], "t string").select(trigrams(F.col("t")).alias("g")).collect()
                   for g in r.g) if texts else []
    grams = sorted(set(grams))
    if grams:
        blocks = (spark.read.parquet(os.path.join(version, "postings")).where(F.col("gram").isin(grams))
                  .groupBy(_BLOCK).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select(_BLOCK))
        some = [r[0] for r in blocks.limit(MOST_BLOCKS + 1).collect()]
        table = table.where(F.col(_BLOCK).isin(some)) if len(some) <= MOST_BLOCKS else table.join(blocks, _BLOCK, "left_semi")
    table = table.drop(_BLOCK)
    return Found(id_search(table, term, column, literal), table)
