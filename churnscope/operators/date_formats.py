"""Which format are a column's dates written in?

One aggregate counts, for every column, how many values each format parses;
partial counts per task, one merge.  The format that parses most is the
column's, whatever the order of its rows.  Day-first and month-first dates
differ only in values over twelve: where both orders parse equally many, the
column is ambiguous, which is reported, and month first is taken.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnscope.functions.dates import BY_NAME, DATE_FORMATS, DateFormat, parse_as

# Formats that read the same texts in another order.
RIVALS = {"month/day/year": "day/month/year", "day/month/year": "month/day/year",
          "month/day/yy": "day/month/yy", "day/month/yy": "month/day/yy"}


def date_formats(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Rows ``column, format, present, parsed, rival_parsed, rival_only,
    chosen, ambiguous``, one per column and format.

    ``present`` counts the values, ``parsed`` those in this format,
    ``rival_parsed`` those in the other order of day and month and
    ``rival_only`` those in that order alone.  A column without any date has
    no chosen format.  A chosen format is ``ambiguous`` if its rival parses
    as many values.
    """
    cols = list(dict.fromkeys(cols))
    at = {f.name: k for k, f in enumerate(DATE_FORMATS)}
    # One row per value and column; the parses are staged, so that each is made once.
    values = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("col"), F.col(f"`{c}`").cast("string").alias("txt")) for i, c in enumerate(cols)])))
    reads = values.select("col", "txt", *[parse_as("txt", f).isNotNull().alias(f"reads{k}") for k, f in enumerate(DATE_FORMATS)])
    aggs, rows = [F.count("txt").alias("present")], []
    for k, f in enumerate(DATE_FORMATS):
        aggs.append(F.count_if(F.col(f"reads{k}")).alias(f"p{k}"))
        rival, only = F.lit(0).cast("long"), F.lit(0).cast("long")
        if f.name in RIVALS:
            other = at[RIVALS[f.name]]
            aggs.append(F.count_if(F.col(f"reads{other}") & ~F.col(f"reads{k}")).alias(f"r{k}"))
            rival, only = F.col(f"p{other}"), F.col(f"r{k}")
        rows.append(F.struct(F.lit(k).alias("place"), F.lit(f.name).alias("format"), F.col(f"p{k}").alias("parsed"),
                             rival.alias("rival_parsed"), only.alias("rival_only")))
    # A column of an empty table is reported too.
    counts = reads.groupBy("col").agg(*aggs)
    named = df.sparkSession.createDataFrame(list(enumerate(cols)), "col int, column string")
    zeros = [c for c in counts.columns if c != "col"]
    long = named.join(counts, "col", "left").fillna(0, zeros).select("column", "present", F.inline(F.array(*rows)))
    best = Window.partitionBy("column").orderBy(F.desc("parsed"), "place")  # a few rows per column
    chosen = (F.row_number().over(best) == 1) & (F.col("parsed") > 0)
    long = long.withColumn("chosen", chosen).orderBy("column", "place")
    return long.select("column", "format", "present", "parsed", "rival_parsed", "rival_only", "chosen",
                       (F.col("chosen") & (F.col("parsed") == F.col("rival_parsed"))).alias("ambiguous"))


def infer_date_formats(df: DataFrame, cols: Iterable[str]) -> dict[str, DateFormat]:
    """The chosen format of each column (ISO where no value is a date); a few
    rows per column reach the driver."""
    cols = list(dict.fromkeys(cols))
    found = {r["column"]: BY_NAME[r["format"]] for r in date_formats(df, cols).where("chosen").collect()}
    return {c: found.get(c, BY_NAME["iso"]) for c in cols}
