"""Uploads with malformed lines: nothing is lost, nothing fails.

Every line is read whole and judged by its own text: a field that opens a
quote and never closes it, more fields than the header, or fewer.  One scan
writes the parsed rows and, beside them, the malformed lines as they stand,
with their file and the reason; both are read from there.

Lines with too few fields are rows all the same, their last columns null (as
the usual reader has it), and are listed too.  Lines with too many fields or
a broken quote are listed only.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.functions.cleaning import NA_TOKENS
from churnscope.session import checkpoint_dir

TOO_MANY, TOO_FEW, BROKEN, UNREADABLE = "too many fields", "too few fields", "broken quotes", "unreadable"
# A separator that no line has in practice; a line that has it comes whole as well.
_NO_SEPARATOR = "\u0001"
# A quoted field with its opening edge; quotes inside it are doubled.
_QUOTED = r'(^|,)"(?:[^"]++|"")*+"'


@dataclass(frozen=True)
class Checked:
    """An upload's rows (text columns) and its malformed lines
    (``file, line, reason, in_data``)."""

    data: DataFrame
    quarantine: DataFrame

    def counts(self) -> DataFrame:
        """Malformed lines by reason."""
        return self.quarantine.groupBy("reason", "in_data").agg(F.count(F.lit(1)).alias("lines")).orderBy("reason")


def reason_of(line: Column, n_columns: int) -> Column:
    """Why a line is malformed, or null."""
    # Quoted fields stand as one letter, so the commas left are separators.
    plain = F.regexp_replace(line, _QUOTED, "$1Q")
    fields = F.length(plain) - F.length(F.replace(plain, F.lit(","), F.lit(""))) + 1
    return (F.when(plain.rlike('(^|,)"'), F.lit(BROKEN)).when(fields > n_columns, F.lit(TOO_MANY))
            .when(fields < n_columns, F.lit(TOO_FEW)))


def read_checked(spark: SparkSession, path: str, na_tokens: Iterable[str] = NA_TOKENS) -> Checked:
    """Read a CSV upload (a file or a folder of files with one header).

    Each file's first line is its header; blank lines are none.  Every column
    is text, NA tokens are null.  Quoted line breaks are not read here: such
    a line's parts are malformed lines (``read_customers(multiline=True)``
    reads them).  The upload may be of any size: lines are split over tasks.
    """
    columns = spark.read.option("header", True).option("escape", '"').csv(path).columns
    lines = (spark.read.option("header", True).option("sep", _NO_SEPARATOR).option("quote", "").option("escape", "")
             .option("columnNameOfCorruptRecord", "whole").option("columnPruning", False)
             .schema("line string, whole string").csv(path)
             .select(F.coalesce("whole", "line").alias("line"), F.col("_metadata.file_path").alias("file")))
    judged = lines.withColumn("reason", reason_of(F.col("line"), len(columns)))
    fits = F.col("reason").isNull() | (F.col("reason") == TOO_FEW)
    fields = ", ".join(f"c{i} string" for i in range(len(columns)))
    parsed = F.from_csv(F.when(fits, F.col("line")), fields + ", bad string",
                        {"columnNameOfCorruptRecord": "bad", "escape": '"', "mode": "PERMISSIVE"})
    judged = judged.withColumn("row", parsed)
    judged = judged.withColumn("reason", F.when(F.col("reason").isNull() & F.col("row.bad").isNotNull(), F.lit(UNREADABLE))
                               .otherwise(F.col("reason")))
    in_data = F.col("reason").isNull() | (F.col("reason") == TOO_FEW)
    out = os.path.join(checkpoint_dir(spark), "checked", uuid.uuid4().hex)
    (judged.select("file", F.when(F.col("reason").isNotNull(), F.col("line")).alias("line"), "reason",
                   *[F.col(f"row.c{i}").alias(f"c{i}") for i in range(len(columns))], in_data.alias("in_data"))
     .write.partitionBy("in_data").parquet(out))
    table = spark.read.schema("file string, line string, reason string, " + fields + ", in_data boolean").parquet(out)
    tokens = list(na_tokens)
    data = table.where("in_data").select(*[F.when(~F.col(f"c{i}").isin(*tokens), F.col(f"c{i}")).alias(c)
                                           for i, c in enumerate(columns)])
    return Checked(data, table.where("reason IS NOT NULL").select("file", "line", "reason", "in_data"))
