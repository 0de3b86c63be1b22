"""Row filters: active, churned, and the ledger's customer-ID search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.functions import is_active, is_churned
from churnscope.functions.status import STATUS_CLASS


def active_filter(df: DataFrame, status: str = "Status") -> DataFrame:
    """Rows whose lower-cased status is exactly ``active`` (no trimming).

    On a dataset registered with its status class (same rule, precomputed),
    the filter uses that column, so a partitioned layout is pruned.
    """
    if STATUS_CLASS in df.columns:
        return df.where(F.col(STATUS_CLASS) == F.lit("active"))
    return df.where(is_active(status))


def churned_filter(df: DataFrame, status: str = "Status") -> DataFrame:
    """Rows whose lower-cased status is ``churned`` or ``inactive``."""
    if STATUS_CLASS in df.columns:
        return df.where(F.col(STATUS_CLASS) == F.lit("churned"))
    return df.where(is_churned(status))


def id_search(df: DataFrame, term: str | None, column: str = "CustomerID",
              literal: bool = False) -> DataFrame:
    """Case-insensitive contains on the ID column; a blank term keeps every row.

    By default ``term`` is a regular expression (as in the reference);
    ``literal=True`` matches it as plain text, so ``(`` is not an error.
    """
    if not term:
        return df
    ids = F.col(column).cast("string")
    if literal:
        return df.where(F.contains(F.lower(ids), F.lower(F.lit(term))))
    return df.where(ids.rlike("(?iu)" + term))
