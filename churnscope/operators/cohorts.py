"""Cohort retention matrix.

One ``groupBy(cohort)`` with a conditional sum per month index: the retention
of every month is computed in the same pass, with no row explosion and one
shuffle of (cohorts x tasks) partial rows.  The newest ``last`` cohorts are
then picked from that small aggregate with a top-k (``TakeOrderedAndProject``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.functions import month_bucket, retained_in_month
from churnscope.functions.rounding import round_half_even


def cohort_counts(df: DataFrame, months: int = 12, formats=None) -> DataFrame:
    """Wide per-cohort counts: ``cohort``, ``cohort_size``, ``m0`` .. ``m{months-1}``."""
    cohort = month_bucket("SignupDate", formats).alias("cohort")
    aggs = [F.count(F.lit(1)).alias("cohort_size")]
    aggs += [F.count_if(retained_in_month(i)).alias(f"m{i}") for i in range(months)]
    return df.groupBy(cohort).agg(*aggs)


def cohort_sizes(df: DataFrame, formats=None) -> DataFrame:
    """Rows per cohort with the display label ``yyyy-MM (n)``, all cohorts."""
    return (df.groupBy(month_bucket("SignupDate", formats).alias("cohort"))
              .agg(F.count(F.lit(1)).alias("cohort_size"))
              .withColumn("label", F.format_string("%s (%d)", "cohort", "cohort_size"))
              .orderBy("cohort"))


def last_cohorts(counts: DataFrame, last: int = 12) -> DataFrame:
    """The ``last`` lexicographically largest cohorts (``NaT`` sorts last and takes a slot)."""
    return counts.orderBy(F.col("cohort").desc()).limit(last)


def cohort_matrix(df: DataFrame, last: int | None = 12, months: int = 12, wide: bool = False,
                  censor: bool = False, as_of: str | None = None, formats=None) -> DataFrame:
    """Retention percentages of the newest cohorts.

    Long form (default): ``cohort, label, cohort_size, month_idx, month,
    retained, pct`` with ``pct`` = retained/size*100 rounded half-even to one
    decimal on its exact binary value (as Python's ``round``; plain ``bround``
    differs on some ties once cohorts reach about 2,000 rows).  Wide form: ``cohort, label, cohort_size, Month 0 .. Month n``.
    ``censor=True`` nulls months a cohort has not lived through by ``as_of``
    (default: today; the reference counts them as lost); ``last=None`` keeps
    every cohort.
    """
    counts = cohort_counts(df, months, formats)
    if last is not None:
        counts = last_cohorts(counts, last)
    counts = counts.withColumn("label", F.format_string("%s (%d)", "cohort", "cohort_size"))

    def pct(retained):
        return round_half_even(retained / F.col("cohort_size") * F.lit(100.0), 1)

    def censored(i, value):
        if not censor:
            return value
        start = F.try_to_timestamp(F.col("cohort"), F.lit("yyyy-MM"))
        ref = F.to_date(F.lit(as_of)) if as_of else F.current_date()
        age = F.months_between(ref, start)
        return F.when(age >= F.lit(i), value)

    if wide:
        return (counts.select("cohort", "label", "cohort_size",
                              *[censored(i, pct(F.col(f"m{i}"))).alias(f"Month {i}")
                                for i in range(months)])
                      .orderBy("cohort"))
    stack = ", ".join(f"{i}, m{i}" for i in range(months))
    long = counts.selectExpr("cohort", "label", "cohort_size",
                             f"stack({months}, {stack}) AS (month_idx, retained)")
    return (long.select("cohort", "label", "cohort_size",
                        F.col("month_idx").cast("int").alias("month_idx"),
                        F.concat(F.lit("Month "), F.col("month_idx").cast("string")).alias("month"),
                        "retained",
                        censored(F.col("month_idx"), pct(F.col("retained"))).alias("pct"))
                .orderBy("cohort", "month_idx"))
