"""Grouped chart datasets: plan split, signup trend, support-load churn.

Each is one ``groupBy`` over a low-cardinality key.  Spark's partial
aggregation collapses every task's rows to one row per key before the shuffle,
so a key holding a third of the table costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.functions import is_churned, month_bucket
from churnscope.operators.exact import exact_sums
from churnscope.operators.ranks import write_again


def plan_distribution(df: DataFrame) -> DataFrame:
    """Per non-null plan: revenue summed exactly over all statuses and row count, key ascending."""
    plans = df.where(F.col("PlanType").isNotNull()).withColumn("label", F.col("PlanType"))
    return (exact_sums(plans, ["label"], {"revenue": F.col("MonthlyRevenue")}, {"users": F.lit(True)})
            .select("label", "revenue", "users").orderBy("label"))


def plan_revenue_share(plan_dist: DataFrame) -> DataFrame:
    """Add each plan's share of plotted revenue (the donut's parts of a whole).

    The plan table is written once, so its total (an exact sum, one value) is
    read from there and the customers are scanned once.
    """
    plans = write_again(plan_dist, "plan-table")
    total = exact_sums(plans, [], {"total": F.col("revenue")}).select("total").scalar()
    return plans.withColumn(
        "share", F.when(total != 0, F.col("revenue") / total).otherwise(F.lit(0.0))).orderBy("label")


def signup_trend(df: DataFrame, formats=None) -> DataFrame:
    """Rows per signup month (``NaT`` kept as a group), ascending, empty months not filled."""
    return (df.groupBy(month_bucket("SignupDate", formats).alias("month"))
              .agg(F.count(F.lit(1)).alias("acquisitions"))
              .orderBy("month"))


def support_churn(df: DataFrame) -> DataFrame:
    """Per ticket count: non-null IDs, churned rows and churn rate in percent."""
    counts = (df.groupBy(F.col("SupportTickets").alias("tickets"))
              .agg(F.count("CustomerID").alias("Total"),
                   F.count_if(is_churned("Status")).alias("Churned")))
    return support_rates(counts)


def support_rates(counts: DataFrame) -> DataFrame:
    total, churned = F.col("Total"), F.col("Churned")
    return counts.withColumn("churn_rate", F.when(total > 0, churned / total * F.lit(100.0)).otherwise(F.lit(0.0))).orderBy("tickets")
