"""Rule-based executive insights over the KPI row and the support split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.functions.labels import LTV_CAC_BENCHMARK, ltv_cac_band
from churnscope.operators.charts import support_rates
from churnscope.operators.exact import combine, partial_sums
from churnscope.operators.kpis import kpi_measures, kpi_rows
from churnscope.operators.ranks import write_again

# Insight texts and the support-friction thresholds (the rule
# looks at the 5th ticket group in ascending ticket order and fires above 50%).
CRITICAL_ECONOMICS = ("**Critical Unit Economics:** Your LTV to CAC ratio is currently below the "
                      "industry benchmark of 3.0x. Consider reducing marketing spends or increasing "
                      "monthly prices.")
EXCELLENT_ECONOMICS = ("**Excellent Unit Economics:** Your LTV:CAC is highly positive. Expand search "
                       "ads immediately to capture higher market shares.")
SUPPORT_FRICTION = ("**Customer Experience Friction:** Churn rates spike above 50% for users with more "
                    "than 4 support tickets. Implement a proactive outreach program for high-ticket "
                    "clients.")
FRICTION_GROUP_POSITION = 5
FRICTION_RATE_ABOVE = 50.0


def unit_economics(kpi_row: DataFrame) -> DataFrame:
    """``critical`` when LTV:CAC is below 3.0, else ``excellent``; with the card colour."""
    below = F.col("ltv_cac_ratio") < F.lit(LTV_CAC_BENCHMARK)
    return kpi_row.select(
        "ltv_cac_ratio",
        F.when(below, F.lit("critical")).otherwise(F.lit("excellent")).alias("level"),
        F.when(below, F.lit(CRITICAL_ECONOMICS)).otherwise(F.lit(EXCELLENT_ECONOMICS)).alias("message"),
        ltv_cac_band("ltv_cac_ratio").alias("band_color"))


def support_friction(support: DataFrame) -> DataFrame:
    """One row: does the 5th ticket group (by position) churn above 50%?

    Only the five smallest ticket keys are needed, so this is a top-5
    (per-task top-n, merge of five rows per task) followed by a tiny agg;
    no window over the whole support table.
    """
    first = support.orderBy("tickets").limit(FRICTION_GROUP_POSITION)
    row = first.agg(F.count(F.lit(1)).alias("groups_seen"),
                    F.max("tickets").alias("fifth_tickets"),
                    F.max_by("churn_rate", "tickets").alias("fifth_churn_rate"))
    full = F.col("groups_seen") >= F.lit(FRICTION_GROUP_POSITION)
    fires = full & (F.col("fifth_churn_rate") > F.lit(FRICTION_RATE_ABOVE))
    return row.select(
        F.when(full, F.col("fifth_tickets")).alias("fifth_tickets"),
        F.when(full, F.col("fifth_churn_rate")).alias("fifth_churn_rate"),
        fires.alias("fires"),
        F.when(fires, F.lit(SUPPORT_FRICTION)).alias("message"))


def insights(kpi_row: DataFrame, support: DataFrame) -> DataFrame:
    """All fired insights as rows ``(rule, level, message)``."""
    econ = unit_economics(kpi_row).select(F.lit("unit_economics").alias("rule"), "level", "message")
    fr = (support_friction(support).where("fires")
          .select(F.lit("support_friction").alias("rule"), F.lit("warning").alias("level"), "message"))
    return econ.unionByName(fr)


def insights_of(df: DataFrame) -> DataFrame:
    """All fired insights of a cleaned customer table, from one scan.

    The sums of the KPIs are grouped by ticket count and written (a few rows
    per ticket count); the support split reads them as they are, the KPI row
    adds them up further.
    """
    sums, counts = kpi_measures()
    counts = {**counts, "Total": F.col("CustomerID").isNotNull()}
    parts = df.withColumn("tickets", F.col("SupportTickets"))
    parts = write_again(partial_sums(parts, ["tickets"], sums, counts), "insights")
    kpi_row = kpi_rows(combine(parts, [], list(sums), list(counts)))
    by_tickets = combine(parts, ["tickets"], list(sums), list(counts))
    support = support_rates(by_tickets.select("tickets", "Total", F.col("churn_count").alias("Churned")))
    return insights(kpi_row, support)
