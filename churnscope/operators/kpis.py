"""Recurring-revenue KPI row: one global aggregate of conditional measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.functions import is_active, is_churned
from churnscope.operators.exact import exact_sums


def kpis(df: DataFrame, by: list[str] | tuple[str, ...] | None = None) -> DataFrame:
    """KPI row over a cleaned, role-named frame (one row per ``by`` group if given).

    All measures come from one scan: each task reduces its rows to a few whole
    numbers per measure (``operators.exact``), one merge adds them up, so the
    result is the same to the last bit for every layout of the table; the
    derived ratios are projections over that one row.

    * total_customers counts rows, not distinct IDs;
    * churned means ``churned``/``inactive``; other statuses count in totals only;
    * avg_cac is 1.0 on an empty table, every other empty measure is 0.
    """
    keys = list(by or ())
    sums, counts = kpi_measures()
    return kpi_rows(exact_sums(df, keys, sums, counts), keys)


def kpi_measures() -> tuple[dict[str, Column], dict[str, Column]]:
    """The sums and counts that the KPIs are made of."""
    active, churned, rev = is_active("Status"), is_churned("Status"), F.col("MonthlyRevenue")
    return ({"mrr": F.when(active, rev), "lost": F.when(churned, rev), "ltv": F.col("LTV"), "cac": F.col("CAC")},
            {"total_customers": F.lit(True), "active_count": active, "churn_count": churned})


def kpi_rows(base: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The KPI rows of :func:`kpi_measures` added up."""
    def mean(name: str) -> Column:
        return F.when(F.col(f"{name}_n") > 0, F.col(name) / F.col(f"{name}_n"))

    base = base.withColumns({
        "latest_mrr": F.coalesce("mrr", F.lit(0.0)), "lost_mrr": F.coalesce("lost", F.lit(0.0)),
        "arpu": F.coalesce(mean("mrr"), F.lit(0.0)), "_avg_ltv": mean("ltv"), "_avg_cac": mean("cac")})
    total = F.col("total_customers")
    mrr, lost = F.col("latest_mrr"), F.col("lost_mrr")
    avg_ltv = F.when(total > 0, F.col("_avg_ltv")).otherwise(F.lit(0.0))
    avg_cac = F.when(total > 0, F.col("_avg_cac")).otherwise(F.lit(1.0))
    return (base
            .withColumns({"avg_ltv": avg_ltv, "avg_cac": avg_cac})
            .select(
                *keys,
                "latest_mrr",
                (mrr * F.lit(12)).alias("latest_arr"),
                "arpu",
                "active_count",
                "total_customers",
                F.when(total > 0, F.col("churn_count") / total * F.lit(100.0))
                 .otherwise(F.lit(0.0)).alias("logo_churn_rate"),
                F.when(mrr + lost > 0, lost / (mrr + lost) * F.lit(100.0))
                 .otherwise(F.lit(0.0)).alias("revenue_churn_rate"),
                "avg_ltv",
                "avg_cac",
                F.when(F.col("avg_cac") > 0, F.col("avg_ltv") / F.col("avg_cac"))
                 .otherwise(F.lit(0.0)).alias("ltv_cac_ratio"),
            ))
