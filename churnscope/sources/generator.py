"""Synthetic subscription customers, generated distributed.

``spark.range(n)`` plus hash-derived uniforms: every value is a function of
(row id, field, seed), so the output does not depend on partitioning (Spark's
``rand(seed)`` does) and any number of rows can be generated across executors
without the driver holding them.  Ranges, shares and formulas follow the
reference's sample set; its exact random numbers are not a goal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Plan tiers with their probabilities, prices and acquisition
# costs, the sample's reference date and its churn-score weights.
PLANS = ("Starter", "Growth", "Enterprise")
PLAN_PROBS = (0.6, 0.3, 0.1)
PLAN_PRICES = (29.0, 99.0, 299.0)
PLAN_CAC = (90.0, 300.0, 1200.0)
TODAY = "2026-06-02"
SIGNUP_DAYS = (30, 730)          # days ago, upper bound exclusive
REVENUE_JITTER = (-5.0, 15.0)
CAC_JITTER = (-20.0, 50.0)
USAGE_RANGE = (1, 31)            # upper bound exclusive
TICKETS_RANGE = (0, 11)
LOGIN_RANGE = (0, 45)
SCORE_WEIGHTS = {"tickets": 0.18, "last_login": 0.03, "usage": -0.02}
SCORE_NOISE_SD = 0.25
CHURN_ABOVE = 0.5
DAYS_PER_MONTH = 30.4


def uniform(field: str, seed: int, id_col: str = "id") -> Column:
    """U[0, 1) from the top 52 bits of md5(id:field:seed)."""
    h = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(field), F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint") / F.lit(float(16 ** 13))


def _randint(field: str, seed: int, lo: int, hi: int) -> Column:
    return (F.lit(lo) + F.floor(uniform(field, seed) * F.lit(hi - lo))).cast("bigint")


def _pick(idx: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + F.lit(1)).cast("int"))


def generate_customers(spark: SparkSession, n: int = 1000, seed: int = 42,
                       num_partitions: int | None = None) -> DataFrame:
    """Customers with the eleven standard columns (typed as in the sample set)."""
    ids = spark.range(0, n, 1, num_partitions) if num_partitions else spark.range(n)
    today = F.to_date(F.lit(TODAY))
    u_plan = uniform("plan", seed)
    plan_idx = (F.when(u_plan < F.lit(PLAN_PROBS[0]), F.lit(0))
                 .when(u_plan < F.lit(PLAN_PROBS[0] + PLAN_PROBS[1]), F.lit(1))
                 .otherwise(F.lit(2)))
    # Box-Muller standard normal from two uniforms (1 - u keeps log away from 0).
    normal = (F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform("n1", seed)))
              * F.cos(F.lit(2 * math.pi) * uniform("n2", seed)))
    base = ids.select(
        "id",
        F.date_sub(today, _randint("days", seed, *SIGNUP_DAYS).cast("int")).alias("signup"),
        plan_idx.alias("plan_idx"),
        _randint("usage", seed, *USAGE_RANGE).alias("UsageFrequency"),
        _randint("tickets", seed, *TICKETS_RANGE).alias("SupportTickets"),
        _randint("login", seed, *LOGIN_RANGE).alias("LastLoginDaysAgo"),
        (normal * F.lit(SCORE_NOISE_SD)).alias("noise"),
        uniform("rev", seed).alias("u_rev"), uniform("cac", seed).alias("u_cac"),
        uniform("tenure", seed).alias("u_ten"))
    lo_r, hi_r = REVENUE_JITTER
    lo_c, hi_c = CAC_JITTER
    score = (F.col("SupportTickets") * F.lit(SCORE_WEIGHTS["tickets"])
             + F.col("LastLoginDaysAgo") * F.lit(SCORE_WEIGHTS["last_login"])
             + F.col("UsageFrequency") * F.lit(SCORE_WEIGHTS["usage"]) + F.col("noise"))
    months = F.greatest(F.lit(1), F.floor(F.datediff(today, F.col("signup")) / F.lit(DAYS_PER_MONTH)))
    churned = score > F.lit(CHURN_ABOVE)
    typed = base.select(
        "*",
        F.bround(_pick(F.col("plan_idx"), PLAN_PRICES) + F.lit(lo_r) + F.col("u_rev") * F.lit(hi_r - lo_r),
                 2).alias("MonthlyRevenue"),
        F.bround(_pick(F.col("plan_idx"), PLAN_CAC) + F.lit(lo_c) + F.col("u_cac") * F.lit(hi_c - lo_c),
                 2).alias("CAC"),
        F.when(churned, F.lit("Churned")).otherwise(F.lit("Active")).alias("Status"),
        F.when(churned, F.lit(1) + F.floor(F.col("u_ten") * months)).otherwise(months)
         .cast("bigint").alias("TenureMonths"))
    return typed.select(
        F.concat(F.lit("CUST-"), (F.col("id") + F.lit(1000)).cast("string")).alias("CustomerID"),
        F.date_format("signup", "yyyy-MM-dd").alias("SignupDate"),
        _pick(F.col("plan_idx"), PLANS).alias("PlanType"),
        "MonthlyRevenue", "Status", "TenureMonths", "UsageFrequency", "SupportTickets",
        "LastLoginDaysAgo",
        F.bround(F.col("MonthlyRevenue") * F.col("TenureMonths"), 2).alias("LTV"),
        "CAC")
