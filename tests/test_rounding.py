"""Exact half-even rounding matches Python's round; plain bround does not always."""

import pytest
from pyspark.sql import functions as F

from churnscope.functions.rounding import round_half_even


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_matches_python_round_on_cohort_ratios(spark, digits):
    ns = [7, 400, 1999, 2000, 3333, 4999]
    rows = [(a, n) for n in ns for a in range(n + 1)]
    df = spark.createDataFrame(rows, "a long, n long").withColumn("x", F.col("a") / F.col("n") * F.lit(100.0))
    got = df.select("a", "n", round_half_even("x", digits).alias("r")).collect()
    bad = [(r.a, r.n, r.r) for r in got if r.r != round((r.a / r.n) * 100, digits)]
    assert bad == []


def test_plain_bround_differs_somewhere(spark):
    rows = [(a, 2000) for a in range(2001)]
    df = spark.createDataFrame(rows, "a long, n long").withColumn("x", F.col("a") / F.col("n") * F.lit(100.0))
    got = df.select("a", F.bround("x", 1).alias("b")).collect()
    assert any(r.b != round((r.a / 2000) * 100, 1) for r in got)


def test_signs_zero_and_exact_ties(spark):
    vals = [0.0, 6.25, 6.35, -6.35, 2.675, -2.675, 0.05, 1e9 + 0.15, 99.95]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(round_half_even("x", 1)).collect()]
    assert got == [round(v, 1) for v in vals]
    got2 = [r[0] for r in df.select(round_half_even("x", 2)).collect()]
    assert got2 == [round(v, 2) for v in vals]
