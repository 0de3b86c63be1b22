"""Coercion rules on edge tables, and against pandas itself."""

import math

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from churnscope.functions import clean_int, clean_money, month_bucket, na_to_null
from churnscope.functions.cleaning import clean_columns


def pandas_money(v):
    s = pd.Series([v], dtype=object).astype(str).str.replace(r"[$,\s]", "", regex=True)
    return float(pd.to_numeric(s, errors="coerce").fillna(0.0)[0])


def pandas_int(v):
    x = pd.to_numeric(pd.Series([v], dtype=object), errors="coerce").fillna(0)[0]
    if math.isinf(x) or not -2.0 ** 63 <= x < 2.0 ** 63:
        return 0  # the reference fails here; we coerce to 0 (intended difference)
    return int(x)


def run(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, raw string")
    return [r["x"] for r in df.select("i", expr(F.col("raw")).alias("x")).orderBy("i").collect()]


MONEY_EDGE = ["$1,200.50", "  $5 ", "1 000", "(5)", "1e3", "nan", "inf", "-inf", "1d", None, "",
              "N/A", "$ 473274.17", "12.", ".5", "1e400", "€5", "--5", "+7"]
INT_EDGE = ["5.9", "-5.9", "1,200", " 5 ", "", "inf", None, "nan", "12.7", "1e3", "1d", "0x10",
            " 5", "3.7", "-3.7", "99999999999999999999"]


def test_money_edge_matches_pandas(spark):
    got = run(spark, MONEY_EDGE, clean_money)
    want = [pandas_money(v) for v in MONEY_EDGE]
    assert got == want


def test_int_edge_matches_pandas(spark):
    got = run(spark, INT_EDGE, clean_int)
    want = [pandas_int(v) for v in INT_EDGE]
    assert got == want


def test_int_truncates_toward_zero(spark):
    assert run(spark, ["3.7", "-3.7", "12.7", "0.7"], clean_int) == [3, -3, 12, 0]


def test_staged_cleaning_equals_column_cleaners(spark):
    vals = MONEY_EDGE + INT_EDGE
    df = spark.createDataFrame([(v, v) for v in vals], "m string, n string")
    staged = clean_columns(df, money=["m"], ints=["n"]).collect()
    direct = df.select(clean_money("m").alias("m"), clean_int("n").alias("n")).collect()
    assert [tuple(r) for r in staged] == [tuple(r) for r in direct]


_alphabet = st.sampled_from(list("0123456789.,-+eE$ dfinaINFx") + [" ", "\t"])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(_alphabet, min_size=0, max_size=8), min_size=1, max_size=20))
def test_property_money_and_int_match_pandas(spark, values):
    got_m = run(spark, values, clean_money)
    got_i = run(spark, values, clean_int)
    for v, gm, gi in zip(values, got_m, got_i):
        wm = pandas_money(v)
        assert (gm == wm) or (math.isnan(gm) and math.isnan(wm)), (v, gm, wm)
        assert gi == pandas_int(v), (v, gi, pandas_int(v))


def test_na_tokens_exact_match(spark):
    vals = ["", "N/A", "nan", " nan", "NULL", "null", "x", None, "NaN", "n/a", "<NA>"]
    got = run(spark, vals, na_to_null)
    assert got == [None, None, None, " nan", None, None, "x", None, None, None, None]


def test_month_bucket_edges(spark):
    vals = ["2025-01-05", "2025-01-05T10:00:00", "2025/02/06", "2025-13-01", "2025-04", None, "unknown"]
    got = run(spark, vals, month_bucket)
    assert got == ["2025-01", "2025-01", "NaT", "NaT", "2025-04", "NaT", "NaT"]


def test_month_bucket_extra_formats(spark):
    df = spark.createDataFrame([("2025/02/06",), ("2025-03-01",)], "d string")
    got = [r[0] for r in df.select(month_bucket("d", formats=["yyyy/MM/dd"])).collect()]
    assert got == ["2025-02", "2025-03"]


@pytest.mark.parametrize("status,active,churned", [
    ("Active", True, False), ("ACTIVE", True, False), (" Active", False, False),
    ("churned", False, True), ("Inactive", False, True), ("Trial", False, False), (None, False, False)])
def test_status_rules(spark, status, active, churned):
    from churnscope.functions import is_active, is_churned
    df = spark.createDataFrame([(status,)], "Status string")
    r = df.select(is_active("Status").alias("a"), is_churned("Status").alias("c")).first()
    assert (r.a, r.c) == (active, churned)


def test_month_bucket_takes_dates_only(spark):
    from churnscope.functions import month_bucket
    want = {"2025-01-05": "2025-01", "2025-04": "2025-04", "2025": "2025-01", "20250105": "2025-01",
            "2025-01-31T23:30:00-05:00": "2025-01", "2025-01-31 23:30:00+0500": "2025-01",
            "2025-03-01T10:00:00Z": "2025-03", "2025-02-30": "NaT", "45123": "NaT", "T10:30": "NaT",
            "10:30": "NaT", "+45123-01-01": "NaT", "": "NaT", "20251305": "NaT", "2025-01-05 x": "NaT"}
    df = spark.createDataFrame([(k,) for k in [*want, None]], "d string")
    got = {r.d: r.m for r in df.select("d", month_bucket("d").alias("m")).collect()}
    assert got == want | {None: "NaT"}
