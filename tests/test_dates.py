"""Date formats: each against Python's own parser, and the choice for a column."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from churnscope.functions import DATE_FORMATS, month_bucket, parse_as
from churnscope.operators import charts
from churnscope.operators.date_formats import date_formats, infer_date_formats

# Writing of each format, as strftime has it.
WRITTEN = {"iso": "%Y-%m-%d", "year/month/day": "%Y/%m/%d", "month/day/year": "%m/%d/%Y", "day/month/year": "%d.%m.%Y",
           "month/day/yy": "%m/%d/%y", "day/month/yy": "%d-%m-%y", "month day, year": "%B %d, %Y", "day month year": "%d %b %Y"}
DAYS = [dt.datetime(1969, 1, 1) + dt.timedelta(days=97 * i, hours=i % 24, minutes=i % 60) for i in range(190)]


def parsed(spark, texts, fmt):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return {r.i: r.d for r in df.select("i", parse_as("t", fmt).alias("d")).collect()}


@pytest.mark.parametrize("name", list(WRITTEN))
def test_every_format_reads_what_it_writes(spark, name):
    for time in ("", " %H:%M:%S", " %I:%M %p") if name != "iso" else ("", " %H:%M:%S"):
        texts = [d.strftime(WRITTEN[name] + time) for d in DAYS]
        want = [d if time else dt.datetime(d.year, d.month, d.day) for d in DAYS]
        assert list(parsed(spark, texts, name).values()) == want


def test_no_date_is_null(spark):
    texts = ["02/30/2020", "13/13/2020", "2020/13/01", "Foo 1, 2020", "1/2/3", "01/02/2020 25:00", "01/02/2020 13:00 PM",
             "01/02.2020", "x 01/02/2020", "01/02/20200", "", None, "1 Marchx 2020", "May 32, 2020"]
    for f in DATE_FORMATS:
        assert set(parsed(spark, texts, f).values()) == {None}, f.name


def test_month_names(spark):
    texts = ["Sept. 5, 2021", "september 5th 2021", "5 SEP 2021", "05-Sep-2021", "May 1, 2020", "12th of May 2020"]
    us, eu = parsed(spark, texts, "month day, year"), parsed(spark, texts, "day month year")
    assert [d and d.month for d in us.values()] == [9, 9, None, None, 5, None]
    assert [d and d.month for d in eu.values()] == [None, None, 9, 9, None, None]


@pytest.mark.parametrize("name", list(WRITTEN))
def test_chosen_format_gives_pandas_months(spark, name):
    if name == "day/month/yy":
        pytest.skip("pandas takes the last two digits for a day")
    texts = [d.strftime(WRITTEN[name]) for d in DAYS if d.day > 12] + ["nonsense", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(5)
    chosen = infer_date_formats(df, ["t"])["t"]
    assert chosen.name == name
    want = pd.Series(pd.to_datetime(texts, errors="coerce", format=WRITTEN[name])).dt.to_period("M").astype(str).tolist()
    got = {r.i: r.m for r in df.select("i", month_bucket("t", chosen).alias("m")).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_order_of_day_and_month(spark):
    few = [f"{m:02d}/{d:02d}/2021" for m in range(1, 13) for d in range(1, 13)]
    tables = {"told": few + ["25/01/2021"], "not told": few, "mixed": few + ["25/01/2021"] * 2 + ["01/25/2021"],
              "most": few + ["2021-01-01"] * 10, "none": ["x", None]}
    said = {}
    for name, texts in tables.items():
        for rows in (texts, texts[::-1]):
            df = spark.createDataFrame([(t,) for t in rows], "`a b` string")
            got = [r for r in date_formats(df, ["a b"]).collect() if r.chosen]
            said.setdefault(name, set()).add(tuple((r.format, r.ambiguous, r.rival_only) for r in got))
    assert said == {"told": {(("day/month/year", False, 0),)}, "not told": {(("month/day/year", True, 0),)},
                    "mixed": {(("day/month/year", False, 1),)}, "most": {(("month/day/year", True, 0),)}, "none": {()}}


def test_empty_table_and_trend(spark):
    none = spark.createDataFrame([], "t string")
    assert [r.present for r in date_formats(none, ["t"]).collect()] == [0] * len(DATE_FORMATS)
    assert infer_date_formats(none, ["t"])["t"].name == "iso"
    df = spark.createDataFrame([("13/01/2025",), ("14/01/2025",), ("2025-02-01",)], "SignupDate string")
    fmt = infer_date_formats(df, ["SignupDate"])["SignupDate"]
    assert [tuple(r) for r in charts.signup_trend(df, fmt).collect()] == [("2025-01", 2), ("NaT", 1)]
    assert df.select(F.count(month_bucket("SignupDate"))).first()[0] == 3
