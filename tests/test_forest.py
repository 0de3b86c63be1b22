"""Native forests, exact stratified splits and ranks over partitions."""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from churnscope.operators import forest, ml, splits
from churnscope.operators.ranks import numbered, ranked
from churnscope.plans import catalog as C
from churnscope.roles import FEATURES
from conftest import SF_SMALL

SMALL_FOREST = dict(num_trees=12, max_depth=5)


@pytest.fixture(scope="module")
def fitted(spark):
    c = C.cleaned(spark, SF_SMALL)
    return c, ml.train_churn(c, **SMALL_FOREST)[0]


def test_compiled_forest_equals_the_fitted_one(spark, fitted):
    c, model = fitted
    want = {r.CustomerID: r.churn_probability for r in model.transform(c).collect()}
    got = {r.CustomerID: r.churn_probability for r in model.native().transform(c).collect()}
    assert got == want and len(set(want.values())) > 20


def test_full_size_forest_compiles(spark):
    c = C.cleaned(spark, SF_SMALL)
    model = ml.train_churn(c)[0]
    assert len(model.native().forest.trees) == ml.NUM_TREES
    want = model.transform(c).agg(F.sum("churn_probability"), F.max("churn_probability")).first()
    got = model.native().transform(c).agg(F.sum("churn_probability"), F.max("churn_probability")).first()
    assert got[0] == pytest.approx(want[0]) and got[1] == want[1]


def test_native_scoring_has_no_udf_and_no_shuffle(spark):
    rows = spark.range(100).selectExpr(*[f"cast(id % {7 + i} as double) AS {f}" for i, f in enumerate(FEATURES)])
    plan = forest.with_probability(rows, C.HAND_FOREST, {f: F.col(f) for f in FEATURES})._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("UDF", "Exchange", "Python"))


def test_column_equals_plain_walk(spark):
    rows = spark.range(400).selectExpr("(id * 7919) % 60 AS TenureMonths", "id % 25 AS UsageFrequency", "id % 5 AS SupportTickets",
                                       "(id * 31) % 45 AS LastLoginDaysAgo", "id % 6 AS PlanType", "(id * 977) % 300000 AS MonthlyRevenue")
    for r in forest.with_probability(rows, C.HAND_FOREST, {f: F.col(f) for f in FEATURES}).collect():
        assert r.churn_probability == C.HAND_FOREST.probability({f: r[f] for f in FEATURES})


def test_one_class_model_compiles(spark):
    c = C.cleaned(spark, SF_SMALL).where("lower(Status) = 'active'")
    model = ml.train_churn(c, **SMALL_FOREST)[0]
    assert {r.churn_probability for r in model.native().transform(c).collect()} == {0.0}


def test_fit_does_not_depend_on_the_layout(spark):
    c = C.cleaned(spark, SF_SMALL)
    rows = spark.createDataFrame(c.collect(), c.schema)  # no file layout behind it
    said = []
    for n in (1, 4, 16):
        model, metrics = ml.train_churn(rows.repartition(n), partitions=4, **SMALL_FOREST)
        said.append((model.importances(spark).collect(), metrics.collect()))
    assert said[0] == said[1] == said[2]


# Exact split

def test_hold_out_counts():
    assert splits.hold_out_counts({0: 99, 1: 1}, 0.25, 42) == {0: 25, 1: 0}
    assert splits.hold_out_counts({0: 60, 1: 40}, 0.25, 42) == {0: 15, 1: 10}
    assert sum(splits.hold_out_counts({0: 13, 1: 13}, 0.25, 42).values()) == 7
    assert splits.hold_out_counts({}, 0.25, 42) == {}
    assert splits.hold_out_counts({1: 1}, 0.25, 42) == {1: 1}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d", None, "hot"]), st.sampled_from([0.0, 0.0, 0.0, 1.0, 2.0])),
                min_size=1, max_size=60), st.sampled_from([0.25, 0.1, 0.5]))
def test_split_counts_are_exact(spark, rows, test):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "CustomerID string, target double, n int").repartition(3)
    out = ml.split(df, test=test, balanced=True).collect()
    assert sorted(r.n for r in out) == list(range(len(rows)))
    want = splits.hold_out_counts(dict(Counter(t for _, t in rows)), test, 42)
    got = Counter(r.target for r in out if r.is_test)
    assert {k: got[k] for k in want} == want


def test_one_class_with_nearly_all_rows_and_a_hot_id(spark):
    rows = [("hot", 0.0, 1)] * 500 + [(f"c{i}", 0.0, i) for i in range(490)] + [(f"d{i}", 1.0, i) for i in range(10)]
    df = spark.createDataFrame(rows, "CustomerID string, target double, n int")
    want = splits.hold_out_counts({0.0: 990, 1.0: 10}, 0.25, 42)
    picks = []
    for n in (1, 7):
        out = ml.split(df.repartition(n), balanced=True).collect()
        assert Counter(r.target for r in out if r.is_test) == want
        picks.append(sorted((r.CustomerID, r.n, r.is_test) for r in out))
    assert picks[0] == picks[1]


def test_split_of_no_rows(spark):
    assert ml.split(spark.createDataFrame([], "CustomerID string, target double"), balanced=True).collect() == []


# Ranks

def brute_ranks(values, tiles):
    order = sorted(values, key=lambda v: (v[1] is None, -(v[1] or 0), v[0]))
    out, n = {}, len(order)
    for i, (name, v) in enumerate(order):
        first = next(k for k, x in enumerate(order) if x[1] == v)
        dense = len({x[1] for x in order[:first]}) + 1
        size, big = divmod(n, tiles)
        tile = i // (size + 1) if i < big * (size + 1) else big + (i - big * (size + 1)) // max(size, 1)
        out[name] = (i + 1, first + 1, dense, first / (n - 1) if n > 1 else 0.0, tile + 1)
    return out


@pytest.mark.parametrize("parts,width", [(1, 2), (6, 3), (16, 16)])
def test_ranks_with_a_tie_over_many_partitions(spark, parts, width):
    values = [(i, 5.0 if i % 3 == 0 else float(i * 37 % 41)) for i in range(300)] + [(1000 + i, None) for i in range(7)]
    df = spark.createDataFrame(values, "id long, v double").repartition(parts)
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(width))
    try:
        got = {r.id: (r.row_number, r["rank"], r.dense_rank, r.percent_rank, r.tile)
               for r in ranked(df, "v", [F.col("id")], tiles=10).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == brute_ranks(values, 10)


def test_ranks_of_one_value_one_row_and_none(spark):
    for values in ([(i, 1.0) for i in range(50)], [(1, 2.0)], []):
        df = spark.createDataFrame(values, "id long, v double")
        got = {r.id: (r.row_number, r["rank"], r.dense_rank, r.percent_rank, r.tile) for r in ranked(df, "v", [F.col("id")], 7).collect()}
        assert got == brute_ranks(values, 7)


def test_equal_rows_are_numbered_without_gaps(spark):
    df = spark.createDataFrame([(1,)] * 90 + [(2,)] * 10, "v int").repartition(5)
    out = numbered(df, [F.col("v").desc()]).collect()
    assert sorted(r.row_number for r in out) == list(range(1, 101))
    assert all(r.v == 2 for r in out if r.row_number <= 10)


def test_one_plan_for_all_equals_the_plan_row_by_row(spark):
    c = C.cleaned(spark, SF_SMALL)
    model = C.hand_model(c)
    for plan in ("HIGH", "no such plan", None):
        got = {r.CustomerID: r.probability for r in ml.what_if(c, model, {"plan": plan}).collect()}
        rows = ml.as_scenarios(C.filters.active_filter(c)).withColumn("plan", F.lit(plan).cast("string"))
        want = {r.CustomerID: r.probability for r in ml.score_scenarios(rows, model, keep=("CustomerID",)).collect()}
        assert got == want and len(set(got.values())) > 3
