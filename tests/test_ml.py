"""Churn model properties: split, encoding, one-class safeguard, ledger, what-if."""

import pytest
from pyspark.sql import functions as F

from churnscope.operators import ml, preprocess
from churnscope.plans import catalog as C
from churnscope.sources import models
from conftest import SF_SMALL, customers

SMALL_FOREST = dict(num_trees=10, max_depth=4)


@pytest.fixture(scope="module")
def trained(spark):
    c = C.cleaned(spark, SF_SMALL)
    model, metrics = ml.train_churn(c, **SMALL_FOREST)
    return c, model, metrics.first().asDict()


def test_split_share_and_stability(spark):
    c = ml.with_target(C.cleaned(spark, SF_SMALL))
    a = ml.split(c).select("CustomerID", "is_test")
    b = ml.split(c.repartition(7)).select("CustomerID", "is_test")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    share = a.where("is_test").count() / a.count()
    assert 0.2 < share < 0.3


def test_balanced_split_per_class(spark):
    c = ml.with_target(C.cleaned(spark, SF_SMALL))
    rows = ml.split(c, balanced=True).groupBy("target").agg(F.avg(F.col("is_test").cast("double")).alias("s"))
    for r in rows.collect():
        assert abs(r.s - 0.25) < 0.01


def test_plan_codes_alphabetical_null_is_nan(spark):
    df = preprocess.preprocess(customers(spark, [
        dict(CustomerID="a", PlanType="b"), dict(CustomerID="b", PlanType=None),
        dict(CustomerID="c", PlanType="a"), dict(CustomerID="d", PlanType="B")]))
    enc = ml.fit_plan_encoder(df)
    assert [tuple(r) for r in enc.orderBy("_plan_code").collect()] == [("B", 0), ("a", 1), ("b", 2), ("nan", 3)]
    got = {r.CustomerID: r.plan_code for r in ml.plan_codes(df, enc).collect()}
    assert got == {"a": 2, "b": 3, "c": 1, "d": 0}


def test_plan_dictionary_over_many_partitions(spark):
    """Codes are gapless and in text order across the sorted partitions."""
    df = spark.range(5000).selectExpr("cast(id as string) AS CustomerID", "concat('p', id % 1700) AS PlanType")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        got = [tuple(r) for r in ml.fit_plan_encoder(df).collect()]
    finally:
        spark.conf.set(key, before)
    want = sorted(f"p{i}" for i in range(1700))
    assert sorted(got) == [(p, i) for i, p in enumerate(want)]


def test_metrics_from_confusion(spark):
    pred = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0), (0.0, 0.0)],
                                 "target double, prediction double")
    m = ml.binary_metrics(pred)
    assert m.columns[:4] == list(ml.METRIC_NAMES)
    r = m.first()
    assert r.Accuracy == pytest.approx(60.0) and r.Precision == pytest.approx(50.0)
    assert r.Recall == pytest.approx(50.0) and r["F1-Score"] == pytest.approx(50.0)
    none = spark.createDataFrame([(0.0, 0.0)], "target double, prediction double")
    r = ml.binary_metrics(none).first()
    assert (r.Precision, r.Recall, r["F1-Score"]) == (0.0, 0.0, 0.0)


def test_importances_sum_to_one(spark, trained):
    _, model, metrics = trained
    imp = model.importances(spark).collect()
    assert len(imp) == 6 and sum(r.Importance for r in imp) == pytest.approx(1.0)
    assert [r.Importance for r in imp] == sorted((r.Importance for r in imp), reverse=True)
    assert 0 <= metrics["Accuracy"] <= 100


def test_ledger_sorted_active_and_banded(spark, trained):
    c, model, _ = trained
    ledger = ml.risk_ledger(c, model)
    assert ledger.columns == list(ml.LEDGER_COLUMNS)
    led = ledger.collect()
    assert len(led) == c.where("lower(Status) = 'active'").count()
    probs = [r.ChurnRiskProbability for r in led]
    assert probs == sorted(probs, reverse=True)
    for r in led:
        p = r.ChurnRiskProbability
        want = "🔴 HIGH RISK" if p >= 0.7 else ("🟡 MEDIUM RISK" if p >= 0.4 else "🟢 SAFE")
        assert r.RiskCategory == want
    top = ml.risk_ledger(c, model, top_n=5).collect()
    assert [r.CustomerID for r in top] == [r.CustomerID for r in led[:5]]
    found = ml.risk_ledger(c, model, search="cust-1").collect()
    assert found and all("cust-1" in r.CustomerID.lower() for r in found)
    lit = ml.risk_ledger(c, model, search="(", literal=True).collect()
    assert lit == []


def test_what_if_and_unseen_plan(spark, trained):
    c, model, _ = trained
    w = ml.what_if(c, model, {"tickets": 0}).collect()
    assert w and all(r.tickets == 0 for r in w)
    many = ml.what_if_many(c, model, [{"tickets": 0}, {"last_login": 90, "usage": 0}])
    counts = {r.scenario: r["count"] for r in many.groupBy("scenario").count().collect()}
    assert counts == {0: len(w), 1: len(w)}
    assert all(r.risk_text in ("HIGH RISK", "MEDIUM RISK", "SAFE") for r in w)
    sc = spark.createDataFrame(
        [("NoSuchPlan", 99.0, 6, 25, 2, 3), (model.plans.where("_plan_code = 0").first()["_plan_text"], 99.0, 6, 25, 2, 3)],
        "plan string, revenue double, tenure bigint, usage bigint, tickets bigint, last_login bigint")
    p = [r.probability for r in ml.score_scenarios(sc, model).collect()]
    assert p[0] == pytest.approx(p[1])  # unseen plan scores as code 0
    with pytest.raises(Exception):
        bad = preprocess.preprocess(customers(spark, [dict(CustomerID="z", Status="Active",
                                                           PlanType="NoSuchPlan")]))
        ml.risk_ledger(bad, model).collect()


@pytest.mark.parametrize("status,want", [("Active", 0.0), ("Churned", 1.0)])
def test_one_class_model(spark, status, want):
    rows = [dict(CustomerID=f"c{i}", Status=status, PlanType="p", TenureMonths=str(i % 7),
                 MonthlyRevenue=str(10 + i)) for i in range(40)]
    df = preprocess.preprocess(customers(spark, rows))
    model, _ = ml.train_churn(df, **SMALL_FOREST)
    sc = spark.createDataFrame([("p", 50.0, 3, 1, 1, 1)],
                               "plan string, revenue double, tenure bigint, usage bigint, tickets bigint, last_login bigint")
    assert ml.score_scenarios(sc, model).first().probability == want


def test_model_save_load_roundtrip(spark, trained, tmp_dir):
    c, model, _ = trained
    path = models.save_model(model, tmp_dir + "/m")
    again = models.load_model(path)
    a = [r.ChurnRiskProbability for r in ml.risk_ledger(c, model).collect()]
    b = [r.ChurnRiskProbability for r in ml.risk_ledger(c, again).collect()]
    assert a == b
    assert again.metrics_row == model.metrics_row
    models.save_model(again, path)  # a model may replace the version it was read from
    assert models.load_model(path).plans.count() == model.plans.count()
    with pytest.raises(models.NoModelError):
        models.load_model(tmp_dir + "/missing")


def test_scenario_grid(spark):
    g = ml.scenario_grid(spark, plans=("A", "B"), revenue=(10.0, 20.0), tenure=range(1, 4),
                         usage=range(0, 2), tickets=range(0, 2), last_login=range(0, 3))
    rows = g.collect()
    assert len(rows) == 2 * 2 * 3 * 2 * 2 * 3
    assert len(set(map(tuple, rows))) == len(rows)
    assert {r.plan for r in rows} == {"A", "B"} and {r.tenure for r in rows} == {1, 2, 3}


def test_ledger_sort_spreads_a_hot_id(spark):
    """A third of the rows share one id: the sort still uses many partitions."""
    rows = [dict(CustomerID="HOT" if i % 3 == 0 else f"c{i}", Status="Active", PlanType="p",
                 TenureMonths=str(i % 13), MonthlyRevenue=str(10 + i % 97), SupportTickets=str(i % 5))
            for i in range(3000)]
    df = preprocess.preprocess(customers(spark, rows))
    # A one-class model scores every row 0: a third of the rows then share
    # both the id and the score, the worst case for a range partitioner.
    model, _ = ml.train_churn(df, **SMALL_FOREST)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")  # keep the range partitions as planned (tiny data)
    try:
        sizes = ml.risk_ledger(df, model).rdd.glom().map(len).collect()
    finally:
        spark.conf.set(key, before)
    assert sum(sizes) == 3000 and len(sizes) > 1
    assert max(sizes) < 1000  # the 1,000 HOT rows did not land in one partition
