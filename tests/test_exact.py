"""Exact sums against Python's own exact sum, bit for bit, for any layout."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from churnscope.operators import charts, insights, kpis
from churnscope.operators.exact import FIRST_BIN, LAST_BIN, _power, combine, exact_sums, partial_sums
from churnscope.plans import catalog as C
from conftest import SF_SMALL


def exact(values):
    values = [v for v in values if v is not None]
    if not values:
        return None
    if any(math.isnan(v) or math.isinf(v) for v in values):
        return sum(v for v in values if math.isnan(v) or math.isinf(v))
    try:
        return math.fsum(values)
    except OverflowError:
        return None


def same(a, b):
    return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))


def test_powers_of_two_are_exact(spark):
    bins = spark.range(FIRST_BIN, LAST_BIN + 1).select("id", F.expr(_power("id")).alias("p")).collect()
    assert all(r.p == math.ldexp(1.0, max(16 * r.id, -1074)) for r in bins)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(allow_nan=False, allow_infinity=False, min_value=-1e300, max_value=1e300),
                          st.integers(-10 ** 6, 10 ** 6).map(lambda c: c / 100)), max_size=30))
def test_any_doubles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    got = exact_sums(df, [], {"s": F.col("x")}, {"above": F.col("x") > 0}).first()
    assert got.s == exact(values)
    assert got.s_n == sum(v is not None for v in values) and got.above == sum(v is not None and v > 0 for v in values)


def test_layouts_give_the_same_bits(spark):
    rnd = random.Random(7)
    rows = [(k, math.ldexp(rnd.uniform(-1, 1), rnd.randint(-e, e))) for k, e in ((0, 4), (1, 60), (2, 900)) for _ in range(400)]
    rows += [(3, 1e308), (3, -1e308), (3, 5e-324), (4, 0.1)] + [(4, 0.1)] * 999 + [(5, 2.0 ** 16), (5, 65535.999999999993), (5, 2.0 ** -16)]
    rows += [(6, math.inf), (6, 1.0), (7, math.inf), (7, -math.inf), (8, math.nan), (9, None), (10, 0.0), (10, -0.0), (11, -math.inf)]
    want = {k: exact([x for j, x in rows if j == k]) for k in {r[0] for r in rows}}
    for n in (1, 4, 16, 64):
        got = {r.k: r.s for r in exact_sums(spark.createDataFrame(rows, "k int, x double").repartition(n), ["k"], {"s": F.col("x")}).collect()}
        assert got.keys() == want.keys() and all(same(got[k], want[k]) for k in want), n


def test_partial_sums_add_up_further(spark):
    df = spark.createDataFrame([(i % 3, i % 2, i / 7) for i in range(200)], "a int, b int, x double")
    parts = partial_sums(df, ["a", "b"], {"x": F.col("x")}, {"n": F.lit(True)})
    by_b = {r.b: (r.x, r.n) for r in combine(parts, ["b"], ["x"], ["n"]).collect()}
    assert by_b == {b: (math.fsum(i / 7 for i in range(200) if i % 2 == b), 100) for b in (0, 1)}
    assert combine(parts, [], ["x"], ["n"]).first().x == math.fsum(i / 7 for i in range(200))


def test_kpis_plans_and_means_do_not_depend_on_the_layout(spark):
    c = C.cleaned(spark, SF_SMALL)
    rows = spark.createDataFrame(c.collect(), c.schema)
    said = set()
    for n in (1, 4, 16, 64):
        part = rows.repartition(n)
        said.add(repr((kpis.kpis(part).collect(), charts.plan_revenue_share(charts.plan_distribution(part)).collect())))
    assert len(said) == 1


def test_kpis_of_no_rows(spark):
    none = C.cleaned(spark, SF_SMALL).limit(0)
    row = kpis.kpis(none).first()
    assert (row.latest_mrr, row.arpu, row.avg_ltv, row.avg_cac, row.total_customers) == (0.0, 0.0, 0.0, 1.0, 0)
    assert kpis.kpis(none, by=["PlanType"]).count() == 0
    assert charts.plan_distribution(none).count() == 0


def test_insights_from_one_scan_equal_the_two_parts(spark):
    for c in (C.cleaned(spark, SF_SMALL), C.downturn(spark, SF_SMALL)):
        two = insights.insights(kpis.kpis(c), charts.support_churn(c)).collect()
        one = insights.insights_of(c)
        assert sorted(one.collect()) == sorted(two)
        assert "orders" not in one._jdf.queryExecution().executedPlan().toString()
    assert len(two) == 2 and two[0].level == "critical"


def test_kpis_scan_the_customers_once(spark):
    plan = kpis.kpis(C.cleaned(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("partial_sum") >= 1


@pytest.mark.parametrize("key", ["a b", "a.b"])
def test_odd_key_names(spark, key):
    df = spark.createDataFrame([("x", 1.5), (None, 2.5), ("x", 0.25)], f"`{key}` string, x double")
    assert {r[0]: r.s for r in exact_sums(df, [key], {"s": F.col("x")}).collect()} == {"x": 1.75, None: 2.5}
