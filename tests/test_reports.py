"""Response curves, rejected texts, file-order preview and the search index, each against the plain way."""

import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from churnscope.operators import ml, profile, rejects, responses
from churnscope.operators.filters import id_search
from churnscope.plans import catalog as C
from churnscope.sources import search_index
from conftest import SF_SMALL


# Response curves

def test_curves_equal_scoring_every_slider_value(spark):
    c = C.cleaned(spark, SF_SMALL)
    model = C.hand_model(c)
    curves = responses.response_curves(c.where("CustomerID LIKE '%7'"), model).collect()
    by = {}
    for r in curves:
        by.setdefault((r.CustomerID, r.field), []).append(r)
    for field in ("tenure", "tickets"):
        low, high = responses.SLIDERS[field]
        for value in range(int(low), int(high) + 1):
            want = {r.CustomerID: r for r in ml.what_if(c.where("CustomerID LIKE '%7'"), model, {field: value}).collect()}
            for name, w in want.items():
                rows = [r for r in by[(name, field)] if r.low < value <= r.high or value == r.low == low == r.low and r is by[(name, field)][0]]
                assert len(rows) == 1 and rows[0].probability == w.probability and rows[0].risk_text == w.risk_text
                assert rows[0].change == w.probability - w.baseline_probability


def test_curves_of_a_fitted_model(spark):
    c = C.cleaned(spark, SF_SMALL)
    model, _ = ml.train_churn(c, num_trees=5, max_depth=4)
    one = c.where("CustomerID = 'CUST-1'") if c.where("CustomerID = 'CUST-1' and lower(Status) = 'active'").count() else c.limit(1)
    rows = responses.response_curves(one, model, ["usage"], active_only=False).orderBy("low").collect()
    for value in range(31):
        want = ml.what_if(one, model, {"usage": value}, active_only=False).first().probability
        assert [r.probability for r in rows if r.low < value <= r.high or value == r.low == 0.0][0] == want


def test_intervals_cover_the_slider():
    for field, (low, high) in responses.SLIDERS.items():
        steps = responses.intervals(C.HAND_FOREST, field, low, high)
        assert steps[0][0] == low and steps[-1][1] == high
        assert all(a[1] == b[0] for a, b in zip(steps, steps[1:]))
    assert responses.intervals(C.HAND_FOREST, "tickets", 0.5, 3.0) == [(0.5, 0.5), (0.5, 1.5), (1.5, 2.5), (2.5, 3.0)]
    assert responses.intervals(C.HAND_FOREST, "tickets", 2.0, 2.0) == [(2.0, 2.0)]


# Rejected texts

@pytest.mark.parametrize("buckets", [1, 7, 1 << 16])
def test_most_frequent_is_exact(spark, buckets):
    rnd = random.Random(buckets)
    rows = [("a", f"t{int(rnd.paretovariate(0.8)) % 300}") for _ in range(3000)] + [("a", "hot")] * 2500
    rows += [("b", f"u{i}") for i in range(40)] + [("c", "only")]
    want = set()
    for role in "abc":
        counts = Counter(t for r, t in rows if r == role)
        for i, (t, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:5]):
            want.add((role, t, n, i + 1))
    df = spark.createDataFrame(rows, "role string, text string").repartition(6)
    assert {tuple(r) for r in rejects.most_frequent(df, 5, buckets).collect()} == want


def test_rejected_texts_agree_with_the_quality_report(spark):
    raw = C.raw(spark, SF_SMALL)
    counts = {r.role: r.n for r in rejects.rejected(raw).groupBy("role").agg(F.count("*").alias("n")).collect()}
    report = {r.role: r.coerced_count for r in C.preprocess.quality_report(raw).collect() if r.coerced_count}
    assert counts == report
    assert rejects.rejected_texts(raw.limit(0)).count() == 0


# Preview in file order

def test_preview_follows_the_files(spark, tmp_dir):
    rows = spark.range(1000).selectExpr("cast((id * 7919) % 1000 as string) AS v", "id")
    for n, files in ((3, 1), (5, 6)):
        path = f"{tmp_dir}/p{files}"
        rows.repartition(files).write.parquet(path)
        want = []
        for f in sorted(spark.read.parquet(path).inputFiles()):
            want += [r.v for r in spark.read.parquet(f).coalesce(1).collect()]
        assert [r.v for r in profile.preview_files(spark, path, n).collect()] == want[:n]
    few = f"{tmp_dir}/few"
    spark.range(8).repartition(8).write.parquet(few)
    want = [r.id for f in sorted(spark.read.parquet(few).inputFiles()) for r in spark.read.parquet(f).collect()]
    assert [r.id for r in profile.preview_files(spark, few, 5).collect()] == want[:5]
    assert len(profile.preview_files(spark, few, 50).collect()) == 8


def test_preview_of_csv_files(spark, tmp_dir):
    for i, lines in enumerate((["9,x", "8,y"], ["7,z", "6,w"])):
        with open(f"{tmp_dir}/{i}.csv", "w") as f:
            f.write("\n".join(["n,t", *lines]) + "\n")
    got = profile.preview_files(spark, tmp_dir, 3, "csv").collect()
    assert [tuple(r) for r in got] == [("9", "x"), ("8", "y"), ("7", "z")]


# Search index

@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("indexed"))
    names = [f"CUST-{i}" for i in range(3000)] + ["Ümlaut-ß", "Kelvin", "long-ſ-id", "x\u0130y\u0131z", "ΟΔΟΣ-1", "a(b", "", "ab", None, "cust-42"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "CustomerID string, n int").repartition(4)
    search_index.write_indexed(df, path, block_rows=100)
    return path, df


@pytest.mark.parametrize("term,literal", [
    ("cust-42", False), ("CUST-299", True), ("42$", False), ("cust-1[0-9]5", False), ("st-1.*9", False), ("cust|kel", False), ("kelvin", False),
    ("LONG-S-ID", False), ("XIYIZ", False), ("οδοσ", False), ("a(b", True), ("", False), (None, True), ("ab", True), ("cust-(12|34)5?", False), ("cust-2?99", False),
    (r"\d{4}", False), (r"ST\-29{2}", False), (r"\Qcust-17\E", False), ("zzz", True), ("^cust-20+$", False)])
def test_index_finds_what_a_scan_finds(spark, store, term, literal):
    path, df = store
    got = sorted(search_index.search(spark, path, term, literal=literal).rows.collect(), key=str)
    assert got == sorted(id_search(df, term, literal=literal).collect(), key=str)


def test_index_reads_few_rows(spark, store):
    path, df = store
    found = search_index.search(spark, path, "CUST-1234", literal=True)
    assert found.rows.count() == 1 and found.read.count() <= 200 < df.count()
    assert search_index.search(spark, path, "zzz", literal=True).read.count() == 0
    assert search_index.search(spark, path, ".", literal=False).read.count() == df.count()
    with pytest.raises(LookupError):
        search_index.search(spark, path + "-missing", "x")


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abc-.?*+|()[]{}\\^$12"), max_size=9), st.text(st.sampled_from("abc-12."), max_size=12))
def test_required_text_is_required(pattern, text):
    try:
        match = re.compile(pattern).search(text)
    except re.error:
        return
    if match:
        assert all(run in text for run in search_index.required_text(pattern, False))
