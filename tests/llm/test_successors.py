"""Successors in descending id where one id has many rows."""

import pytest

from churnscope.llm import sketches


def brute(rows, hashes):
    key = lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1] or ""])
    order = sorted(rows, key=key)
    return sorted(((i, t or "", (order[(k + 1) % len(order)][1] or "")) for k, (i, t) in enumerate(order)), key=str)


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("hot", [5, None, -9])
def test_hot_id(spark, parts, hot):
    rows = [(hot, f"text {k} of one id") for k in range(400)] + [(k, f"own {k}") for k in range(-300, 300) if k != hot] + [(hot, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    hashes = {r.text or "": r.h for r in df.select("text", sketches.F.expr("xxhash64(coalesce(text, ''))").alias("h")).collect()}
    got = sorted((tuple(r) for r in sketches.with_next(df).collect()), key=str)
    assert got == brute(rows, hashes)
    sizes = sketches.with_next(df)
    assert sizes.count() == len(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_few_rows(spark, n):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(n)], "doc_id long, text string")
    got = {r.doc_id: r.next for r in sketches.with_next(df).collect()}
    assert got == {i: f"t{(i - 1) % n}" for i in range(n)}


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "same")] * 50 + [(2, "two")] + [(0, "none")], "doc_id long, text string").repartition(4)
    out = [tuple(r) for r in sketches.with_next(df).collect()]
    assert sorted(out) == sorted([(1, "same", "same")] * 49 + [(1, "same", "none"), (2, "two", "same"), (0, "none", "two")])
