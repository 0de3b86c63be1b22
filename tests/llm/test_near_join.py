"""Join sizes of the near-duplicate comparison, and hot nodes."""

import re

import pytest

from churnscope.llm import near_duplicates as N


def join_rows(spark, df):
    """Rows that the last join of a plan made, from the plan's own figures."""
    df.collect()
    seen, best = [df._jdf.queryExecution().executedPlan()], 0
    while seen:
        node = seen.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            seen.append(node.executedPlan())
            continue
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            best = max(best, node.metrics().apply("numOutputRows").value())
        children = node.children()
        seen += [children.apply(i) for i in range(children.size())]
        if node.nodeName().endswith("QueryStage"):
            seen.append(node.plan())
    return best


def holders(spark, groups):
    """Rows of one hot token: (comp, n, most) repeated."""
    rows, k = [], 0
    for comp, n, most, times in groups:
        for _ in range(times):
            k += 1
            rows.append((b"%06d" % k, b"%06d" % k if comp is None else comp, n, most, 1, []))
    return spark.createDataFrame(rows, "node binary, comp binary, n long, most long, token long, before array<long>")


def test_template_texts_that_cannot_be_alike_meet_in_no_join(spark):
    """Forty shingles of which 35 are the template's: at most 35 in common, 35.6 needed."""
    sizes = []
    for times in (200, 800):
        pairs = N._holders_pairs(holders(spark, [(None, 40, 35, times)]))
        assert pairs.count() == 0
        sizes.append(join_rows(spark, pairs))
    assert sizes[1] <= 4 * sizes[0] + 10


def test_one_class_meets_others_only(spark):
    pairs = N._holders_pairs(holders(spark, [(b"big", 40, 40, 600), (None, 40, 40, 3), (b"big", 10, 10, 5)])).collect()
    assert len(set(pairs)) == len(pairs) == 600 * 3 + 3
    assert N._holders_pairs(holders(spark, [(b"big", 40, 40, 600)])).count() == 0


def test_pairs_equal_brute_force(spark):
    groups = [(bytes([65 + c]), n, most, 2) for c in range(4) for n in (20, 24, 30) for most in (n - 3, n - 1, n)]
    head = holders(spark, groups)
    rows = head.collect()
    want = {(min(x.node, y.node), max(x.node, y.node)) for x in rows for y in rows
            if x.comp != y.comp and min(x.n, y.n) >= 0.8 * max(x.n, y.n) and min(x.most, y.most) >= 0.8 / 1.8 * (x.n + y.n) - 1e-9}
    got = [(bytes(r.a), bytes(r.b)) for r in N._holders_pairs(head).collect()]
    assert len(got) == len(set(got)) and set(got) == {(bytes(a), bytes(b)) for a, b in want}


@pytest.mark.parametrize("hot", [3, 1000])
def test_hot_nodes_have_the_same_overlaps(spark, monkeypatch, hot):
    monkeypatch.setattr(N, "HOT_PAIRS", hot)
    texts = [(i, "the one text that many others are like with word " + " ".join(f"w{(i + k) % 7}" for k in range(i % 5))) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    nodes = N.signed(docs).groupBy("node").agg(N.F.min(N.F.struct("ord", "text_hash")).alias("first"))
    bags = N.contents(docs, nodes.select("node", "first.ord", "first.text_hash")).cache()
    centre = bags.agg(N.F.min("node")).first()[0]
    pairs = bags.where(N.F.col("node") != centre).select(N.F.lit(centre).alias("a"), N.F.col("node").alias("b"))
    got = {bytes(r.b): r.like for r in N.overlaps(pairs, bags).collect()}
    bag = {bytes(r.node): r for r in bags.collect()}
    assert got.keys() == bag.keys() - {bytes(centre)}
    import numpy as np
    for name, like in got.items():
        x, y = (np.frombuffer(bag[k].items, np.uint64) for k in (bytes(centre), name))
        assert like == len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert re.match("^[0-9.]+$", str(sum(got.values())))
