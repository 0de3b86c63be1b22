"""The exchange of co-training sees all documents, and hot ids don't reach the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnscope.llm import quality
from churnscope.llm.shared import read


@pytest.fixture(scope="module")
def mid(spark):
    return read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")


def scores(spark, docs, model):
    return {(r.doc_id, r.p_good) for r in quality.classify(docs, model).collect()}


def test_the_surest_come_from_all_unlabelled_rows(spark, mid, monkeypatch):
    docs, labels = mid
    monkeypatch.setattr(quality, "SURE", 0.6)
    views = quality.featured(docs)
    rnd = np.random.default_rng(3)
    weights = {v: rnd.normal(0, 0.3, dim + 1) for v, dim in quality.VIEWS.items()}
    scales = {v: np.array([0.8, -0.1]) for v in quality.VIEWS}
    ids = labels.select("doc_id").distinct()
    told = quality.surest(views, ids, weights, scales, 7)
    known = {r.doc_id for r in ids.collect()}
    for v in quality.VIEWS:
        best = {}
        for r in views.collect():
            if r.doc_id in known:
                continue
            z = np.clip(weights[v][np.frombuffer(r[v], np.int32)].sum() + weights[v][-1], -20, 20)
            p = 1 / (1 + np.exp(-(0.8 * z - 0.1)))
            lo, hi = best.get(r.text_hash, (1.0, 0.0))
            best[r.text_hash] = (min(lo, p), max(hi, p))
        for label in (0, 1):
            sure = sorted((lo if label else 1 - hi for lo, hi in best.values()), reverse=True)
            got = [best[t][0] if label else 1 - best[t][1] for t, k in told[v] if k == label]
            assert np.allclose(sorted(got, reverse=True), [x for x in sure if x >= 0.6][:7])


def test_an_id_with_a_third_of_all_rows_counts_once(spark, mid):
    docs, labels = mid
    one = labels.where("quality = 1").first().doc_id
    hot = spark.range(500).select(F.lit(one).alias("doc_id"), F.concat(F.lit("text of one id, number "), F.col("id")).alias("text"),
                                  F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    model = quality.train(docs.unionByName(hot), labels)
    again = quality.train(docs.unionByName(hot).repartition(7), labels)
    assert scores(spark, docs, model) == scores(spark, docs, again)
    out = quality.classify(docs, model).join(labels, "doc_id").toPandas()
    good = (out.quality == 1) & (out.toxic == 0)
    assert out.accepted[good].mean() > 0.9 and out.accepted[~good].mean() < 0.3


def test_names_that_end_alike_differ():
    data, offsets = np.frombuffer(b"abcabcabc", np.uint8), np.array([0, 3, 6, 9])
    meta = [m for _, m in quality.features(data, offsets, ["en", "en", None], ["crawl-2024-10", "wiki-2024-10", "None"])]
    assert meta[0][-1] != meta[1][-1] and meta[0][-2] == meta[1][-2]
    other = [m for _, m in quality.features(data, offsets, ["en"] * 3, [None, "None", "x"])]
    assert other[0][-1] != other[1][-1] == meta[2][-1]
