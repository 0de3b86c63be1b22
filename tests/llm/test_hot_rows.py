"""Sharding and language fits where one row or one id holds a third of the table."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from churnscope.llm import language, sharding
from churnscope.llm.shared import read


@pytest.mark.parametrize("parts", [1, 9])
def test_equal_rows_keep_the_law_of_bytes(spark, parts):
    rows = [(5, "the very same row " * 8)] * 900 + [(None, "the same without an id" * 6)] * 300 + [(i, f"{i:05d}" * 28) for i in range(1500)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    size, slots = Counter(), {}
    for r in out:
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    mean = sum(size.values()) / 8
    assert len(size) == 8 and all(abs(b - mean) < 0.01 * mean for b in size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_language_sample_is_bounded_by_texts(spark, monkeypatch):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    one = docs.where("lang = 'en'").where(~language.is_held_out(F.col("doc_id"))).first()
    hot = spark.range(3000).select(F.lit(one.doc_id).alias("doc_id"), F.when(F.col("id") < 2000, F.lit(one.text)).otherwise(
        F.concat(F.lit("one id and many texts "), F.col("id"))).alias("text"), F.lit("en").alias("lang"))
    rows = docs.select("doc_id", "text", "lang").unionByName(hot)
    sizes = []
    real = language.fit
    monkeypatch.setattr(language, "fit", lambda x, langs: sizes.append(Counter(langs)) or real(x, langs))
    monkeypatch.setattr(language, "IN_ALL", 200)
    model = language.train(rows)
    assert sum(sizes[0].values()) <= 200 and max(sizes[0].values()) < 80
    out = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    assert out.where("lang = lang_pred").count() > 0.97 * out.count()


def test_landmarks_for_every_language():
    import numpy as np
    rnd = np.random.default_rng(1)
    x = (rnd.random((600, 1 << language.BITS)) < 0.01).astype(np.uint8)
    langs = [f"l{i % 100:03d}" for i in range(600)]
    model = language.fit(x, langs)
    assert len(model["marks"]) == 600 and len(model["names"]) == 100
