"""Raking against numpy, sampling decisions, and every pipeline stage on odd and empty tables."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from churnscope.llm import mixing
from churnscope.llm.shared import read, unit_hash

SF = "/root/testdata/sf0.001"


def brute_rake(cells, temper, rounds=25, tolerance=1e-4):
    """Iterative proportional fitting over a dictionary of cells in numpy."""
    keys = list(cells)
    w = np.array([float(cells[k]) for k in keys])
    total = w.sum()
    goals = []
    for d, dim in enumerate(mixing.DIMS):
        values = sorted({k[d] for k in keys})
        at = np.array([values.index(k[d]) for k in keys])
        now = np.bincount(at, w, len(values))
        t = np.where(now > 0, (now / total) ** temper[dim], 0.0)
        goals.append((at, t / t.sum() * total, len(values)))
    for _ in range(rounds):
        for at, goal, n in goals:
            now = np.bincount(at, w, n)
            w = w * np.where(now > 0, goal / np.where(now > 0, now, 1), 0)[at]
        if max(np.abs(np.bincount(at, w, n) - goal).max() for at, goal, n in goals[:-1]) / total <= tolerance:
            break
    return dict(zip(keys, w))


def brute_rates(cells, w, budget):
    """Probabilities min(1, c w / tokens) that spend the budget, c by bisection."""
    tokens = np.array([float(cells[k]) for k in cells])
    ratio = np.array([w[k] / cells[k] if cells[k] else 0.0 for k in cells])
    lo, hi = 0.0, 1 / ratio[ratio > 0].min()
    for _ in range(200):
        c = (lo + hi) / 2
        lo, hi = (c, hi) if (np.minimum(1, c * ratio) * tokens).sum() < budget * tokens.sum() else (lo, c)
    return dict(zip(cells, np.minimum(1, hi * ratio)))


def test_rake_and_probabilities_equal_numpy(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    out = mixing.mix(docs).collect()
    cells = Counter()
    for r in out:
        cells[tuple(r[d] for d in mixing.DIMS)] += r.n_tokens
    w = brute_rake(cells, mixing.TEMPER)
    p = brute_rates(cells, w, mixing.BUDGET)
    for r in out:
        cell = tuple(r[d] for d in mixing.DIMS)
        assert r.weight == pytest.approx(w[cell] / max(cells[cell], 1), rel=1e-6)
        assert r.probability == pytest.approx(p[cell] if r.n_tokens else 1.0, rel=1e-6)


def test_decisions_follow_the_probabilities(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    drawn = {(r.doc_id, r.h): r.u for r in docs.select("doc_id", F.xxhash64("text").alias("h"), unit_hash(
        2, F.col("doc_id"), F.xxhash64("text")).alias("u")).collect()}
    out = mixing.mix(docs).collect()
    assert all(r.kept == (drawn[(r.doc_id, r.text_hash)] < r.probability) for r in out)
    spent = sum(r.n_tokens for r in out if r.kept) / sum(r.n_tokens for r in out)
    assert abs(spent - mixing.BUDGET) < 0.05


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_and_empty_tables(spark, odd, none, name, stage):
    """A result of defined columns, no row made up, clean rows kept by the filters."""
    out = stage(spark, odd, SF)
    assert stage(spark, none, SF).count() == 0
    rows = out.collect()
    if name == "sharding":
        assert len(rows) == odd.count()
        return
    assert out.columns == list(corpus_pipeline.COLUMNS)
    given = Counter(tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in odd.collect())
    assert not Counter(tuple(r) for r in rows) - given
    if name == "near_duplicates":
        texts = {(r.text or "").lower() for r in odd.collect()}
        assert {(r.text or "").lower() for r in rows} == texts and len(rows) == len(texts)
    if name == "decontamination":
        assert len(rows) == odd.count()


def test_whole_pipeline_keeps_to_its_stages(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    docs = {r.doc_id for r in read(spark, SF, "documents").collect()}
    assert {r.doc_id for r in out} <= docs and len({r.doc_id for r in out}) == len(out) > 20
    assert {r.shard for r in out} <= set(range(8))
