"""Importance resampling against a plain computation in Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from churnscope.llm import resampling
from churnscope.llm.shared import read

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, target, shortest=1, longest=1, m=10_000, percent=10, least=20):
    def buckets(text):
        w = tokens(text)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % m for n in range(shortest, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets(text))
    for text in target:
        t.update(buckets(text))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + m) / ((s[b] + 1) * (T + m)))) for b in range(m)]
    rows = []
    for doc_id, text in docs:
        f = buckets(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(tokens(text))))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = able[:percent * len(able) // 100]
    place = Counter()
    out = [(*r[:4], i + 1) for i, r in enumerate(drawn)]
    place.update(drawn)
    for r in rows:
        if place[r]:
            place[r] -= 1
        else:
            out.append((*r[:4], None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def test_query(spark, docs):
    want = brute([(r.doc_id, r.text) for r in docs.collect()],
                 [r.text for r in read(spark, "/root/testdata/sf0.001", "benchmark").collect()])
    assert rows_of(resampling.op12_split_resampling(spark, "/root/testdata/sf0.001")) == want
    assert any(r[4] for r in want)


@pytest.mark.parametrize("shortest,longest", [(1, 2), (2, 4)])
def test_longer_windows(spark, docs, shortest, longest):
    some, target = docs.select("doc_id", "text").collect(), read(spark, "/root/testdata/sf0.001", "benchmark")
    got = resampling.resample(docs, target, shortest, longest, 997, 30, 5)
    assert rows_of(got) == brute([tuple(r) for r in some], [r.text for r in target.collect()], shortest, longest, 997, 30, 5)


def test_odd_rows(spark, odd, none):
    some = [(r.doc_id, r.text) for r in odd.collect()]
    got = resampling.resample(odd, odd, percent=50, min_words=3)
    assert rows_of(got) == brute(some, [t for _, t in some], percent=50, least=3)
    assert rows_of(resampling.resample(odd, none, percent=100, min_words=1)) == brute(some, [], percent=100, least=1)
    assert resampling.resample(none, odd).count() == 0
    assert resampling.resample(none, none).columns == got.columns


def test_one_id_with_a_third_of_the_rows(spark):
    rows = [(7, "the very same text of this id again")] * 400 + [(i, f"text number {i} of its own words") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = resampling.resample(df, df.where("doc_id = 7"), percent=60, min_words=1)
    assert rows_of(got) == brute(rows, [t for i, t in rows if i == 7], percent=60, least=1)


@pytest.mark.parametrize("piece", [1, 3, 50])
def test_pieces_of_long_texts(monkeypatch, piece):
    text = "Aé b, c" * 3 + " x y Z\x0012 é😀"
    monkeypatch.setattr(resampling, "PIECE", piece)
    for a, b in ((1, 1), (1, 3), (3, 5)):
        w = tokens(text)
        want = sorted(zlib.crc32(" ".join(w[i:i + n]).encode()) % 97 for n in range(a, b + 1) for i in range(len(w) - n + 1))
        n, found = resampling.feature_buckets(resampling.splitter(), text, a, b, 97)
        assert (n, sorted(found)) == (len(w), want)
