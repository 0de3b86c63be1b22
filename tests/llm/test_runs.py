"""Periodic runs against brute force over every period."""

import hashlib
import re
import zlib
from fractions import Fraction

from hypothesis import given, settings, strategies as st

from churnscope.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least_words=6, least_periods=4):
    out, n = [], len(words)
    for q in range(1, n // least_periods + 1):
        i = q
        while i < n:
            if words[i] == words[i - q]:
                s = i - q
                while i < n and words[i] == words[i - q]:
                    i += 1
                if i - s >= max(least_words, least_periods * q) and not any(
                        all(words[k] == words[k - r] for k in range(s + r, i)) for r in range(1, q)):
                    out.append((s, i - s, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


periodic = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 9)), max_size=5).map(
    lambda parts: [b"%d" % x for root, k in parts for x in root * k])


@settings(max_examples=300, deadline=None)
@given(st.lists(periodic, min_size=1, max_size=4), st.sampled_from([(6, 4), (2, 2), (5, 3), (9, 2)]))
def test_runs_of_any_words(texts, bounds):
    assert runs._block_runs(texts, *bounds) == [brute_runs(t, *bounds) for t in texts]


def test_automaton_finds_every_run_without_the_parting():
    words = [0, 1, 2, 0, 1, 2, 0, 1, 2, 0, 1, 2, 5, 5, 5, 5, 5, 5, 1, 1, 2, 1, 1, 2, 1, 1, 2, 1, 1, 2, 1, 1]
    assert runs.periodic_runs(words, 2, 2) == brute_runs(words, 2, 2)
    assert runs.periodic_runs([7] * 50_000, 6, 4) == [(0, 50_000, 1)]


def test_query_on_whole_documents(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
            if len(r.text or "") < 8000]  # brute force is quadratic; the query itself takes all
    want = {r.doc_id: brute_row(r.doc_id, r.text) for r in rows}
    got = {r.doc_id: tuple(r) for r in runs.op11_suffix_automaton_runs(spark, "/root/testdata/sf0.001").collect()}
    assert all(got[i] == want[i] for i in want) and len(got) >= len(want)
    assert sum(w[1] > 0 for w in want.values()) > 5


def test_odd_rows(odd, none):
    got = {(r.doc_id, r.text): r for r in runs.collapse_runs(odd).collect()}
    assert runs.collapse_runs(odd).count() == odd.count() and runs.collapse_runs(none).count() == 0
    assert got[(0, "")].n_words == 0 and got[(1, "")].runs == []
    for r in odd.where("doc_id != 4 or doc_id is null").collect():
        words = (r.text or "").split()
        assert got[(r.doc_id, " ".join(words))].n_words == len(words)


def test_collapse_keeps_first_period_and_unicode_spaces_are_letters(spark):
    df = spark.createDataFrame([(1, "x " + "a b " * 5 + "y"), (2, "é b " * 6 + "z z")], "doc_id long, text string")
    one, two = runs.collapse_runs(df).orderBy("doc_id").collect()
    assert one.text == "x a b y" and [tuple(r) for r in one.runs] == [(1, 10, 2)]
    assert two.text == "é b z z" and [tuple(r) for r in two.runs] == [(0, 6, 1)]
