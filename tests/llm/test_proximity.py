"""Proximity matches against brute force, and searches in several passes."""

import random

import pytest

from churnscope.llm import decontamination as D


def brute(docs, items, window, slop):
    phrases = {}
    for item, text in items:
        w = text.split()
        for s in range(max(1, len(w) - window + 1)):
            phrases.setdefault(tuple(w[s:s + window]), set()).add(item)
    out = {}
    for doc_id, text in docs:
        w, hit, own = text.split(), set(), set()
        for p, ids in phrases.items():
            for b in range(len(w)):
                if slop == 0 and b + len(p) > len(w):
                    continue
                if all(any(0 <= b + k + d < len(w) and w[b + k + d] == t for d in range(-slop, slop + 1)) for k, t in enumerate(p)):
                    hit |= {x for x in range(b, b + len(p)) if x < len(w)}
                    own |= ids
        out[doc_id] = (len(w), len(hit), sorted(own))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(5)
    items = [(i, " ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 3)) for _ in range(rnd.randint(2, 12)))) for i in range(12)]
    docs = []
    for i in range(80):
        w = [rnd.choice("abcdefgh") + str(rnd.randint(0, 3)) for _ in range(rnd.randint(0, 25))]
        if i % 2:
            part = rnd.choice(items)[1].split()
            k = rnd.randrange(len(part))
            part = rnd.choice((part, part[:k] + ["zz"] + part[k:], part[:k] + part[k + 1:], part[:k][::-1] + part[k:]))
            w[len(w) // 2:len(w) // 2] = part
        docs.append((i, " ".join(w)))
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("slop", [0, 1, 2])
@pytest.mark.parametrize("segment,block,passes", [(1 << 20, 200_000, 16), (300, 30, 2)])
def test_matches_equal_brute_force(tables, monkeypatch, slop, segment, block, passes):
    docs, items, table, bench = tables
    monkeypatch.setattr(D, "PASS_BLOCKS", passes)
    out = D.search(D.build_index(table, segment), bench, window=5, slop=slop, block_words=block).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in out} == brute(docs, items, 5, slop)
    assert all(sum(s.words for s in r.spans) == r.n_hit for r in out)


def test_query_finds_what_phrases_find_and_more(spark):
    sf = "/root/testdata/sf0.001"
    exact = {r.doc_id: r for r in D.op3_positional_index(spark, sf).collect()}
    near = {r.doc_id: r for r in D.proximity_matches(spark, sf).collect()}
    assert near.keys() == exact.keys()
    assert all(near[i].n_near >= exact[i].n_hit and near[i].n_near_items >= exact[i].n_items for i in near)
