"""Personal data against plain regular expressions, and the trees against plain sums."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from churnscope.llm import private

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def holds(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in hit.split(".")),
            "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def base(text):
    return [(m.start(), at, kind, m.end()) for at, (kind, p) in enumerate(BASE.items())
            for m in re.finditer(p, text or "") if holds(kind, m[0])]


def text_of(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))


TRICKY = [
    "a@b.c@d.e x@y a@b.c._x@d.e .@a.b -@-.- a@b..c a@@b.c é.ü@x.y 😀 m.e+1%_@h-o.st.co.", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3 255.255.255.255",
    "0001.002.0003.4 256.1.1.1 1.1.1.0000255 1.1.1.999999999999", "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 11111111",
    "4111111111111111 4111111111111112 5 4111111111111111", "12345678901234567890 79927398713 -4111111111111111- x4111111111111111y",
    "+1 (017) 555-7713 +12 +123456789 +1234567890123456 ++49 30 123456-7) +4( +1 2 3 4 5 6 7 8 9 (0", "+1 (017) 555-7713\n+1 (017) 555-7714 +1.2.3.4",
    "", "no data", "@", "+", "7 " * 50, "1." * 40, "a" * 3000 + "@" + "b" * 3000 + ".c", "1" * 5000, "1 " * 5000, "a.b@" * 300]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)] + [(99, None), (None, "x@y.z")], "doc_id long, text string")
    return {r.doc_id: r for r in private.find(df).collect()}


def test_base_spans_of_tricky_texts(found):
    for i, text in enumerate(TRICKY):
        assert [tuple(s) for s in found[i].base] == sorted(base(text)), text[:80]
    assert found[99].base == [] and [tuple(s) for s in found[None].base] == [(0, 0, "email", 5)]


def test_query_on_whole_documents(spark, docs):
    text = {r.doc_id: r.text for r in docs.collect()}
    out = private.op13_boosted_candidates(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == docs.count()
    for r in out:
        want = base(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(text_of(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(s[2] == k for s in want) for k in BASE]
        assert set(text_of(want).split(",")) <= set(r.spans.split(",")) or not want


def test_trees_add_what_looks_like_the_certain(spark):
    """Phone numbers of one format, one in 40 without the plus that the base asks for; serial numbers of another."""
    rows = []
    for i in range(2000):
        number = f"({i % 900 + 100}) 555-{i % 9000 + 1000}"
        rows.append((i, f"call us on {'' if i % 40 == 0 else '+'}1 {number} today; part {i * 7919 % 10 ** 9:09d} is out"))
    out = private.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    text = dict(rows)
    bare = {r.doc_id for r in out if any(text[r.doc_id][s.start:s.end].startswith("1 (") for s in r.added)}
    assert bare == {i for i in range(2000) if i % 40 == 0}
    assert not any(text[r.doc_id][s.start:s.end].isdigit() for r in out for s in r.added)
    assert all(not r.added for r in private.find(spark.createDataFrame(rows, "doc_id long, text string"), precision=1.01).collect())


def test_odd_rows(odd, none):
    out = private.find(odd)
    assert out.count() == odd.count() and private.find(none).count() == 0
    assert all(not r.base for r in out.collect())


def test_running_totals(spark):
    for n in (0, 1, 2, 3, 10, 97, 2000):
        row = spark.range(1).select(F.array(*[]).cast("array<long>").alias("a") if n == 0 else F.transform(
            F.sequence(F.lit(1), F.lit(n)), lambda i: (i * 7 % 5).cast("long")).alias("a"))
        got = row.select(private.running_totals(F.col("a")).alias("t")).first().t
        want, total = [], 0
        for i in range(1, n + 1):
            total += i * 7 % 5
            want.append(total)
        assert got == want


def test_isotonic_calibration():
    assert private.rising([(0, 10, 1), (1, 10, 5), (2, 10, 4), (3, 10, 9)]) == [(0, 0.1), (1, 0.45), (3, 0.9)]
    assert private.rising([(2, 4, 4), (0, 4, 4)]) == [(0, 1.0)]
    assert private.rising([]) == []


def test_no_python_on_the_executors(spark, docs):
    plans = []
    for df in (private.with_matches(docs, private.EMAIL, "@", "m"), private.find(docs)):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert not any(word in plan for plan in plans for word in ("Python", "Arrow", "Pandas"))
