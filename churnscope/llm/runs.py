"""Periodic run detection (operator 11).

A run is a stretch of words that repeats itself with a smallest period and
can't be made longer.  A suffix automaton takes the words one by one; its
suffix links form a tree kept as a link-cut tree, in which every preferred
path holds the nodes that last occurred at one end.  Appending a word accesses
its prefix's node: the path to the root falls into segments of one former end
each and is recoloured to the new one.  Where the distance of the two ends is
at most the segment's length, a square of that period ends here, and the
square is extended to its run.

Only stretches that can hold a run enter the automaton: in a run of the
wanted length every window of a few words has a copy one period away, so
windows that don't recur nearby part the text.  That test is exact: it never
parts a run.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from churnscope.llm.shared import pick, read
from churnscope.llm.tokens import mix64

#: A run has at least so many words and so many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Words handled together by the whole-array steps (or one text).
BLOCK = 1 << 17
DOC = {"doc_id": "long", "text": "string"}
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(words: list[int], least_words: int, least_periods: int) -> list[tuple[int, int, int]]:
    """Start, length and period of every run of the stretch, by start and period."""
    n = len(words)
    size = 2 * n + 2
    # The automaton, node 1 its root; 0 is no node.
    after: list[dict[int, int]] = [{}, {}]
    length, link = [0] * size, [0] * size
    # The link-cut tree: splay trees of preferred paths by depth; a path's colour stands at its splay root.
    up, left, right, colour = [0] * size, [0] * size, [0] * size, [0] * size
    known: dict[int, int] = {}
    found = []

    def rotate(x: int, p: int) -> None:
        g = up[p]
        if left[p] == x:
            child = left[p] = right[x]
            right[x] = p
        else:
            child = right[p] = left[x]
            left[x] = p
        if child:
            up[child] = p
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x
        up[p], up[x] = x, g

    def splay(x: int) -> None:
        p = up[x]
        while p and (left[p] == x or right[p] == x):
            g = up[p]
            if not g or (left[g] != p and right[g] != p):
                colour[x] = colour[p]
                rotate(x, p)
                return
            top = up[g]
            if not top or (left[top] != g and right[top] != g):
                colour[x] = colour[g]
            if (left[g] == p) == (left[p] == x):
                rotate(p, g)
                rotate(x, p)
            else:
                rotate(x, p)
                rotate(x, g)
            p = up[x]

    last = 1
    for i, word in enumerate(words):
        node = len(after)
        after.append({})
        length[node] = i + 1
        p = last
        while p and word not in after[p]:
            after[p][word] = node
            p = link[p]
        if not p:
            above = 1
        else:
            q = after[p][word]
            if length[q] == length[p] + 1:
                above = q
            else:
                # The clone goes in just above q, on q's preferred path.
                above = len(after)
                after.append(after[q].copy())
                length[above] = length[p] + 1
                link[above] = link[q]
                link[q] = above
                splay(q)
                if left[q]:
                    left[above] = left[q]
                    up[left[q]] = above
                left[q] = above
                up[above] = q
                while p and after[p].get(word) == q:
                    after[p][word] = above
                    p = link[p]
        link[node] = up[node] = above
        last = node
        # Access: every segment of the path, with its former end and its greatest length.
        end = i + 1
        x, below = node, 0
        while x:
            splay(x)
            before = colour[x]
            period = end - before
            if before and period <= length[x] and known.get(period, 0) < end:
                start, stop = end - 2 * period, end
                while start and words[start - 1] == words[start - 1 + period]:
                    start -= 1
                while stop < n and words[stop] == words[stop - period]:
                    stop += 1
                known[period] = stop
                if stop - start >= max(least_words, least_periods * period):
                    found.append((start, stop - start, period))
            if right[x]:
                colour[right[x]] = before
            right[x] = below
            below, x = x, up[x]
        colour[below] = end
    return sorted(found, key=lambda run: (run[0], run[2]))


def stretches(words: np.ndarray, rows: np.ndarray, least_words: int, least_periods: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the stretches of the rows' words that can hold a run.

    ``rows`` has each word's row.  A run of period q and at least
    ``max(least_words, least_periods * q)`` words has, for each of its windows
    of ``gram`` words, a copy q words before or after it within the run."""
    gram = min(max(least_words, least_periods * q) - 2 * q + 1 for q in range(1, least_words + 1))
    n = len(words) - gram + 1
    if n <= 0 or gram < 1:
        whole = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(words) else np.zeros(0, int)
        return whole, np.r_[whole[1:], len(words)][:len(whole)]
    h = mix64(rows[:n].astype(np.uint64) + np.uint64(1))
    for k in range(gram):
        h = mix64(h + words[k:n + k].astype(np.uint64) + np.uint64(1))
    order = np.argsort(h, kind="stable")
    order = order[rows[order] == rows[order + gram - 1]]
    same = h[order[1:]] == h[order[:-1]]
    gap = np.where(same, order[1:] - order[:-1], len(words))
    near = np.full(n, len(words), np.int64)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    at = np.flatnonzero(near < len(words))
    first = last = np.zeros(0, np.int64)
    for _ in range(8):  # each round only leaves out windows that no run can hold
        edge = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (rows[at[1:]] != rows[at[:-1]])]) if len(at) else np.zeros(0, int)
        first, last = at[edge], at[np.r_[edge[1:], len(at)][:len(edge)] - 1]
        long = last - first + gram
        mine = np.repeat(long, np.diff(np.r_[edge, len(at)]))
        keep = (mine >= least_words) & (near[at] <= mine // least_periods)
        if keep.all():
            break
        at = at[keep]
    else:
        edge = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (rows[at[1:]] != rows[at[:-1]])]) if len(at) else np.zeros(0, int)
        first, last = at[edge], at[np.r_[edge[1:], len(at)][:len(edge)] - 1]
    return first, last + gram


def _block_runs(texts: list[list[bytes]], least_words: int, least_periods: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each word list."""
    ids: dict[bytes, int] = {}
    counts = np.array([len(t) for t in texts], np.int64)
    words = np.fromiter((ids.setdefault(w, len(ids)) for t in texts for w in t), np.int64, int(counts.sum()))
    rows = np.repeat(np.arange(len(texts)), counts)
    base = np.cumsum(counts) - counts
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for first, end in zip(*(x.tolist() for x in stretches(words, rows, least_words, least_periods))):
        row = int(rows[first])
        offset = first - int(base[row])
        out[row] += [(s + offset, n, q) for s, n, q in periodic_runs(words[first:end].tolist(), least_words, least_periods)]
    return [sorted(runs, key=lambda run: (run[0], run[2])) for runs in out]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    kept, at = [], 0
    for first, end in sorted((s + q, s + n) for s, n, q in runs):
        kept += words[at:first]
        at = max(at, end)
    return b" ".join(kept + words[at:])


def collapse_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS,
                  planted: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """Every document's periodic runs, and its text without their repeats.

    Words are runs of anything but ASCII white space.  Returns ``doc_id``,
    ``n_words``, ``runs`` (``start``, ``length`` and ``period`` in words, by
    start and period) and ``text``: the kept words joined by one space.
    ``planted`` may name a place and a period from the id and the number of
    words; the words from that place on then repeat that many first ones.

    Null and empty texts have no words, no runs and an empty text.  A text is
    searched whole; memory grows with the longest stretch of words that recur
    nearby (some 600 bytes a word of it), not with the table.  Rows are
    independent: repeated rows, equal ids and a null id change nothing.  An
    empty table gives none.  Only ``doc_id`` and ``text``, by their exact
    names, are read."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(ids: list[int | None], texts: list[list[bytes]]) -> pa.RecordBatch:
            found = _block_runs(texts, least_words, least_periods)
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
            left = pa.array([_collapsed(t, r) for t, r in zip(texts, found)], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                                               pa.array(runs, pa.list_(RUN)), left], schema=schema)

        for batch in batches:
            ids, texts, total = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                doc_id, words = doc_id.as_py(), (text.as_py() or b"").split()
                tail = planted(doc_id, len(words)) if planted and words else None
                if tail:
                    a, p = tail
                    words = words[:a] + (words[a:a + p] * (-(-(len(words) - a) // p)))[:len(words) - a]
                if ids and total + len(words) > BLOCK:
                    yield answer(ids, texts)
                    ids, texts, total = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                total += len(words)
            if ids:
                yield answer(ids, texts)

    return pick(docs, DOC).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")


def planted_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Place and period of the repeated tail that one document in ten gets;
    the id's decimal digits decide (a null id counts as empty text)."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op11_suffix_automaton_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(read(spark, sf_dir, "documents"), planted=planted_tail)
    # Runs stand by start and period, so an equal ratio keeps the earlier one.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(
        r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best_of = found.withColumn("best", best)
    return best_of.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
