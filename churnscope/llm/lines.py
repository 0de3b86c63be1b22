"""Substring dedup by line hashing (operator 7).

A text is cut into units: its lines, cut again after the ends of sentences.
Every unit is normalised (lower case, white space runs as one space) and
digested with 128 bits.  Digests are grouped over the whole corpus, and the
occurrence first in (doc_id, text hash, place) is the one to keep.  Any other
occurrence is a repeat.  Repeats go where they stand together: a run of
consecutive repeats with at least ``LEAST_WORDS`` words is a passage that the
corpus has already, while a single short sentence or line that others happen
to have is not.  What stays keeps its offsets in the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from churnscope.llm.shared import pick, read, written

DOC = {"doc_id": "long", "text": "string"}
LAST = (1 << 63) - 1
KEY = ["ord", "text_hash"]
#: Where a unit ends: after a sentence's end and the blanks behind it, and after line breaks.
UNIT_END = re.compile(r"[.!?][\"')\]]*[ \t]+|\n\s*")
#: Words that a run of repeats needs to go.  Against exact shared windows of 51
#: words in 10,000 documents, 20 to 30 words catch 0.94 to 0.95 of those that
#: share one and leave as many of the others unchanged.
LEAST_WORDS = 25
#: A digest with more than this share of all units is joined by broadcast; so many digests at most can be.
HOT_SHARE = 10_000
#: A text's documents handled together, by code points (or one text).
BLOCK = 1 << 20


def cut(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of every unit; together they are the whole text."""
    at = 0
    for end in UNIT_END.finditer(text):
        yield at, end.end()
        at = end.end()
    if at < len(text):
        yield at, len(text)


def normalised(unit: str) -> str:
    return " ".join(unit.lower().split())


def _keyed(docs: DataFrame) -> DataFrame:
    return pick(docs, DOC).select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("ord"),
                                  F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")


def units(docs: DataFrame) -> DataFrame:
    """Place and digest of every unit that isn't blank."""
    schema = pa.schema([(c, pa.int64()) for c in ("ord", "text_hash")] + [("unit", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[], [], [], [], []]
        for batch in batches:
            for i in range(batch.num_rows):
                o, h, text = (batch.column(c)[i].as_py() for c in (1, 2, 3))
                for no, (a, b) in enumerate(cut(text or "")):
                    if unit := normalised(text[a:b]):
                        d = xxhash.xxh3_128_digest(unit.encode())
                        for c, v in zip(cols, (o, h, no, int.from_bytes(d[:8], "little", signed=True),
                                               int.from_bytes(d[8:], "little", signed=True))):
                            c.append(v)
                if len(cols[0]) >= 1 << 14:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
                    cols = [[], [], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return _keyed(docs).mapInArrow(run, "ord long, text_hash long, unit int, d1 long, d2 long")


def repeats(docs: DataFrame) -> DataFrame:
    """For each document with repeats: the places of those units.

    Digests with more than one ten-thousandth of all units meet their
    occurrences by broadcast (there are fewer than ten thousand of them), the
    others by a shuffle in which no digest weighs much."""
    u = written(units(docs), "units")
    at = F.struct("ord", "text_hash", "unit")
    groups = written(u.groupBy("d1", "d2").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1"), "unit-groups")
    bound = max(1000, u.count() // HOT_SHARE)
    hot = F.broadcast(groups.where(F.col("n") > bound))
    rare = groups.where(F.col("n") <= bound)
    many = u.join(hot, ["d1", "d2"])
    few = u.join(hot, ["d1", "d2"], "left_anti").join(rare, ["d1", "d2"])
    return (many.unionByName(few).where(at != F.col("first"))
            .groupBy(*KEY).agg(F.collect_set("unit").alias("again")))


def passages(text: str, again: set[int], least_words: int) -> list[tuple[int, int, int, int]]:
    """Start, end, units and words of every run of consecutive repeats with
    enough words; blank units neither count nor part a run."""
    out, run = [], None
    for no, (a, b) in enumerate(cut(text)):
        words = len(text[a:b].split())
        if no in again:
            run = [run[0], b, run[2] + 1, run[3] + words] if run else [a, b, 1, words]
        elif words and run:
            out.append(tuple(run))
            run = None
    if run:
        out.append(tuple(run))
    return [r for r in out if r[3] >= least_words]


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Every document without the passages that stand earlier in the corpus.

    Returns ``doc_id``, ``n_units``, ``n_removed`` (units), ``n_removed_words``,
    ``text`` (what is kept), ``kept`` and ``removed`` (start and length of each
    stretch in the original, in code points).  ``least_words`` of 1 removes
    every repeat.  A text is one whole however long it is.

    Rows equal in id and text are one document with one decision, returned as
    often as given; a null id ranks last; a null text stays null and has no
    units; an empty table gives none.  Only ``doc_id`` and ``text``, by their
    exact names, are read."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("n_removed_words", pa.int64()),
                        ("text", pa.string()), ("kept", span), ("removed", span)])

    def row(doc_id: int | None, text: str | None, again: list[int] | None) -> dict:
        whole = text or ""
        gone = passages(whole, set(again), least_words) if again else []
        edges = [0, *(x for a, b, _, _ in gone for x in (a, b)), len(whole)]
        kept = [(a, b) for a, b in zip(edges[::2], edges[1::2]) if a < b]
        spans = lambda pairs: [{"start": a, "length": b - a} for a, b in pairs]
        return {"doc_id": doc_id, "n_units": sum(1 for _ in cut(whole)), "n_removed": sum(g[2] for g in gone),
                "n_removed_words": sum(g[3] for g in gone), "text": None if text is None else "".join(whole[a:b] for a, b in kept),
                "kept": spans(kept), "removed": spans([g[:2] for g in gone])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                rows.append(row(*(batch.column(c)[i].as_py() for c in range(3))))
                size += len(rows[-1]["text"] or "")
                if size >= BLOCK or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0

    out = "array<struct<start:long,length:long>>"
    return (_keyed(docs).join(repeats(docs), KEY, "left").select("doc_id", "text", "again")
            .mapInArrow(run, "doc_id long, n_units long, n_removed long, n_removed_words long, text string, "
                             f"kept {out}, removed {out}"))


def op7_line_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents"))
