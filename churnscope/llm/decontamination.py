"""Benchmark decontamination by a positional inverted index (operator 3).

The training texts are cut into segments of whole documents.  A segment's
index lists, for every term, the positions at which it stands; the segments
are a written table.  A search takes each test phrase's terms from the rarest
in the segment on, and intersects their position lists, each moved back by the
term's offset in the phrase.  The test phrases are sent in blocks of bounded
size, a bounded number of blocks at a time; every segment meets every block,
so no texts are shuffled.  Phrases are matched exactly, or by proximity: every
term within a few words of its place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from churnscope.llm.shared import pick, read, small, written
from churnscope.llm.tokens import blocks, words

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: Words of test phrases in one block.
BLOCK_WORDS = 200_000
#: Blocks searched together; further ones wait until these are released.
PASS_BLOCKS = 16
#: Words that a term may stand off its place in a proximity match.
NEAR = 2

INDEX = "doc_ids array<bigint>, text_hashes array<bigint>, lengths binary, terms binary, counts binary, gaps binary"
HITS = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
        "items array<bigint>, spans array<struct<first:int,words:int>>, text_hash long")


def _segment(ids: pa.Array, hashes: pa.Array, data: np.ndarray, offsets: np.ndarray) -> dict:
    """The postings of one segment.  Documents stand one position apart, so
    that no phrase reaches from one into the next."""
    terms, rows = words(data, offsets)
    at = np.arange(len(terms)) + rows
    order = np.argsort(terms, kind="stable")
    terms, at = terms[order], at[order]
    first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, int)
    gaps = np.diff(at, prepend=0)
    gaps[first] = at[first]
    return {"doc_ids": ids.to_pylist(), "text_hashes": hashes.to_pylist(),
            "lengths": np.bincount(rows, minlength=len(ids)).astype(np.int32).tobytes(),
            "terms": terms[first].tobytes(), "counts": np.diff(np.r_[first, len(terms)]).astype(np.int32).tobytes(),
            "gaps": gaps.astype(np.int32).tobytes()}


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")


def build_index(docs: DataFrame, segment_bytes: int = 1 << 20) -> DataFrame:
    """The positional index of all tokens, a row for each segment (written).

    ``docs`` has ``doc_id`` and ``text``; null and empty texts are documents
    without terms.  A longer text is a segment of its own."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(1), segment_bytes):
                row = _segment(batch.column(0)[i:j], batch.column(2)[i:j], data, offsets)
                yield pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema([(c, pa.list_(pa.int64())) for c in ("doc_ids", "text_hashes")]
                       + [(c, pa.binary()) for c in ("lengths", "terms", "counts", "gaps")])
    rows = pick(docs, {"doc_id": "long", "text": "string"}).select("doc_id", "text", _text_hash())
    return written(rows.mapInArrow(build, INDEX), "postings")


def phrase_blocks(items: DataFrame, window: int, block_words: int) -> Iterator[dict]:
    """The windows of the test items, in blocks of at most ``block_words`` words
    (or one item).  Only one block at a time is in the driver."""
    def block(ids: list, terms: list) -> dict:
        found: dict[bytes, set] = {}
        for item, t in zip(ids, terms):
            for s in range(max(1, len(t) - window + 1)):
                found.setdefault(t[s:s + window].tobytes(), set()).add(item)
        return {"phrases": [np.frombuffer(p, np.uint64) for p in found],
                "items": [sorted(x for x in s if x is not None) for s in found.values()]}

    ids, terms, size = [], [], 0
    for row in pick(items, {"item_id": "long", "text": "string"}).where("text is not null").toLocalIterator():
        raw = np.frombuffer(row.text.encode(), np.uint8)
        t, _ = words(raw, np.array([0, len(raw)]))
        if not len(t):
            continue
        if size and size + len(t) * window > block_words:
            yield block(ids, terms)
            ids, terms, size = [], [], 0
        ids.append(row.item_id)
        terms.append(t)
        size += max(1, len(t) - window + 1) * window
    if ids:
        yield block(ids, terms)


def matches(terms: np.ndarray, counts: np.ndarray, at: np.ndarray, size: int, block: dict,
            slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Start position and phrase number of every occurrence in a segment.

    With ``slop`` every term may stand up to so many positions from its place;
    each start at which all of them do counts once."""
    lens = np.array([len(p) for p in block["phrases"]], np.int64)
    flat = np.concatenate(block["phrases"])
    head = np.cumsum(lens) - lens
    own = np.searchsorted(terms, flat)
    own[own == len(terms)] = 0
    known = terms[own] == flat if len(terms) else np.zeros(len(flat), bool)
    count = np.where(known, counts[own] if len(terms) else 0, 0).astype(np.int64)
    alive = np.flatnonzero(np.minimum.reduceat(count, head) > 0)
    if not len(alive):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    post = np.cumsum(counts.astype(np.int64)) - counts
    term_at = np.full(size + 1, -1, np.int64)  # the lists by position: a member test of any list
    term_at[at] = np.repeat(np.arange(len(terms)), counts)
    doc_at = np.cumsum(term_at < 0)  # documents stand one empty position apart
    starts, whose = [], []
    for length in np.unique(lens[alive]):
        mine = alive[lens[alive] == length]
        grid = head[mine][:, None] + np.arange(length)
        rarest = np.argsort(count[grid], axis=1, kind="stable")
        pick_ = np.take_along_axis(grid, rarest[:, :1], 1)[:, 0]
        n = count[pick_]
        phrase = np.repeat(np.arange(len(mine)), n)
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        stand = at[np.repeat(post[own[pick_]], n) + within]
        begin = stand - np.repeat(rarest[:, 0], n)
        if slop:  # the rarest term may be off its place, too; a start found twice is one
            moves = np.arange(-slop, slop + 1)
            stand, phrase = np.repeat(stand, len(moves)), np.repeat(phrase, len(moves))
            begin = np.repeat(begin, len(moves)) + np.tile(moves, len(begin))
        # A window starts in its document; by proximity its end may lie past the document's.
        ok = (begin >= 0) & (begin + (1 if slop else length) <= size)
        begin, phrase, stand = begin[ok], phrase[ok], stand[ok]
        ok = (doc_at[begin] == doc_at[stand]) & (term_at[begin] >= 0)
        begin, phrase = begin[ok], phrase[ok]
        if slop and len(begin):
            pair = np.unique(np.stack([phrase, begin], 1), axis=0)
            phrase, begin = pair[:, 0], pair[:, 1]
        for k in range(1, length):
            off = rarest[phrase, k]
            want = own[grid[phrase, off]]
            hit = np.zeros(len(begin), bool)
            for d in range(-slop, slop + 1):
                spot = begin + off + d
                spot = np.where((spot >= 0) & (spot < size), spot, size)
                hit |= (term_at[spot] == want) & (doc_at[spot] == doc_at[begin])
            begin, phrase = begin[hit], phrase[hit]
            if not len(begin):
                break
        starts.append(begin)
        whose.append(mine[phrase])
    return np.concatenate(starts), np.concatenate(whose)


def _found(seg: dict, sent: list, slop: int) -> tuple[np.ndarray, np.ndarray, dict[int, set]]:
    """What a segment's documents hold of the phrases in some blocks: their
    lengths, their hit spans (document, first word, words) and their items."""
    lens = np.frombuffer(seg["lengths"], np.int32).astype(np.int64)
    terms, counts = np.frombuffer(seg["terms"], np.uint64), np.frombuffer(seg["counts"], np.int32)
    gaps = np.frombuffer(seg["gaps"], np.int32).astype(np.int64)
    first = np.cumsum(counts.astype(np.int64)) - counts
    run = np.cumsum(gaps)
    at = run - np.repeat((run[first] - gaps[first]) if len(first) else run[:0], counts)
    size = int(lens.sum()) + len(lens)
    head = np.cumsum(lens + 1) - (lens + 1)
    edge, items_of = np.zeros(size + 1, np.int64), {}
    for block in sent:
        begin, phrase = matches(terms, counts, at, size, block, slop)
        length = np.array([len(block["phrases"][p]) for p in phrase], np.int64)
        doc = np.searchsorted(head, begin, "right") - 1
        stop = np.minimum(begin + length, head[doc] + lens[doc]) if len(doc) else begin
        np.add.at(edge, begin, 1)
        np.add.at(edge, stop, -1)
        for d, p in set(zip(doc.tolist(), phrase.tolist())):
            items_of.setdefault(d, set()).update(block["items"][p])
    hit = (np.cumsum(edge)[:size] > 0).astype(np.int64)
    turn = np.diff(np.r_[0, hit, 0])
    span_first, span_end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    span_doc = np.searchsorted(head, span_first, "right") - 1
    spans = np.stack([span_doc, span_first - head[span_doc], span_end - span_first], 1) if len(span_doc) else np.zeros((0, 3), np.int64)
    return lens, spans, items_of


def _rows(seg: dict, lens: np.ndarray, spans: np.ndarray, items_of: dict[int, set]) -> list[dict]:
    """The result rows of a segment's documents."""
    out = []
    cut = np.searchsorted(spans[:, 0], np.arange(len(lens) + 1))
    for d, (doc_id, text_hash) in enumerate(zip(seg["doc_ids"], seg["text_hashes"])):
        mine = spans[cut[d]:cut[d + 1]]
        n, n_hit = int(lens[d]), int(mine[:, 2].sum())
        own = sorted(items_of.get(d, ()))
        out.append({"doc_id": doc_id, "n_words": n, "n_hit": n_hit, "n_items": len(own),
                    "items_sha256": hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest(),
                    "contaminated": n_hit > 0 and SHARE * n_hit >= n, "items": own,
                    "spans": [{"first": f, "words": w} for f, w in mine[:, 1:].tolist()], "text_hash": text_hash})
    return out


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The union of spans (document, first word, words), by document and place."""
    spans = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
    out: list[list[int]] = []
    for d, first, words_ in spans[np.lexsort((spans[:, 1], spans[:, 0]))].tolist():
        if out and out[-1][0] == d and first <= out[-1][1] + out[-1][2]:
            out[-1][2] = max(out[-1][2], first + words_ - out[-1][1])
        else:
            out.append([d, first, words_])
    return np.array(out, np.int64).reshape(-1, 3)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
                    ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.int64())),
                    ("spans", pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))), ("text_hash", pa.int64())])


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0,
           block_words: int = BLOCK_WORDS, keyed: bool = False) -> DataFrame:
    """Per document: its words, the words inside any occurrence of a window,
    the items with occurring windows, their digest, the verdict, and the hit
    spans by word number.

    An item of fewer words than ``window`` is one window; an item without
    words or with null text has none; an item with a null id hits but is not
    listed.  Equal ids count once.  Rows with equal ``doc_id`` are separate
    rows, equal rows get equal results; null and empty texts have no words.
    An empty table gives no rows, no items give no hits.  With ``slop`` > 0
    the matches are by proximity: each term within so many words of its place
    (a window then reaches from its first place over as many words as it has).
    With ``keyed`` there is the text's hash, too.

    Up to ``PASS_BLOCKS`` blocks of items are on the driver and the workers at
    a time.  Where there are more, each pass writes what it found, a row for
    every segment with hits, and the passes' spans are united per segment."""
    sc = index.sparkSession.sparkContext
    stream = phrase_blocks(items, window, block_words)
    found, sent = None, list(islice(stream, PASS_BLOCKS))
    following = list(islice(stream, PASS_BLOCKS))
    if following:
        seg_key = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place")]
        while sent:
            shared = sc.broadcast(sent)

            def part(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for k in range(batch.num_rows):
                        seg = batch.slice(k, 1).to_pylist()[0]
                        _, spans, items_of = _found(seg, shared.value, slop)
                        if len(spans):
                            own = np.array([(d, i) for d, s in items_of.items() for i in s], np.int64)
                            yield pa.RecordBatch.from_pylist([{"file": seg["file"], "place": seg["place"], "spans": spans.tobytes(),
                                                               "own": own.tobytes()}], pa.schema(
                                [("file", pa.string()), ("place", pa.int64()), ("spans", pa.binary()), ("own", pa.binary())]))

            hits = written(index.select("*", *seg_key).mapInArrow(part, "file string, place long, spans binary, own binary"), "hits")
            found = found.unionByName(hits) if found else hits
            shared.destroy()
            sent, following = following, list(islice(stream, PASS_BLOCKS))
        per_segment = found.groupBy("file", "place").agg(F.collect_list("spans").alias("parts"), F.collect_list("own").alias("owns"))
        whole = index.select("*", *seg_key).join(per_segment, ["file", "place"], "left").drop("file", "place")

        def unite(seg: dict) -> list[dict]:
            spans = _joined([np.frombuffer(p, np.int64).reshape(-1, 3) for p in seg["parts"] or ()])
            items_of: dict[int, set] = {}
            for own in seg["owns"] or ():
                for d, i in np.frombuffer(own, np.int64).reshape(-1, 2).tolist():
                    items_of.setdefault(d, set()).add(i)
            return _rows(seg, np.frombuffer(seg["lengths"], np.int32).astype(np.int64), spans, items_of)

        rows = unite
    else:
        whole, shared = index, sc.broadcast(sent)

        def rows(seg: dict) -> list[dict]:
            return _rows(seg, *_found(seg, shared.value, slop))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist(rows(batch.slice(k, 1).to_pylist()[0]), SCHEMA)

    hits = whole.mapInArrow(run, HITS)
    return hits if keyed else hits.drop("text_hash")


def clean(docs: DataFrame, items: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns of the documents that aren't contaminated.  Rows are
    known by id and text hash: others with a contaminated one's id (or with a
    null id, as it) stay."""
    keys = ["doc_id", "text_hash"]
    found = written(search(build_index(docs), items, keyed=True).where("contaminated").select(*keys).distinct(), "contaminated")
    known = small(found, found.count(), 200_000)
    rows = pick(docs, {"doc_id": "long", "text": "string"} | columns).withColumn("text_hash", _text_hash())
    same = rows["doc_id"].eqNullSafe(known["doc_id"]) & (rows["text_hash"] == known["text_hash"])
    return rows.join(known, same, "left_anti").select(*columns)


def proximity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in the documents with every word within ``NEAR`` words
    of its place: what small insertions, swaps and losses hide from phrases."""
    near = search(build_index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"), slop=NEAR)
    return near.select("doc_id", "n_words", F.col("n_hit").alias("n_near"), F.col("n_items").alias("n_near_items"),
                       F.col("items").alias("near_items"), F.col("spans").alias("near_spans"))


def op3_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search(build_index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))
    return hits.drop("items", "spans")


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[0-9a-z\x{80}-\x{10FFFF}]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[0-9a-z\x{80}-\x{10FFFF}]+') as w from benchmark),
win as (select distinct item_id, least(len(w), 13) as n, array_to_string(w[s + 1:s + least(len(w), 13)], ' ') as k
        from (select item_id, w, unnest(range(0, greatest(len(w) - 12, 1))) as s from b where len(w) > 0)),
grams as (select doc_id, n, s, array_to_string(w[s + 1:s + n], ' ') as k
          from (select doc_id, w, n, unnest(range(0, len(w) - n + 1)) as s
                from d, (select distinct n from win) where len(w) >= n)),
hits as (select g.doc_id, g.s, g.n, win.item_id from grams g join win using (n, k)),
spots as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hits) group by 1),
found as (select doc_id, count(distinct item_id) as n_items,
                 array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') as ids from hits group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join spots using (doc_id) left join found using (doc_id)
"""
