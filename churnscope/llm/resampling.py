"""Target-distribution importance resampling (operator 12).

An untrained Split pre-tokeniser (the tokenizers package) cuts the text,
lower-cased in ASCII, into words with their offsets.  Windows of consecutive
offset pairs are the features; a feature's CRC-32 modulo the number of buckets
is its bucket.  Spark counts the buckets of the documents and of the target
texts, the counts give each bucket's gain in log likelihood, and a document's
weight is the mean gain of its features.  Gumbel noise from a hash of the
document's id turns the weights into a draw without replacement.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Regex, pre_tokenizers

from churnscope.llm.shared import pick, read, written
from churnscope.operators.ranks import numbered

#: Runs of everything but ASCII punctuation, controls and (after lowering) capitals.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
BUCKETS = 10_000
SEED = 2024
#: Share of the documents drawn, and the words a document needs to be drawn.
PERCENT = 10
MIN_WORDS = 20
#: A longer text is cut into words piece by piece, at a gap between words.
PIECE = 1 << 18
TEXT = {"doc_id": "long", "text": "string"}


def splitter() -> pre_tokenizers.PreTokenizer:
    return pre_tokenizers.Split(Regex(WORD), "removed", invert=True)


def word_offsets(split: pre_tokenizers.PreTokenizer, text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """The lowered text in pieces, each with the offsets of its words."""
    text = text.encode().lower().decode()
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = gap.start() if gap else len(text)
        piece = text[at:end]
        yield piece, [span for _, span in split.pre_tokenize_str(piece)]
        at = end


def feature_buckets(split: pre_tokenizers.PreTokenizer, text: str, shortest: int, longest: int, buckets: int) -> tuple[int, list[int]]:
    """Number of words, and the bucket of every window of ``shortest`` to ``longest`` words."""
    n_words, out, left = 0, [], []
    for piece, spans in word_offsets(split, text):
        n_words += len(spans)
        words = left + [piece[a:b] for a, b in spans]
        for n in range(shortest, longest + 1):
            # Windows that end in this piece; ``left`` holds the last words of those before.
            tail = words[max(0, len(left) - n + 1):]
            found = tail if n == 1 else [" ".join(tail[i:i + n]) for i in range(len(tail) - n + 1)]
            out += [zlib.crc32(feature.encode()) % buckets for feature in found]
        left = words[max(0, len(words) - longest + 1):] if longest > 1 else []
    return n_words, out


def features(texts: DataFrame, shortest: int, longest: int, buckets: int) -> DataFrame:
    """``doc_id, n_words, buckets`` of every row, as a written table."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("buckets", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            start, n_words, offsets, values = 0, [], [0], []
            for i in range(batch.num_rows):
                n, found = feature_buckets(split, texts[i].as_py() or "", shortest, longest, buckets)
                n_words.append(n)
                values += found
                offsets.append(len(values))
                if len(values) >= PIECE or i + 1 == batch.num_rows:
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
                    yield pa.RecordBatch.from_arrays([ids[start:i + 1], pa.array(n_words, pa.int64()), lists], schema=schema)
                    start, n_words, offsets, values = i + 1, [], [0], []

    return written(pick(texts, TEXT).mapInArrow(run, "doc_id long, n_words long, buckets array<int>"), "buckets")


def histogram(found: DataFrame, buckets: int) -> list[int]:
    """How many features fall in each bucket; ``buckets`` numbers at most reach the driver."""
    counts = [0] * buckets
    for b, n in found.select(F.explode("buckets").alias("b")).groupBy("b").count().collect():
        counts[b] = n
    return counts


def bucket_gains(source: list[int], target: list[int]) -> np.ndarray:
    """Gain of each bucket in thousandths, floored; one is added to every count."""
    m, s_all, t_all = len(source), float(sum(source)), float(sum(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + m) / ((s + 1.0) * (t_all + m))))
                     for s, t in zip(source, target)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise of an id in thousandths, floored; a null id counts as empty text."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(found: DataFrame, gains: np.ndarray, seed: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row of the feature table."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            n = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            ends = np.cumsum(n)
            sums = np.concatenate([[0], np.cumsum(gains[values])])
            weight = (sums[ends] - sums[ends - n]) // np.maximum(n, 1)
            drawn = np.array([noise(d, seed) for d in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(weight),
                                              pa.array(weight + drawn)], schema=schema)

    return found.select("doc_id", "n_words", "buckets").mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS,
             percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Every document with its weight, score and, where drawn, its rank.

    Returns ``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and
    ``rank``: 1, 2, 3, ... for the highest scores among documents of
    ``min_words`` words or more, as many as ``percent`` of those; else null.
    Equal scores go to the smaller id (a null id last), then to fewer
    features; rows equal in these are alike and take consecutive ranks.
    Null and empty texts have no words, weight 0 and are never drawn; texts
    of any length count whole, in bounded pieces.  Repeated rows are rows of
    their own.  Without documents the result is empty; without target texts
    every gain comes from the documents' counts alone.  Only ``doc_id`` and
    ``text``, by their exact names, are read."""
    found = features(docs, shortest, longest, buckets)
    wanted = features(target, shortest, longest, buckets)
    gains = bucket_gains(histogram(found, buckets), histogram(wanted, buckets))
    scored = written(weights(found, gains, seed), "scores")
    able = scored.where(F.col("n_words") >= min_words)
    # Scores are thousandths of logarithms: some ten thousand different values, however many rows.
    steps = able.groupBy("score").agg(F.count("*").alias("n"))
    total = steps.agg(F.sum("n")).first()[0] or 0
    draws = percent * total // 100
    above = Window.orderBy(F.desc("score"))
    cut = (steps.withColumn("upto", F.sum("n").over(above)).where(F.col("upto") >= draws)
           .agg(F.max("score")).first()[0]) if draws else None
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    near = (F.col("n_words") >= min_words) & (F.col("score") >= cut)
    ranked = numbered(scored.where(near), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    return ranked.unionByName(scored.where(~near).withColumn("rank", F.lit(None).cast("long")))


def op12_split_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
            .select("doc_id", "n_features", "weight", "score", "rank"))


#: CRC-32 over a word's bytes by the usual table of 256 remainders, made by eight halvings each.
ORACLE = r"""
with recursive rem as (
  select range as i, range as r, 0 as k from range(256)
  union all select i, case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end, k + 1 from rem where k < 8),
tab as (select list(r order by i) as t from rem where k = 8),
src as (select 0 as side, doc_id as id, text from documents union all select 1, null, text from benchmark),
rows as (select row_number() over () as no, side, id,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[0-9a-z\x{80}-\x{10FFFF}]+') as w from src),
uses as (select no, side, w, count(*) as c from (select no, side, unnest(w) as w from rows) group by all),
vocab as (select w, hex(encode(w)) as h from (select distinct w from uses)),
bytes as (select w, list_transform(range(0, cast(len(h) / 2 as bigint)), lambda j: cast(concat('0x', substr(h, cast(2 * j + 1 as bigint), 2)) as bigint)) as b
          from vocab),
crc as (select w, xor(list_reduce(list_prepend(cast(4294967295 as bigint), b),
                      lambda c, x: xor(c >> 8, t[cast(xor(c, x) & 255 as bigint) + 1])), 4294967295) % 10000 as bucket from bytes, tab),
hits as (select no, side, bucket, sum(c) as c from uses join crc using (w) group by all),
sums as (select coalesce(sum(c) filter (side = 0), 0) as S, coalesce(sum(c) filter (side = 1), 0) as T from hits),
gains as (select bucket, cast(floor(1000 * ln((coalesce(sum(c) filter (side = 1), 0) + 1)::double * (any_value(S) + 10000)::double
                 / ((coalesce(sum(c) filter (side = 0), 0) + 1)::double * (any_value(T) + 10000)::double))) as bigint) as g
          from hits, sums group by bucket),
per as (select no, sum(c) as n, sum(c * g) as total from hits join gains using (bucket) where side = 0 group by no),
weighed as (select id as doc_id, cast(coalesce(n, 0) as bigint) as n_features,
                   cast(coalesce(floor(total / n), 0) as bigint) as weight,
                   cast(concat('0x', substr(sha256('2024:' || coalesce(cast(id as varchar), '')), 1, 8)) as bigint) as h
            from rows left join per using (no) where side = 0),
scored as (select doc_id, n_features, weight, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score from weighed),
able as (select *, row_number() over (order by score desc, doc_id nulls last, n_features) as place, count(*) over () as n
         from scored where n_features >= 20)
select doc_id, n_features, weight, score, cast(case when place <= 10 * n // 100 then place end as bigint) as rank from able
union all select doc_id, n_features, weight, score, null from scored where n_features < 20
"""
