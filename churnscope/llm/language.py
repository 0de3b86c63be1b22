"""Language identification with string kernels (operator 8).

The kernel of two texts is the number of hashed byte n-grams (1 to 3 bytes,
case folded, other ASCII as spaces) present in both, over the geometric mean of
the numbers present in each.  Nystroem features against landmark texts feed a
one-versus-rest kernel ridge regression; texts are scored by matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from churnscope.llm.shared import pick, read, unit_hash
from churnscope.llm.tokens import blocks

BITS = 14
#: Labelled texts used for the fit: about so many for each language, and in all.
PER_LANGUAGE, IN_ALL = 600, 12_000
#: Landmark texts: for each language, at least in all, and beyond which there
#: are only two for each language.
PER_MARK, LANDMARKS, MOST_MARKS = 16, 64, 1024
RIDGE, SHARPNESS = 1e-3, 5.0
DOC = {"doc_id": "long", "text": "string", "lang": "string"}

_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[65:91] += 32
_CLASS[:128][~((_CLASS[:128] >= 97) & (_CLASS[:128] <= 122))] = 32


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of 0/1: which hashed n-grams each whole text holds."""
    n, b = len(offsets) - 1, _CLASS[data]
    out = np.zeros(n << BITS, np.uint8)
    lens = np.diff(offsets)
    row = np.repeat(np.arange(n, dtype=np.int64) << BITS, lens)
    left = np.repeat(offsets[1:], lens) - np.arange(len(b))  # bytes up to the row's end
    gram = np.zeros(len(b), np.uint32)
    for k in range(1, 4):
        gram = gram[:len(b) - k + 1] * np.uint32(256) + b[k - 1:] if len(b) >= k else gram[:0]
        code = (gram + np.uint32(k << 24)) * np.uint32(2654435761) >> np.uint32(32 - BITS)
        ok = left[:len(gram)] >= k
        out[row[:len(gram)][ok] + code[ok]] = 1
    return out.reshape(n, 1 << BITS)


def _small(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    for i, j, data, offsets in blocks(col):
        for k in range(0, j - i, 256):
            part = offsets[k:min(j - i, k + 256) + 1]
            yield i + k, i + k + len(part) - 1, presence(data[part[0]:part[-1]], part - part[0])


def kernel(x: np.ndarray, landmarks: np.ndarray, norms: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    own = np.sqrt(np.maximum(x.sum(1), 1))
    return (x @ landmarks.T) / own[:, None] / norms[None, :]


def fit(x: np.ndarray, langs: list[str]) -> dict:
    """Nystroem map and ridge weights from presence rows and their languages.
    Landmarks are taken from each language in turn."""
    names = sorted(set(langs))
    y = np.array([names.index(v) for v in langs])
    ranks = np.zeros(len(y), int)
    for c in range(len(names)):
        ranks[y == c] = np.arange((y == c).sum())
    wanted = max(LANDMARKS, min(PER_MARK * len(names), max(MOST_MARKS, 2 * len(names))))
    chosen = np.lexsort((y, ranks))[:wanted]
    marks = x[chosen].astype(np.float32)
    norms = np.sqrt(np.maximum(marks.sum(1), 1))
    value, vector = np.linalg.eigh(kernel(x[chosen], marks, norms).astype(np.float64))
    good = value > 1e-6
    half = vector[:, good] / np.sqrt(value[good])
    phi = kernel(x, marks, norms) @ half
    phi = np.c_[phi, np.ones(len(phi))]
    weight = 1.0 / np.bincount(y, minlength=len(names))[y]
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    gram = (phi * weight[:, None]).T @ phi + RIDGE * np.eye(phi.shape[1])
    beta = np.linalg.solve(gram, (phi * weight[:, None]).T @ target)
    return {"names": names, "marks": marks.astype(np.uint8), "norms": norms, "half": half, "beta": beta}


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame) -> dict | None:
    """Fit on a bounded sample of the labelled texts that aren't held out;
    only their bit rows (2 KB each) come to the driver.  None without such
    rows.  A text that stands in many rows of a language counts once."""
    rows = pick(docs, DOC).where("lang is not null and text is not null and doc_id is not null")
    rows = rows.where(~is_held_out(F.col("doc_id"))).select("text", "lang", F.xxhash64("text").alias("text_hash"))
    texts = rows.select("lang", "text_hash").distinct()
    top = texts.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(IN_ALL).collect()
    if not top:
        return None
    quota = min(PER_LANGUAGE, max(1, IN_ALL // len(top)))
    rate = rows.sparkSession.createDataFrame([(r.lang, min(1.0, quota / r["count"])) for r in top], "lang string, rate double")
    draw = unit_hash(8, F.col("text_hash"), F.col("lang"))
    chosen = (texts.join(F.broadcast(rate), "lang").where(draw < F.col("rate"))
              .orderBy(draw / F.col("rate"), "lang", "text_hash").limit(IN_ALL).select("lang", "text_hash"))
    taken = (rows.join(F.broadcast(chosen), ["lang", "text_hash"]).groupBy("lang", "text_hash")
             .agg(F.min("text").alias("text")).select("text_hash", "text", "lang"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x in _small(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], pa.array(
                    [r.tobytes() for r in np.packbits(x, axis=1)], pa.binary())], ["text_hash", "lang", "bits"])

    sample = taken.mapInArrow(bits, "text_hash long, lang string, bits binary").toPandas().sort_values(["lang", "text_hash"])
    if not len(sample):
        return None
    x = np.unpackbits(np.frombuffer(b"".join(sample.bits), np.uint8).reshape(len(sample), -1), axis=1)
    return fit(x, list(sample.lang))


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """Language of every whole text: ``und`` with score 0 where the text is
    null or has no letter (or nothing could be learnt).  ``score`` is the
    softmax of the margins.  A null id isn't held out; rows with equal ids
    are separate rows, equal rows get equal results; a text counts whole,
    however long; an empty table gives none.  Columns are found by their
    exact names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, held_out boolean, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        if m:
            marks, names = m["marks"].astype(np.float32), np.array(m["names"], object)
        for batch in batches:
            lettered = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            lang, score = np.full(len(lettered), "und", object), np.zeros(len(lettered))
            for i, j, x in _small(batch.column(1)) if m else ():
                phi = kernel(x, marks, m["norms"]) @ m["half"]
                f = SHARPNESS * (np.c_[phi, np.ones(len(phi))] @ m["beta"])
                p = np.exp(f - f.max(1, keepdims=True))
                ok = lettered[i:j]
                lang[i:j][ok] = names[f.argmax(1)][ok]
                score[i:j][ok] = (p.max(1) / p.sum(1))[ok]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(score)],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    rows = pick(docs, DOC).select("doc_id", "text", is_held_out(F.col("doc_id")).alias("held_out"),
                                  F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return rows.mapInArrow(run, schema)


def op8_string_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return predict(docs, train(docs))
