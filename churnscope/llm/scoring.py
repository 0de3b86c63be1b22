"""Masked pseudo-likelihood scores (operator 4).

A window network predicts every word from the two words on either side.  The
448 most frequent words are classes of their own, the others share 64 classes
by length and last byte; classes stand in groups, and the network gives the
probability of the group and of the class in its group.  A word's probability
is its class's times its share of the class in the whole corpus.  The corpus
counts come from every document; in training every position is masked and
predicted once.  With several rounds, a hash of the word and its place in its
text says in which.  Partitions train in numpy from the same start and Spark averages
their parameters, weighted by tokens, so the parameters (not the counts, the
classes or the masks) depend on how the table is partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from churnscope.llm.shared import pick, read, written
from churnscope.llm.tokens import LOWER, blocks, mix64, word_hashes, word_spans

GROUPS, EACH, RARE = 16, 32, 64
CLASSES = GROUPS * EACH
FREQUENT = CLASSES - RARE
SIDE, HIDDEN = 2, 16
#: Buckets of rare words' shares: twice the different words, between these powers of two.
LEAST_BITS, MOST_BITS = 18, 22
#: Every position is masked and predicted in one of the rounds.
ROUNDS, BATCH, RATE = 1, 1024, 4.0
SHAPES = ((2 * SIDE * (CLASSES + 1), HIDDEN), (HIDDEN,), (HIDDEN, GROUPS), (GROUPS,), (GROUPS, HIDDEN, EACH), (GROUPS, EACH))
DOC = {"doc_id": "long", "text": "string"}
#: Different words of a task that are counted before they are passed on.
FLUSH = 1 << 20


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, rare class and row of every word."""
    starts, ends, rows = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    shape = np.minimum(ends - starts, 8) * 256 + (LOWER[data[ends - 1]] if len(ends) else 0)
    return h, FREQUENT + (mix64(np.asarray(shape, np.uint64)) % np.uint64(RARE)).astype(np.int64), rows


def count_words(docs: DataFrame) -> DataFrame:
    """Corpus-wide count of each word (its hash, and its rare class), summed
    before and after the shuffle (written)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rares, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(rares), pa.array(sums)], ["word", "rare", "n"])

        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0), 4 << 20):
                h, rare, _ = _tokens(data, offsets)
                k, first, n = np.unique(h, return_index=True, return_counts=True)
                keys, at, back = np.unique(np.r_[keys, k], return_index=True, return_inverse=True)
                rares = np.r_[rares, rare[first]][at]
                sums = np.bincount(back, np.r_[sums, n], len(keys)).astype(np.int64)
                if len(keys) > FLUSH:
                    yield told()
                    keys, rares, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield told()

    return written(pick(docs, {"text": "string"}).mapInArrow(run, "word long, rare long, n long")
                   .groupBy("word", "rare").agg(F.sum("n").alias("n")), "words")


def vocabulary(docs: DataFrame) -> dict:
    """The most frequent words in groups by frequency, and the log share of
    every bucket of the other words in its class.  Buckets grow with the
    different words counted; at most 2**22 of them come to the driver."""
    counts = count_words(docs)
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    words = np.array([r.word for r in top], np.int64).view(np.uint64)
    order = np.argsort(words)
    bits = int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(2 * max(1, counts.count()))))))
    others = counts.join(F.broadcast(docs.sparkSession.createDataFrame([(r.word,) for r in top], "word long")), "word", "left_anti")
    bucket = F.pmod(F.shiftrightunsigned("word", 20), F.lit(1 << bits)).cast("int")
    got = others.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.max_by("rare", F.struct("n", "word")).alias("rare")).toPandas()
    mass = np.zeros(CLASSES)
    mass[:len(top)] = [r.n for r in top]
    mass += np.bincount(got.rare.to_numpy(np.int64), got.n.to_numpy(float) + 0.5, CLASSES)
    n = np.zeros(1 << bits, np.float32)
    n[got.bucket] = got.n
    prior = mass + 1.0
    group = prior.reshape(GROUPS, EACH).sum(1)
    return {"words": words[order], "classes": order, "bits": bits, "n": n, "mass": np.log(np.maximum(mass, 0.5)),
            "group": np.log(group / group.sum()), "class": np.log(prior.reshape(GROUPS, EACH) / group[:, None])}


def classes_of(vocab: dict, h: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of every word, and the log share of the word in its class."""
    words = vocab["words"]
    if not len(words):
        return rare, np.zeros(len(h), np.float32)
    at = np.searchsorted(words, h)
    at[at == len(words)] = 0
    known = words[at] == h
    cls = np.where(known, vocab["classes"][at], rare)
    n = vocab["n"][((h >> np.uint64(20)) & np.uint64((1 << vocab["bits"]) - 1)).astype(np.int64)]
    return cls, np.where(known, 0.0, np.log(n + 0.5) - vocab["mass"][cls]).astype(np.float32)


def start(vocab: dict) -> np.ndarray:
    rng = np.random.default_rng(4)
    parts = [rng.normal(0, 0.1, s) for s in SHAPES]
    parts[1][:], parts[3][:], parts[5][:] = 0, vocab["group"], vocab["class"]
    return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


def unpack(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for s in SHAPES:
        out.append(flat[at:at + int(np.prod(s))].reshape(s).copy())
        at += int(np.prod(s))
    return out


def windows(cls: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """For each word the embedding rows of its neighbours; beyond a text's
    edges stands the padding class."""
    at = np.arange(len(cls)) + SIDE * (rows + 1)
    line = np.full(len(cls) + SIDE * (n_rows + 1), CLASSES, np.int64)
    line[at] = cls
    moves = [d for d in range(-SIDE, SIDE + 1) if d]
    return np.stack([line[at + d] + k * (CLASSES + 1) for k, d in enumerate(moves)], 1)


def hidden(ctx: np.ndarray, emb: np.ndarray, b1: np.ndarray) -> np.ndarray:
    h = emb[ctx[:, 0]]
    for k in range(1, ctx.shape[1]):
        h = h + emb[ctx[:, k]]
    return np.tanh(h + b1)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def _softmax(z: np.ndarray) -> np.ndarray:
    """In place."""
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def by_group(want: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order of the words that puts groups together, and each group's slice."""
    group = want // EACH
    order = np.argsort(group, kind="stable")
    names, first = np.unique(group[order], return_index=True)
    return order, [(int(g), slice(a, b)) for g, a, b in zip(names, first, np.r_[first[1:], len(want)])]


def log_chances(params: list[np.ndarray], ctx: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Log-probability of each wanted class given its neighbours."""
    emb, b1, out_g, b_g, out_c, b_c = params
    order, groups = by_group(want)
    h, want = hidden(ctx[order], emb, b1), want[order]
    every = np.arange(len(want))
    z = np.empty((len(want), EACH), h.dtype)
    for g, part in groups:
        np.matmul(h[part], out_c[g], out=z[part])
        z[part] += b_c[g]
    ll = _log_softmax(h @ out_g + b_g)[every, want // EACH] + _log_softmax(z)[every, want % EACH]
    back = np.empty_like(ll)
    back[order] = ll
    return back


def descend(params: list[np.ndarray], ctx: np.ndarray, want: np.ndarray, rate: float) -> None:
    """One step of gradient descent on a batch, in place."""
    emb, b1, out_g, b_g, out_c, b_c = params
    order, groups = by_group(want)
    ctx, want = ctx[order], want[order]
    h = hidden(ctx, emb, b1)
    pace, every = rate / len(want), np.arange(len(want))
    p = _softmax(h @ out_g + b_g)
    p[every, want // EACH] -= 1
    back = p @ out_g.T
    out_g -= pace * (h.T @ p)
    b_g -= pace * p.sum(0)
    own = want % EACH
    q = np.empty((len(want), EACH), h.dtype)
    for g, part in groups:
        np.matmul(h[part], out_c[g], out=q[part])
        q[part] += b_c[g]
    _softmax(q)
    q[every, own] -= 1
    for g, part in groups:
        back[part] += q[part] @ out_c[g].T
        out_c[g] -= pace * (h[part].T @ q[part])
        b_c[g] -= pace * q[part].sum(0)
    back *= 1 - h * h
    b1 -= pace * back.sum(0)
    # Embeddings are rarely touched: larger steps.  Rows that occur again add up.
    flat = ctx.ravel()
    turn = np.argsort(flat, kind="stable")
    flat = flat[turn]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    emb[flat[first]] -= 4 * pace * np.add.reduceat(back[turn // ctx.shape[1]], first)


def masked_in(h: np.ndarray, rows: np.ndarray, n_rows: int, rounds: int) -> np.ndarray:
    """The round in which each word is masked, by its hash and its place in its text."""
    count = np.bincount(rows, minlength=n_rows)
    nth = (np.arange(len(h)) - (np.cumsum(count) - count)[rows]).astype(np.uint64)
    return ((mix64(h + nth) >> np.uint64(8)) % np.uint64(rounds)).astype(np.int64)


def train(docs: DataFrame, vocab: dict, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters after ``rounds`` passes, each masking other positions."""
    sc = docs.sparkSession.sparkContext
    flat, sent_vocab = start(vocab), sc.broadcast(vocab)
    texts = pick(docs, {"text": "string"})
    for r in range(rounds):
        sent = sc.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], r: int = r, sent=sent) -> Iterator[pa.RecordBatch]:
            params, v, seen = unpack(sent.value), sent_vocab.value, 0
            for batch in batches:
                for _, _, data, offsets in blocks(batch.column(0)):
                    h, rare, rows = _tokens(data, offsets)
                    chosen = np.flatnonzero(masked_in(h, rows, len(offsets) - 1, rounds) == r)
                    if not len(chosen):
                        continue
                    cls, _ = classes_of(v, h, rare)
                    ctx = windows(cls, rows, len(offsets) - 1)[chosen]
                    want = cls[chosen]
                    mixed = np.random.default_rng(seen).permutation(len(chosen))
                    for s in range(0, len(mixed), BATCH):
                        b = mixed[s:s + BATCH]
                        descend(params, ctx[b], want[b], RATE * len(b) / BATCH / (1 + seen / 200_000) ** 0.5)
                        seen += len(b)
            if seen:
                w = np.concatenate([p.ravel() for p in params]).astype(np.float64) * seen
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w))), pa.array(w), pa.array(np.full(len(w), seen))],
                                                 ["i", "w", "n"])

        means = texts.mapInArrow(run, "i long, w double, n long").groupBy("i").agg(
            (F.sum("w") / F.sum("n")).alias("w")).toPandas()
        if len(means):
            flat = flat.copy()
            flat[means.i] = means.w
    return flat


def score(docs: DataFrame, vocab: dict, flat: np.ndarray) -> DataFrame:
    """Pseudo-log-likelihood of every whole text: the sum over its words of
    the log-probability given both sides.

    A null, empty or wordless text has no words, sum 0 and a null mean.  Equal
    texts have equal scores but for the last digits of float sums; repeated
    rows and equal ids are rows of their own; a text counts whole, however
    long, in bounded pieces.  An empty table gives no rows.  Only ``doc_id``
    and ``text``, by their exact names, are read."""
    sent = docs.sparkSession.sparkContext.broadcast((vocab, flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = sent.value
        params = unpack(w)
        for batch in batches:
            total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, j, data, offsets in blocks(batch.column(1)):
                h, rare, rows = _tokens(data, offsets)
                cls, share = classes_of(v, h, rare)
                ctx, ll = windows(cls, rows, j - i), np.zeros(len(cls), np.float32)
                for s in range(0, len(cls), 8192):
                    e = slice(s, s + 8192)
                    ll[e] = log_chances(params, ctx[e], cls[e]) + share[e]
                total[i:j] = np.bincount(rows, ll, j - i)
                count[i:j] = np.bincount(rows, minlength=j - i)
            mean = np.where(count > 0, total / np.maximum(count, 1), np.nan)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count), pa.array(total), pa.array(mean, mask=count == 0)],
                ["doc_id", "n_words", "pseudo_log_likelihood", "per_word"])

    return pick(docs, DOC).mapInArrow(run, "doc_id long, n_words long, pseudo_log_likelihood double, per_word double")


def op4_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    vocab = vocabulary(docs)
    return score(docs, vocab, train(docs, vocab))
