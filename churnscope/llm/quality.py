"""Quality classification by co-training (operator 5).

Two views of a document: its text content (hashed words, runs of other
characters, and words said twice in a row) and its page metadata (source,
language, size and layout figures).  A logistic classifier is fitted on each
view of a bounded sample of labelled rows.  In every round both classifiers
score all unlabelled documents in Spark, and each gives the texts that it is
surest of to the other one, which is fitted again with them.  At the end both
views' margins are calibrated together on labelled rows kept aside, and every
document is scored.  A document is good if its quality is 1 and it isn't toxic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from churnscope.llm.shared import pick, read, unit_hash, written
from churnscope.llm.tokens import WORD, blocks, mix64, word_hashes, word_spans

#: Bound of the fit: labelled rows.
LABELLED = 20_000
TEXT_BITS, META_BITS = 18, 12
#: Rounds of the exchange, the probability from which a view is sure, and the
#: texts of each class that a view gives in the first round (twice as many in
#: the second): the surest of the whole corpus, which bounds the rows fitted.
ROUNDS, SURE, EACH = 2, 0.97, 500
#: Feature ids handled at once in the fit.
PIECE = 1 << 19
DOC = {"doc_id": "long", "text": "string", "lang": "string", "source": "string"}

#: Both views and their numbers of features.
VIEWS = {"text": 1 << TEXT_BITS, "meta": 3 << META_BITS}

_SHARES = np.array([1e-9, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.5, 0.8])
_UPPER, _DIGIT, _SYMBOL = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91], _DIGIT[48:58] = True, True
_SYMBOL[33:128] = ~WORD[33:128]


def _per_row(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags)][edges])


def features(data: np.ndarray, offsets: np.ndarray, langs: list, sources: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row the ids of its text features and of its metadata features."""
    n = len(offsets) - 1
    starts, ends, rows = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    near = np.flatnonzero(rows[1:] == rows[:-1])
    gap_from, gap_to = ends[near], starts[near + 1]
    odd = gap_to - gap_from > 1  # a single character between two words says little
    gaps = mix64(word_hashes(data, gap_from[odd], gap_to[odd]) + np.uint64(1))
    twice = near[h[near] == h[near + 1]]
    ids = np.r_[h, gaps, mix64(h[twice] + np.uint64(2))] & np.uint64((1 << TEXT_BITS) - 1)
    owner = np.r_[rows, rows[near[odd]], rows[twice]]
    flat = np.unique(owner << TEXT_BITS | ids.astype(np.int64))
    cut = np.searchsorted(flat, np.arange(n + 1) << TEXT_BITS)

    size = np.maximum(np.diff(offsets), 1)
    lines = _per_row(data == 10, offsets) + 1
    words = np.bincount(rows, minlength=n)
    figures = [np.searchsorted(_SHARES, _per_row(f[data], offsets) / size) for f in (_UPPER, _DIGIT, _SYMBOL)]
    figures += [np.searchsorted(_SHARES, np.bincount(rows[twice], minlength=n) / np.maximum(words, 1)),
                np.log2(size).astype(int), np.log2(lines).astype(int), np.log2(size / lines).astype(int),
                np.searchsorted(np.arange(2, 14), size / np.maximum(words, 1))]
    meta = np.stack([k * 64 + np.asarray(v) for k, v in enumerate(figures)], 1)
    mask = np.uint64((1 << META_BITS) - 1)
    named = {v: xxhash.xxh3_64_intdigest(repr(v).encode()) & int(mask) for v in {(0, x) for x in langs} | {(1, x) for x in sources}}
    for i in range(n):
        own = [(1 << META_BITS) + named[0, langs[i]], (2 << META_BITS) + named[1, sources[i]]]
        yield (flat[cut[i]:cut[i + 1]] & ((1 << TEXT_BITS) - 1)).astype(np.int32), np.r_[meta[i], own].astype(np.int32)


def _views(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    langs, sources = batch.column(2).to_pylist(), batch.column(3).to_pylist()
    for i, j, data, offsets in blocks(batch.column(1)):
        for k, (t, m) in enumerate(features(data, offsets, langs[i:j], sources[i:j])):
            yield i + k, t, m


class Sparse:
    """Rows of feature ids, all of value 1."""

    def __init__(self, rows: list[np.ndarray]):
        self.lens = np.array([len(r) for r in rows], np.int64)
        self.ids = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), self.lens)

    def margins(self, w: np.ndarray) -> np.ndarray:
        return self.by_row(w) + w[-1]

    def by_row(self, w: np.ndarray) -> np.ndarray:
        """Sum of w over each row's features, in pieces that bound the memory."""
        out = np.zeros(len(self.lens))
        for s in range(0, len(self.ids), PIECE):
            out += np.bincount(self.row[s:s + PIECE], w[self.ids[s:s + PIECE]], len(out))
        return out

    def by_feature(self, g: np.ndarray, dim: int) -> np.ndarray:
        """Sum of g over each feature's rows, likewise."""
        out = np.zeros(dim)
        for s in range(0, len(self.ids), PIECE):
            out += np.bincount(self.ids[s:s + PIECE], g[self.row[s:s + PIECE]], dim)
        return out


def log_ratios(x: Sparse, y: np.ndarray, dim: int, smooth: float = 3.0) -> np.ndarray:
    """How far each feature's rates in the two classes lie apart."""
    n = np.maximum(np.bincount(y, minlength=2), 1)
    rates = []
    for k in (0, 1):
        seen = x.by_feature((y == k).astype(float), dim)
        rates.append(np.log((seen + smooth * n[k] / n.max()) / (n[k] + 2 * smooth * n[k] / n.max())))
    return np.abs(rates[1] - rates[0])


def logistic(x: Sparse, y: np.ndarray, dim: int, steps: int = 100, ridge: float = 1e-4) -> np.ndarray:
    """Weights (bias last) by accelerated gradient steps; both classes weigh
    the same.  Features are scaled by their log ratios, so that words of one
    class stand out among many neutral ones; those seen in fewer than 3 rows
    keep weight 0."""
    scale = log_ratios(x, y, dim) * (np.bincount(x.ids, minlength=dim) >= 3)
    weight = 0.5 / np.maximum(np.bincount(y, minlength=2), 1)[y]
    norm = x.by_row(scale ** 2)
    pace = 1 / (0.25 * np.percentile(norm, 90) + 1 + ridge)
    w, move = np.zeros(dim + 1), np.zeros(dim + 1)
    for _ in range(steps):
        ahead = w + 0.9 * move
        z = x.margins(np.r_[ahead[:-1] * scale, ahead[-1]])
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        grad = np.r_[x.by_feature(g, dim) * scale + ridge * ahead[:-1], g.sum()]
        move = 0.9 * move - pace * grad
        w = w + move
    return np.r_[w[:-1] * scale, w[-1]]


def combined(zt: np.ndarray, zm: np.ndarray) -> np.ndarray:
    return np.c_[np.clip(zt, -20, 20), np.clip(zm, -20, 20), np.ones(len(zt))]


def calibrate(z: np.ndarray, y: np.ndarray, even: bool) -> np.ndarray:
    """Logistic regression of the label on margins, by Newton steps; with
    ``even`` classes weigh by the root of their rates, else as often as they occur."""
    w = np.zeros(z.shape[1])
    c = (0.5 * len(y) / np.bincount(y, minlength=2)[y]) ** 0.5 if even else np.ones(len(y))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (c * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(z.shape[1])
        w -= np.linalg.solve(hess, z.T @ (c * (p - y)) + 0.1 * w)
    return w


def fitted(sample: DataFrame, given: DataFrame | None) -> dict | None:
    """Both views' weights, the calibration of each (``scales``) and of both
    together (``mix``), fitted in one task; only they come to the driver.

    ``sample`` has ``doc_id, good, text, meta`` of the labelled rows, a fourth
    of which is kept aside for the calibrations; ``given`` has ``view, label,
    ids, text_hash`` of the texts exchanged.  None if a part of the labels
    holds fewer than two classes."""
    rows = sample.select("doc_id", F.col("good").alias("label"), "text", "meta", F.lit("").alias("view"))
    if given is not None:
        rows = rows.unionByName(given.select(F.col("text_hash").alias("doc_id"), "label", F.col("ids").alias("text"),
                                             F.lit(b"").alias("meta"), "view"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: (r[4], r[0], r[1], r[2]))
        own = [r for r in all_rows if not r[4]]
        y = np.array([r[1] for r in own], int)
        aside = mix64(np.array([r[0] for r in own], np.int64).astype(np.uint64)) % np.uint64(4) == 0
        out = {k: None for k in (*VIEWS, *(f"{v}_scale" for v in VIEWS), "mix")}
        if len(own) and min(len({*y[~aside]}), len({*y[aside]})) == 2:
            margins = []
            for v, dim in VIEWS.items():
                ids = [np.frombuffer(r[2 if v == "text" else 3], np.int32) for r in own]
                more = [r for r in all_rows if r[4] == v]
                fixed = [x for x, a in zip(ids, aside) if not a] + [np.frombuffer(r[2], np.int32) for r in more]
                w = logistic(Sparse(fixed), np.r_[y[~aside], np.array([r[1] for r in more], int)], dim).astype(np.float32)
                margins.append(Sparse([x for x, a in zip(ids, aside) if a]).margins(w))
                # Sure by the calibrated probability at the classes' natural rates, so
                # that metadata never vouches for words it can't see.
                scale = calibrate(np.c_[np.clip(margins[-1], -20, 20), np.ones(len(margins[-1]))], y[aside], False)
                out |= {v: w.tobytes(), f"{v}_scale": scale.tobytes()}
            out["mix"] = calibrate(combined(*margins), y[aside], True).tobytes()
        yield pa.RecordBatch.from_pylist([out], pa.schema([(k, pa.binary()) for k in out]))

    names = [*VIEWS, *(f"{v}_scale" for v in VIEWS), "mix"]
    # A bounded number of rows: the labelled sample and the texts exchanged.
    row = rows.coalesce(1).mapInArrow(run, ", ".join(f"{k} binary" for k in names)).first()
    if row is None or row["mix"] is None:
        return None
    return {v: np.frombuffer(row[v], np.float32) for v in VIEWS} | {
        "scales": {v: np.frombuffer(row[f"{v}_scale"]) for v in VIEWS}, "mix": np.frombuffer(row["mix"])}


def featured(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash`` and both views' feature ids of every row (written)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, m = zip(*((t.tobytes(), m.tobytes()) for _, t, m in _views(batch))) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(t, pa.binary()), pa.array(m, pa.binary())],
                                             ["doc_id", "text_hash", "text", "meta"])

    rows = pick(docs, DOC).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    return written(rows.mapInArrow(run, "doc_id long, text_hash long, text binary, meta binary"), "views")


def surest(views: DataFrame, labelled: DataFrame, weights: dict, scales: dict, many: int) -> dict[str, list[tuple[int, int]]]:
    """For each view, the texts (by hash) that it gives away with their labels:
    of all unlabelled documents, the ``many`` surest of each class.  A text
    that stands in several rows counts once."""
    sent = views.sparkSession.sparkContext.broadcast((weights, scales))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, scale = sent.value
        for batch in batches:
            sure = []
            for v, col in zip(VIEWS, (2, 3)):
                z = Sparse([np.frombuffer(x, np.int32) for x in batch.column(col).to_pylist()]).margins(w[v])
                sure.append(1 / (1 + np.exp(-np.clip(np.c_[np.clip(z, -20, 20), np.ones(len(z))] @ scale[v], -30, 30))))
            sure = np.array(sure)
            any_sure = pa.array((np.maximum(sure, 1 - sure) >= SURE).any(0))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(any_sure), batch.column(1).filter(any_sure),
                                              *(pa.array(p).filter(any_sure) for p in sure)], ["doc_id", "text_hash", "text", "meta"])

    scored = views.mapInArrow(run, "doc_id long, text_hash long, text double, meta double").join(labelled, "doc_id", "left_anti")
    # Rows of one text differ in metadata at most; the least sure one speaks for it.
    texts = written(scored.groupBy("text_hash").agg(*[F.min(v).alias(f"{v}_lo") for v in VIEWS], *[F.max(v).alias(f"{v}_hi") for v in VIEWS]), "sure")
    out = {}
    for v in VIEWS:
        best = []
        for label, p in ((1, F.col(f"{v}_lo")), (0, 1 - F.col(f"{v}_hi"))):
            top = texts.where(p >= SURE).orderBy(p.desc(), unit_hash(6, F.col("text_hash")), "text_hash").limit(many)
            best += [(r.text_hash, label) for r in top.select("text_hash").collect()]
        out[v] = best
    return out


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Fit on a bounded sample of labelled rows and the texts exchanged; None
    if the labels hold fewer than two classes.

    An id's rows count as one labelled row, its first by text hash.  The fit
    is one task over the features of at most ``LABELLED`` labelled rows and of
    the texts exchanged; the choice of those is made from all documents."""
    spark = docs.sparkSession
    rows = pick(labels, {"doc_id": "long", "quality": "int", "toxic": "int"}).where("doc_id is not null and quality is not null")
    good = F.min(F.expr("if(quality = 1 and coalesce(toxic, 0) = 0, 1, 0)")).alias("good")
    labelled = rows.select("doc_id").distinct()
    chosen = rows.groupBy("doc_id").agg(good).orderBy(unit_hash(5, F.col("doc_id")), "doc_id").limit(LABELLED)
    views = featured(docs)
    one = F.min(F.struct("text_hash", "text", "meta")).alias("v")
    sample = written(views.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "good").agg(one).select(
        "doc_id", "good", "v.text", "v.meta"), "labelled")
    model = fitted(sample, None)
    for r in range(ROUNDS if model else 0):
        told = surest(views, labelled, model, model["scales"], EACH * (r + 1))
        pairs = [(t, other, label) for mine, other in (("text", "meta"), ("meta", "text")) for t, label in told[mine]]
        names = F.broadcast(spark.createDataFrame(pairs, "text_hash long, view string, label int"))
        found = views.join(names, "text_hash").groupBy("text_hash", "view", "label").agg(F.min(F.struct("text", "meta")).alias("v"))
        model = fitted(sample, found.select("text_hash", "view", "label", F.when(F.col("view") == "text", F.col("v.text")).otherwise(
            F.col("v.meta")).alias("ids")))
    return model and {k: model[k] for k in (*VIEWS, "mix")}


def classify(docs: DataFrame, model: dict | None, extra: dict[str, str] | None = None) -> DataFrame:
    """Both views' margins and the calibrated probability of being good for
    every whole document; ``accepted`` if it is at least one half.  Without a
    model (fewer than two classes of labels) every probability is 0.5 and every
    document is accepted.  A null text is an empty one; null source and
    language are values of their own; rows with equal ids are separate rows,
    equal rows get equal results; a text counts whole, however long; an empty
    table gives none.  Columns are found by their exact names.
    ``extra`` columns (name to type) are passed through, texts included."""
    extra = extra or {}
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = "text_margin double, meta_margin double, p_good double, accepted boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            zt, zm = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            if m:
                for i, t, meta in _views(batch):
                    zt[i] = m["text"][t].sum() + m["text"][-1]
                    zm[i] = m["meta"][meta].sum() + m["meta"][-1]
            p = 1 / (1 + np.exp(-np.clip(combined(zt, zm) @ m["mix"], -30, 30))) if m else np.full(batch.num_rows, 0.5)
            kept = [batch.column(0), *(batch.column(c) for c in range(4, batch.num_columns))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(zt), pa.array(zm), pa.array(p), pa.array(p >= 0.5)],
                                             ["doc_id", *(f"x{i}" for i in range(len(extra))), "text_margin", "meta_margin", "p_good", "accepted"])

    rows = pick(docs, DOC | extra).select(*DOC, *[F.col(c).alias(f"x{i}") for i, c in enumerate(extra)])
    schema = ", ".join(["doc_id long", *(f"x{i} {t}" for i, t in enumerate(extra.values())), out])
    return rows.mapInArrow(run, schema).withColumnsRenamed({f"x{i}": c for i, c in enumerate(extra)})


def good(docs: DataFrame, labels: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns of the documents that are accepted."""
    passed = {f"own_{c}": t for c, t in columns.items()}
    own = pick(docs, DOC | columns)
    own = own.select(*DOC, *[F.col(c).alias(f"own_{c}") for c in columns])
    return (classify(own, train(docs, labels), passed).where("accepted")
            .select(*[F.col(f"own_{c}").alias(c) for c in columns]))


def op5_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return classify(docs, train(docs, read(spark, sf_dir, "labels")))
