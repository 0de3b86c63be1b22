"""Near-duplicate detection by BagMinHash (operator 10).

A text is the multiset of its five-word shingles (all words as one shingle if
it has fewer).  Texts with equal multisets are one node.  BagMinHash draws, for
every shingle and unit of its count, points of a Poisson process; the units
above the first are reached through processes over intervals of units, halved
only while their first point can still matter.  The earliest point in each of
the signature's components is the same in two texts with the probability of
their weighted Jaccard similarity.  Nodes that share a band of components are
candidates; every link is decided by the exact multiset overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from churnscope.llm.shared import pick, read, written
from churnscope.llm.tokens import blocks, mix64, words

SHINGLE, LIKE = 5, 0.8
#: At similarity 0.8 all 32 bands differ with a chance of 3 in a million.
BANDS, ROWS = 32, 5
#: Bits of the filter that spares most texts the shuffle to the comparison.
FILTER_BITS = 24
#: Rare shingles kept with each one, to give a pair once.
BEFORE = 64
#: A node with more pairs than this is compared in so many places.
HOT_PAIRS, SALTS = 5000, 64
LAST = (1 << 63) - 1
_GOLD = np.uint64(0x9E3779B97F4A7C15)
DOC = {"doc_id": "long", "text": "string"}


def _combine(h: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(h[0]), np.uint64)
    for k, part in enumerate(h):
        out = mix64(out * np.uint64(31) + part + np.uint64(k + 1))
    return mix64(out + np.uint64(len(h)))


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of every distinct shingle, ordered by row and hash."""
    h, rows = words(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(rows, minlength=n)
    first = np.cumsum(count) - count
    hashes, owner = [], []
    if len(h) >= SHINGLE:
        whole = rows[SHINGLE - 1:] == rows[:len(rows) - SHINGLE + 1]
        at = np.flatnonzero(whole)
        hashes.append(_combine([h[at + k] for k in range(SHINGLE)]))
        owner.append(rows[at])
    for few in range(1, SHINGLE):
        short = np.flatnonzero(count == few)
        hashes.append(_combine([h[first[short] + k] for k in range(few)]))
        owner.append(short)
    s, o = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((s, o))
    s, o = s[order], o[order]
    new = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (o[1:] != o[:-1])]) if len(s) else np.zeros(0, int)
    return o[new], s[new], np.diff(np.r_[new, len(s)])


def _waits(seed: np.ndarray) -> np.ndarray:
    """Exponential waiting times of mean 1 from seeds."""
    return -np.log(((mix64(seed) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53)


def bag_min_hash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, size: int) -> np.ndarray:
    """Signatures (n x size) of n multisets given as rows of owner, element
    and integer weight.  Equal components are equal floating-point times."""
    best = np.full(n * size, np.inf)
    doc, w, lo, span, seed = [], [], [], [], []
    base, width = 0, 1
    left = np.arange(len(owner))
    while len(left):  # the intervals [0, 1), [1, 2), [2, 4), [4, 8) ... that the weight reaches into
        doc.append(owner[left])
        w.append(weight[left])
        lo.append(np.full(len(left), base))
        span.append(np.full(len(left), width))
        seed.append(mix64(element[left] + np.full(len(left), base + 1, np.uint64) * _GOLD))
        base, width = base + width, max(1, base + width)
        left = left[weight[left] > base]
    if not doc:
        return best.reshape(n, size)
    doc, w, lo, span, seed = map(np.concatenate, (doc, w, lo, span, seed))
    x = _waits(seed) / span
    step = np.zeros(len(doc), np.uint64)
    limit = np.full(n, np.inf)
    while len(doc):
        unit = span == 1
        d, s, t, at = doc[unit], seed[unit], step[unit], x[unit]
        many = int(min(64, max(1, 4096 // max(1, len(d)))))
        turn = t[:, None] + np.arange(many, dtype=np.uint64)
        odd = np.uint64(2) * turn + np.uint64(3)
        waits = _waits(s[:, None] + odd * _GOLD)  # from each point to the next
        times = np.cumsum(np.c_[at, waits], axis=1)  # in order, so that a point has one value in chunks of any length
        place = mix64(s[:, None] + (odd + np.uint64(1)) * _GOLD) % np.uint64(size)
        np.minimum.at(best, (d[:, None] * size + place.astype(np.int64)).ravel(), times[:, :-1].ravel())
        parts = [(d, w[unit], lo[unit], span[unit], s, times[:, -1], t + np.uint64(many))]
        if not unit.all():
            wide = ~unit
            d, ww, ll, half, s, at = doc[wide], w[wide], lo[wide], span[wide] // 2, seed[wide], x[wide]
            to_left = (mix64(s + np.uint64(5)) & np.uint64(1)) == 0
            for side in (0, 1):
                child = mix64(s ^ np.uint64(0xA5A5 + side))
                begin = at + np.where(to_left == (side == 0), 0.0, _waits(child) / half)
                reach = ll + side * half < ww
                parts.append((d[reach], ww[reach], (ll + side * half)[reach], half[reach], child[reach], begin[reach],
                              np.zeros(int(reach.sum()), np.uint64)))
        doc, w, lo, span, seed, x, step = map(np.concatenate, zip(*parts))
        live = np.unique(doc)
        limit[live] = best.reshape(n, size)[live].max(1)
        go = x <= limit[doc]
        doc, w, lo, span, seed, x, step = (v[go] for v in (doc, w, lo, span, seed, x, step))
    return best.reshape(n, size)


def _nodes(data: np.ndarray, offsets: np.ndarray, o: np.ndarray, s: np.ndarray, c: np.ndarray) -> list[bytes]:
    """128-bit digest of each row's multiset (of its bytes, if it has none)."""
    n = len(offsets) - 1
    item = mix64(s + c.astype(np.uint64) * _GOLD)
    out = np.zeros((n, 2), np.uint64)
    np.add.at(out[:, 0], o, item)
    np.add.at(out[:, 1], o, mix64(item ^ _GOLD))
    bare = np.bincount(o, minlength=n) == 0
    for i in np.flatnonzero(bare):
        raw = data[offsets[i]:offsets[i + 1]]
        h = mix64(np.array([int.from_bytes(raw[k:k + 8].tobytes(), "little") for k in range(0, len(raw), 8)] or [0], np.uint64))
        out[i] = [mix64(np.array([np.bitwise_xor.reduce(h * (2 * np.arange(len(h), dtype=np.uint64) + np.uint64(1)))]))[0], 0]
    return [r.tobytes() for r in out]


def _keyed(docs: DataFrame) -> DataFrame:
    return pick(docs, DOC).select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("ord"),
                                  F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")


def signed(docs: DataFrame) -> DataFrame:
    """For every row its node, number of shingles and band keys (written)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(3)):
                o, s, c = shingles(data, offsets)
                sig = bag_min_hash(o, s, c, j - i, BANDS * ROWS).view(np.uint64).reshape(j - i, BANDS, ROWS)
                key = np.zeros((j - i, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for k in range(ROWS):
                    key = mix64(key * np.uint64(31) + sig[:, :, k])
                total = np.bincount(o, c, j - i).astype(np.int64)
                bands = [list(k) if t else [] for k, t in zip(key.view(np.int64), total)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k)[i:j] for k in range(3)] + [pa.array(_nodes(data, offsets, o, s, c), pa.binary()),
                     pa.array(total), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "ord", "text_hash", "node", "n_shingles", "bands"])

    return written(_keyed(docs).mapInArrow(
        run, "doc_id long, ord long, text_hash long, node binary, n_shingles long, bands array<long>"), "signed")


def contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The shingle multisets of the wanted nodes (node, ord, text_hash), read
    from their first documents again.  A filter of fixed size keeps most other
    texts out of the shuffle."""
    sc = docs.sparkSession.sparkContext
    spot = F.pmod(F.xxhash64("ord", "text_hash"), F.lit(1 << FILTER_BITS))
    cells = wanted.select(spot.alias("spot")).groupBy(F.shiftright("spot", 5).alias("cell")).agg(
        F.expr("bit_or(shiftleft(1L, cast(spot & 31 as int)))").alias("mask"))
    got = cells.toPandas()
    masks = np.zeros(1 << FILTER_BITS - 5, np.uint32)
    masks[got["cell"]] = got["mask"]
    sent = sc.broadcast(masks)

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(3).to_numpy()
            hit = (sent.value[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(hit.astype(bool))) for k in range(3)],
                                             ["ord", "text_hash", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()  # repeated rows of a task's nodes
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(1)):
                o, s, c = shingles(data, offsets)
                cut = np.searchsorted(o, np.arange(j - i + 1))
                node, items, counts = [], [], []
                for k, name in enumerate(batch.column(0)[i:j].to_pylist()):
                    if name not in done:
                        done.add(name)
                        e = slice(cut[k], cut[k + 1])
                        node.append(name)
                        items.append(s[e].tobytes())
                        counts.append(c[e].astype(np.int32).tobytes() if (c[e] > 1).any() else b"")
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()) for v in (node, items, counts)], ["node", "items", "counts"])

    texts = _keyed(docs).select("ord", "text_hash", "text", spot.alias("spot")).mapInArrow(
        sieve, "ord long, text_hash long, text string")
    return written(texts.join(wanted, ["ord", "text_hash"]).select("node", "text")
                   .mapInArrow(run, "node binary, items binary, counts binary"), "contents")


def overlaps(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """Exact multiset Jaccard similarity of node pairs (a, b) (written)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = []
            for xi, xc, yi, yc in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                xi, yi = np.frombuffer(xi, np.uint64), np.frombuffer(yi, np.uint64)
                xc = np.frombuffer(xc, np.int32) if xc else np.ones(len(xi), np.int32)
                yc = np.frombuffer(yc, np.int32) if yc else np.ones(len(yi), np.int32)
                at = np.searchsorted(yi, xi)
                at[at == len(yi)] = 0
                both = yi[at] == xi
                inter = int(np.minimum(xc[both], yc[at[both]]).sum())
                like.append(inter / (int(xc.sum()) + int(yc.sum()) - inter))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(like, pa.float64())], ["a", "b", "like"])

    rows = pairs
    for side, other, items, counts in (("a", "b", "xi", "xc"), ("b", "a", "yi", "yc")):
        rows = _with_bags(rows, bags, side, other, items, counts)
    rows = rows.select("a", "b", "xi", "xc", "yi", "yc")
    return written(rows.mapInArrow(run, "a binary, b binary, like double"), "overlaps")


def _with_bags(pairs: DataFrame, bags: DataFrame, side: str, other: str, items: str, counts: str) -> DataFrame:
    """The bag of one side of each pair.  A node with many pairs, such as the
    centre of a large group, has its bag sent to SALTS places, and its pairs
    go to the place that the other node's hash says."""
    often = pairs.groupBy(side).agg(F.count("*").alias("n")).where(F.col("n") > HOT_PAIRS).select(F.col(side).alias("node"), F.lit(True).alias("hot"))
    often = F.broadcast(written(often, "hot-nodes"))  # at most one in HOT_PAIRS of the pairs, names only
    dealt = pairs.join(often.withColumnRenamed("node", side), side, "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.xxhash64(other), F.lit(SALTS))).otherwise(F.lit(0))).drop("hot")
    spread = bags.join(often, "node", "left").withColumn(
        "salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).select(
        F.col("node").alias(side), F.col("salt").cast("long").alias("salt"), F.col("items").alias(items), F.col("counts").alias(counts))
    return dealt.join(spread, [side, "salt"]).drop("salt")


def ordered(a: str, b: str) -> list:
    """A pair's nodes, smaller first."""
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node with an edge: comp is the least node that
    can be reached.  Labels take the least label next to them, then their
    label's own label, until nothing changes."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select(
        "node", F.least("node", "b").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("other"))
        stepped = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "other").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        new = written(stepped.join(jump, "comp", "left").select("node", "was", F.least("comp", F.coalesce("far", "comp")).alias("comp")), "labels")
        labels = new.select("node", "comp")
        if new.where("was <> comp").isEmpty():
            return labels


def rare_pairs(bags: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of the members (node, comp) of different classes that may be alike.

    Two bags of similarity 0.8 share a shingle among their rarest: any order
    of shingles leaves one in common in the first n - ceil(0.8 n) + 1 of both.
    Ordered by how many members have them, these are rarely shared by others.
    At the first shingle two members share, their overlap is at most what follows
    it in either; shingles that only one member has can't overlap.  A pair comes
    out at its first shared shingle only, told by the up to BEFORE shared ones
    before it; a pair whose first lies further back comes out more than once.
    Each occurrence of a shingle counts as a shingle of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, comp, items, counts in zip(*(batch.column(k).to_pylist() for k in range(4))):
                token = np.frombuffer(items, np.uint64)
                c = np.frombuffer(counts, np.int32) if counts else np.ones(len(token), np.int32)
                nth = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
                token = mix64(np.repeat(token, c) + nth.astype(np.uint64) * _GOLD)  # the same in bags with and without repeats
                n = len(token)
                yield pa.RecordBatch.from_arrays([pa.array([node] * n, pa.binary()), pa.array([comp] * n, pa.binary()),
                                                  pa.array(np.full(n, n)), pa.array(token.view(np.int64))], ["node", "comp", "n", "token"])

    tokens = written(bags.join(members, "node").select("node", "comp", "items", "counts")
                     .mapInArrow(run, "node binary, comp binary, n long, token long"), "tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("node")  # one document's shingles
    rarest = own.orderBy("df", "token")
    known = tokens.join(often, "token").withColumns({
        "at": F.row_number().over(rarest), "several": F.count("*").over(own)})
    first = F.col("n") - F.ceil(F.lit(LIKE) * F.col("n") - 1e-9) + 1
    head = known.where(F.col("n") - F.col("several") + F.col("at") <= first).withColumns({
        "before": F.collect_list("token").over(rarest.rowsBetween(-BEFORE, -1)),
        "most": F.col("several") - F.col("at") + 1})
    head = written(head.select("node", "comp", "n", "most", "token", "before"), "rare")
    return _holders_pairs(head)


def _holders_pairs(head: DataFrame) -> DataFrame:
    """Pairs of different classes at a token, from rows (node, comp, n, most,
    token, before).

    Whether two holders of a token can be alike depends on their numbers of
    shingles and what follows the token in them.  These combinations are
    joined first, so the holders of a token that many texts have meet only
    where a combination allows it.  At each token the class with most holders
    needs no pairs within itself: the others meet it and each other."""
    per_class = head.groupBy("token", "comp").agg(F.count("*").alias("holders"))
    big = per_class.groupBy("token").agg(F.max(F.struct("holders", "comp"))["comp"].alias("big"), F.count("*").alias("classes"))
    big = big.where("classes > 1").select("token", "big")
    head = written(head.join(big, "token").withColumn("is_big", F.col("comp") == F.col("big")).drop("big"), "holders")
    kinds = head.groupBy("token", "n", "most").agg(F.min("is_big").alias("all_big"))
    x, y = (kinds.select("token", *[F.col(k).alias(f"{c}_{k}") for k in ("n", "most", "all_big")]) for c in "xy")
    able = x.where("not x_all_big").join(y, "token").where(f"""least(x_n, y_n) >= {LIKE} * greatest(x_n, y_n) - 1e-9
        and least(x_most, y_most) >= {LIKE / (1 + LIKE)} * (x_n + y_n) - 1e-9""").select("token", "x_n", "x_most", "y_n", "y_most")
    x, y = (head.select("token", *[F.col(k).alias(f"{c}_{k}") for k in ("n", "most", "node", "comp", "before", "is_big")]) for c in "xy")
    rows = x.where("not x_is_big").join(able, ["token", "x_n", "x_most"]).join(y, ["token", "y_n", "y_most"])
    return rows.where("x_comp <> y_comp and (y_is_big or x_node < y_node) and not arrays_overlap(x_before, y_before)").select(
        *ordered("x_node", "y_node"))


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, comp) for the nodes with a link of similarity 0.8 or more.

    In every group of candidates all members are compared with one centre,
    the member with most candidates.  Those alike are settled.  A member less
    alike can only be alike to a settled one if its distance to the centre is
    at most twice the limit (Jaccard distance is a metric); such members and
    the settled ones, and members unlike their centre in groups that still hold
    several classes, are compared where they share a rare shingle, which
    misses no link.  Pairs within a class need no comparison."""
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    groups = written(keys.join(shared, "key"), "groups")
    degree = written(groups.groupBy("node").agg(F.sum("n").alias("degree")), "degree")
    groups = groups.join(degree, "node").select("key", "node", "degree")
    centre = groups.groupBy("key").agg(F.max(F.struct("degree", "node"))["node"].alias("centre"))
    star = written(groups.join(centre, "key").where("node <> centre").select("key", "node", "centre", *ordered("node", "centre")), "star")

    first = nodes.select("node", "first.ord", "first.text_hash")
    bags = contents(docs, first.join(degree, "node", "left_semi"))
    known = overlaps(star.select("a", "b").distinct(), bags)
    seen = written(star.join(known, ["a", "b"]).select("key", "node", "centre", "like"), "seen")
    comps = components(known.where(F.col("like") >= LIKE))

    def classed(df: DataFrame, column: str) -> DataFrame:
        named = comps.withColumnsRenamed({"node": column, "comp": f"{column}_comp"})
        return df.join(named, column, "left").withColumn(f"{column}_comp", F.coalesce(f"{column}_comp", column))

    unlike = seen.where(F.col("like") < LIKE)
    ring = classed(classed(unlike.where(F.col("like") >= 2 * LIKE - 1 - 1e-9), "node"), "centre")
    ring = written(ring.where("node_comp <> centre_comp").select("key", "node", F.col("node_comp").alias("comp")), "ring")
    settled = seen.where(F.col("like") >= LIKE).join(ring.select("key").distinct(), "key").select("key", "node")
    settled = classed(settled, "node").select("node", F.col("node_comp").alias("comp"))
    left = classed(unlike.select("key", "node"), "node")
    several = left.groupBy("key").agg(F.min("node_comp").alias("lo"), F.max("node_comp").alias("hi")).where("lo <> hi")
    members = left.join(several.select("key"), "key").select("node", F.col("node_comp").alias("comp"))
    members = written(members.unionByName(settled).unionByName(ring.select("node", "comp")).distinct(), "members")
    pairs = rare_pairs(bags, members).distinct().join(known, ["a", "b"], "left_anti")
    more = overlaps(pairs, bags).where(F.col("like") >= LIKE)
    joined = written(classed(classed(more, "a"), "b").select("a_comp", "b_comp"), "joined")
    merged = components(joined.select(*ordered("a_comp", "b_comp")))  # few classes: those that a later link joins
    joined = joined.select(F.explode(F.array("a_comp", "b_comp")).alias("node"))
    alone = joined.distinct().join(comps, "node", "left_anti").select("node", F.col("node").alias("comp"))
    least = merged.select(F.col("node").alias("comp"), F.col("comp").alias("least"))
    return comps.unionByName(alone).join(least, "comp", "left").select("node", F.coalesce("least", "comp").alias("comp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (the least doc_id of its
    class), ``class_size``, ``n_shingles``, ``kept`` (the class's first row by
    id and text hash), and the keys ``ord`` and ``text_hash``.

    Texts with equal shingle multisets are in one class, as are those linked
    by similarity 0.8 or more, directly or through others.  Texts without
    words (null or empty among them) are alike only if equal.  A null id ranks
    last; rows equal in id and text share a class and are all the first.  A
    text counts whole, however long; an empty table gives none.  Only
    ``doc_id`` and ``text``, by their exact names, are read."""
    rows = signed(docs)
    nodes = written(rows.groupBy("node").agg(F.min(F.struct("ord", "text_hash", "doc_id")).alias("first"),
                                             F.count("*").alias("copies"), F.any_value("bands").alias("bands")), "nodes")
    comps = links(docs, nodes)
    named = nodes.join(comps, "node", "left").select("node", "first", "copies", F.coalesce("comp", "node").alias("comp"))
    classes = named.groupBy("comp").agg(F.min("first").alias("head"), F.sum("copies").alias("class_size"))
    placed = written(named.select("node", "comp").join(classes, "comp").select("node", "head", "class_size"), "classes")
    return rows.join(placed, "node").select(
        "doc_id", F.col("head.doc_id").alias("class_id"), "class_size", "n_shingles",
        ((F.col("ord") == F.col("head.ord")) & (F.col("text_hash") == F.col("head.text_hash"))).alias("kept"), "ord", "text_hash")


def first_of_each(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns of one row of every class.  Rows equal in id and text
    are told apart only where a kept one has such rows."""
    keys = ["ord", "text_hash"]
    kept = written(near_duplicates(docs).where("kept").select(*keys), "kept")
    again = kept.groupBy(*keys).count().where("count > 1")
    rows = pick(docs, DOC | columns).withColumns({
        "ord": F.coalesce("doc_id", F.lit(LAST)), "text_hash": F.xxhash64(F.coalesce("text", F.lit("")))})
    rows = rows.join(kept, keys, "left_semi")
    return (rows if again.isEmpty() else rows.dropDuplicates(keys)).select(*columns)


def op10_bag_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("ord", "text_hash")
