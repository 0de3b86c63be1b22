"""Sharding by histogram sort (operator 9), in DataFrame functions only.

Rows get a 64-bit key: 32 bits of the text's hash, 16 bits of the id's hash,
and 16 bits of the hash of the row's place in the written table of sizes.
Equal texts are therefore neighbours, and rows equal in all columns can still
be told apart.  Rounds of exact histograms count
rows and bytes below candidate key boundaries (the edges of key prefixes);
a prefix in which a splitter falls is probed with longer prefixes until its
bytes meet the tolerance.  Then the rows are exchanged once, by prefix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from churnscope.llm.shared import TOPMOST, pick, read, written

#: Bits of the prefix in each round; 32 is a text's whole hash.
DEPTHS = (12, 20, 28, 32, 40, 48, 56, 64)


@dataclass(frozen=True)
class Leaf:
    """A key prefix of ``depth`` bits with its exact rows and bytes."""
    depth: int
    prefix: int
    rows: int
    bytes: int

    @property
    def first(self) -> int:
        return self.prefix << (64 - self.depth)


def _prefix(depth: int) -> Column:
    """The first bits of the key as an unsigned number; all 64 keep their sign."""
    return F.shiftrightunsigned("k", 64 - depth) if depth < 64 else F.col("k")


def _histogram(slim: DataFrame, depth: int, within: tuple[int, set[int]] | None = None) -> list[Leaf]:
    """Exact rows and bytes of each prefix, at most 2**12 in the first round
    and 2**8 for each probed prefix later; partial counts combine before the
    shuffle."""
    if within:
        slim = slim.where(_prefix(within[0]).isin(sorted(within[1])))
    got = slim.groupBy(_prefix(depth).alias("p")).agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()
    return [Leaf(depth, r.p & ((1 << depth) - 1), r.n, r.b) for r in got]


def splitters(slim: DataFrame, shards: int, tolerance: float) -> tuple[list[Leaf], list[int], dict[int, set[int]]]:
    """Leaves in key order, the shard of each, and the probed prefixes by depth.

    A leaf is probed again while a splitter falls inside it and its bytes
    exceed the tolerance, or while it holds over four times the mean rows
    (a large group of copies or of equal rows), unless it is one row or one
    whole key."""
    leaves = _histogram(slim, DEPTHS[0])
    total, rows = sum(x.bytes for x in leaves), sum(x.rows for x in leaves)
    most_rows = max(256, 4 * rows // (1 << DEPTHS[0]))
    probed: dict[int, set[int]] = {}
    for depth, deeper in zip(DEPTHS, DEPTHS[1:]):
        leaves.sort(key=lambda x: x.first)
        again, done = set(), 0
        for x in leaves:
            inside = any(done * shards < total * i < (done + x.bytes) * shards for i in range(1, shards))
            if x.depth == depth and x.rows > 1 and (
                    x.rows > most_rows or inside and x.bytes * shards > tolerance * total):
                again.add(x.prefix)
            done += x.bytes
        if not again:
            break
        probed[depth] = again
        leaves = [x for x in leaves if x.depth != depth or x.prefix not in again]
        leaves += _histogram(slim, deeper, (depth, again))
    leaves.sort(key=lambda x: x.first)
    shard, done, where = 0, 0, []
    for x in leaves:  # the splitter goes to the nearer edge of its leaf
        while shard < shards - 1 and (2 * done + x.bytes) * shards >= 2 * total * (shard + 1):
            shard += 1
        where.append(shard)
        done += x.bytes
    return leaves, where, probed


def shard_by_bytes(docs: DataFrame, shards: int = 8, tolerance: float = 0.002) -> DataFrame:
    """Assign every row a shard of near-equal bytes and a gapless slot in it.

    Size is the text's UTF-8 bytes plus 1; a null text has size 1 and the
    checksum of an empty one.  A group of equal texts stays in one shard unless
    its bytes exceed the tolerance where a splitter falls; so do rows equal in
    id and text, which are split by their place where they exceed it, else take
    neighbouring slots.  A null id sorts as any other value, an empty table
    gives no rows, further columns are ignored.  The driver sees counts of
    bounded number only.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    high = F.shiftleft(F.shiftright(F.xxhash64(text), 32), 32)
    of_id = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(TOPMOST))), 48), 16)
    slim = written(pick(docs, {"doc_id": "long", "text": "string"}).select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), high.bitwiseOR(of_id).alias("k")), "sizes")
    # The place in the written files is the same however often they are read.
    place = F.shiftrightunsigned(F.xxhash64("_metadata.file_name", "_metadata.row_index"), 48)
    slim = slim.select("doc_id", "size", "text_crc32", F.col("k").bitwiseOR(place).alias("k"))
    leaves, where, probed = splitters(slim, shards, tolerance)

    at, table = {}, []
    for no, (x, shard) in enumerate(zip(leaves, where)):
        signed = x.prefix - (1 << 64) if x.depth == 64 and x.prefix >= 1 << 63 else x.prefix
        table.append((x.depth, signed, shard, no, at.get(shard, 0)))
        at[shard] = at.get(shard, 0) + x.rows
    # at most 2**12 leaves and 2**8 for each probed prefix
    leaf = spark.createDataFrame(table, "depth int, prefix long, shard int, leaf int, base long")
    depth, prefix = F.lit(DEPTHS[0]), _prefix(DEPTHS[0])
    for d, deeper in zip(DEPTHS, DEPTHS[1:]):
        if d not in probed:
            break
        hit = (depth == d) & _prefix(d).isin([p for p in sorted(probed[d])])
        depth, prefix = F.when(hit, F.lit(deeper)).otherwise(depth), F.when(hit, _prefix(deeper)).otherwise(prefix)
    order = Window.partitionBy("leaf").orderBy(F.shiftright("k", 16).bitwiseXOR(F.lit(TOPMOST)), "doc_id", "text_crc32", "k")
    return (slim.withColumns({"depth": depth, "prefix": prefix}).join(F.broadcast(leaf), ["depth", "prefix"])
            .withColumn("slot", F.col("base") + F.row_number().over(order) - 1)
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))


def op9_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(read(spark, sf_dir, "documents"))
