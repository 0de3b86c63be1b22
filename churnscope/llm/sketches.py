"""Document fingerprints by invertible Bloom lookup sketches (operator 1),
in DataFrame functions only.

A text's paragraphs become 64-bit digests: 48 hash bits, 15 bits that check
them, and a last bit that names the side in a comparison.  A sketch has 3 x 8
cells of (count, xor of digests); each digest is in one cell of each third.
Sketches of two versions are subtracted cell by cell and peeled: a cell that
holds one digest gives it up, and it is taken from its other cells.  A peeling
that gets stuck is tried again larger: the digests are dealt by their leading
bits to a sketch each, with enough bits for a few digests in every sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from churnscope.llm.shared import TOPMOST, below, pick, read, written

#: A paragraph: a line, cut after a sentence's end once it has 120 characters.
PARAGRAPH = r"[^\n]{120,}?[.!?](?=\s)|[^\n]+"
PEEL_ROUNDS = 12
#: Digests of both sides for which one larger sketch is meant.
LOAD = 10
#: More differences than this are too many for the 24 cells of a fingerprint.
HOPELESS = 22


def paragraphs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))


def _check(k: Column) -> Column:
    """The 15 check bits (in place) that belong to a digest's 48 hash bits."""
    return F.shiftrightunsigned(F.xxhash64(k.bitwiseAND(F.lit(-0x10000))), 48).bitwiseAND(F.lit(0xFFFE))


def digests(text: Column) -> Column:
    """The set of the text's paragraph digests, side bit 0."""
    def one(p: Column) -> Column:
        h = F.xxhash64(p).bitwiseAND(F.lit(-0x10000))
        return h.bitwiseOR(_check(h))
    return F.array_distinct(F.transform(paragraphs(text), one))


#: Where the three cell numbers of a digest stand in it.
THIRDS = "array(16, 19, 22)"


def sketch(keys: str) -> str:
    """SQL for the 24 cells of the digests in ``keys``; side bit 1 counts -1."""
    return f"""flatten(transform({THIRDS}, s -> transform(sequence(0, 7), n -> transform(
        array(filter({keys}, k -> (shiftrightunsigned(k, s) & 7) = n)), m -> named_struct(
        'c', aggregate(m, 0L, (a, k) -> a + 1 - 2 * (k & 1)), 'x', aggregate(m, 0L, (a, k) -> a ^ (k & -2L))))[0])))"""


def peeled(cells: str) -> str:
    """SQL that peels cells: struct(cells, found), found = digests with side."""
    pure = """filter(transform(s.cells, (z, i) ->
        if((z.c = 1 or z.c = -1) and (z.x & 65535) = (shiftrightunsigned(xxhash64(z.x & -65536L), 48) & 65534)
           and (shiftrightunsigned(z.x, cast(16 + 3 * (i div 8) as int)) & 7) = i % 8,
           z.x | if(z.c = -1, 1L, 0L), null)), y -> y is not null)"""
    step = """named_struct('cells', if(size(f) = 0, s.cells, transform(s.cells, (z, i) -> aggregate(
        filter(f, k -> (shiftrightunsigned(k, cast(16 + 3 * (i div 8) as int)) & 7) = i % 8), z, (a, k) ->
           named_struct('c', a.c - 1 + 2 * (k & 1), 'x', a.x ^ (k & -2L))))),
        'found', concat(s.found, f), 'go', size(f) > 0)"""
    return f"""aggregate(sequence(1, {PEEL_ROUNDS}),
        named_struct('cells', {cells}, 'found', cast(array() as array<bigint>), 'go', true),
        (s, r) -> if(s.go, transform(array(array_distinct({pure})), f -> {step})[0], s))"""


def _tried(rows: DataFrame, cells: str) -> DataFrame:
    """Peel: adds ``found`` and ``ok`` (every cell came out empty)."""
    return rows.withColumn("peel", F.expr(peeled(cells))).withColumns({
        "found": F.expr("peel.found"), "ok": F.expr("forall(peel.cells, z -> z.c = 0 and z.x = 0)")}).drop("peel")


def _dealt(rows: DataFrame) -> DataFrame:
    """Sorted digests cut where their first ``bits`` bits change: one row each."""
    block = "shiftrightunsigned(keys[{}], 64 - bits)"
    starts = F.expr(f"filter(sequence(0, size(keys) - 1), i -> i = 0 or {block.format('i')} <> {block.format('i - 1')})")
    cut = F.expr("transform(starts, (b, j) -> slice(keys, b + 1, coalesce(get(starts, j + 1), size(keys)) - b))")
    return rows.withColumn("starts", starts).withColumn("keys", F.explode(cut)).drop("starts")


def differences(pairs: DataFrame) -> DataFrame:
    """Digests in which the two sides of each pair differ, recovered by peeling.

    ``pairs`` has ``id``, ``a`` and ``b`` (digest sets).  Returns ``id``,
    ``only_a`` and ``only_b`` counts.  The first try subtracts the 24-cell
    fingerprints; a pair whose peeling fails (or must fail, as its sets' sizes
    alone differ by nearly as much as there are cells) is tried again with as
    many sketches as its digests need, a sketch that fails with four in its
    place, until none is left.  Each try is a written table of what failed
    before."""
    merged = "array_sort(concat(a, transform(b, k -> k | 1L)))"
    hopeless = f"abs(size(a) - size(b)) > {HOPELESS}"
    # Cells that can't be peeled stand for a failure without being made.
    first = pairs.select("id", F.expr(merged).alias("keys"),
                         F.expr(f"if({hopeless}, array(named_struct('c', 2L, 'x', 0L)), zip_with({sketch('a')}, {sketch('b')}, (p, q) -> "
                                "named_struct('c', p.c - q.c, 'x', p.x ^ q.x)))").alias("cells"))
    tried = written(_tried(first, "cells").select("id", "found", "ok", F.when(~F.col("ok"), F.col("keys")).alias("keys")),
                    "peel")
    count = [F.expr("sum(size(filter(found, k -> k & 1 = 0)))").alias("only_a"),
             F.expr("sum(size(filter(found, k -> k & 1 = 1)))").alias("only_b")]
    parts = [tried.where("ok").groupBy("id").agg(*count)]
    stuck = tried.where(~F.col("ok")).select(
        "id", "keys", F.ceil(F.log2(F.greatest(F.size("keys") / LOAD, F.lit(2.0)))).cast("int").alias("bits"))
    while True:
        again = written(_tried(_dealt(stuck), sketch("keys")).select(
            "id", "bits", "found", "ok", F.when(~F.col("ok"), F.col("keys")).alias("keys")), "peel")
        parts.append(again.where("ok").groupBy("id").agg(*count))
        stuck = again.where(~F.col("ok")).select("id", "keys", F.least(F.col("bits") + 2, F.lit(60)).alias("bits"))
        if stuck.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.sum("only_a").alias("only_a"), F.sum("only_b").alias("only_b"))


def likeness(n_a: Column, n_b: Column, only_a: Column, only_b: Column) -> Column:
    """Jaccard likeness of two digest sets; two empty ones are alike."""
    both = (n_a + n_b - only_a - only_b) / 2
    return F.when(n_a + n_b == 0, 1.0).otherwise(both / (both + only_a + only_b)).cast("double")


def printed(cells: Column) -> Column:
    return F.concat_ws(" ", F.transform(cells, lambda z: F.concat(z["c"].cast("string"), F.lit(":"), F.hex(z["x"]))))


def with_next(docs: DataFrame) -> DataFrame:
    """Each row with the text that follows in descending id (after the last:
    the first), without a global window.

    Ids are dealt to ranges by their quantiles; an id with many rows has a
    range of its own, parted by text hash into as many as it needs.  A copy of
    the first row of each range goes to the end of the range before it, so
    that one shuffle gives every row its successor.  Equal ids follow each
    other by text hash; a null id comes last.  Rows equal in id and text stay
    in one range."""
    df = pick(docs, {"doc_id": "long", "text": "string"}).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("doc_id", F.lit(TOPMOST)).alias("ord")).withColumn("hash", F.xxhash64("text"))
    n = min(4096, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts, total = df.agg(F.percentile_approx("ord", [i / n for i in range(1, n)], 10 * n), F.count("*")).first()
    # Fewer than n ids have this many rows.
    many = {r.ord: r["count"] for r in df.groupBy("ord").count().where(F.col("count") > F.lit(max(2, 2 * total // n))).collect()}
    bounds = sorted({*(cuts or []), *many, *(h - 1 for h in many if h > TOPMOST)})
    pieces = {h: -(-c * n // total) for h, c in many.items()}
    share = F.shiftrightunsigned(F.col("hash").bitwiseXOR(F.lit(TOPMOST)), 32) / F.lit(float(1 << 32))
    by_id = F.create_map(*[F.lit(v).cast("long") for kv in pieces.items() for v in kv]) if pieces else None
    piece = F.coalesce(F.floor(share * F.try_element_at(by_id, F.col("ord"))), F.lit(0)) if pieces else F.lit(0)
    ranged = df.withColumns({"part": below(bounds, F.col("ord")).cast("int"), "piece": piece.cast("int")})
    # The first row of each range, in descending id and ascending text hash.
    heads = ranged.groupBy("part", "piece").agg(F.min_by(F.struct("ord", "hash"), F.struct(F.bitwise_not("ord"), "hash")).alias("head")).collect()
    order = sorted((-r.part, r.piece) for r in heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}  # of the first range: the last
    sent = df.sparkSession.createDataFrame(
        [(-before[-r.part, r.piece][0], before[-r.part, r.piece][1], r.head.ord, r.head.hash) for r in heads],
        "part int, piece int, ord long, hash long")
    ghosts = (df.join(F.broadcast(sent), ["ord", "hash"]).groupBy("part", "piece").agg(F.any_value("text").alias("text"))
              .select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("ord"), F.lit(0).cast("long").alias("hash"),
                      "part", "piece", F.lit(1).alias("ghost")))
    placed = ranged.select("doc_id", "text", "ord", "hash", "part", "piece", F.lit(0).alias("ghost")).unionByName(ghosts)
    win = Window.partitionBy("part", "piece").orderBy("ghost", F.desc("ord"), "hash")
    return placed.withColumn("next", F.lead("text").over(win)).where("ghost = 0").select("doc_id", "text", "next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint each text and its edited text, and compare them by peeling.

    Null counts as empty; a text without paragraphs has the empty sketch, and
    two such are alike (1).  Equal texts have equal fingerprints.  Rows with
    equal ids are separate rows.  A table of one row is followed by itself; an
    empty one gives no rows.  Further columns are ignored."""
    half = F.floor(F.length("text") / 2).cast("int")
    both = with_next(docs).withColumn("edited", F.concat(
        F.col("text").substr(F.lit(1), F.length("text") - half), F.col("next").substr(F.lit(1), half)))
    table = both.select(
        F.monotonically_increasing_id().alias("id"), "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("own"),
        digests(F.col("edited")).alias("changed"), digests(F.col("next")).alias("next"))
    table = written(table, "digests")
    pairs = table.select(F.explode(F.array(
        F.struct((F.col("id") * 2).alias("id"), F.col("own").alias("a"), F.col("changed").alias("b")),
        F.struct((F.col("id") * 2 + 1).alias("id"), F.col("own").alias("a"), F.col("next").alias("b")))).alias("p")).select("p.*")
    sides = [F.max(F.when(F.col("id") % 2 == s, F.col(c))).alias(f"{c}_{s}") for s in (0, 1) for c in ("only_a", "only_b")]
    diff = differences(pairs).groupBy(F.expr("shiftright(id, 1)").alias("id")).agg(*sides)
    n = {c: F.size(c) for c in ("own", "changed", "next")}
    return table.join(diff, "id").select(
        "doc_id", "n_chars", "edited_sha256",
        printed(F.expr(sketch("own"))).alias("fingerprint"), printed(F.expr(sketch("changed"))).alias("edited_fingerprint"),
        likeness(n["own"], n["changed"], F.col("only_a_0"), F.col("only_b_0")).alias("near_edited"),
        likeness(n["own"], n["next"], F.col("only_a_1"), F.col("only_b_1")).alias("near_next"),
        F.col("only_a_0").alias("paragraphs_lost"), F.col("only_b_0").alias("paragraphs_gained"))


def op1_paragraph_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
