"""Personal data by candidate gradient boosting (operator 13), in DataFrame functions only.

Base patterns with their checks (address parts, Luhn, digit counts) give the
certain spans.  Two wide generators propose further, overlapping spans: any
number-like stretch and anything written around an at sign.  Each candidate
has small whole-number features of its format and its context, and none of
those that the checks look at.  Candidates that hold a certain span are the
positive examples; equal feature rows are counted over the whole corpus, and
boosted trees are grown on the counts, one grouped aggregate per tree level.
On a part held out, the trees' margins are calibrated per generator; a
candidate without a certain span is added where at least ``precision`` of the
candidates calibrated like it hold one.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from churnscope.llm.shared import pick, read, written

#: Base kinds in their order.  Written so that no pattern tries a stretch of
#: characters twice: a match starts where its stretch starts or the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?=[0-9](?:[ -]?[0-9]){11})[0-9]++(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"
#: Wide generators: kind given to an added span, and the candidates' pattern.
NUMBER = r"\+?(?<![0-9])[0-9(][0-9 ().-]{5,}[0-9]"
AROUND_AT = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?@ ?| ?[\[(](?i:at)[\])] ?)[A-Za-z0-9-]++"
             r"(?:(?:\.| ?[\[(](?i:dot)[\])] ?)[A-Za-z0-9-]++)*+")
WIDE = {"number": NUMBER, "address": AROUND_AT}
#: Words before a candidate that speak of personal data.
CUES = r"(?i)(?:phone|tel|call|mobile|fax|card|visa|account|mail|contact|write|reach|address|host|server|\bip)\W*\w*\W*$"
BEFORE, AFTER = 24, 8
#: Feature values are cut off here; trees ask whether a value is at most a bound.
TOP = 31
ROUNDS, DEPTH, RATE, RIDGE = 10, 3, 0.4, 1.0
PRECISION = 0.9
#: One candidate in so many is held out for the calibration, whose margins are counted in steps of 1 / STEPS.
HELD_OUT, STEPS, FAR = 4, 4, 40
DOC = {"doc_id": "long", "text": "string"}


def running_totals(lengths: Column) -> Column:
    """Sum of the array up to and with each place.  Totals are summed up in
    stretches of the square root of the length, as appending copies an array."""
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(lengths))).cast("int"))

    def along(values: Column, start: Column) -> Column:
        grown = F.aggregate(values, F.struct(start.alias("at"), F.array().cast("array<long>").alias("all")),
                            lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.array_append(acc["all"], acc["at"] + v).alias("all")))
        return grown["all"]

    stretch = F.transform(F.sequence(F.lit(0), step - 1), lambda j: F.slice(lengths, j * step + 1, step))
    sums = F.transform(stretch, lambda s: F.aggregate(s, F.lit(0).cast("long"), lambda a, v: a + v))
    starts = along(sums, F.lit(0).cast("long"))
    return F.flatten(F.transform(stretch, lambda s, j: along(s, F.coalesce(F.get(starts, j - 1), F.lit(0).cast("long")))))


def with_matches(df: DataFrame, pattern: str, needs: str, name: str) -> DataFrame:
    """Add ``name``: the pattern's leftmost matches as an array of their text,
    start and end in code points, and the text just before and after.

    The pieces between the matches and the matches themselves give the
    offsets.  Texts without the literal ``needs`` aren't searched."""
    hit = (F.contains("text", F.lit(needs)) if needs else F.lit(True)) & F.col("text").rlike(pattern)
    df = df.withColumn("_pieces", F.when(hit, F.split("text", pattern, -1)))
    df = df.withColumn("_hits", F.when(F.col("_pieces").isNotNull(), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    df = df.withColumn("_steps", F.zip_with("_pieces", "_hits", lambda p, h: (F.length(p) + F.coalesce(F.length(h), F.lit(0))).cast("long")))
    df = df.withColumn("_ends", F.when(F.col("_hits").isNotNull(), running_totals(F.col("_steps"))))
    found = F.transform("_hits", lambda h, i: F.struct(
        h.alias("hit"), (F.get(F.col("_ends"), i) - F.length(h)).alias("start"), F.get(F.col("_ends"), i).alias("end"),
        F.right(F.get(F.col("_pieces"), i), F.lit(BEFORE)).alias("before"),
        F.left(F.get(F.col("_pieces"), i + 1), F.lit(AFTER)).alias("after")))
    none = F.array().cast("array<struct<hit:string,start:bigint,end:bigint,before:string,after:string>>")
    return df.withColumn(name, F.coalesce(found, none)).drop("_pieces", "_hits", "_steps", "_ends")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Does a number of 20 digits at most pass the Luhn check?"""
    padded = F.lpad(number, 20, "0")

    def add(total: Column, i: Column) -> Column:
        d = F.substring(padded, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), add) % 10 == 0


def holds(kind: str, hit: Column) -> Column:
    """Does a base pattern's match pass its kind's check?"""
    if kind == "email":
        return hit.isNotNull()
    if kind == "ip":
        return hit.rlike(IP_PARTS)
    n = F.length(digits(hit))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(12, 19), luhn(digits(hit))).otherwise(F.lit(False))


def certain(hit: Column) -> Column:
    """Does a candidate's text hold a base span?"""
    out = F.lit(False)
    for kind, pattern in KINDS.items():
        out = out | F.exists(F.regexp_extract_all(hit, F.lit(pattern), F.lit(0)), partial(holds, kind))
    return out


def _count(c: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(c, drop, ""))


FEATURES = {
    "n_chars": lambda c: _count(c["hit"], r"\+"),
    "n_digits": lambda c: _count(c["hit"], "[^0-9]"),
    "n_letters": lambda c: _count(c["hit"], "[^A-Za-z]"),
    "n_groups": lambda c: F.size(F.regexp_extract_all(c["hit"], F.lit("[0-9]+"), F.lit(0))),
    "longest_group": lambda c: F.coalesce(F.array_max(F.transform(
        F.regexp_extract_all(c["hit"], F.lit("[0-9]+"), F.lit(0)), lambda g: F.length(g))), F.lit(0)),
    "n_dots": lambda c: _count(c["hit"], r"[^.]"),
    "n_dashes": lambda c: _count(c["hit"], r"[^-]"),
    "n_spaces": lambda c: _count(c["hit"], r"[^ ]"),
    "n_brackets": lambda c: _count(c["hit"], r"[^()\[\]]"),
    "glued_before": lambda c: c["before"].rlike(r"[\p{L}\p{N}_]$").cast("int"),
    "glued_after": lambda c: c["after"].rlike(r"^[\p{L}\p{N}_]").cast("int"),
    "quoted": lambda c: c["before"].rlike(r"[\"'=:/#]\s*$").cast("int"),
    "cue": lambda c: c["before"].rlike(CUES).cast("int"),
    "numbers_near": lambda c: _count(F.concat(c["before"], c["after"]), "[^0-9]"),
}


def candidates(df: DataFrame, kind: str) -> Column:
    """The wide generator's matches with their features; ``sure``: holds a base span."""
    return F.transform(f"_{kind}", lambda c: F.struct(
        F.lit(kind).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), certain(c["hit"]).alias("sure"),
        *[F.least(f(c), F.lit(TOP)).cast("int").alias(name) for name, f in FEATURES.items()]))


def spans(kind: str, at: int) -> Column:
    """The base kind's matches that pass their check."""
    sure = F.filter(f"_{kind}", lambda h: holds(kind, h["hit"]))
    return F.transform(sure, lambda h: F.struct(h["start"].alias("start"), F.lit(at).alias("at"), F.lit(kind).alias("kind"), h["end"].alias("end")))


def searched(docs: DataFrame) -> DataFrame:
    """``doc_id``, the certain spans and the candidates of every text, as a written table."""
    df = pick(docs, DOC).withColumn("text", F.coalesce("text", F.lit("")))
    for kind, pattern in KINDS.items():
        df = with_matches(df, pattern, {"email": "@", "phone": "+", "ip": "."}.get(kind, ""), f"_{kind}")
    df = df.select("doc_id", "text", F.array_sort(F.concat(*[spans(kind, at) for at, kind in enumerate(KINDS)])).alias("base"))
    df = with_matches(df, NUMBER, "", "_number")
    df = with_matches(df, AROUND_AT, "", "_address")
    return written(df.select("doc_id", "base", F.concat(*[candidates(df, kind) for kind in WIDE]).alias("wide")), "private")


# --------------------------------------------------------------------------
# Boosted trees on counted feature rows
# --------------------------------------------------------------------------

Tree = dict  # {"leaf": value} or {"feature": name, "bound": value, "below": Tree, "above": Tree}


def tree_value(tree: Tree, of) -> Column:
    """The tree as nested conditions; ``of`` gives a feature's column."""
    if "leaf" in tree:
        return F.lit(tree["leaf"])
    return F.when(of(tree["feature"]) <= F.lit(tree["bound"]), tree_value(tree["below"], of)).otherwise(tree_value(tree["above"], of))


def margin(model: dict, of) -> Column:
    out = F.lit(model["start"])
    for tree in model["trees"]:
        out = out + tree_value(tree, of)
    return out


def _grow(rows: DataFrame, depth: int) -> Tree:
    """One regression tree on the rows' gradients ``g`` and weights ``h``: every
    level is one grouped aggregate by node, feature and value."""
    root: Tree = {}
    open_nodes, where = [root], F.lit(0)
    pairs = ", ".join(f"'{f}', {f}" for f in FEATURES)
    for level in range(depth + 1):
        sums: dict[int, dict[str, dict[int, tuple[float, float]]]] = {}
        table = (rows.withColumn("node", where).where("node >= 0")
                 .selectExpr("node", "g", "h", f"stack({len(FEATURES)}, {pairs}) as (feature, value)")
                 .groupBy("node", "feature", "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h")))
        for r in table.collect():
            sums.setdefault(r.node, {}).setdefault(r.feature, {})[r.value] = (r.g, r.h)
        following, splits = [], []
        for i, node in enumerate(open_nodes):
            by = sums.get(i, {})
            some = next(iter(by.values()), {})
            G, H = sum(g for g, _ in some.values()), sum(h for _, h in some.values())
            best = None
            for feature in FEATURES if level < depth else ():
                gl = hl = 0.0
                values = sorted(by.get(feature, {}))
                for v in values[:-1]:
                    gl, hl = gl + by[feature][v][0], hl + by[feature][v][1]
                    gain = round(gl * gl / (hl + RIDGE) + (G - gl) ** 2 / (H - hl + RIDGE) - G * G / (H + RIDGE), 6)
                    if gain > 1e-3 and (best is None or gain > best[0]):
                        best = (gain, feature, v)
            if best is None:
                node["leaf"] = round(RATE * G / (H + RIDGE), 9)
                splits.append(None)
            else:
                node.update(feature=best[1], bound=best[2], below={}, above={})
                splits.append((best[1], best[2], len(following)))
                following += [node["below"], node["above"]]
        if not following:
            break
        step = F.lit(-1)
        for i, split in enumerate(splits):
            if split:
                feature, bound, at = split
                step = F.when(F.col("node") == i, F.when(F.col(feature) <= bound, F.lit(at)).otherwise(F.lit(at + 1))).otherwise(step)
        rows = rows.withColumn("node", where).withColumn("node", step)
        open_nodes, where = following, F.col("node")
    return root


def fit(counts: DataFrame) -> dict | None:
    """Boosted trees of the counted rows that aren't held out (``n`` rows,
    ``sure`` of them positive); None where only one class occurs."""
    train = counts.where("not held_out")
    n, sure = train.agg(F.sum("n"), F.sum("sure")).first()
    if not sure or sure == n:
        return None
    model = {"start": round(math.log(sure / (n - sure)), 9), "trees": []}
    for _ in range(ROUNDS):
        p = 1 / (1 + F.exp(-margin(model, F.col)))
        tree = _grow(train.withColumns({"g": F.col("sure") - F.col("n") * p, "h": F.col("n") * p * (1 - p)}), DEPTH)
        if tree.get("leaf") is not None:
            break
        model["trees"].append(tree)
    return model


def rising(points: list[tuple[int, int, int]]) -> list[tuple[int, float]]:
    """Isotonic calibration: for steps with rows and positives, the lowest step
    of each pooled stretch and its share of positives."""
    pooled: list[list[float]] = []
    for step, n, sure in sorted(points):
        pooled.append([step, n, sure])
        while len(pooled) > 1 and pooled[-2][2] * pooled[-1][1] >= pooled[-1][2] * pooled[-2][1]:
            _, m, s = pooled.pop()
            pooled[-1][1] += m
            pooled[-1][2] += s
    return [(int(step), sure / n) for step, n, sure in pooled]


def margin_step(m: Column) -> Column:
    return F.floor(F.greatest(F.least(m, F.lit(float(FAR))), F.lit(float(-FAR))) * STEPS).cast("int")


def thresholds(counts: DataFrame, model: dict | None, precision: float) -> dict[str, int]:
    """Per generator: the lowest step of the margin whose calibrated share of
    positives, on the candidates held out, reaches ``precision``."""
    if model is None:
        return {}
    steps: dict[str, list[tuple[int, int, int]]] = {}
    held = counts.where("held_out").withColumn("step", margin_step(margin(model, F.col)))
    for r in held.groupBy("kind", "step").agg(F.sum("n").alias("n"), F.sum("sure").alias("sure")).collect():
        steps.setdefault(r.kind, []).append((r.step, r.n, r.sure))
    return {kind: min(good) for kind, points in steps.items()
            if (good := [step for step, share in rising(points) if share >= precision])}


def find(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """Personal data in every text.

    Returns ``doc_id``, ``base`` (the certain spans: ``start``, ``at``: the
    kind's place among email, ip, card and phone, ``kind``, ``end``) and
    ``added`` (candidates chosen by the boosted trees, of kind ``number`` or
    ``address``; they hold no certain span but may overlap each other's
    edges).  Offsets are code points, ends exclusive; spans are in order of
    start and kind.

    Every candidate of the corpus counts in the fit; only counts by feature
    row, node and value reach the driver (some thousand numbers a tree level).
    Null and empty texts have no spans; texts of any length are searched
    whole; repeated rows, equal and null ids are rows of their own; without
    candidates of both classes nothing is added; an empty table gives none.
    Only ``doc_id`` and ``text``, by their exact names, are read."""
    found = searched(docs)
    held = F.pmod(F.xxhash64("doc_id", "c.start"), F.lit(HELD_OUT)) == 0
    counts = (found.select("doc_id", F.explode("wide").alias("c"))
              .select(F.col("c.kind"), *[F.col(f"c.{f}") for f in FEATURES], F.col("c.sure").cast("long").alias("yes"), held.alias("held_out"))
              .groupBy("kind", *FEATURES, "held_out").agg(F.count("*").alias("n"), F.sum("yes").alias("sure")))
    counts = written(counts, "private-counts")
    model = fit(counts)
    least = thresholds(counts, model, precision)

    def chosen(c: Column) -> Column:
        step = margin_step(margin(model, lambda f: c[f]))
        at_least = F.lit(None).cast("int")
        for kind, bound in least.items():
            at_least = F.when(c["kind"] == kind, F.lit(bound)).otherwise(at_least)
        return ~c["sure"] & F.coalesce(step >= at_least, F.lit(False))

    added = F.filter("wide", chosen) if least else F.filter("wide", lambda c: F.lit(False))
    order = {kind: len(KINDS) + i for i, kind in enumerate(WIDE)}
    place = lambda c: F.when(c["kind"] == "number", F.lit(order["number"])).otherwise(F.lit(order["address"]))
    return found.select("doc_id", "base", F.array_sort(F.transform(added, lambda c: F.struct(
        c["start"].alias("start"), place(c).alias("at"), c["kind"].alias("kind"), c["end"].alias("end")))).alias("added"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def _of_kind(kind: str, span: Column) -> Column:
    return span["kind"] == kind


def op13_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[F.size(F.filter("base", partial(_of_kind, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.array_sort(F.concat("base", "added"))).alias("spans"))
