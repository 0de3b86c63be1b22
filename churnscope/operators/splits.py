"""Exact stratified hold-out split.

Every row gets a 60-bit key from its customer ID and the seed.  Per class, the
rows with the greatest keys form the hold-out, exactly as many as the
stratified rule asks for.  The key at which a class is cut is found by counting
keys per class in ever finer ranges (4,096 counts a class and round, five
rounds): no sorting, no window over a class and no approximate quantile, so a
class with nearly all rows costs no more than any other.
"""

from __future__ import annotations

import math
from collections.abc import Hashable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.operators.ranks import numbered, write_again

# The key's hexadecimal digits and the bits told apart in a round.
KEY_DIGITS = 15
KEY_BITS = 60
ROUND_BITS = 12
#: More classes than this are no classes (their counts are kept on the driver).
MOST_CLASSES = 1000


def split_key(id_col: str = "CustomerID", seed: int = 42) -> Column:
    """The first 60 bits of md5(id#seed); a null id counts as empty text."""
    text = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f"#{seed}"))
    return F.conv(F.substring(F.md5(text), 1, KEY_DIGITS), 16, 10).cast("bigint")


def hold_out_counts(counts: dict[Hashable, int], test: float, seed: int) -> dict[Hashable, int]:
    """How many rows of each class are held out.

    All in all ``ceil(test * n)``.  The classes' training shares are rounded
    down and the rows still missing go to the largest remainders; equal
    remainders are drawn by a generator of the seed, classes in order."""
    n = sum(counts.values())
    n_train = n - math.ceil(test * n)
    labels = sorted(counts, key=lambda v: (v is None, v))
    exact = [counts[v] / n * n_train for v in labels] if n else []
    train = [math.floor(x) for x in exact]
    missing = n_train - sum(train)
    draw = np.random.RandomState(seed)
    for remainder in sorted({x - math.floor(x) for x in exact}, reverse=True):
        if missing <= 0:
            break
        alike = [i for i, x in enumerate(exact) if x - math.floor(x) == remainder]
        for i in draw.choice(alike, size=min(missing, len(alike)), replace=False):
            train[i] += 1
            missing -= 1
    return {v: counts[v] - t for v, t in zip(labels, train)}


def _is(label: str, value: Hashable) -> Column:
    return F.col(label).eqNullSafe(F.lit(value))


def cut_points(keys: DataFrame, label: str, wanted: dict[Hashable, int]) -> dict[Hashable, tuple[int, int, int]]:
    """Per class: the key of its ``wanted``-th row from the greatest key down,
    how many rows have a greater key, and how many have this one."""
    prefix = {v: 0 for v, n in wanted.items() if n > 0}
    greater = dict.fromkeys(prefix, 0)
    same: dict[Hashable, int] = {}
    for shift in range(KEY_BITS - ROUND_BITS, -1, -ROUND_BITS):
        inside = F.lit(False)
        for v in prefix:
            inside = inside | (_is(label, v) & (F.shiftright("_key", shift + ROUND_BITS) == F.lit(prefix[v])))
        by_class: dict[Hashable, dict[int, int]] = {}
        for v, part, n in (keys.where(inside).groupBy(label, F.shiftright("_key", shift).alias("_part"))
                           .agg(F.count(F.lit(1)).alias("n")).collect()):
            by_class.setdefault(v, {})[part] = n
        for v, parts in by_class.items():
            for part in sorted(parts, reverse=True):
                if greater[v] + parts[part] >= wanted[v]:
                    prefix[v], same[v] = part, parts[part]
                    break
                greater[v] += parts[part]
    return {v: (prefix[v], greater[v], same[v]) for v in prefix}


def stratified_split(df: DataFrame, test: float, seed: int, label: str = "target", id_col: str = "CustomerID") -> DataFrame:
    """Add ``is_test``: exactly as many rows of each class as :func:`hold_out_counts` says.

    Rows that share the key at which their class is cut (equal IDs) are told
    apart by a hash of the row; rows equal in all columns are alike, and as
    many of them as needed are held out.  A class of one row is no error; an
    empty table stays empty.
    """
    keyed = df.withColumn("_key", split_key(id_col, seed))
    keys = write_again(keyed.select(label, "_key"), "split-keys")
    counts = dict(tuple(r) for r in keys.groupBy(label).agg(F.count(F.lit(1))).limit(MOST_CLASSES + 1).collect())
    if len(counts) > MOST_CLASSES:
        raise ValueError(f"{label!r} has more than {MOST_CLASSES} classes")
    wanted = hold_out_counts(counts, test, seed)
    cuts = cut_points(keys, label, wanted)
    held, partly = F.lit(False), {}
    for v, (key, greater, same) in cuts.items():
        need = wanted[v] - greater
        held = held | (_is(label, v) & ((F.col("_key") >= F.lit(key)) if need == same else (F.col("_key") > F.lit(key))))
        if need < same:
            partly[v] = (key, need)
    out = keyed.withColumn("is_test", held)
    if not partly:
        return out.drop("_key")
    at_cut = F.lit(False)
    for v, (key, _) in partly.items():
        at_cut = at_cut | (_is(label, v) & (F.col("_key") == F.lit(key)))
    whole = out.where(~at_cut)
    for v, (key, need) in partly.items():
        tied = out.where(_is(label, v) & (F.col("_key") == F.lit(key))).drop("is_test")
        tied = numbered(tied, [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])], "_nth")
        whole = whole.unionByName(tied.withColumn("is_test", F.col("_nth") <= F.lit(need)).drop("_nth"))
    return whole.drop("_key")
