"""Exact sums of doubles.

The sum of doubles depends on the order of the additions, so on the layout of
the table.  Here each double is cut into whole numbers that stand for fixed
powers of two: its exponent gives a bin of 16 binary places, and its 53 bits
give four numbers in that bin.  Whole numbers add up without error in any
order, partial sums per task and one merge; the sums of the bins are put
together once at the end, to the double next to the true sum.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Binary places of a bin and of a piece, and the bins of all finite doubles.
BIN_PLACES = 16
PIECE_PLACES = 18
FIRST_BIN, LAST_BIN = -68, 63
PIECES = ("p0", "p1", "p2", "p3")
#: Bins of what has no finite value.
INFINITE, MINUS_INFINITE, NOT_A_NUMBER = 1000, 1001, 1002
_STEP = 2 ** PIECE_PLACES


def _power(k: str) -> str:
    """2^(16 k) of a bin, exact; the lowest bin starts at the least double."""
    return f"pow(2D, greatest(({k}) * {BIN_PLACES}, -1074))"


def _with_pieces(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``bin`` and the pieces of column ``x``; zero and null have bin null."""
    keep = [f"`{c}`" for c in keep]
    df = df.selectExpr(*keep, "x", "CASE WHEN x <> 0 AND NOT isnan(x) AND abs(x) < double('inf') THEN abs(x) END AS size")
    df = df.selectExpr(*keep, "x", "size", "CASE WHEN size IS NOT NULL THEN "
                       f"least({LAST_BIN}, greatest({FIRST_BIN}, CAST(floor(log2(size) / {BIN_PLACES}) AS INT))) END AS near")
    # The logarithm may be off by one at an edge; the edge itself decides.
    df = df.selectExpr(*keep, "x", "size", f"CASE WHEN size < {_power('near')} AND near > {FIRST_BIN} THEN near - 1 "
                       f"WHEN near < {LAST_BIN} AND size >= {_power('near + 1')} THEN near + 1 ELSE near END AS near")
    df = df.selectExpr(*keep, "x", "near", f"size / {_power('near')} AS s")
    first, second = f"floor(s * {_STEP}D)", f"floor(s * {_STEP ** 2}D)"
    pieces = ("floor(s)", f"({first} - floor(s) * {_STEP})", f"({second} - {first} * {_STEP})",
              f"floor((s * {_STEP ** 2}D - {second}) * {_STEP}D)")
    return df.selectExpr(
        *keep, "x", f"coalesce(near, CASE WHEN isnan(x) THEN {NOT_A_NUMBER} WHEN x = double('inf') THEN {INFINITE} "
        f"WHEN x = double('-inf') THEN {MINUS_INFINITE} END) AS bin",
        *[f"coalesce({piece} * CASE WHEN x < 0 THEN -1 ELSE 1 END, 0L) AS {name}" for piece, name in zip(pieces, PIECES)])


def partial_sums(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], counts: Mapping[str, Column] | None = None) -> DataFrame:
    """Whole-number sums by key, measure and bin: a table that adds up further.

    ``sums`` are doubles (null counts as nothing), ``counts`` conditions whose
    true rows are counted.  Each row of the table becomes one row per measure,
    pre-aggregated in its task: a key's rows in a task leave it as one row per
    measure and bin in use (two or three for money)."""
    counts = dict(counts or {})
    flags, values = [f"c{j}" for j in range(len(counts))], [f"x{m}" for m in range(len(sums))]
    by = [F.col(f"`{k}`") for k in keys]
    staged = df.select(*by,
                       *[F.coalesce(c, F.lit(False)).cast("long").alias(f) for f, c in zip(flags, counts.values())],
                       *[x.cast("double").alias(v) for v, x in zip(values, sums.values())])
    flat = staged.unpivot([*by, *flags], values, "measure", "x")
    return _with_pieces(flat, [*keys, "measure", *flags]).groupBy(*by, "measure", "bin").agg(
        F.count("x").alias("n"), *[F.sum(p).alias(p) for p in PIECES], *[F.sum(f).alias(f) for f in flags])


def _total(cells: str) -> str:
    """The bins of one measure as one double; null where there is no value.

    From the highest bin down, each sum goes in as its upper and lower 32 bits
    (both exact as doubles), the rounding errors of the additions next to it."""
    terms = ", ".join(
        f"CASE WHEN b.{p} < 0 THEN -1D ELSE 1D END * {half} * {_power('b.bin')} * {2.0 ** (-PIECE_PLACES * i)!r}D{up}"
        for i, p in enumerate(PIECES)
        for half, up in ((f"shiftright(abs(b.{p}), 32)", " * 4294967296D"), (f"(abs(b.{p}) & 4294967295L)", "")))
    listed = (f"flatten(transform(sort_array(filter({cells}, b -> b.bin <= {LAST_BIN}), false), b -> array({terms})))")
    added = (f"aggregate({listed}, named_struct('s', 0D, 'c', 0D), (a, v) -> named_struct('s', a.s + v, "
             "'c', a.c + ((a.s - ((a.s + v) - ((a.s + v) - a.s))) + (v - ((a.s + v) - a.s)))), "
             # Past the greatest double the error term isn't a number.
             "a -> CASE WHEN abs(a.s) = double('inf') THEN a.s ELSE a.s + a.c END)")
    def has(k: int) -> str:
        return f"exists({cells}, b -> b.bin = {k})"

    return (f"CASE WHEN {has(NOT_A_NUMBER)} OR ({has(INFINITE)} AND {has(MINUS_INFINITE)}) THEN double('nan') "
            f"WHEN {has(INFINITE)} THEN double('inf') WHEN {has(MINUS_INFINITE)} THEN double('-inf') "
            f"WHEN {_values(cells)} > 0 THEN {added} END")


def _values(cells: str) -> str:
    return f"aggregate({cells}, 0L, (a, b) -> a + b.n)"


def combine(partials: DataFrame, keys: Sequence[str], sums: Sequence[str], counts: Sequence[str] = ()) -> DataFrame:
    """One row per key: each sum, ``<sum>_n`` (its values) and each count.

    ``keys`` may be some of the partial table's keys, or none: one row, also
    of an empty table."""
    by = [F.col(f"`{k}`") for k in keys]
    if list(keys) != partials.columns[:partials.columns.index("measure")]:
        partials = partials.groupBy(*by, "measure", "bin").agg(
            *[F.sum(c).alias(c) for c in ("n", *PIECES, *[f"c{j}" for j in range(len(counts))])])
    # Zeros and nulls stand in the bin that is null.
    cell = f"named_struct('bin', coalesce(bin, {FIRST_BIN}), 'n', n, " + ", ".join(f"'{p}', {p}" for p in PIECES) + ")"
    lists = [F.expr(f"collect_list(CASE WHEN measure = 'x{m}' THEN {cell} END) AS _m{m}") for m in range(len(sums))]
    # Every measure has all rows; the first one's are counted.
    flags = [F.expr(f"coalesce(sum(CASE WHEN measure = 'x0' THEN c{j} END), 0L) AS _c{j}") for j in range(len(counts))]
    rows = partials.groupBy(*by).agg(*lists, *flags)
    out = list(by)
    for m, name in enumerate(sums):
        out += [F.expr(_total(f"_m{m}")).alias(name), F.expr(_values(f"_m{m}")).alias(f"{name}_n")]
    return rows.select(*out, *[F.col(f"_c{j}").alias(name) for j, name in enumerate(counts)])


def exact_sums(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], counts: Mapping[str, Column] | None = None) -> DataFrame:
    """Sums and counts by key in one pass over the table; see :func:`combine`."""
    return combine(partial_sums(df, keys, sums, counts), keys, list(sums), list(counts or {}))
