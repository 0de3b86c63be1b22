"""Numeric coercion as native column expressions.

The cleaners reproduce pandas ``to_numeric(errors="coerce")`` followed by
``fillna(0)``: text that is not a plain decimal/scientific number (or an
infinity literal) becomes 0.  Spark's own string->double cast is more lenient
(``1d``, ``1f``, overflow to Infinity), so the accepted grammar is checked with
``rlike`` before ``try_cast``; everything stays JVM-side and codegen-friendly.

For whole tables use :func:`clean_columns`, which evaluates each regular
expression once per value: it stages text normalisation, parsing and
coercion in separate projections (Catalyst keeps a non-trivial expression
that is referenced several times in its own projection rather than
re-inlining it into every reference).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The number grammar pandas accepts after trimming ASCII
# whitespace, and the characters the money cleaner strips ($, comma, and any
# whitespace as Python's regex ``\s`` defines it, which also covers U+001C..1F).
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITY_PATTERN = r"^[+-]?(?i:inf|infinity)$"
ASCII_TRIM_PATTERN = r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$"
MONEY_STRIP_PATTERN = r"(?U)[$,\s\x1C-\x1F]"

# pandas' default missing-value tokens (read_csv ``na_values``).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

LONG_LIMIT = 2.0 ** 63  # a double fits a bigint from -2**63 up to below 2**63


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_text(c: Column | str) -> Column:
    """Text with every ``$``, ``,`` and whitespace character removed."""
    return F.regexp_replace(_col(c).cast("string"), MONEY_STRIP_PATTERN, "")


def int_text(c: Column | str) -> Column:
    """Text with leading/trailing ASCII whitespace removed."""
    return F.regexp_replace(_col(c).cast("string"), ASCII_TRIM_PATTERN, "")


def parse_text(t: Column) -> Column:
    """Parse normalised text the way pandas does; null where it would give NaN.

    Finite numbers, +/-Infinity for infinity literals, null for anything else
    (including NaN text and overflow).
    """
    num = t.try_cast("double")
    inf = F.when(F.startswith(t, F.lit("-")), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return (F.when(t.rlike(NUMBER_PATTERN) & ~F.isnan(num) & (F.abs(num) != F.lit(float("inf"))), num)
             .when(t.rlike(INFINITY_PATTERN), inf))


def parse_number(c: Column | str, trim: bool = True) -> Column:
    return parse_text(int_text(c) if trim else _col(c).cast("string"))


def money_value(parsed: Column) -> Column:
    return F.coalesce(parsed, F.lit(0.0))


def fits_long(parsed: Column) -> Column:
    return (parsed >= F.lit(-LONG_LIMIT)) & (parsed < F.lit(LONG_LIMIT))


def int_value(parsed: Column) -> Column:
    """Truncate toward zero; infinity and out-of-range values become 0."""
    finite = F.when(fits_long(parsed), parsed)
    return F.coalesce(finite.try_cast("long"), F.lit(0).cast("long"))


def clean_money(c: Column | str) -> Column:
    """Money cleaner: strip ``$``, ``,`` and whitespace, parse, else 0.0."""
    return money_value(parse_text(money_text(c)))


def clean_int(c: Column | str) -> Column:
    """Integer cleaner: parse without stripping, else 0, truncate to long.

    Infinity (which the reference cannot convert and fails on) and values
    outside the long range become 0 as well.
    """
    return int_value(parse_number(c))


def clean_columns(df: DataFrame, money: Iterable[str] = (), ints: Iterable[str] = ()) -> DataFrame:
    """Clean several columns in place with each regex evaluated once per value."""
    money, ints = list(money), list(ints)
    cols = money + ints
    if not cols:
        return df
    txt = {c: f"__txt_{c}" for c in cols}
    num = {c: f"__num_{c}" for c in cols}
    staged = df.withColumns({**{txt[c]: money_text(c) for c in money},
                             **{txt[c]: int_text(c) for c in ints}})
    staged = staged.withColumns({num[c]: parse_text(F.col(txt[c])) for c in cols})
    out = staged.withColumns({**{c: money_value(F.col(num[c])) for c in money},
                              **{c: int_value(F.col(num[c])) for c in ints}})
    return out.drop(*txt.values(), *num.values())


def is_invalid_number(raw: Column | str, money: bool) -> Column:
    """True where a non-null raw value was silently coerced to 0."""
    raw_c = _col(raw)
    if money:
        parsed = parse_text(money_text(raw_c))
    else:
        parsed = parse_number(raw_c)
        parsed = F.when(fits_long(parsed), parsed)
    return raw_c.isNotNull() & parsed.isNull()


def na_to_null(c: Column | str) -> Column:
    """Turn pandas' default NA tokens (exact match, no trimming) into null."""
    c = _col(c)
    return F.when(~c.isin(*NA_TOKENS), c)
