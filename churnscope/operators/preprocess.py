"""Column mapping, cleaning, status flags and the coercion-loss report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.functions import churn_target, is_active, is_churned, month_bucket, parse_date
from churnscope.functions.cleaning import clean_columns, fits_long, int_text, money_text, parse_text
from churnscope.functions.status import STATUS_CLASS
from churnscope.roles import INT_ROLES, MONEY_ROLES, ROLES


class MappingError(ValueError):
    """A role could not be resolved to a column of the input table."""


def resolve_mapping(df: DataFrame, mapping: Mapping[str, str] | None = None) -> dict[str, str]:
    """Complete a role -> column mapping; roles left out map to the same-named column.

    Unlike a UI that silently falls back to the first column, an unresolved
    role is an error, raised once and up front (schema check on the driver).
    """
    mapping = dict(mapping or {})
    unknown = set(mapping) - set(ROLES)
    if unknown:
        raise MappingError(f"unknown roles: {sorted(unknown)}")
    cols = set(df.columns)
    if STATUS_CLASS in cols:
        raise MappingError(f"column name {STATUS_CLASS!r} is reserved for registered datasets")
    out = {}
    for role in ROLES:
        src = mapping.get(role, role)
        if src not in cols:
            raise MappingError(f"role {role!r}: column {src!r} not in {df.columns}")
        out[role] = src
    return out


def map_columns(df: DataFrame, mapping: Mapping[str, str] | None = None,
                keep_other: bool = True) -> DataFrame:
    """Rename physical columns to the eleven roles in one projection.

    Two roles may share one source column; each becomes its own output
    column, so cleaning one never changes the other.  Unmapped columns are
    kept after the roles unless ``keep_other`` is false; one that is named
    like a role filled from elsewhere gets ``__source`` after its name.
    """
    m = resolve_mapping(df, mapping)
    cols = [F.col(f"`{m[r]}`").alias(r) for r in ROLES]
    if keep_other:
        used = set(m.values())
        cols += [F.col(f"`{c}`").alias(f"{c}__source" if c in ROLES else c) for c in df.columns if c not in used]
    return df.select(*cols)


def clean_roles(df: DataFrame) -> DataFrame:
    """Coerce money and integer roles of a role-named frame (staged: text, parse, value)."""
    return clean_columns(df, money=MONEY_ROLES, ints=INT_ROLES)


def preprocess(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Map then clean: money roles -> double (bad -> 0.0), integer roles -> long (bad -> 0)."""
    return clean_roles(map_columns(df, mapping))


def with_status_flags(df: DataFrame, status: str = "Status") -> DataFrame:
    """Add ``is_active``, ``is_churned`` and the ML ``target``."""
    return df.withColumns({
        "is_active": is_active(status),
        "is_churned": is_churned(status),
        "target": churn_target(status),
    })


def with_month(df: DataFrame, date_col: str = "SignupDate", name: str = "signup_month",
               formats=None) -> DataFrame:
    return df.withColumn(name, month_bucket(date_col, formats))


def quality_report(raw: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Per numeric role (and the signup date): rows, null inputs, and non-null
    inputs silently coerced (numbers to zero, dates to the ``NaT`` month).

    One global aggregate (partial per task, then a single tiny merge) over the
    raw table, unpivoted to one row per role.
    """
    df = map_columns(raw, mapping, keep_other=False)
    roles = list(MONEY_ROLES) + list(INT_ROLES)
    # Stage text and parse in their own projections (one regex pass per value).
    df = df.withColumns({f"{r}__txt": (money_text(r) if r in MONEY_ROLES else int_text(r))
                         for r in roles})
    df = df.withColumns({f"{r}__num": parse_text(F.col(f"{r}__txt")) for r in roles})
    aggs = [F.count(F.lit(1)).alias("rows")]
    for r in roles:
        parsed = F.col(f"{r}__num")
        if r in INT_ROLES:
            parsed = F.when(fits_long(parsed), parsed)
        aggs.append(F.count_if(F.col(r).isNull()).alias(f"{r}__null"))
        aggs.append(F.count_if(F.col(r).isNotNull() & parsed.isNull()).alias(f"{r}__bad"))
    # Dates that cannot be parsed silently become the NaT month.
    aggs.append(F.count_if(F.col("SignupDate").isNull()).alias("SignupDate__null"))
    aggs.append(F.count_if(F.col("SignupDate").isNotNull() & parse_date("SignupDate").isNull())
                .alias("SignupDate__bad"))
    wide = df.agg(*aggs)
    reported = roles + ["SignupDate"]
    stack = ", ".join(f"'{r}', `{r}__null`, `{r}__bad`" for r in reported)
    return wide.selectExpr(
        "rows", f"stack({len(reported)}, {stack}) AS (role, null_count, coerced_count)")
