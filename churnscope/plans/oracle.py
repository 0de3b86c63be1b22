"""Independent ANSI-SQL (DuckDB) formulations of the registered queries.

Each string runs on the raw parquet views (``orders``, ``lineitem``, ...),
re-derives the subscriptions table and cleans it in SQL, so the oracle shares
no code path with the Spark operators.  Column names and types match the Spark
results; sums of doubles are exact on both sides.
"""

from __future__ import annotations

from churnscope.sources.subscriptions import subscriptions_sql

# The same number grammar and strip sets as ``functions.cleaning``,
# written for RE2 (whose ``\s`` is ASCII only, so Unicode spaces are listed).
_NUM = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INF = r"^[+-]?(inf|infinity)$"
_TRIM = r"^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$"
_MONEY = (r"[$,\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
          r"\x{202F}\x{205F}\x{3000}]")


def sql_parse(t: str) -> str:
    """pandas-style parse of text expression ``t`` (already trimmed) -> DOUBLE or NULL."""
    d = f"TRY_CAST({t} AS DOUBLE)"
    return (f"(CASE WHEN regexp_matches({t}, '{_NUM}') AND isfinite({d}) THEN {d} "
            f"WHEN regexp_matches(lower({t}), '{_INF}') THEN "
            f"(CASE WHEN starts_with({t}, '-') THEN CAST('-inf' AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END) END)")


def sql_money_text(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '{_MONEY}', '', 'g')"


def sql_int_text(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '{_TRIM}', '', 'g')"


def sql_money(x: str) -> str:
    return f"COALESCE({sql_parse(sql_money_text(x))}, 0.0)"


def sql_int(x: str) -> str:
    v = sql_parse(sql_int_text(x))
    return f"COALESCE(TRY_CAST(trunc(CASE WHEN {v} >= -9223372036854775808e0 AND {v} < 9223372036854775808e0 THEN {v} END) AS BIGINT), CAST(0 AS BIGINT))"


# Fixed value: 2^64, the part of one in which exact sums count.
_SCALE = "18446744073709551616e0"


def exact_sum(x: str, over: str = "") -> str:
    """The exact sum of doubles from 2^-11 up to 2^40: whole numbers of 2^-64."""
    return f"CAST(SUM(CAST(({x}) * {_SCALE} AS HUGEINT)) {over} AS DOUBLE) / {_SCALE}"


ACTIVE = "COALESCE(lower(Status) = 'active', false)"
CHURNED = "COALESCE(lower(Status) IN ('churned', 'inactive'), false)"
MONTH = "COALESCE(strftime(TRY_CAST(SignupDate AS TIMESTAMP), '%Y-%m'), 'NaT')"

BASE = f"""
WITH subscriptions AS ({subscriptions_sql()}),
clean AS (
  SELECT CustomerID, SignupDate, PlanType,
         {sql_money('MonthlyRevenue')} AS MonthlyRevenue,
         Status,
         {sql_int('TenureMonths')} AS TenureMonths,
         {sql_int('SupportTickets')} AS SupportTickets,
         {sql_int('UsageFrequency')} AS UsageFrequency,
         {sql_int('LastLoginDaysAgo')} AS LastLoginDaysAgo,
         {sql_money('LTV')} AS LTV,
         {sql_money('CAC')} AS CAC
  FROM subscriptions),
flagged AS (
  SELECT *, {ACTIVE} AS is_active, {CHURNED} AS is_churned,
         CAST(CASE WHEN {CHURNED} THEN 1.0 ELSE 0.0 END AS DOUBLE) AS target
  FROM clean)
"""


def with_base(body: str, extra_ctes: str = "") -> str:
    """A full oracle statement: shared CTEs, optional extra CTEs, then ``body``."""
    ctes = BASE.rstrip()
    if extra_ctes:
        ctes += ",\n" + extra_ctes.strip()
    return ctes + "\n" + body.strip() + "\n"
