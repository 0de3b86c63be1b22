"""Registered queries: name -> (Spark plan builder, DuckDB oracle SQL or None).

Every query reads the driver's parquet tables of one scale-factor directory
(``orders`` and ``lineitem`` through the derived subscriptions table) and runs
over all of their rows.  Sums of doubles are exact in both engines (whole
numbers that add up without error), so nothing is rounded for the comparison.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.functions import (month_bucket, percent_text, retention_action, risk_band,
                                  risk_color)
from churnscope.functions.cleaning import NA_TOKENS, na_to_null
from churnscope.functions.labels import PROTOCOLS
from churnscope.operators import (charts, cohorts, date_formats, filters, forest, insights, kpis, ml, preprocess,
                                  profile, rejects, responses)
from churnscope.plans import oracle as O
from churnscope.roles import FEATURES, ROLES
from churnscope.session import checkpoint_dir
from churnscope.sources import export, models, quarantine, registry, search_index
from churnscope.sources.files import impute_mean, infer_types
from churnscope.sources.subscriptions import subscriptions
from churnscope.sources.tables import read_table, table_path


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql)
        return fn
    return deco


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscriptions(spark, sf_dir)


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.preprocess(raw(spark, sf_dir))


# --------------------------------------------------------------------------
# Sources, mapping and cleaning
# --------------------------------------------------------------------------

# Column order of the derived table as the oracle's DESCRIBE would list it.
SUBSCRIPTION_COLUMNS = ("CustomerID", "SignupDate", "PlanType", "MonthlyRevenue", "Status",
                        "TenureMonths", "UsageFrequency", "SupportTickets", "LastLoginDaysAgo",
                        "LTV", "CAC")


@register("profile", O.with_base(
    "SELECT CAST(COUNT(*) AS BIGINT) AS rows, CAST(11 AS BIGINT) AS n_columns, "
    f"'{','.join(SUBSCRIPTION_COLUMNS)}' AS columns FROM subscriptions"))
def q_profile(spark, sf_dir):
    return profile.profile(raw(spark, sf_dir))


@register("preview", O.with_base(
    "SELECT * FROM subscriptions ORDER BY CustomerID LIMIT 5"))
def q_preview(spark, sf_dir):
    return profile.preview(raw(spark, sf_dir), 5, "CustomerID")


@register("preview_files", "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderpriority "
          "FROM orders LIMIT 5")
def q_preview_files(spark, sf_dir):
    return profile.preview_files(spark, table_path(sf_dir, "orders"), 5).select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderpriority")


# Physical names of a differently-named upload, mapped back onto the roles.
PHYSICAL_NAMES = ("cust_id", "signup", "plan", "mrr", "status", "tenure", "tickets", "usage",
                  "last_login", "lifetime_value", "acq_cost")


@register("map_columns", O.with_base(
    "SELECT " + ", ".join(ROLES) + " FROM subscriptions"))
def q_map_columns(spark, sf_dir):
    r = raw(spark, sf_dir).select(*ROLES)
    upload = r.toDF(*PHYSICAL_NAMES)
    return preprocess.map_columns(upload, dict(zip(ROLES, PHYSICAL_NAMES)))


# An upload with malformed lines, written as text files from the orders.
RAGGED_HEADER = "CustomerID,PlanType,MonthlyRevenue"
_PLAN = "SUBSTR(o_orderpriority, 3)"
RAGGED_SQL = f"""
SELECT o_orderkey AS k, {_PLAN} AS plan, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR(20)) AS price,
       CASE WHEN o_orderkey % 83 = 0 THEN CONCAT('CUST-', CAST(o_orderkey AS VARCHAR(20)), ',', {_PLAN}, ',1,2')
            WHEN o_orderkey % 79 = 0 THEN CONCAT('CUST-', CAST(o_orderkey AS VARCHAR(20)), ',', {_PLAN})
            WHEN o_orderkey % 73 = 0 THEN CONCAT('CUST-', CAST(o_orderkey AS VARCHAR(20)), ',"', {_PLAN}, ',3')
            WHEN o_orderkey % 71 = 0 THEN CONCAT('CUST-', CAST(o_orderkey AS VARCHAR(20)), ',"', {_PLAN}, ', ""big"", new",N/A')
            ELSE CONCAT('CUST-', CAST(o_orderkey AS VARCHAR(20)), ',', {_PLAN}, ',', CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR(20)))
       END AS line
FROM {{orders}}
"""


def ragged_upload(spark, sf_dir) -> quarantine.Checked:
    path = os.path.join(checkpoint_dir(spark), "ragged", uuid.uuid4().hex)
    lines = spark.sql(RAGGED_SQL, orders=read_table(spark, sf_dir, "orders")).select(F.col("line").alias(RAGGED_HEADER))
    lines.write.option("header", True).option("sep", "\u0001").option("quote", "").option("escape", "").csv(path)
    return quarantine.read_checked(spark, path)


@register("ragged_upload", f"WITH r AS ({RAGGED_SQL.format(orders='orders')}) SELECT 'CUST-' || k AS CustomerID, "
          "CASE WHEN k % 79 <> 0 AND k % 71 = 0 THEN plan || ', \"big\", new' ELSE plan END AS PlanType, "
          "CASE WHEN k % 79 <> 0 AND k % 71 <> 0 THEN price END AS MonthlyRevenue "
          "FROM r WHERE k % 83 <> 0 AND (k % 79 = 0 OR k % 73 <> 0)")
def q_ragged_upload(spark, sf_dir):
    return ragged_upload(spark, sf_dir).data


@register("quarantine", f"WITH r AS ({RAGGED_SQL.format(orders='orders')}) SELECT line, "
          "CASE WHEN k % 83 = 0 THEN 'too many fields' WHEN k % 79 = 0 THEN 'too few fields' ELSE 'broken quotes' END AS reason, "
          "k % 83 <> 0 AND k % 79 = 0 AS in_data FROM r WHERE k % 83 = 0 OR k % 79 = 0 OR k % 73 = 0")
def q_quarantine(spark, sf_dir):
    return ragged_upload(spark, sf_dir).quarantine.select("line", "reason", "in_data")


@register("clean_money", O.with_base(
    "SELECT CustomerID, MonthlyRevenue, LTV, CAC FROM clean"))
def q_clean_money(spark, sf_dir):
    return cleaned(spark, sf_dir).select("CustomerID", "MonthlyRevenue", "LTV", "CAC")


@register("clean_int", O.with_base(
    "SELECT CustomerID, TenureMonths, SupportTickets, UsageFrequency, LastLoginDaysAgo FROM clean"))
def q_clean_int(spark, sf_dir):
    return cleaned(spark, sf_dir).select("CustomerID", "TenureMonths", "SupportTickets",
                                         "UsageFrequency", "LastLoginDaysAgo")


@register("preprocess", O.with_base("SELECT * FROM clean"))
def q_preprocess(spark, sf_dir):
    return cleaned(spark, sf_dir)


def _na_sql(c: str) -> str:
    toks = ", ".join("'" + t.replace("'", "''") + "'" for t in NA_TOKENS)
    return f"CASE WHEN {c} IN ({toks}) THEN NULL ELSE {c} END AS {c}"


# pandas-style typing of this table: Tenure (fractions, gaps) and Tickets
# (gaps) become double and are mean-filled, Usage and LastLogin stay integer,
# the rest is text.
IMPUTE_SQL = O.with_base(
    "SELECT CustomerID, SignupDate, PlanType, MonthlyRevenue, Status, "
    f"COALESCE(TenureMonths, {O.exact_sum('TenureMonths', 'OVER ()')} / COUNT(TenureMonths) OVER ()) AS TenureMonths, "
    f"UsageFrequency, COALESCE(SupportTickets, {O.exact_sum('SupportTickets', 'OVER ()')} / COUNT(SupportTickets) OVER ()) AS SupportTickets, "
    "LastLoginDaysAgo, LTV, CAC FROM typed",
    "na AS (SELECT " + ", ".join(_na_sql(c) for c in SUBSCRIPTION_COLUMNS) + " FROM subscriptions),\n"
    "typed AS (SELECT CustomerID, SignupDate, PlanType, MonthlyRevenue, Status, "
    "TRY_CAST(TenureMonths AS DOUBLE) AS TenureMonths, CAST(UsageFrequency AS BIGINT) AS UsageFrequency, "
    "TRY_CAST(SupportTickets AS DOUBLE) AS SupportTickets, "
    "CAST(LastLoginDaysAgo AS BIGINT) AS LastLoginDaysAgo, LTV, CAC FROM na)")


@register("impute_mean", IMPUTE_SQL)
def q_impute_mean(spark, sf_dir):
    r = raw(spark, sf_dir)
    typed, means = infer_types(r.select(*[na_to_null(c).alias(c) for c in r.columns]), with_means=True)
    return impute_mean(typed, means=means)


_QUALITY_ROLES = ("MonthlyRevenue", "LTV", "CAC", "TenureMonths", "SupportTickets",
                  "UsageFrequency", "LastLoginDaysAgo")


def _quality_sql() -> str:
    parts = []
    for r in _QUALITY_ROLES:
        text = O.sql_money_text(r) if r in ("MonthlyRevenue", "LTV", "CAC") else O.sql_int_text(r)
        parsed = O.sql_parse(text)
        if r not in ("MonthlyRevenue", "LTV", "CAC"):
            parsed = f"(CASE WHEN {parsed} >= -9223372036854775808e0 AND {parsed} < 9223372036854775808e0 THEN {parsed} END)"
        parts.append(
            f"SELECT '{r}' AS role, "
            f"CAST(SUM(CASE WHEN {r} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_count, "
            f"CAST(SUM(CASE WHEN {r} IS NOT NULL AND {parsed} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS coerced_count "
            f"FROM subscriptions")
    parts.append(
        "SELECT 'SignupDate' AS role, "
        "CAST(SUM(CASE WHEN SignupDate IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_count, "
        "CAST(SUM(CASE WHEN SignupDate IS NOT NULL AND TRY_CAST(SignupDate AS TIMESTAMP) IS NULL "
        "THEN 1 ELSE 0 END) AS BIGINT) AS coerced_count FROM subscriptions")
    body = ("SELECT (SELECT CAST(COUNT(*) AS BIGINT) FROM subscriptions) AS rows, q.* FROM ("
            + " UNION ALL ".join(parts) + ") q")
    return O.with_base(body)


@register("quality_report", _quality_sql())
def q_quality_report(spark, sf_dir):
    return preprocess.quality_report(raw(spark, sf_dir))


# More kinds of bad texts than the table has by itself.
_APPROX = "CASE WHEN CAST(LastLoginDaysAgo AS INT) < 20 THEN CONCAT('approx ', UsageFrequency, ' k') ELSE MonthlyRevenue END"
_MONTHS = "CASE WHEN CAST(LastLoginDaysAgo AS INT) % 7 = 0 THEN CONCAT(LastLoginDaysAgo, ' months') ELSE TenureMonths END"


def _rejected_sql() -> str:
    parts = []
    for r in _QUALITY_ROLES:
        money = r in ("MonthlyRevenue", "LTV", "CAC")
        parsed = O.sql_parse(O.sql_money_text(r) if money else O.sql_int_text(r))
        if not money:
            parsed = f"(CASE WHEN {parsed} >= -9223372036854775808e0 AND {parsed} < 9223372036854775808e0 THEN {parsed} END)"
        parts.append(f"SELECT '{r}' AS role, {r} AS text FROM worse WHERE {r} IS NOT NULL AND {parsed} IS NULL")
    parts.append("SELECT 'SignupDate', SignupDate FROM worse WHERE SignupDate IS NOT NULL AND TRY_CAST(SignupDate AS TIMESTAMP) IS NULL")
    return O.with_base(
        "SELECT role, text, n AS count, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY role ORDER BY n DESC, text) AS rank "
        f"FROM (SELECT role, text, COUNT(*) AS n FROM ({' UNION ALL '.join(parts)}) t GROUP BY ALL) c) r WHERE rank <= 10",
        f"worse AS (SELECT * REPLACE ({_APPROX} AS MonthlyRevenue, {_MONTHS} AS TenureMonths) FROM subscriptions)")


@register("rejected_texts", _rejected_sql())
def q_rejected_texts(spark, sf_dir):
    worse = raw(spark, sf_dir).withColumns({"MonthlyRevenue": F.expr(_APPROX), "TenureMonths": F.expr(_MONTHS)})
    return rejects.rejected_texts(worse, k=10)


@register("status_flags", O.with_base(
    "SELECT CustomerID, Status, is_active, is_churned, target FROM flagged"))
def q_status_flags(spark, sf_dir):
    return (preprocess.with_status_flags(cleaned(spark, sf_dir))
            .select("CustomerID", "Status", "is_active", "is_churned", "target"))


@register("month_bucket", O.with_base(
    f"SELECT CustomerID, SignupDate, {O.MONTH} AS signup_month FROM clean"))
def q_month_bucket(spark, sf_dir):
    return cleaned(spark, sf_dir).select("CustomerID", "SignupDate",
                                         month_bucket("SignupDate").alias("signup_month"))


# The same dates written as other uploads would have them; the one text runs in
# both engines.  ``us_few`` has days up to 12 only, so its order can't be told.
_D, _M = "LPAD(CAST(DAY(d) AS VARCHAR(2)), 2, '0')", "LPAD(CAST(MONTH(d) AS VARCHAR(2)), 2, '0')"
_Y, _DAY = "CAST(YEAR(d) AS VARCHAR(4))", "CAST(DAY(d) AS VARCHAR(2))"
_NAME = "SUBSTR('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * CAST(MONTH(d) AS INT) - 2, 3)"
DATED_SQL = f"""
SELECT k AS CustomerID, d,
       CASE WHEN k % 97 = 0 THEN 'unknown' ELSE CONCAT({_M}, '/', {_D}, '/', {_Y}) END AS us,
       CASE WHEN k % 89 = 0 THEN NULL ELSE CONCAT({_D}, '.', {_M}, '.', {_Y}, ' 10:30') END AS eu,
       CASE WHEN k % 50 = 0 THEN CONCAT({_D}, '/', {_M}, '/', {_Y}) ELSE CONCAT({_M}, '/', {_D}, '/', {_Y}) END AS us_some_eu,
       CASE WHEN DAY(d) <= 12 THEN CONCAT({_M}, '/', {_D}, '/', {_Y}) END AS us_few,
       CONCAT({_Y}, '/', {_M}, '/', {_D}) AS slashes,
       CASE WHEN k % 53 = 0 THEN 'Foo 1, 2020' ELSE CONCAT({_NAME}, ' ', {_DAY}, ', ', {_Y}) END AS named,
       CONCAT({_DAY}, '-', {_NAME}, '-', {_Y}) AS day_named,
       CONCAT({_D}, '/', {_M}, '/', SUBSTR({_Y}, 3, 2)) AS short,
       CASE WHEN k % 71 = 0 THEN CONCAT({_M}, '/', {_D}, '/', {_Y}) ELSE SUBSTR(CAST(d AS VARCHAR(30)), 1, 10) END AS iso,
       'none' AS never
FROM (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM {{orders}}) o
"""
DATED_COLUMNS = ("us", "eu", "us_some_eu", "us_few", "slashes", "named", "day_named", "short", "iso", "never")


def dated(spark, sf_dir) -> DataFrame:
    return spark.sql(DATED_SQL, orders=read_table(spark, sf_dir, "orders"))


# DuckDB's reading of each format: the shape, then the formats it may stand for.
_TIMES = ("", " %H:%M")
_STRPTIME = {
    "iso": (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", ["%Y-%m-%d"]),
    "year/month/day": (r"^[0-9]{4}[/.]", ["%Y/%m/%d"]),
    "month/day/year": (r"^[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4}", ["%m/%d/%Y", "%m.%d.%Y"]),
    "day/month/year": (r"^[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4}", ["%d/%m/%Y", "%d.%m.%Y"]),
    "month/day/yy": (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$", ["%m/%d/%y"]),
    "day/month/yy": (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$", ["%d/%m/%y"]),
    "month day, year": (r"^[A-Z][a-z]{2} ", ["%b %d, %Y"]),
    "day month year": (r"^[0-9]{1,2}-[A-Z]", ["%d-%b-%Y"]),
}


def _reads_sql(fmt: str, x: str = "x") -> str:
    shape, forms = _STRPTIME[fmt]
    listed = ", ".join(f"'{f}{t}'" for f in forms for t in _TIMES)
    return f"(regexp_matches({x}, '{shape}') AND TRY_STRPTIME({x}, [{listed}]) IS NOT NULL)"


def _date_formats_sql() -> str:
    values = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS x FROM dated" for c in DATED_COLUMNS)
    parts = []
    for place, fmt in enumerate(_STRPTIME):
        rival = date_formats.RIVALS.get(fmt)
        reads, other = _reads_sql(fmt), _reads_sql(rival) if rival else "false"
        parts.append(f"SELECT \"column\", {place} AS place, '{fmt}' AS format, COUNT(x) AS present, COUNT(*) FILTER (WHERE {reads}) AS parsed, "
                     f"COUNT(*) FILTER (WHERE {other}) AS rival_parsed, COUNT(*) FILTER (WHERE {other} AND NOT {reads}) AS rival_only "
                     "FROM vals GROUP BY 1")
    return (f"WITH dated AS ({DATED_SQL.format(orders='orders')}), vals AS ({values}), counts AS ({' UNION ALL '.join(parts)}), "
            "picked AS (SELECT *, parsed > 0 AND ROW_NUMBER() OVER (PARTITION BY \"column\" ORDER BY parsed DESC, place) = 1 AS chosen FROM counts) "
            "SELECT \"column\", format, present, parsed, rival_parsed, rival_only, chosen, "
            "chosen AND parsed = rival_parsed AS ambiguous FROM picked")


@register("date_formats", _date_formats_sql())
def q_date_formats(spark, sf_dir):
    return date_formats.date_formats(dated(spark, sf_dir), DATED_COLUMNS)


# Months by each column's inferred format, against the date they were written from.
_MONTH_OF = "strftime(d, '%Y-%m')"


@register("months_by_format", f"WITH dated AS ({DATED_SQL.format(orders='orders')}) SELECT CustomerID, "
          f"CASE WHEN us = 'unknown' THEN 'NaT' ELSE {_MONTH_OF} END AS us, CASE WHEN eu IS NULL THEN 'NaT' ELSE {_MONTH_OF} END AS eu, "
          f"COALESCE(strftime(TRY_STRPTIME(us_some_eu, '%m/%d/%Y'), '%Y-%m'), 'NaT') AS us_some_eu, "
          f"CASE WHEN us_few IS NULL THEN 'NaT' ELSE {_MONTH_OF} END AS us_few, {_MONTH_OF} AS slashes, "
          f"CASE WHEN named LIKE 'Foo%' THEN 'NaT' ELSE {_MONTH_OF} END AS named, {_MONTH_OF} AS day_named, {_MONTH_OF} AS short, "
          f"CASE WHEN iso LIKE '%/%' THEN 'NaT' ELSE {_MONTH_OF} END AS iso, 'NaT' AS never FROM dated")
def q_months_by_format(spark, sf_dir):
    upload = dated(spark, sf_dir)
    formats = date_formats.infer_date_formats(upload, DATED_COLUMNS)
    return upload.select("CustomerID", *[month_bucket(c, formats[c]).alias(c) for c in DATED_COLUMNS])


# --------------------------------------------------------------------------
# Filters
# --------------------------------------------------------------------------

@register("active_filter", O.with_base(f"SELECT * FROM clean WHERE {O.ACTIVE}"))
def q_active_filter(spark, sf_dir):
    return filters.active_filter(cleaned(spark, sf_dir))


@register("churned_filter", O.with_base(f"SELECT * FROM clean WHERE {O.CHURNED}"))
def q_churned_filter(spark, sf_dir):
    return filters.churned_filter(cleaned(spark, sf_dir))


SEARCH_TERM = "cust-42"


def indexed(spark, sf_dir) -> str:
    """The cleaned customers, written with their search index (small blocks, as the tables are)."""
    path = os.path.join(checkpoint_dir(spark), "indexed", uuid.uuid4().hex)
    search_index.write_indexed(cleaned(spark, sf_dir), path, block_rows=500)
    return path


LITERAL_TERM = "T-123"


@register("id_search_indexed", O.with_base(
    f"SELECT * FROM clean WHERE regexp_matches(CustomerID, '(?i)cust-42[0-9]+$')"))
def q_id_search_indexed(spark, sf_dir):
    return search_index.search(spark, indexed(spark, sf_dir), "cust-42[0-9]+$").rows


@register("id_search_literal", O.with_base(
    f"SELECT * FROM clean WHERE contains(lower(CustomerID), lower('{LITERAL_TERM}'))"))
def q_id_search_literal(spark, sf_dir):
    return search_index.search(spark, indexed(spark, sf_dir), LITERAL_TERM, literal=True).rows


@register("id_search", O.with_base(
    f"SELECT * FROM clean WHERE regexp_matches(CustomerID, '(?i){SEARCH_TERM}')"))
def q_id_search(spark, sf_dir):
    return filters.id_search(cleaned(spark, sf_dir), SEARCH_TERM)


# --------------------------------------------------------------------------
# KPIs and charts
# --------------------------------------------------------------------------

KPI_SQL_BODY = """
SELECT latest_mrr, latest_mrr * 12 AS latest_arr, arpu, active_count, total_customers,
       CASE WHEN total_customers > 0 THEN churn_count / total_customers * 100.0 ELSE 0.0 END AS logo_churn_rate,
       CASE WHEN latest_mrr + lost_mrr > 0 THEN lost_mrr / (latest_mrr + lost_mrr) * 100.0 ELSE 0.0 END AS revenue_churn_rate,
       avg_ltv, avg_cac, CASE WHEN avg_cac > 0 THEN avg_ltv / avg_cac ELSE 0.0 END AS ltv_cac_ratio
FROM kpi_base
"""

def kpi_cte(table: str = "flagged", by: str = "") -> str:
    """The sums of the KPIs as ``kpi_base``, of all rows or by a column."""
    return f"""
kpi_base AS (
  SELECT {by + ', ' if by else ''}CAST(COUNT(*) AS BIGINT) AS total_customers,
         CAST(SUM(CASE WHEN is_active THEN 1 ELSE 0 END) AS BIGINT) AS active_count,
         CAST(SUM(CASE WHEN is_churned THEN 1 ELSE 0 END) AS BIGINT) AS churn_count,
         COALESCE({O.exact_sum('CASE WHEN is_active THEN MonthlyRevenue END')}, 0.0) AS latest_mrr,
         COALESCE({O.exact_sum('CASE WHEN is_active THEN MonthlyRevenue END')}
                  / COUNT(CASE WHEN is_active THEN MonthlyRevenue END), 0.0) AS arpu,
         COALESCE({O.exact_sum('CASE WHEN is_churned THEN MonthlyRevenue END')}, 0.0) AS lost_mrr,
         CASE WHEN COUNT(*) > 0 THEN {O.exact_sum('LTV')} / COUNT(LTV) ELSE 0.0 END AS avg_ltv,
         CASE WHEN COUNT(*) > 0 THEN {O.exact_sum('CAC')} / COUNT(CAC) ELSE 1.0 END AS avg_cac
  FROM {table}{' GROUP BY ' + by if by else ''})
"""


KPI_CTE = kpi_cte()


def kpi_row(spark, sf_dir) -> DataFrame:
    return kpis.kpis(cleaned(spark, sf_dir))


@register("kpis", O.with_base(KPI_SQL_BODY, KPI_CTE))
def q_kpis(spark, sf_dir):
    return kpi_row(spark, sf_dir)


@register("registered_kpis", O.with_base(KPI_SQL_BODY, KPI_CTE))
def q_registered_kpis(spark, sf_dir):
    """The KPIs of a dataset that was uploaded twice: the second upload, derived
    from the first one, is the owner's current dataset."""
    owner = f"kpis-{uuid.uuid4().hex}"
    first = registry.register_dataset(spark, cleaned(spark, sf_dir).withColumn("MonthlyRevenue", F.col("MonthlyRevenue") * 2), owner=owner)
    registry.register_dataset(spark, first.withColumn("MonthlyRevenue", F.col("MonthlyRevenue") / 2), owner=owner, by_status=True)
    return kpis.kpis(registry.get_dataset(spark, owner=owner))


@register("exported_plans", O.with_base(
    f"SELECT PlanType AS label, {O.exact_sum('MonthlyRevenue')} AS revenue, CAST(COUNT(*) AS BIGINT) AS users "
    "FROM clean WHERE PlanType IS NOT NULL GROUP BY PlanType"))
def q_exported_plans(spark, sf_dir):
    """The plan chart's records as a client reads them from the exported JSON."""
    path = export.export(charts.plan_distribution(cleaned(spark, sf_dir)),
                         os.path.join(checkpoint_dir(spark), "exports", uuid.uuid4().hex), single_file=True)
    return spark.read.schema("label string, revenue double, users bigint").json(path)


@register("plan_distribution", O.with_base(
    f"SELECT PlanType AS label, {O.exact_sum('MonthlyRevenue')} AS revenue, "
    "CAST(COUNT(*) AS BIGINT) AS users FROM clean WHERE PlanType IS NOT NULL "
    "GROUP BY PlanType ORDER BY label"))
def q_plan_distribution(spark, sf_dir):
    return charts.plan_distribution(cleaned(spark, sf_dir))


@register("plan_revenue_share", O.with_base(
    "SELECT label, revenue, users, CASE WHEN total <> 0 THEN revenue / total ELSE 0.0 END AS share "
    f"FROM (SELECT *, {O.exact_sum('revenue', 'OVER ()')} AS total "
    f"FROM (SELECT PlanType AS label, {O.exact_sum('MonthlyRevenue')} AS revenue, CAST(COUNT(*) AS BIGINT) AS users "
    "FROM clean WHERE PlanType IS NOT NULL GROUP BY PlanType) p) q ORDER BY label"))
def q_plan_revenue_share(spark, sf_dir):
    dist = charts.plan_distribution(cleaned(spark, sf_dir))
    return charts.plan_revenue_share(dist)


@register("signup_trend", O.with_base(
    f"SELECT {O.MONTH} AS month, CAST(COUNT(*) AS BIGINT) AS acquisitions FROM clean "
    "GROUP BY 1 ORDER BY 1"))
def q_signup_trend(spark, sf_dir):
    return charts.signup_trend(cleaned(spark, sf_dir))


def support_cte(table: str = "flagged") -> str:
    return f"""
support AS (
  SELECT SupportTickets AS tickets, CAST(COUNT(CustomerID) AS BIGINT) AS Total,
         CAST(SUM(CASE WHEN is_churned THEN 1 ELSE 0 END) AS BIGINT) AS Churned
  FROM {table} GROUP BY SupportTickets)
"""


SUPPORT_CTE = support_cte()


@register("support_churn", O.with_base(
    "SELECT tickets, Total, Churned, "
    "CASE WHEN Total > 0 THEN Churned / Total * 100.0 ELSE 0.0 END AS churn_rate "
    "FROM support ORDER BY tickets", SUPPORT_CTE))
def q_support_churn(spark, sf_dir):
    return charts.support_churn(cleaned(spark, sf_dir))


# --------------------------------------------------------------------------
# Cohorts
# --------------------------------------------------------------------------

@register("cohort_sizes", O.with_base(
    f"SELECT cohort, cohort_size, format('{{}} ({{}})', cohort, cohort_size) AS label FROM ("
    f"SELECT {O.MONTH} AS cohort, CAST(COUNT(*) AS BIGINT) AS cohort_size FROM clean GROUP BY 1) c "
    "ORDER BY cohort"))
def q_cohort_sizes(spark, sf_dir):
    return cohorts.cohort_sizes(cleaned(spark, sf_dir))


def _retained_sql(i: int) -> str:
    return (f"CAST(SUM(CASE WHEN (CASE WHEN is_active THEN {i} <= TenureMonths "
            f"ELSE {i} < TenureMonths END) THEN 1 ELSE 0 END) AS BIGINT) AS m{i}")


COHORT_CTE = (
    "counts AS (SELECT " + f"{O.MONTH} AS cohort, CAST(COUNT(*) AS BIGINT) AS cohort_size, "
    + ", ".join(_retained_sql(i) for i in range(12))
    + " FROM flagged GROUP BY 1),\n"
    "last12 AS (SELECT * FROM counts ORDER BY cohort DESC LIMIT 12)")


@register("last_cohorts", O.with_base(
    "SELECT cohort, cohort_size FROM last12 ORDER BY cohort", COHORT_CTE))
def q_last_cohorts(spark, sf_dir):
    counts = cohorts.cohort_counts(cleaned(spark, sf_dir))
    return cohorts.last_cohorts(counts, 12).select("cohort", "cohort_size").orderBy("cohort")


@register("cohort_matrix", O.with_base(
    "SELECT cohort, format('{} ({})', cohort, cohort_size) AS label, cohort_size, "
    "CAST(i AS INTEGER) AS month_idx, 'Month ' || CAST(i AS VARCHAR) AS month, retained, "
    "round_even(retained / cohort_size * 100.0, 1) AS pct "
    "FROM (" + " UNION ALL ".join(
        f"SELECT cohort, cohort_size, {i} AS i, m{i} AS retained FROM last12" for i in range(12))
    + ") u ORDER BY cohort, month_idx", COHORT_CTE))
def q_cohort_matrix(spark, sf_dir):
    return cohorts.cohort_matrix(cleaned(spark, sf_dir), last=12, months=12)


@register("cohort_matrix_wide", O.with_base(
    "SELECT cohort, format('{} ({})', cohort, cohort_size) AS label, cohort_size, "
    + ", ".join(f"round_even(m{i} / cohort_size * 100.0, 1) AS \"Month {i}\"" for i in range(12))
    + " FROM last12 ORDER BY cohort", COHORT_CTE))
def q_cohort_matrix_wide(spark, sf_dir):
    return cohorts.cohort_matrix(cleaned(spark, sf_dir), last=12, months=12, wide=True)


# --------------------------------------------------------------------------
# Insights
# --------------------------------------------------------------------------

_CRIT = insights.CRITICAL_ECONOMICS.replace("'", "''")
_EXC = insights.EXCELLENT_ECONOMICS.replace("'", "''")
_FRIC = insights.SUPPORT_FRICTION.replace("'", "''")


@register("unit_economics", O.with_base(
    "SELECT ltv_cac_ratio, "
    "CASE WHEN ltv_cac_ratio < 3.0 THEN 'critical' ELSE 'excellent' END AS level, "
    f"CASE WHEN ltv_cac_ratio < 3.0 THEN '{_CRIT}' ELSE '{_EXC}' END AS message, "
    "CASE WHEN ltv_cac_ratio >= 3.0 THEN '#10B981' WHEN ltv_cac_ratio >= 1.0 THEN '#F59E0B' "
    "ELSE '#EF4444' END AS band_color "
    "FROM (SELECT CASE WHEN avg_cac > 0 THEN avg_ltv / avg_cac ELSE 0.0 END AS ltv_cac_ratio FROM kpi_base) k",
    KPI_CTE))
def q_unit_economics(spark, sf_dir):
    return insights.unit_economics(kpi_row(spark, sf_dir))


@register("ltv_cac_band", O.with_base(
    "SELECT ltv_cac_ratio, "
    "CASE WHEN ltv_cac_ratio >= 3.0 THEN '#10B981' WHEN ltv_cac_ratio >= 1.0 THEN '#F59E0B' "
    "ELSE '#EF4444' END AS band_color "
    "FROM (SELECT CASE WHEN avg_cac > 0 THEN avg_ltv / avg_cac ELSE 0.0 END AS ltv_cac_ratio FROM kpi_base) k",
    KPI_CTE))
def q_ltv_cac_band(spark, sf_dir):
    return insights.unit_economics(kpi_row(spark, sf_dir)).select("ltv_cac_ratio", "band_color")


FIRST5_CTE = """
first5 AS (SELECT tickets, CASE WHEN Total > 0 THEN Churned / Total * 100.0 ELSE 0.0 END AS churn_rate
           FROM support ORDER BY tickets LIMIT 5),
fr AS (SELECT COUNT(*) AS n, MAX(tickets) AS t5, arg_max(churn_rate, tickets) AS r5 FROM first5)
"""
FRICTION_CTE = SUPPORT_CTE.strip() + ",\n" + FIRST5_CTE.strip()


@register("support_friction", O.with_base(
    "SELECT CASE WHEN n >= 5 THEN t5 END AS fifth_tickets, CASE WHEN n >= 5 THEN r5 END AS fifth_churn_rate, "
    "(n >= 5 AND r5 > 50.0) AS fires, "
    f"CASE WHEN n >= 5 AND r5 > 50.0 THEN '{_FRIC}' END AS message FROM fr", FRICTION_CTE))
def q_support_friction(spark, sf_dir):
    return insights.support_friction(charts.support_churn(cleaned(spark, sf_dir)))


INSIGHTS_SQL = (
    "SELECT 'unit_economics' AS rule, "
    "CASE WHEN r < 3.0 THEN 'critical' ELSE 'excellent' END AS level, "
    f"CASE WHEN r < 3.0 THEN '{_CRIT}' ELSE '{_EXC}' END AS message "
    "FROM (SELECT CASE WHEN avg_cac > 0 THEN avg_ltv / avg_cac ELSE 0.0 END AS r FROM kpi_base) k "
    f"UNION ALL SELECT 'support_friction', 'warning', '{_FRIC}' FROM fr WHERE n >= 5 AND r5 > 50.0")


@register("insights", O.with_base(INSIGHTS_SQL, KPI_CTE.strip() + ",\n" + FRICTION_CTE))
def q_insights(spark, sf_dir):
    return insights.insights_of(cleaned(spark, sf_dir))


# The same customers in a bad year: lifetime values a 4,000th, everyone with a
# returned order gone.  Here the other branch of both rules holds.
def downturn(spark, sf_dir) -> DataFrame:
    return cleaned(spark, sf_dir).withColumns({
        "LTV": F.col("LTV") / 4000.0,
        "Status": F.when(F.col("SupportTickets") >= 1, F.lit("Churned")).otherwise(F.col("Status"))})


DOWNTURN_CTE = """
bad_year AS (SELECT * REPLACE (LTV / 4000e0 AS LTV, is_active AND SupportTickets < 1 AS is_active,
                               is_churned OR SupportTickets >= 1 AS is_churned) FROM flagged)"""


@register("insights_downturn", O.with_base(INSIGHTS_SQL, ",\n".join(
    cte.strip() for cte in (DOWNTURN_CTE, kpi_cte("bad_year"), support_cte("bad_year"), FIRST5_CTE))))
def q_insights_downturn(spark, sf_dir):
    return insights.insights_of(downturn(spark, sf_dir))


@register("kpis_downturn_by_plan", O.with_base(
    KPI_SQL_BODY.strip().replace("SELECT", "SELECT COALESCE(PlanType, 'none') AS plan,", 1),
    DOWNTURN_CTE.strip() + ",\n" + kpi_cte("bad_year", "PlanType").strip()))
def q_kpis_downturn_by_plan(spark, sf_dir):
    rows = downturn(spark, sf_dir).withColumn("plan", F.coalesce("PlanType", F.lit("none")))
    return kpis.kpis(rows, by=["plan"])


# --------------------------------------------------------------------------
# Churn model
# --------------------------------------------------------------------------

def model_key(spark: SparkSession, sf_dir: str) -> str:
    """A name for the model of these tables as they are: their files' names,
    sizes and times, and the number of partitions that the fit deals to."""
    files = [read_table(spark, sf_dir, t).select(F.lit(t).alias("t"), "_metadata.file_name", "_metadata.file_size",
                                                 "_metadata.file_modification_time").distinct() for t in ("orders", "lineitem")]
    said = F.xxhash64("t", "file_name", "file_size", "file_modification_time").cast("decimal(20,0)")
    total = files[0].unionByName(files[1]).agg(F.sum(said)).first()[0]
    return f"churn-{total}-{spark.conf.get('spark.sql.shuffle.partitions')}"


def train_and_store(spark: SparkSession, sf_dir: str) -> tuple[ml.ChurnModel, DataFrame]:
    model, metrics = ml.train_churn(cleaned(spark, sf_dir))
    models.save_model(model, models.model_path(spark, model_key(spark, sf_dir)))
    return model, metrics


def churn_model(spark: SparkSession, sf_dir: str) -> ml.ChurnModel:
    """The stored model of this dataset; trained and stored where there is none."""
    try:
        return models.load_model(models.model_path(spark, model_key(spark, sf_dir)))
    except models.NoModelError:
        return train_and_store(spark, sf_dir)[0]


# A small forest written by hand, so that scoring has an oracle: splits are
# (feature, threshold, at most, above), leaves are (kept, churned) row counts.
# It reaches every band on the derived table.
HAND_FOREST = forest.grow((
    ("TenureMonths", 6.5,
        ("SupportTickets", 1.5, (3, 7), (1, 19)),
        ("LastLoginDaysAgo", 30.5, (9, 1), ("PlanType", 1.5, (5, 3), (4, 3)))),
    ("UsageFrequency", 9.5,
        ("TenureMonths", 24.5, (1, 9), (7, 6)),
        ("MonthlyRevenue", 120000.0, (7, 3), (11, 2))),
    ("LastLoginDaysAgo", 21.5,
        ("SupportTickets", 0.5, (12, 1), ("PlanType", 2.5, (4, 1), (5, 4))),
        ("UsageFrequency", 17.5, (1, 5), (3, 4))),
    ("MonthlyRevenue", 150000.5,
        ("TenureMonths", 11.5, (2, 7), (8, 3)),
        ("SupportTickets", 2.5, (6, 1), (1, 6))),
    ("PlanType", 3.5, ("TenureMonths", 47.5, (5, 4), (13, 2)), (1, 3)),
), FEATURES)


def hand_model(df: DataFrame) -> ml.ChurnModel:
    """The hand-written forest with the plan dictionary of these customers."""
    return ml.ChurnModel(ml.fit_plan_encoder(df), HAND_FOREST)


def hand_sql(**changed: str) -> str:
    """The forest's probability over ``coded``'s columns, some of them replaced."""
    inputs = {f: f for f in FEATURES} | {"PlanType": "plan_code"} | changed
    return forest.probability_sql(HAND_FOREST, {f: f"CAST({x} AS DOUBLE)" for f, x in inputs.items()})


@register("target_encode", O.with_base("SELECT CustomerID, Status, target FROM flagged"))
def q_target_encode(spark, sf_dir):
    return ml.with_target(cleaned(spark, sf_dir)).select("CustomerID", "Status", "target")


PLAN_CODE_SQL = "CAST(DENSE_RANK() OVER (ORDER BY COALESCE(PlanType, 'nan')) - 1 AS BIGINT)"


@register("plan_encode", O.with_base(
    f"SELECT CustomerID, PlanType, {PLAN_CODE_SQL} AS plan_code FROM clean"))
def q_plan_encode(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    return ml.plan_codes(c, ml.fit_plan_encoder(c))


@register("features", O.with_base(
    "SELECT CustomerID, CAST(TenureMonths AS DOUBLE) AS TenureMonths, "
    "CAST(UsageFrequency AS DOUBLE) AS UsageFrequency, CAST(SupportTickets AS DOUBLE) AS SupportTickets, "
    "CAST(LastLoginDaysAgo AS DOUBLE) AS LastLoginDaysAgo, MonthlyRevenue, "
    f"CAST({PLAN_CODE_SQL} AS DOUBLE) AS PlanCode, target FROM flagged"))
def q_features(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    return ml.feature_frame(c, ml.fit_plan_encoder(c))


SPLIT_SQL = ("('0x' || substr(md5(COALESCE(CustomerID, '') || '#42'), 1, 8))::BIGINT / 4294967296.0 "
             ">= 0.75")


@register("split", O.with_base(f"SELECT CustomerID, target, {SPLIT_SQL} AS is_test FROM flagged"))
def q_split(spark, sf_dir):
    return ml.split(ml.with_target(cleaned(spark, sf_dir))).select("CustomerID", "target", "is_test")


# Exactly as many test rows of each class as the stratified rule asks for.
@register("stratified_split", O.with_base(
    "SELECT CustomerID, target, ROW_NUMBER() OVER (PARTITION BY target ORDER BY key DESC, CustomerID) <= c - train AS is_test "
    "FROM keyed JOIN sizes USING (target)", """
keyed AS (SELECT CustomerID, target, ('0x' || substr(md5(COALESCE(CustomerID, '') || '#42'), 1, 15))::BIGINT AS key FROM flagged),
counts AS (SELECT target, COUNT(*) AS c, SUM(COUNT(*)) OVER () AS n FROM keyed GROUP BY target),
exact AS (SELECT target, c, n - ceil(0.25e0 * n) AS n_train, c::DOUBLE / n::DOUBLE * (n - ceil(0.25e0 * n)) AS x FROM counts),
sizes AS (SELECT target, c, floor(x) + CASE WHEN ROW_NUMBER() OVER (ORDER BY x - floor(x) DESC, target)
                 <= n_train - SUM(floor(x)) OVER () THEN 1 ELSE 0 END AS train FROM exact)"""))
def q_stratified_split(spark, sf_dir):
    return (ml.split(ml.with_target(cleaned(spark, sf_dir)), balanced=True).select("CustomerID", "target", "is_test"))


# The support-friction rule of thumb ("more than 4 tickets churn") scored as
# a classifier on the hold-out rows: the metrics operator fed a predictor the
# oracle can reproduce exactly.
RULE_TICKETS_ABOVE = 4


@register("binary_metrics", O.with_base(
    "SELECT CASE WHEN n > 0 THEN (tp + tn) / n * 100.0 ELSE 0.0 END AS Accuracy, "
    "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) * 100.0 ELSE 0.0 END AS Precision, "
    "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) * 100.0 ELSE 0.0 END AS Recall, "
    "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) * 100.0 ELSE 0.0 END AS \"F1-Score\", "
    "tp, fp, fn, tn FROM (SELECT *, tp + fp + fn + tn AS n FROM ("
    "SELECT CAST(SUM(CASE WHEN y AND p THEN 1 ELSE 0 END) AS BIGINT) AS tp, "
    "CAST(SUM(CASE WHEN NOT y AND p THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
    "CAST(SUM(CASE WHEN y AND NOT p THEN 1 ELSE 0 END) AS BIGINT) AS fn, "
    "CAST(SUM(CASE WHEN NOT y AND NOT p THEN 1 ELSE 0 END) AS BIGINT) AS tn "
    f"FROM (SELECT target = 1.0 AS y, SupportTickets > {RULE_TICKETS_ABOVE} AS p FROM flagged "
    f"WHERE {SPLIT_SQL}) s) c) m"))
def q_binary_metrics(spark, sf_dir):
    parts = ml.split(ml.with_target(cleaned(spark, sf_dir)))
    pred = (parts.where("is_test")
                 .withColumn("prediction",
                             F.when(F.col("SupportTickets") > RULE_TICKETS_ABOVE, 1.0).otherwise(0.0)))
    return ml.binary_metrics(pred)


def _band_sql(p: str, high: str, medium: str, safe: str) -> str:
    return f"CASE WHEN {p} >= 0.7 THEN '{high}' WHEN {p} >= 0.4 THEN '{medium}' ELSE '{safe}' END"


# A probability of every customer that both engines compute identically: the
# md5 bucket of the ID, spread over [0, 1), so every band holds many rows.
BUCKET_SQL = "('0x' || substr(md5(COALESCE(CustomerID, '') || '#42'), 1, 8))::BIGINT / 4294967296.0"
CHANCE_CTE = f"chances AS (SELECT *, {BUCKET_SQL} AS p FROM flagged)"
LEDGER_BAND_SQL = _band_sql("p", "🔴 HIGH RISK", "🟡 MEDIUM RISK", "🟢 SAFE")


def customer_chances(spark, sf_dir) -> DataFrame:
    """The cleaned customers with the stand-in probability ``p``."""
    return cleaned(spark, sf_dir).withColumn("p", ml.split_bucket())


@register("risk_band", O.with_base(
    f"SELECT CustomerID, p, {LEDGER_BAND_SQL} AS RiskCategory, "
    f"{_band_sql('p', 'HIGH RISK', 'MEDIUM RISK', 'SAFE')} AS risk_text, "
    f"{_band_sql('p', '#EF4444', '#F59E0B', '#10B981')} AS risk_color FROM chances", CHANCE_CTE))
def q_risk_band(spark, sf_dir):
    return customer_chances(spark, sf_dir).select(
        "CustomerID", "p", risk_band("p").alias("RiskCategory"),
        risk_band("p", emoji=False).alias("risk_text"), risk_color("p").alias("risk_color"))


@register("retention_action", O.with_base(
    f"SELECT CustomerID, p, {_band_sql('p', *PROTOCOLS)} AS protocol FROM chances", CHANCE_CTE))
def q_retention_action(spark, sf_dir):
    return customer_chances(spark, sf_dir).select("CustomerID", "p", retention_action("p").alias("protocol"))


# The ledger's filter, projection, bands and order, fed the stand-in probability.
@register("rank_ledger", O.with_base(
    "SELECT CustomerID, COALESCE(PlanType, 'nan') AS PlanType, MonthlyRevenue, TenureMonths, SupportTickets, "
    f"LastLoginDaysAgo, p AS ChurnRiskProbability, {LEDGER_BAND_SQL} AS RiskCategory FROM chances "
    "WHERE is_active ORDER BY p DESC, CustomerID", CHANCE_CTE))
def q_rank_ledger(spark, sf_dir):
    return ml.rank_ledger(filters.active_filter(customer_chances(spark, sf_dir))
                          .withColumnRenamed("p", "churn_probability"))


@register("train_churn", None)
def q_train_churn(spark, sf_dir):
    return train_and_store(spark, sf_dir)[1]


@register("importances", None)
def q_importances(spark, sf_dir):
    return churn_model(spark, sf_dir).importances(spark)


CODED_CTE = f"coded AS (SELECT *, {PLAN_CODE_SQL} AS plan_code FROM flagged)"
LEDGER_SQL = ("CustomerID, COALESCE(PlanType, 'nan') AS PlanType, MonthlyRevenue, TenureMonths, SupportTickets, "
              f"LastLoginDaysAgo, p AS ChurnRiskProbability, {LEDGER_BAND_SQL} AS RiskCategory")


@register("risk_ledger", O.with_base(
    f"SELECT {LEDGER_SQL} FROM (SELECT *, {hand_sql()} AS p FROM coded) s WHERE is_active ORDER BY p DESC, CustomerID", CODED_CTE))
def q_risk_ledger(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    return ml.risk_ledger(c, hand_model(c))


def _scored_sql(p: str, record: str) -> str:
    return (f"CustomerID, {record}, {p} AS probability, {_band_sql(p, 'HIGH RISK', 'MEDIUM RISK', 'SAFE')} AS risk_text, "
            f"{_band_sql(p, '#EF4444', '#F59E0B', '#10B981')} AS risk_color, {_band_sql(p, *PROTOCOLS)} AS protocol")


RECORD_SQL = {"plan": "PlanType", "revenue": "MonthlyRevenue", "tenure": "TenureMonths", "usage": "UsageFrequency",
              "tickets": "SupportTickets", "last_login": "LastLoginDaysAgo"}


def _record_sql(**changed: str) -> str:
    return ", ".join(f"{x} AS {field}" for field, x in (RECORD_SQL | changed).items())


# What if every active customer had no open tickets and logged in today?
WHAT_IF_OVERRIDES = {"tickets": 0, "last_login": 0}
# A plan that no customer has counts as the dictionary's first.
NEW_PLAN = "9-NO SUCH PLAN"


def _what_if_sql(record: str, p: str) -> str:
    return O.with_base(f"SELECT {_scored_sql('q', record)}, p AS baseline_probability FROM "
                       f"(SELECT *, {hand_sql()} AS p, {p} AS q FROM coded) s WHERE is_active", CODED_CTE)


@register("what_if", _what_if_sql(
    _record_sql(tickets="CAST(0 AS BIGINT)", last_login="CAST(0 AS BIGINT)"), hand_sql(SupportTickets="0", LastLoginDaysAgo="0")))
def q_what_if(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    return ml.what_if(c, hand_model(c), WHAT_IF_OVERRIDES)


@register("what_if_new_plan", _what_if_sql(_record_sql(plan=f"'{NEW_PLAN}'"), hand_sql(PlanType="0")))
def q_what_if_new_plan(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    return ml.what_if(c, hand_model(c), {"plan": NEW_PLAN})


@register("score_scenarios", O.with_base(
    f"SELECT {_scored_sql('p', _record_sql())} FROM (SELECT *, {hand_sql()} AS p FROM coded) s", CODED_CTE))
def q_score_scenarios(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    return ml.score_scenarios(ml.as_scenarios(c), hand_model(c), keep=("CustomerID",))


@register("stored_model_ledger", O.with_base(
    f"SELECT {LEDGER_SQL} FROM (SELECT *, {hand_sql()} AS p FROM coded) s WHERE is_active "
    "AND contains(lower(CustomerID), '-4') ORDER BY p DESC, CustomerID LIMIT 200", CODED_CTE))
def q_stored_model_ledger(spark, sf_dir):
    """The ledger as a later session makes it: the model is saved, loaded and
    asked for the 200 riskiest customers whose ID holds a text."""
    c = cleaned(spark, sf_dir)
    path = models.model_path(spark, "hand-" + model_key(spark, sf_dir))
    models.save_model(hand_model(c), path)
    return ml.risk_ledger(c, models.load_model(path), top_n=200, search="-4", literal=True)


RANK_SQL = ("RANK() OVER w AS rank, DENSE_RANK() OVER w AS dense_rank, PERCENT_RANK() OVER w AS percent_rank, "
            "ROW_NUMBER() OVER t AS row_number, NTILE(100) OVER t AS tile")


# Every slider's exact steps; the derived table's revenues are beyond the simulator's range.
CURVE_RANGES = {"revenue": (0.0, 600000.0)}


def _curves_sql() -> str:
    parts = []
    for field, bounds in {**responses.SLIDERS, **CURVE_RANGES}.items():
        for low, high in responses.intervals(HAND_FOREST, field, *bounds):
            parts.append(f"SELECT CustomerID, p, '{field}' AS field, {low}e0 AS low, {high}e0 AS high, "
                         f"{hand_sql(**{RECORD_SQL[field]: f'{high}e0'})} AS probability FROM own")
    return O.with_base(
        f"SELECT CustomerID, field, low, high, probability, probability - p AS change, "
        f"{_band_sql('probability', 'HIGH RISK', 'MEDIUM RISK', 'SAFE')} AS risk_text FROM ({' UNION ALL '.join(parts)}) c",
        CODED_CTE + f",\nown AS (SELECT *, {hand_sql()} AS p FROM coded WHERE is_active)")


@register("response_curves", _curves_sql())
def q_response_curves(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    return responses.response_curves(c, hand_model(c), ranges=CURVE_RANGES)


@register("best_move", _curves_sql().replace("SELECT CustomerID, field, low, high, probability, probability - p AS change",
          "SELECT CustomerID, field, low, high, probability, change FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY CustomerID "
          "ORDER BY probability, field, low) AS nth FROM (SELECT CustomerID, field, low, high, probability, probability - p AS change", 1)
          + ") m) n WHERE nth = 1")
def q_best_move(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    return responses.best_move(responses.response_curves(c, hand_model(c), ranges=CURVE_RANGES))


@register("ledger_ranks", O.with_base(
    f"SELECT CustomerID, p AS ChurnRiskProbability, {RANK_SQL} FROM (SELECT *, {hand_sql()} AS p FROM coded) s "
    "WHERE is_active WINDOW w AS (ORDER BY p DESC), t AS (ORDER BY p DESC, CustomerID)", CODED_CTE))
def q_ledger_ranks(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    return ml.ledger_ranks(c, hand_model(c)).select(
        "CustomerID", "ChurnRiskProbability", "rank", "dense_rank", "percent_rank", "row_number", "tile")


# --------------------------------------------------------------------------
# Display values
# --------------------------------------------------------------------------

@register("active_ratio", O.with_base(
    "SELECT active_count, total_customers, "
    "CASE WHEN total_customers > 0 THEN active_count / total_customers ELSE 0.0 END AS active_ratio "
    "FROM kpi_base", KPI_CTE))
def q_active_ratio(spark, sf_dir):
    k = kpi_row(spark, sf_dir)
    return k.select("active_count", "total_customers",
                    F.when(F.col("total_customers") > 0, F.col("active_count") / F.col("total_customers"))
                     .otherwise(F.lit(0.0)).alias("active_ratio"))


@register("percent_text", O.with_base(
    "SELECT CustomerID, p, printf('%.1f%%', round_even(p * 100.0, 1)) AS p_text FROM chances", CHANCE_CTE))
def q_percent_text(spark, sf_dir):
    return customer_chances(spark, sf_dir).select("CustomerID", "p", percent_text("p").alias("p_text"))
