"""The derived ``subscriptions`` table: one (deliberately dirty) subscription per order.

The driver's tables carry no subscription data, so each order stands for one
customer subscription.  The SQL below is the single definition used by both
Spark and the DuckDB oracle; it is ANSI SQL that both engines evaluate to the
same cells.  All eleven role columns are strings and dirty on purpose
(currency signs, blanks, ``N/A``, ``nan``, nulls, fractional integers,
mixed-case statuses, unparseable dates).

Plan shape: ``lineitem`` is reduced to one row per order with a partial
(map-side) aggregate and shuffled once on the order key.  ``orders`` is unique
on its key, so the join cannot fan out, and a hot order key is absorbed by
the partial aggregate before any shuffle.  Operators that need no
``lineitem`` column (KPIs, cohorts, charts) get the join removed by Catalyst
(left join to a side that is unique on the key), so they scan ``orders`` only.

When the ``orders`` scan yields fewer splits than the cluster has task slots
(few small files), it is hash-partitioned on the order key at the session's
shuffle width: cheap at that size, co-partitioned with the lineitem aggregate
for a shuffle join, and it spreads the CPU-heavy per-row cleaning over every
slot.  An explicit width keeps AQE from merging these byte-small partitions.
A wide scan (a large table) keeps its splits, so no extra shuffle is added
where the join is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from churnscope.sources.tables import read_table

# Fixed value: the table definition (identical text for Spark and DuckDB; the
# two ``{...}`` slots name the source tables).
SUBSCRIPTIONS_SQL = """
WITH li AS (
  SELECT l_orderkey,
         CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS r,
         CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q
  FROM {lineitem} GROUP BY l_orderkey),
b AS (
  SELECT o_orderkey AS k, o_orderpriority, o_orderstatus, o_orderdate,
         CAST(o_totalprice AS DECIMAL(12,2)) AS price,
         CAST(GREATEST(1, (2001 - YEAR(o_orderdate)) * 12 + (8 - MONTH(o_orderdate))) AS BIGINT) AS mss,
         COALESCE(r, 0) AS r, COALESCE(q, 0) AS q
  FROM {orders} LEFT JOIN li ON o_orderkey = l_orderkey),
t AS (
  SELECT b.*, CASE WHEN o_orderstatus = 'F' THEN k % (mss + 1) ELSE mss END AS ten FROM b)
SELECT CONCAT('CUST-', CAST(k AS VARCHAR(20))) AS CustomerID,
       CASE WHEN k % 97 = 0 THEN 'unknown' ELSE SUBSTR(CAST(o_orderdate AS VARCHAR(30)), 1, 10) END AS SignupDate,
       CASE WHEN k % 89 = 0 THEN NULL ELSE SUBSTR(o_orderpriority, 3) END AS PlanType,
       CASE WHEN k % 53 = 0 THEN 'N/A' ELSE CONCAT('$ ', CAST(price AS VARCHAR(20))) END AS MonthlyRevenue,
       CASE WHEN k % 71 = 0 THEN 'Trial' WHEN o_orderstatus = 'O' THEN 'Active'
            WHEN o_orderstatus = 'P' THEN 'ACTIVE' WHEN k % 2 = 0 THEN 'Churned' ELSE 'inactive' END AS Status,
       CASE WHEN k % 61 = 0 THEN '' ELSE CONCAT(CAST(ten AS VARCHAR(20)), '.7') END AS TenureMonths,
       CAST(q % 31 AS VARCHAR(20)) AS UsageFrequency,
       CASE WHEN k % 59 = 0 THEN 'nan' ELSE CAST(r AS VARCHAR(20)) END AS SupportTickets,
       CAST((k * 13) % 45 AS VARCHAR(20)) AS LastLoginDaysAgo,
       CONCAT('$', CAST(price * ten AS VARCHAR(30))) AS LTV,
       CASE WHEN k % 67 = 0 THEN NULL ELSE CONCAT('1,', CAST(100 + k % 900 AS VARCHAR(20)), '.50') END AS CAC
FROM t
"""


def subscriptions_sql(orders: str = "orders", lineitem: str = "lineitem") -> str:
    """The definition with concrete table names (as the oracle runs it)."""
    return SUBSCRIPTIONS_SQL.format(orders=orders, lineitem=lineitem)


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw (uncleaned) subscription table derived from ``orders`` and ``lineitem``."""
    orders = read_table(spark, sf_dir, "orders")
    lineitem = read_table(spark, sf_dir, "lineitem")
    return spark.sql(SUBSCRIPTIONS_SQL, orders=orders, lineitem=lineitem)
