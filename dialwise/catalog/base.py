"""Registry that pairs each query with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LEAD_CTES = """
WITH flags AS (
  SELECT l_orderkey, count(*) AS n_lines,
         max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS any_returned,
         max(CASE WHEN l_tax >= 0.075::DOUBLE THEN 1 ELSE 0 END) AS any_taxed,
         max(CASE WHEN l_returnflag = 'R' AND l_discount >= 0.085::DOUBLE AND l_quantity >= 20
                  THEN 1 ELSE 0 END) AS any_hit
  FROM lineitem GROUP BY l_orderkey),
base AS (
  SELECT o.*, c.c_mktsegment, f.n_lines, f.any_returned, f.any_taxed,
         coalesce(f.any_hit, 0)::INTEGER AS y,
         ('0x' || substr(md5(o.o_orderkey::VARCHAR), 1, 8))::BIGINT AS h,
         ('0x' || substr(md5('d' || o.o_orderkey::VARCHAR), 1, 8))::BIGINT AS h2,
         floor(o.o_totalprice / 1400.0::DOUBLE)::INTEGER AS duration
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
                LEFT JOIN flags f ON o.o_orderkey = f.l_orderkey),
visits AS (
  SELECT *, row_number() OVER w AS visit, lag(o_orderdate) OVER w AS prev_ts, lag(y) OVER w AS prev_y
  FROM base WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
leads AS (
  SELECT o_orderkey AS lead_id, o_custkey AS cust_id, o_orderdate AS contact_ts,
    (18 + o_custkey % 70)::INTEGER AS age, c_mktsegment AS job,
    CASE o_orderstatus WHEN 'F' THEN 'married' WHEN 'O' THEN 'single' ELSE 'divorced' END AS marital,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'university.degree' WHEN '2' THEN 'professional.course'
      WHEN '3' THEN 'high.school' WHEN '5' THEN 'basic.9y' ELSE 'unknown' END AS education,
    CASE WHEN o_orderkey % 50 = 0 THEN 'yes' WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE 'no' END AS "default",
    CASE WHEN any_returned IS NULL THEN 'unknown' WHEN any_returned = 1 THEN 'yes' ELSE 'no' END AS housing,
    CASE WHEN any_taxed = 1 THEN 'yes' ELSE 'no' END AS loan,
    CASE WHEN o_orderkey % 3 = 0 THEN 'telephone' ELSE 'cellular' END AS contact,
    lower(strftime(o_orderdate, '%b')) AS month, lower(strftime(o_orderdate, '%a')) AS day_of_week,
    duration, greatest(coalesce(n_lines, 1), 1)::INTEGER AS campaign,
    (visit - 1)::INTEGER AS previous,
    (CASE WHEN date_diff('day', prev_ts::DATE, o_orderdate::DATE) < 999
          THEN date_diff('day', prev_ts::DATE, o_orderdate::DATE) ELSE 999 END)::INTEGER AS pdays,
    CASE WHEN prev_y IS NULL THEN 'nonexistent' WHEN prev_y = 1 THEN 'success' ELSE 'failure' END AS poutcome,
    5.0::DOUBLE - 0.05::DOUBLE * ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1) AS euribor3m,
    y, h, h2,
    (((h * 700000) >> 32) + CASE WHEN y = 1 OR h2 % 8 = 0 THEN 300000 ELSE 0 END) / 1e6::DOUBLE AS score,
    1 - (((h2 * 550000) >> 32) + CASE WHEN duration > 180 THEN 450000 ELSE 0 END) / 1e6::DOUBLE AS prob_short,
    (((h2 * 550000) >> 32) + CASE WHEN duration > 180 THEN 450000 ELSE 0 END) / 1e6::DOUBLE AS prob_long
  FROM visits)
"""


def query(name: str, lead_sql: str | None = None, sql: str | None = None):
    """Register a query. ``lead_sql`` follows the lead CTEs: either a SELECT
    or ``, more AS (...) SELECT``; ``sql`` is a whole statement."""
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if lead_sql is not None:
            ORACLES[name] = LEAD_CTES + lead_sql
        elif sql is not None:
            ORACLES[name] = sql
        return fn
    return register
