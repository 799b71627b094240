"""Registry of named queries and the SQL that checks them.

``CHECK_TABLES`` states the same column bindings as ``sources.tables.TradeStar``, in the
dialect of the checking engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderloom.sources.tables import TradeStar

Query = Callable[[SparkSession, str], DataFrame]

CHECK_TABLES = """
WITH b_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS item_id, l_partkey AS product_id, l_suppkey AS seller_id,
         l_shipdate AS shipping_limit_date, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
         CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS freight_value
  FROM lineitem),
b_facts AS (
  SELECT l_orderkey AS order_id, min(l_shipdate) AS first_ship,
         bool_or(l_returnflag = 'R' AND l_discount > 0.05) AS returned,
         bool_or(l_quantity > 45) AS large, bool_or(l_tax > 0.06) AS taxed
  FROM lineitem GROUP BY 1),
b_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
         o_orderdate AS purchase_ts, o_orderdate AS estimated_ts,
         CASE WHEN o_orderstatus <> 'P' THEN first_ship END AS delivered_ts
  FROM orders LEFT JOIN b_facts ON o_orderkey = order_id),
b_delay AS (
  SELECT *, date_diff('microsecond', estimated_ts, delivered_ts) / 86400000000::DOUBLE AS delay_days,
         CASE WHEN delivered_ts IS NULL THEN NULL WHEN delivered_ts > estimated_ts THEN 1 ELSE 0 END::DOUBLE AS is_late
  FROM b_orders),
b_customers AS (
  SELECT c_custkey AS customer_id, c_name AS customer_unique_id, c_custkey % 50 AS zip_code_prefix,
         c_mktsegment AS city, n_name AS state
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
b_sellers AS (
  SELECT s_suppkey AS seller_id, n_name AS state FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
b_products AS (
  SELECT p_partkey AS product_id, CASE WHEN p_partkey % 50 <> 0 THEN p_brand END AS category FROM part),
b_payments AS (
  SELECT l_orderkey AS order_id, l_returnflag || l_linestatus AS payment_type,
         CAST(l_quantity AS INT) AS payment_installments, CAST(l_extendedprice AS DECIMAL(18,2)) AS payment_value,
         l_linenumber AS payment_sequential
  FROM lineitem),
b_geo AS (
  SELECT c_custkey AS seq, c_custkey % 50 AS zip_code_prefix, c_acctbal AS lat, c_nationkey::DOUBLE AS lng,
         c_mktsegment AS city, n_name AS state
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
b_reviews AS (
  SELECT o_orderkey * 10 AS review_id, o_orderkey AS order_id,
         CAST(1 + (o_orderkey * 7 + o_custkey) % 5 AS INT) AS review_score, text AS review_comment_message
  FROM orders LEFT JOIN documents ON o_orderkey = doc_id),
b_scored AS (
  SELECT o_orderkey * 10 AS review_id, o_orderkey AS order_id,
         CAST(1 + (o_orderkey * 7 + o_custkey) % 5 AS INT) AS review_score,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Negative' WHEN '2-HIGH' THEN 'Neutral' ELSE 'Positive' END AS sentiment_label,
         CAST(o_custkey % 8 AS INT) AS topic_id, 'Topic ' || (o_custkey % 8) AS topic_label
  FROM orders),
b_aspects AS (
  SELECT order_id, 'Returned' AS aspect FROM b_facts WHERE returned
  UNION ALL SELECT order_id, 'Large quantity' FROM b_facts WHERE large
  UNION ALL SELECT order_id, 'High tax' FROM b_facts WHERE taxed
  UNION ALL SELECT o_orderkey, 'Uncategorized' FROM orders LEFT JOIN b_facts ON o_orderkey = order_id
            WHERE NOT (coalesce(returned, false) OR coalesce(large, false) OR coalesce(taxed, false))),
b_text AS (
  SELECT d.doc_id AS review_id, d.doc_id - CASE WHEN d.doc_id % 10 = 1 THEN 1 ELSE 0 END AS order_id,
         CAST(1 + (d.doc_id * 7 + n_chars) % 5 AS INT) AS review_score, text AS review_comment_message, lang,
         CASE WHEN toxic = 1 OR quality = 0 THEN 'Negative' WHEN quality IS NULL THEN 'Neutral' ELSE 'Positive' END AS sentiment_label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


def tie(sql: str) -> str:
    """A check query over the bound tables; further CTEs may follow with a leading comma."""
    body = sql.strip()
    return CHECK_TABLES + (body if body.startswith(",") else body)


class Registry:
    """Collects queries by name, each with its check where SQL can state it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.checks: dict[str, str] = {}

    def add(self, name: str, build: Callable[[TradeStar], DataFrame], check: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"duplicate query {name}")
        self.queries[name] = lambda spark, folder: build(TradeStar(spark, folder))
        if check is not None:
            self.checks[name] = tie(check)

    def merge(self, other: "Registry") -> None:
        for name, query in other.queries.items():
            if name in self.queries:
                raise ValueError(f"duplicate query {name}")
            self.queries[name] = query
        self.checks.update(other.checks)
