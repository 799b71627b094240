"""The named SQL queries: texts in ``plans/sql``, run over registered star views."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.functions.vocabulary import TOPIC_NAMES
from orderloom.operators.quality import union_all
from orderloom.plans.base import Registry
from orderloom.sources.files import register_views
from orderloom.sources.tables import Star, TradeStar

NAMED_SQL = Registry()
FOLDER = Path(__file__).parent / "sql"
DEFAULTS: dict[str, float] = {
    "category_min": 100, "state_min": 100, "seller_min": 30, "product_min": 30, "low": 50, "high": 200}
# Order totals of the trade tables are far above the defaults.
TRADE = {**DEFAULTS, "low": 100_000, "high": 300_000}


def texts() -> dict[str, str]:
    """Query texts by name; the file's number prefix gives the order and is dropped."""
    return {path.stem.split("_", 1)[1]: path.read_text(encoding="utf-8") for path in sorted(FOLDER.glob("*.sql"))}


def title(name: str) -> str:
    return name.replace("_", " ").title()


def star_views(star: Star) -> dict[str, DataFrame]:
    topics = star.spark.createDataFrame(list(TOPIC_NAMES.items()), "topic_id int, business_topic_name string")
    return {
        "star_orders": star["orders"], "star_items": star["items"], "star_products": star["products"],
        "star_customers": star["customers"], "star_reviews": star["scored_reviews"], "star_topics": topics}


def run(star: Star, name: str, parameters: Mapping[str, float] = DEFAULTS) -> DataFrame:
    register_views(star.spark, star_views(star))
    text = texts()[name]
    return star.spark.sql(text, args={k: v for k, v in parameters.items() if f":{k}" in text})


def sql_catalog(star: Star, parameters: Mapping[str, float] = DEFAULTS) -> DataFrame:
    """(name, rows, ok) of every query; an empty result or an analysis error is not ok."""
    register_views(star.spark, star_views(star))
    parts = []
    for name, text in texts().items():
        label = F.lit(title(name)).alias("name")
        try:
            result = star.spark.sql(text, args={k: v for k, v in parameters.items() if f":{k}" in text})
        except PySparkException:
            parts.append(star.spark.range(1).select(label, F.lit(0).cast("long").alias("rows")))
            continue
        parts.append(result.agg(F.count("*").alias("rows")).select(label, "rows"))
    return union_all(parts).withColumn("ok", F.col("rows") > 0)


CHECK_PAIRS = """, oc AS (
  SELECT DISTINCT order_id, coalesce(category, 'unknown') AS category FROM b_items LEFT JOIN b_products USING (product_id)),
rc AS (SELECT * FROM b_scored JOIN oc USING (order_id)),
topics AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, '{n}')" for i, n in TOPIC_NAMES.items()) + """) t(topic_id, topic))"""
NEG = "CASE WHEN sentiment_label = 'Negative' THEN 1::DOUBLE ELSE 0 END"
CHECKS = {
    "category_revenue": """SELECT category, count(DISTINCT order_id) AS total_orders, sum(price)::DOUBLE AS total_revenue,
        sum(freight_value)::DOUBLE AS total_freight FROM b_items LEFT JOIN b_products USING (product_id) GROUP BY 1""",
    "avg_score_by_category": """SELECT category, count(*) AS total_reviews, round(avg(review_score), 3) AS avg_review_score
        FROM rc GROUP BY 1 HAVING count(*) >= 100""",
    "negative_review_rate": """SELECT category, count(*) AS total_reviews,
        round(avg(CASE WHEN review_score <= 2 THEN 1::DOUBLE ELSE 0 END), 4) AS negative_review_rate
        FROM rc GROUP BY 1 HAVING count(*) >= 100""",
    "late_delivery_rate": """SELECT state, count(*) AS total_orders, avg(is_late) AS late_delivery_rate
        FROM b_delay JOIN b_customers USING (customer_id) WHERE delivered_ts IS NOT NULL GROUP BY 1 HAVING count(*) >= 100""",
    "category_complaint_rate": f"""SELECT category, count(*) AS total_reviews, round(avg({NEG}), 4) AS negative_sentiment_rate
        FROM rc GROUP BY 1 HAVING count(*) >= 100""",
    "seller_performance": f""", rev AS (SELECT seller_id, count(DISTINCT order_id) AS total_orders,
          round(sum(price)::DOUBLE, 2) AS total_revenue FROM b_items GROUP BY 1),
        sr AS (SELECT DISTINCT seller_id, review_id, order_id, sentiment_label FROM b_items JOIN b_scored USING (order_id))
        SELECT seller_id, total_orders, total_revenue, count(*) AS text_reviews, round(avg({NEG}), 4) AS negative_sentiment_rate
        FROM rev JOIN sr USING (seller_id) GROUP BY 1, 2, 3 HAVING count(*) >= 30""",
    "monthly_trends": f"""SELECT strftime(purchase_ts, '%Y-%m') AS order_month, count(DISTINCT order_id) AS total_orders,
        avg({NEG}) AS negative_sentiment_rate FROM b_orders JOIN b_scored USING (order_id) GROUP BY 1""",
    "product_ranking": f""", rp AS (SELECT DISTINCT product_id, review_id, order_id, review_score, sentiment_label
          FROM b_items JOIN b_scored USING (order_id))
        SELECT product_id, coalesce(category, 'unknown') AS category, count(*) AS total_reviews, round(avg(review_score), 3) AS avg_score,
               round(avg({NEG}), 4) AS negative_sentiment_rate
        FROM rp LEFT JOIN b_products USING (product_id) GROUP BY 1, 2 HAVING count(*) >= 30""",
    "complaint_breakdown": """SELECT topic, count(*) AS negative_reviews,
        round(count(*) * 100::DOUBLE / sum(count(*)) OVER (), 1) AS share_of_negative_pct, round(avg(review_score), 3) AS avg_review_score
        FROM b_scored JOIN topics USING (topic_id) WHERE sentiment_label = 'Negative' GROUP BY 1""",
    "customer_geography": """, orv AS (SELECT order_id, avg(review_score) AS score FROM b_scored GROUP BY 1)
        SELECT state, count(*) AS delivered_orders, round(avg(date_diff('day', estimated_ts, delivered_ts)), 2) AS avg_delay_days,
               count(r.order_id) AS orders_with_text_review, round(avg(score), 3) AS avg_review_score
        FROM b_orders o JOIN b_customers USING (customer_id) LEFT JOIN orv r ON r.order_id = o.order_id
        WHERE delivered_ts IS NOT NULL GROUP BY 1""",
    "order_value_segments": f""", v AS (SELECT order_id, CASE WHEN sum(price + freight_value) < 100000 THEN 'Low Value'
          WHEN sum(price + freight_value) BETWEEN 100000 AND 300000 THEN 'Medium Value' ELSE 'High Value' END AS value_segment
          FROM b_items GROUP BY 1)
        SELECT value_segment, count(*) AS total_reviews, avg(review_score) AS avg_review_score, avg({NEG}) AS negative_sentiment_rate
        FROM v JOIN b_scored USING (order_id) GROUP BY 1""",
}
for _name in texts():
    NAMED_SQL.add(_name, lambda s, n=_name: run(s, n, TRADE), CHECK_PAIRS + CHECKS[_name])


def _counted(star: TradeStar) -> DataFrame:
    return sql_catalog(star, TRADE)


NAMED_SQL.add("sql_catalog", _counted, CHECK_PAIRS + ", " + ", ".join(
    # each check becomes one CTE; their own CTEs come first
    (CHECKS[n].strip()[2:].rsplit("\n        SELECT", 1)[0] + f", q_{n} AS (SELECT" + CHECKS[n].rsplit("\n        SELECT", 1)[1] + ")"
     if CHECKS[n].strip().startswith(",") else f"q_{n} AS ({CHECKS[n]})") for n in texts())
    + " " + " UNION ALL ".join(
        f"SELECT '{title(n)}' AS name, count(*) AS rows, count(*) > 0 AS ok FROM q_{n}" for n in texts()))
