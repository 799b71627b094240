"""Order feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderloom.functions import metrics
from orderloom.operators import features, ordering
from orderloom.plans.base import Registry
from orderloom.plans.tables import CHECK_PRIMARY

ORDERS = Registry()
add = ORDERS.add

CHECK_ORDER_ITEMS = """, oi AS (
  SELECT order_id, sum(price) AS total_price, sum(freight_value) AS total_freight, count(*) AS items_per_order,
         count(DISTINCT seller_id) AS distinct_sellers_per_order, sum(price) + sum(freight_value) AS order_total_value,
         CASE WHEN sum(price) > 0 THEN sum(freight_value)::DOUBLE / sum(price)::DOUBLE END AS freight_ratio
  FROM b_items GROUP BY 1),
  top AS (SELECT order_id, seller_id, product_id FROM b_items QUALIFY row_number() OVER (
    PARTITION BY order_id ORDER BY price DESC, item_id, product_id, seller_id, shipping_limit_date) = 1)"""

add("delivery_delay", lambda s: features.delivery_delay(s.orders),
    "SELECT order_id, delay_days AS delivery_delay_days FROM b_delay")
add("order_items_agg", lambda s: features.order_items_agg(s.items).select(
    "order_id", F.col("total_price").cast("double").alias("total_price"),
    F.col("total_freight").cast("double").alias("total_freight"), "items_per_order", "distinct_sellers_per_order",
    F.col("order_total_value").cast("double").alias("order_total_value")), CHECK_ORDER_ITEMS + """
    SELECT order_id, total_price::DOUBLE AS total_price, total_freight::DOUBLE AS total_freight, items_per_order,
           distinct_sellers_per_order, order_total_value::DOUBLE AS order_total_value FROM oi""")
add("freight_ratio", lambda s: features.order_items_agg(s.items).select(
    "order_id", F.round("freight_ratio", 8).alias("freight_ratio")),
    CHECK_ORDER_ITEMS + " SELECT order_id, round(freight_ratio, 8) AS freight_ratio FROM oi")
add("order_payment_features", lambda s: s.orders.select("order_id").join(
    features.order_payment_features(s.payments_raw), "order_id", "left"), CHECK_PRIMARY + """
    SELECT order_id, payment_installments_max AS payment_installments, primary_payment_type AS payment_type
    FROM b_orders LEFT JOIN dim_pay USING (order_id)""")
REVIEW_PARTS = ("order_id", "review_score", "review_comment_message")
add("order_review_features", lambda s: features.order_review_features(
    s.reviews.select(*REVIEW_PARTS).unionByName(s.text_reviews.select(*REVIEW_PARTS))), f"""
    SELECT order_id, avg(review_score) AS review_score, bool_or(review_comment_message IS NOT NULL) AS has_review_text
    FROM (SELECT {", ".join(REVIEW_PARTS)} FROM b_reviews UNION ALL SELECT {", ".join(REVIEW_PARTS)} FROM b_text) GROUP BY 1""")
add("dominant_seller_state", lambda s: features.dominant_seller_state(s.items, s.sellers), CHECK_ORDER_ITEMS + """
    SELECT order_id, state AS seller_state FROM top LEFT JOIN b_sellers USING (seller_id)""")
add("is_interstate", lambda s: s.orders.join(s.customers.select("customer_id", "state"), "customer_id").join(
    features.dominant_seller_state(s.items, s.sellers), "order_id", "left").select(
    "order_id", features.is_interstate(F.col("state"), F.col("seller_state")).alias("is_interstate_order")),
    CHECK_ORDER_ITEMS + """
    SELECT o.order_id, c.state <> sl.state AS is_interstate_order
    FROM b_orders o JOIN b_customers c USING (customer_id) LEFT JOIN top t ON t.order_id = o.order_id
    LEFT JOIN b_sellers sl ON sl.seller_id = t.seller_id""")
add("dominant_category", lambda s: features.dominant_category(s.items, s.products), CHECK_ORDER_ITEMS + """
    SELECT order_id, category AS product_category FROM top LEFT JOIN b_products USING (product_id)""")
add("iqr_fence", lambda s: ordering.iqr_fences(
    s.items.select(F.col("price").cast("double").alias("price")), "price").select(
    *[F.round(c, 6).alias(c) for c in ("q1", "q3", "iqr", "lower_fence", "upper_fence")]), """
    , q AS (SELECT quantile_cont(price::DOUBLE, 0.25) AS q1, quantile_cont(price::DOUBLE, 0.75) AS q3 FROM b_items)
    SELECT round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
           round(q1 - 1.5::DOUBLE * (q3 - q1), 6) AS lower_fence, round(q3 + 1.5::DOUBLE * (q3 - q1), 6) AS upper_fence FROM q""")

CHECK_FEATURES = CHECK_ORDER_ITEMS + CHECK_PRIMARY + """, rv AS (
  SELECT order_id, avg(review_score) AS review_score, bool_or(review_comment_message IS NOT NULL) AS has_review_text
  FROM b_reviews GROUP BY 1),
  fence AS (
  SELECT quantile_cont(order_total_value::DOUBLE, 0.75) + 1.5::DOUBLE * (quantile_cont(order_total_value::DOUBLE, 0.75)
           - quantile_cont(order_total_value::DOUBLE, 0.25)) AS fv,
         quantile_cont(freight_ratio, 0.75) + 1.5::DOUBLE * (quantile_cont(freight_ratio, 0.75)
           - quantile_cont(freight_ratio, 0.25)) AS ff FROM oi),
  feats AS (
  SELECT o.order_id, o.customer_id, o.order_status, o.purchase_ts AS order_purchase_timestamp,
         o.delay_days AS delivery_delay_days, oi.order_total_value::DOUBLE AS order_total_value,
         round(oi.freight_ratio, 8) AS freight_ratio, oi.items_per_order, oi.distinct_sellers_per_order,
         payment_installments_max AS payment_installments, primary_payment_type AS payment_type,
         review_score, has_review_text, c.state AS customer_state, sl.state AS seller_state,
         c.state <> sl.state AS is_interstate_order, p.category AS product_category,
         coalesce(oi.order_total_value::DOUBLE > fv, false) AS is_value_outlier,
         coalesce(oi.freight_ratio > ff, false) AS is_freight_ratio_outlier,
         coalesce(o.delay_days > 8.39::DOUBLE, false) AS is_delay_outlier
  FROM b_delay o LEFT JOIN oi USING (order_id) LEFT JOIN dim_pay USING (order_id) LEFT JOIN rv USING (order_id)
  LEFT JOIN b_customers c USING (customer_id) LEFT JOIN top t ON t.order_id = o.order_id
  LEFT JOIN b_sellers sl ON sl.seller_id = t.seller_id LEFT JOIN b_products p ON p.product_id = t.product_id, fence)"""


def _features(star, **kwargs):
    return features.order_features(star, **kwargs).withColumn("freight_ratio", F.round("freight_ratio", 8))


add("order_features", _features, CHECK_FEATURES + " SELECT * FROM feats")
add("outlier_flags", lambda s: features.order_features(s, delay_fence=None).select(
    "order_id", "is_value_outlier", "is_freight_ratio_outlier", "is_delay_outlier"), CHECK_FEATURES + """,
    d AS (SELECT quantile_cont(delay_days, 0.75) + 1.5::DOUBLE * (quantile_cont(delay_days, 0.75)
                 - quantile_cont(delay_days, 0.25)) AS fd FROM b_delay)
    SELECT order_id, is_value_outlier, is_freight_ratio_outlier,
           coalesce(delivery_delay_days > fd, false) AS is_delay_outlier FROM feats, d""")
FEATURE_COLUMNS = (
    "order_id", "customer_id", "order_status", "order_purchase_timestamp", "delivery_delay_days", "order_total_value",
    "freight_ratio", "items_per_order", "distinct_sellers_per_order", "payment_installments", "payment_type",
    "review_score", "has_review_text", "customer_state", "seller_state", "is_interstate_order", "product_category",
    "is_value_outlier", "is_freight_ratio_outlier", "is_delay_outlier")
add("feature_null_report", lambda s: features.null_report(features.order_features(s)),
    CHECK_FEATURES + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, "
        f"round((count(*) - count({c})) * 100::DOUBLE / count(*), 4) AS null_pct FROM feats" for c in FEATURE_COLUMNS))

# --- shared metric definitions ------------------------------------------------------
add("late_flag", lambda s: s.orders.select("order_id", metrics.late_flag(
    metrics.delay_days(F.col("delivered_ts"), F.col("estimated_ts"))).alias("is_late")),
    "SELECT order_id, is_late FROM b_delay")
add("neg_review_flag", lambda s: s.reviews.select(
    "review_id", "order_id", metrics.neg_review_flag(F.col("review_score")).alias("is_neg_review")),
    "SELECT review_id, order_id, CASE WHEN review_score <= 2 THEN 1 ELSE 0 END AS is_neg_review FROM b_reviews")
add("parse_aspect_literals", lambda s: s.raw("part").select("p_partkey", F.array_join(metrics.parse_aspects(
    F.when(F.col("p_size") < 20, F.concat(F.lit('["'), F.col("p_type"), F.lit("'s\", '"), F.col("p_brand"), F.lit("', None]")))
    .otherwise(F.concat(F.lit(r"['it\'s', 4, "), F.lit('"'), F.col("p_brand"), F.lit('",]')))), "|").alias("aspects")), """
    SELECT p_partkey, CASE WHEN p_size < 20 THEN p_type || '''s|' || p_brand || '|None' ELSE 'it''s|4|' || p_brand END AS aspects
    FROM part""")
add("parse_aspects", lambda s: s.raw("part").select("p_partkey", F.array_join(metrics.parse_aspects(
    F.when(F.col("p_size") < 10, F.concat(F.lit("['"), F.col("p_type"), F.lit("', '"), F.col("p_brand"), F.lit("']")))
    .when(F.col("p_size") < 20, F.col("p_type")).when(F.col("p_size") < 30, F.lit("[]"))
    .when(F.col("p_size") < 40, F.lit("  "))), "|").alias("aspects")), """
    SELECT p_partkey, CASE WHEN p_size < 10 THEN p_type || '|' || p_brand WHEN p_size < 20 THEN p_type
                           ELSE 'Uncategorized' END AS aspects FROM part""")
