"""Exploratory summary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.functions.metrics import delay_days
from orderloom.operators import explore, modeling
from orderloom.plans.base import Registry
from orderloom.plans.tables import CHECK_PRIMARY
from orderloom.sources.tables import TradeStar

EXPLORE = Registry()
add = EXPLORE.add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def day_text(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("string"))


add("monthly_volume", lambda s: explore.monthly_volume(s.orders),
    "SELECT strftime(purchase_ts, '%Y-%m') AS order_month, count(*) AS order_count FROM b_orders GROUP BY 1")
# The orders have no empty month, so every third month's are moved a decade on first.
add("month_gaps", lambda s: explore.month_gaps(s.orders.withColumn("purchase_ts", F.when(
    F.month("purchase_ts") % 3 == 0, F.col("purchase_ts") + F.expr("INTERVAL 10 YEARS")).otherwise(F.col("purchase_ts")))), """
    , m AS (SELECT DISTINCT date_trunc('month', CASE WHEN month(purchase_ts) % 3 = 0 THEN purchase_ts + INTERVAL 10 YEAR
                                                ELSE purchase_ts END)::DATE AS m FROM b_orders),
    span AS (SELECT unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH))::DATE AS m FROM m)
    SELECT strftime(m, '%Y-%m') AS missing_month FROM span WHERE m NOT IN (SELECT m FROM m)""")
add("weekly_volume", lambda s: day_text(explore.weekly_volume(s.orders), "week_start"),
    "SELECT date_trunc('week', purchase_ts)::DATE::VARCHAR AS week_start, count(*) AS order_count FROM b_orders GROUP BY 1")
add("weekly_anomalies", lambda s: rounded(day_text(explore.weekly_anomalies(s.orders), "week_start"), "weekly_mean", "weekly_std"), """
    , w AS (SELECT date_trunc('week', purchase_ts)::DATE AS week_start, count(*) AS order_count FROM b_orders GROUP BY 1),
    m AS (SELECT avg(order_count) AS am, stddev_samp(order_count) AS sd FROM w)
    SELECT week_start::VARCHAR AS week_start, order_count, round(am, 6) AS weekly_mean, round(sd, 6) AS weekly_std FROM w, m
    WHERE abs(order_count - am) > 2 * sd""")

PERCENTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def measure_table(star: TradeStar) -> DataFrame:
    """Price, freight, order payment, delivery delay and seller revenue in long form."""
    return explore.measures(
        price=(star.items, "price"),
        freight_value=(star.items, "freight_value"),
        total_payment_value=(modeling.payments_by_order(star.payments_raw), "total_payment_value"),
        delivery_delay_days=(explore.with_delay(star.orders), "delay_days"),
        seller_revenue=(explore.seller_totals(star.items), "total_revenue"))


CHECK_MEASURES = CHECK_PRIMARY + """, long AS (
  SELECT 'price' AS measure, price::DOUBLE AS value FROM b_items
  UNION ALL SELECT 'freight_value', freight_value::DOUBLE FROM b_items
  UNION ALL SELECT 'total_payment_value', total_payment_value::DOUBLE FROM dim_pay
  UNION ALL SELECT 'delivery_delay_days', delay_days FROM b_delay WHERE delay_days IS NOT NULL
  UNION ALL SELECT 'seller_revenue', sum(price + freight_value)::DOUBLE FROM b_items GROUP BY seller_id)"""
P_NAMES = [f"p{int(round(p * 100)):02d}" for p in PERCENTILES]
add("describe_percentiles", lambda s: rounded(rounded(
    explore.describe(measure_table(s), PERCENTILES), "mean", "std", digits=4), *P_NAMES), CHECK_MEASURES + """
    SELECT measure, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
           min(value) AS min, max(value) AS max, """ + ", ".join(
    f"round(quantile_cont(value, {p}), 6) AS {n}" for p, n in zip(PERCENTILES, P_NAMES)) + " FROM long GROUP BY 1")

add("revenue_by_category", lambda s: rounded(explore.revenue_by_category(s.items, s.products), "pct_revenue"), """
    , g AS (SELECT category, sum(price + freight_value) AS rev, count(DISTINCT order_id) AS order_count, count(*) AS item_count
            FROM b_items JOIN b_products USING (product_id) WHERE category IS NOT NULL GROUP BY 1)
    SELECT category, rev::DOUBLE AS total_revenue, order_count, item_count,
           round(rev::DOUBLE * 100 / (sum(rev) OVER ())::DOUBLE, 6) AS pct_revenue
    FROM g ORDER BY rev DESC, category LIMIT 20""")
add("revenue_by_state", lambda s: rounded(explore.revenue_by_state(s.items, s.orders, s.customers), "pct_revenue"), """
    , g AS (SELECT state, sum(price + freight_value) AS rev, count(DISTINCT order_id) AS order_count
            FROM b_items JOIN b_orders USING (order_id) JOIN b_customers USING (customer_id) WHERE state IS NOT NULL GROUP BY 1)
    SELECT state, rev::DOUBLE AS total_revenue, order_count,
           round(rev::DOUBLE * 100 / (sum(rev) OVER ())::DOUBLE, 6) AS pct_revenue FROM g""")
add("revenue_by_payment_type", lambda s: rounded(
    explore.revenue_by_payment_type(modeling.payments_by_order(s.payments_raw)), "pct_payment"), CHECK_PRIMARY + """
    , g AS (SELECT primary_payment_type, sum(total_payment_value) AS total, count(*) AS order_count FROM dim_pay GROUP BY 1)
    SELECT primary_payment_type, total::DOUBLE AS total_payment, order_count,
           round(total::DOUBLE * 100 / (sum(total) OVER ())::DOUBLE, 6) AS pct_payment FROM g""")
add("delivery_summary", lambda s: rounded(explore.delivery_summary(s.orders), "on_time_pct", "late_pct"), """
    SELECT count(*) AS total_orders, count(delivered_ts) AS delivered, count(*) - count(delivered_ts) AS undelivered,
           count(*) FILTER (WHERE delay_days <= 0) AS on_time, count(*) FILTER (WHERE delay_days > 0) AS late,
           round(count(*) FILTER (WHERE delay_days <= 0) * 100::DOUBLE / count(delivered_ts), 6) AS on_time_pct,
           round(count(*) FILTER (WHERE delay_days > 0) * 100::DOUBLE / count(delivered_ts), 6) AS late_pct FROM b_delay""")
add("delay_rate_by_state", lambda s: rounded(explore.delay_rate_by_state(s.orders, s.customers), "delay_rate_pct"), """
    SELECT state, count(*) AS total_orders, count(*) FILTER (WHERE delay_days > 0) AS late_orders,
           round(count(*) FILTER (WHERE delay_days > 0) * 100::DOUBLE / count(*), 6) AS delay_rate_pct
    FROM b_delay JOIN b_customers USING (customer_id) WHERE delivered_ts IS NOT NULL AND state IS NOT NULL GROUP BY 1""")
add("delay_rate_by_category", lambda s: rounded(
    explore.delay_rate_by_category(s.orders, s.items, s.products), "delay_rate_pct"), """
    , g AS (SELECT category, count(*) AS total_items, count(*) FILTER (WHERE delay_days > 0) AS late_items
            FROM b_delay JOIN b_items USING (order_id) JOIN b_products USING (product_id)
            WHERE delivered_ts IS NOT NULL AND category IS NOT NULL GROUP BY 1 HAVING count(*) >= 50)
    SELECT *, round(late_items * 100::DOUBLE / total_items, 6) AS delay_rate_pct FROM g
    ORDER BY late_items * 100::DOUBLE / total_items DESC, category LIMIT 20""")
add("score_distribution", lambda s: rounded(
    explore.score_distribution(s.reviews), "pct", "mean_score", "std_score"), """
    SELECT review_score, count(*) AS n, round(count(*) * 100::DOUBLE / (SELECT count(*) FROM b_reviews), 6) AS pct,
           round((SELECT avg(review_score) FROM b_reviews), 6) AS mean_score,
           (SELECT median(review_score)::DOUBLE FROM b_reviews) AS median_score,
           round((SELECT stddev_samp(review_score) FROM b_reviews), 6) AS std_score FROM b_reviews GROUP BY 1""")
add("score_by_category", lambda s: rounded(
    explore.score_by_category(s.reviews, s.items, s.products), "mean_score"), """
    , first_item AS (SELECT order_id, product_id FROM b_items
       QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY item_id, product_id, seller_id) = 1),
    g AS (SELECT category, avg(review_score) AS m, median(review_score)::DOUBLE AS median_score, count(*) AS review_count
          FROM b_reviews JOIN first_item USING (order_id) JOIN b_products USING (product_id)
          WHERE category IS NOT NULL GROUP BY 1 HAVING count(*) >= 30)
    SELECT * FROM (SELECT category, round(m, 6) AS mean_score, median_score, review_count, 'bottom' AS edge FROM g ORDER BY m, category LIMIT 15)
    UNION ALL SELECT * FROM (SELECT category, round(m, 6), median_score, review_count, 'top' FROM g ORDER BY m DESC, category DESC LIMIT 15)""")
add("score_by_delay_bucket", lambda s: rounded(
    explore.score_by_delay_bucket(s.reviews, s.orders, (-30.0, 0.0, 365.0, 1000.0)),
    "mean_score", "std_score", "pct_score_1", "pct_score_5"), """
    , b AS (SELECT review_score AS s, CASE WHEN delay_days <= -30 THEN '7+ days early' WHEN delay_days <= 0 THEN '0-7 days early'
              WHEN delay_days <= 365 THEN '1-7 days late' WHEN delay_days <= 1000 THEN '8-14 days late' ELSE '15+ days late' END AS delay_bucket
            FROM b_reviews JOIN b_delay USING (order_id) WHERE delivered_ts IS NOT NULL)
    SELECT delay_bucket, round(avg(s), 6) AS mean_score, median(s)::DOUBLE AS median_score, round(stddev_samp(s), 6) AS std_score,
           count(*) AS review_count, round(count(*) FILTER (WHERE s = 1) * 100::DOUBLE / count(*), 6) AS pct_score_1,
           round(count(*) FILTER (WHERE s = 5) * 100::DOUBLE / count(*), 6) AS pct_score_5 FROM b GROUP BY 1""")
add("score_ontime_late", lambda s: rounded(explore.score_ontime_late(s.reviews, s.orders), "mean_score"), """
    SELECT delay_days <= 0 AS on_time, round(avg(review_score), 6) AS mean_score, median(review_score)::DOUBLE AS median_score,
           count(*) AS review_count FROM b_reviews JOIN b_delay USING (order_id) WHERE delivered_ts IS NOT NULL GROUP BY 1""")
add("orders_by_state_cum", lambda s: rounded(
    explore.orders_by_state(s.orders, s.customers), "pct", "cumulative_pct"), """
    , g AS (SELECT state, count(*) AS order_count FROM b_orders JOIN b_customers USING (customer_id) WHERE state IS NOT NULL GROUP BY 1)
    SELECT state, order_count, round(order_count * 100::DOUBLE / sum(order_count) OVER (), 6) AS pct,
           round((sum(order_count) OVER (ORDER BY order_count DESC, state ROWS UNBOUNDED PRECEDING)) * 100::DOUBLE / sum(order_count) OVER (), 6) AS cumulative_pct FROM g""")
add("top_cities", lambda s: rounded(explore.top_cities(s.orders, s.customers), "pct"), """
    , g AS (SELECT state, city, count(*) AS order_count FROM b_orders JOIN b_customers USING (customer_id) GROUP BY 1, 2)
    SELECT state, city, order_count, round(order_count * 100::DOUBLE / (SELECT sum(order_count) FROM g), 6) AS pct
    FROM g ORDER BY order_count DESC, state, city LIMIT 20""")
add("geo_coverage", lambda s: rounded(explore.geo_coverage(
    s.customers, s.geolocation_raw.withColumn("zip_code_prefix", F.col("zip_code_prefix") * 2)), "covered_pct"), """
    , k AS (SELECT DISTINCT zip_code_prefix * 2 AS zip_code_prefix FROM b_geo)
    SELECT count(*)::BIGINT AS customers, count(*) FILTER (WHERE zip_code_prefix IN (FROM k)) AS covered_customers,
           count(DISTINCT zip_code_prefix) AS customer_zips, (SELECT count(*) FROM k) AS geo_zips,
           round(count(*) FILTER (WHERE zip_code_prefix IN (FROM k)) * 100::DOUBLE / count(*), 6) AS covered_pct FROM b_customers""")

CHECK_PARETO = """, t AS (
  SELECT seller_id, count(DISTINCT order_id) AS order_count, count(*) AS item_count, sum(price + freight_value) AS rev
  FROM b_items GROUP BY 1),
  par AS (
  SELECT seller_id, order_count, item_count, rev::DOUBLE AS total_revenue,
         rev::DOUBLE * 100 / (sum(rev) OVER ())::DOUBLE AS pct_revenue,
         (sum(rev) OVER w)::DOUBLE * 100 / (sum(rev) OVER ())::DOUBLE AS cum_pct_revenue,
         order_count * 100::DOUBLE / (sum(order_count) OVER ()) AS pct_orders,
         (sum(order_count) OVER w) * 100::DOUBLE / (sum(order_count) OVER ()) AS cum_pct_orders
  FROM t WINDOW w AS (ORDER BY rev DESC, seller_id ROWS UNBOUNDED PRECEDING))"""
PARETO_SHARES = ("pct_revenue", "cum_pct_revenue", "pct_orders", "cum_pct_orders")
add("seller_pareto", lambda s: rounded(explore.seller_pareto(s.items), *PARETO_SHARES), CHECK_PARETO + """
    SELECT seller_id, order_count, item_count, total_revenue, """ + ", ".join(
    f"round({c}, 6) AS {c}" for c in PARETO_SHARES) + " FROM par")
add("seller_concentration", lambda s: rounded(explore.seller_concentration(
    explore.seller_pareto(s.items)), "pct_sellers_revenue", "pct_sellers_orders"), CHECK_PARETO + """
    , h AS (SELECT unnest([50::DOUBLE, 80::DOUBLE, 90::DOUBLE]) AS threshold_pct),
    c AS (SELECT threshold_pct, count(*) FILTER (WHERE cum_pct_revenue <= threshold_pct) + 1 AS r,
                 count(*) FILTER (WHERE cum_pct_orders <= threshold_pct) + 1 AS o, count(*) AS n FROM par, h GROUP BY 1)
    SELECT threshold_pct, r AS sellers_for_revenue, o AS sellers_for_orders,
           round(r * 100::DOUBLE / n, 6) AS pct_sellers_revenue, round(o * 100::DOUBLE / n, 6) AS pct_sellers_orders FROM c""")

FENCE_COLUMNS = ("q1", "q3", "iqr", "lower_fence", "upper_fence")
add("iqr_outlier_report", lambda s: rounded(explore.iqr_outlier_report(
    measure_table(s).where("measure <> 'seller_revenue'")), *FENCE_COLUMNS), CHECK_MEASURES + """
    , q AS (SELECT measure, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM long
            WHERE measure <> 'seller_revenue' GROUP BY 1),
    f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5::DOUBLE * (q3 - q1) AS lo, q3 + 1.5::DOUBLE * (q3 - q1) AS hi FROM q),
    r AS (SELECT measure, value, row_number() OVER (PARTITION BY measure ORDER BY value DESC) AS r FROM long),
    t AS (SELECT measure, """ + ", ".join(f"max(value) FILTER (WHERE r = {i}) AS top_{i}" for i in range(1, 6)) + """
          FROM r GROUP BY 1),
    c AS (SELECT measure, count(*) AS n, count(*) FILTER (WHERE value < lo) AS low_outliers,
                 count(*) FILTER (WHERE value > hi) AS high_outliers, min(value) AS min, max(value) AS max
          FROM long JOIN f USING (measure) GROUP BY 1)
    SELECT measure, round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr, round(lo, 6) AS lower_fence,
           round(hi, 6) AS upper_fence, n, low_outliers, high_outliers, min, max, top_1, top_2, top_3, top_4, top_5
    FROM f JOIN c USING (measure) JOIN t USING (measure)""")
add("histogram_clipped", lambda s: explore.histogram_clipped(s.orders, -900, 900, 90), """
    SELECT least(floor((least(greatest(delay_days, -900), 900) + 900) / 20) + 1, 90)::BIGINT AS bin,
           -900 + (least(floor((least(greatest(delay_days, -900), 900) + 900) / 20) + 1, 90) - 1) * 20::DOUBLE AS bin_start,
           count(*) AS n FROM b_delay WHERE delivered_ts IS NOT NULL GROUP BY 1, 2""")
add("boxplot_stats", lambda s: rounded(explore.boxplot_stats(s.orders), "q1", "median", "q3"), """
    , q AS (SELECT quantile_cont(delay_days, 0.25) AS q1, median(delay_days) AS med, quantile_cont(delay_days, 0.75) AS q3 FROM b_delay)
    SELECT min(delay_days) AS whisker_low, max(delay_days) AS whisker_high, round(min(q1), 6) AS q1, round(min(med), 6) AS median,
           round(min(q3), 6) AS q3 FROM b_delay, q
    WHERE delay_days BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)""")
