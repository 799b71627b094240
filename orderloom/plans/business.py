"""Review-grain, business and statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.functions.metrics import right_closed_bin
from orderloom.functions.vocabulary import PRICE_LABELS
from orderloom.operators import business, grain, statistics
from orderloom.plans.base import Registry
from orderloom.plans.explore import rounded
from orderloom.session import written
from orderloom.sources.tables import TradeStar

BUSINESS = Registry()
add = BUSINESS.add

ASPECTS = ("Returned", "Large quantity", "High tax", "Uncategorized")
PRICE_BINS = (0.0, 100_000.0, 200_000.0, 400_000.0)

CHECK_GRAIN = """, rh AS (
  SELECT r.*, o.is_late, o.delay_days, c.state, strftime(o.purchase_ts, '%Y-%m') AS order_month,
         year(o.purchase_ts) || 'Q' || quarter(o.purchase_ts) AS order_quarter,
         CASE WHEN review_score <= 2 THEN 1 ELSE 0 END AS is_neg_review,
         CASE WHEN sentiment_label = 'Negative' THEN 1 ELSE 0 END AS is_neg_sentiment
  FROM b_scored r JOIN b_delay o USING (order_id) LEFT JOIN b_customers c USING (customer_id)),
ic AS (SELECT i.*, coalesce(category, 'unknown') AS category FROM b_items i LEFT JOIN b_products USING (product_id)),
ov AS (SELECT order_id, sum(price) AS op, sum(freight_value) AS ofr, sum(price + freight_value) AS order_value,
              count(*) AS n_items FROM b_items GROUP BY 1),
rl AS (SELECT rh.*, op, ofr, order_value, n_items, order_value AS item_value, (op::DOUBLE / n_items)::DECIMAL(24,8) AS avg_item_price,
              (ofr::DOUBLE / n_items)::DECIMAL(24,8) AS avg_freight FROM rh JOIN ov USING (order_id)),
cat AS (SELECT rh.*, order_value, category, item_value, avg_item_price, avg_freight FROM rh JOIN ov USING (order_id)
        JOIN (SELECT order_id, category, sum(price + freight_value) AS item_value, (sum(price)::DOUBLE / count(*))::DECIMAL(24,8) AS avg_item_price,
                     (sum(freight_value)::DOUBLE / count(*))::DECIMAL(24,8) AS avg_freight FROM ic GROUP BY 1, 2) g USING (order_id)),
prod AS (SELECT rh.*, order_value, product_id, item_value, avg_item_price, avg_freight FROM rh JOIN ov USING (order_id)
        JOIN (SELECT order_id, product_id, sum(price + freight_value) AS item_value, (sum(price)::DOUBLE / count(*))::DECIMAL(24,8) AS avg_item_price,
                     (sum(freight_value)::DOUBLE / count(*))::DECIMAL(24,8) AS avg_freight FROM ic GROUP BY 1, 2) g USING (order_id)),
sel AS (SELECT rh.*, order_value, seller_id, item_value, avg_item_price, avg_freight FROM rh JOIN ov USING (order_id)
        JOIN (SELECT order_id, seller_id, sum(price + freight_value) AS item_value, (sum(price)::DOUBLE / count(*))::DECIMAL(24,8) AS avg_item_price,
                     (sum(freight_value)::DOUBLE / count(*))::DECIMAL(24,8) AS avg_freight FROM ic GROUP BY 1, 2) g USING (order_id))"""

MEASURES = """count(*) AS review_count, avg(review_score) AS avg_review_score,
  avg(is_neg_review) AS neg_review_rate, avg(is_neg_sentiment) AS neg_sentiment_rate,
  sum(order_value)::DOUBLE / count(*) AS avg_order_value, sum(avg_item_price)::DOUBLE / count(*) AS avg_item_price,
  sum(avg_freight)::DOUBLE / count(*) AS avg_freight, avg(is_late) AS late_delivery_rate,
  count(is_late) AS delivered_reviews, sum(item_value)::DOUBLE AS total_item_value"""

CHECK_CATEGORIES = CHECK_GRAIN + f""", tt AS (
  SELECT category, topic_label AS top_topic FROM (SELECT category, topic_label, count(*) AS n FROM cat GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, topic_label) = 1),
ta AS (
  SELECT category, aspect AS top_complaint_aspect FROM (
    SELECT category, aspect, count(*) AS n FROM cat JOIN b_aspects USING (order_id)
    WHERE is_neg_sentiment = 1 AND aspect <> 'Uncategorized' GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, aspect) = 1),
cm AS (SELECT category, {MEASURES} FROM cat GROUP BY 1),
cmx AS (SELECT cm.*, top_topic, top_complaint_aspect, CASE WHEN review_count >= 100 THEN 'HIGH' ELSE 'LOW-N' END AS confidence
  FROM cm JOIN tt USING (category) LEFT JOIN ta USING (category))"""


def money(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


# --- grains ---------------------------------------------------------------------------
add("review_item_fact", lambda s: money(
    grain.review_item_fact(s).drop("extracted_aspects"), "price", "freight_value", "item_value"), CHECK_GRAIN + """
    SELECT review_id, order_id, review_score, sentiment_label, topic_label, is_late, delay_days, state, order_month,
           order_quarter, is_neg_review, is_neg_sentiment, item_id, product_id, seller_id, category,
           price::DOUBLE AS price, freight_value::DOUBLE AS freight_value, (price + freight_value)::DOUBLE AS item_value
    FROM rh JOIN ic USING (order_id)""")
add("review_level", lambda s: money(grain.review_level(s).drop("extracted_aspects"),
                                    "order_items_price", "order_freight", "order_value"), CHECK_GRAIN + """
    SELECT review_id, order_id, review_score, sentiment_label, topic_label, is_late, delay_days, state, order_month,
           order_quarter, is_neg_review, is_neg_sentiment, op::DOUBLE AS order_items_price, ofr::DOUBLE AS order_freight,
           order_value::DOUBLE AS order_value, n_items FROM rl""")
for key, table in (("category", "cat"), ("product_id", "prod"), ("seller_id", "sel")):
    add(f"review_level_by_{key.removesuffix('_id')}", lambda s, k=key: rounded(money(
        grain.review_level_by(s, k).select(k, "review_id", "order_id", "item_value", "order_value", "avg_item_price", "avg_freight"),
        "item_value", "order_value", "avg_item_price", "avg_freight"), "avg_item_price", "avg_freight"), CHECK_GRAIN + f"""
        SELECT {key}, review_id, order_id, item_value::DOUBLE AS item_value, order_value::DOUBLE AS order_value,
               round(avg_item_price::DOUBLE, 6) AS avg_item_price, round(avg_freight::DOUBLE, 6) AS avg_freight FROM {table}""")
add("sample_size_buckets", business.sample_size_buckets, CHECK_GRAIN + """
    , p AS (SELECT count(*) AS n FROM prod GROUP BY product_id), c AS (SELECT count(*) AS n FROM cat GROUP BY category)
    SELECT 'product' AS level, '1 review' AS bucket, count(*) FILTER (WHERE n = 1) AS groups FROM p
    UNION ALL SELECT 'product', '2-9', count(*) FILTER (WHERE n BETWEEN 2 AND 9) FROM p
    UNION ALL SELECT 'product', '10-29', count(*) FILTER (WHERE n BETWEEN 10 AND 29) FROM p
    UNION ALL SELECT 'product', '30+', count(*) FILTER (WHERE n >= 30) FROM p
    UNION ALL SELECT 'category', '<30', count(*) FILTER (WHERE n < 30) FROM c
    UNION ALL SELECT 'category', '30-99', count(*) FILTER (WHERE n BETWEEN 30 AND 99) FROM c
    UNION ALL SELECT 'category', '100+', count(*) FILTER (WHERE n >= 100) FROM c""")
add("misleading_example", lambda s: rounded(business.misleading_example(s, 20, 25, 0.30, 0.45).withColumn(
    "neg_rate", F.col("neg_rate")), "neg_rate"), CHECK_GRAIN + """
    , p AS (SELECT product_id, count(*) AS n_reviews, avg(is_neg_review) AS neg_rate FROM prod GROUP BY 1)
    SELECT * FROM (SELECT product_id, n_reviews, round(neg_rate, 6) AS neg_rate, 'low N' AS example FROM p
                   WHERE n_reviews <= 20 AND neg_rate = 1 ORDER BY product_id LIMIT 1)
    UNION ALL SELECT * FROM (SELECT product_id, n_reviews, round(neg_rate, 6), 'high N' FROM p
                   WHERE n_reviews >= 25 AND neg_rate BETWEEN 0.30::DOUBLE AND 0.45::DOUBLE ORDER BY product_id LIMIT 1)""")

# --- group metrics --------------------------------------------------------------------
add("group_metrics", lambda s: grain.group_metrics(
    grain.review_level_by(s, "product_id"), "product_id"),
    CHECK_GRAIN + f" SELECT product_id, {MEASURES} FROM prod GROUP BY 1")
add("category_metrics", lambda s: business.category_metrics(s), CHECK_CATEGORIES + " SELECT * FROM cmx")
add("seller_metrics", lambda s: business.seller_metrics(s), CHECK_GRAIN + f"""
    , m AS (SELECT seller_id, {MEASURES} FROM sel GROUP BY 1)
    SELECT *, CASE WHEN review_count >= 30 THEN 'HIGH' ELSE 'LOW-N' END AS confidence FROM m""")
add("state_metrics", lambda s: business.state_metrics(s),
    CHECK_GRAIN + f" SELECT state, {MEASURES} FROM rl WHERE state IS NOT NULL GROUP BY 1")
add("monthly_metrics", lambda s: business.monthly_metrics(s),
    CHECK_GRAIN + f" SELECT order_month, {MEASURES} FROM rl GROUP BY 1")
add("quarterly_metrics", lambda s: business.quarterly_metrics(s),
    CHECK_GRAIN + f" SELECT order_quarter, {MEASURES} FROM rl GROUP BY 1")
add("top_topic", lambda s: business.top_topic(grain.review_level_by(s, "category")),
    CHECK_CATEGORIES + " SELECT * FROM tt")
add("top_complaint_aspect", lambda s: business.top_complaint_aspect(grain.review_level_by(s, "category")),
    CHECK_CATEGORIES + " SELECT * FROM ta")
add("confidence_flag", lambda s: business.category_metrics(s).select("category", "review_count", "confidence"),
    CHECK_CATEGORIES + " SELECT category, review_count, confidence FROM cmx")
add("complaint_matrix_long", lambda s: rounded(business.complaint_matrix_long(
    grain.review_level_by(s, "category")), "complaint_rate"), CHECK_GRAIN + """
    SELECT category, aspect, count(*) AS mention_count, sum(is_neg_sentiment)::BIGINT AS neg_count,
           round(sum(is_neg_sentiment)::DOUBLE / count(*), 6) AS complaint_rate
    FROM cat JOIN b_aspects USING (order_id) GROUP BY 1, 2""")
add("complaint_matrix", lambda s: rounded(business.complaint_matrix(
    grain.review_level_by(s, "category"), ASPECTS), *ASPECTS), CHECK_GRAIN + """
    SELECT category, """ + ", ".join(
    f"""coalesce(round(avg(is_neg_sentiment) FILTER (WHERE aspect = '{a}'), 6), 0) AS "{a}" """ for a in ASPECTS) + """
    FROM cat JOIN b_aspects USING (order_id)
    WHERE category IN (SELECT category FROM cat GROUP BY 1 HAVING count(*) >= 100) GROUP BY 1""")

# --- statistics -----------------------------------------------------------------------


def delivered_reviews(star: TradeStar) -> DataFrame:
    """One row per delivered review with order totals as doubles."""
    return statistics.delivered_totals(grain.review_level(star))


CHECK_STATS = CHECK_CATEGORIES + """, dr AS (
  SELECT review_score AS score, is_late, delay_days, is_neg_review, op::DOUBLE AS price, ofr::DOUBLE AS freight FROM rl
  WHERE delay_days IS NOT NULL)"""


def check_rank(column: str, table: str = "dr") -> str:
    return (f"(rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2::DOUBLE)")


def check_rho(label: str, x: str, y: str, table: str, rho: str = "round(corr(rx, ry), 6)") -> str:
    return f"""SELECT '{label}' AS pair, {rho} AS rho, count(*) AS n
      FROM (SELECT {check_rank(x)} AS rx, {check_rank(y)} AS ry FROM {table})"""


def check_tail(density: str, start: str, scale: float = 10.0, points: int = 200_000) -> str:
    """Integral of ``density`` (over y) from ``start`` up by the midpoint rule on y = start + scale v / (1 - v)."""
    v = f"((k + 0.5) / {points})"
    return (f"list_sum(list_transform(range({points}), lambda k: "
            f"{density.replace('[y]', f'({start} + {scale} * {v} / (1 - {v}))')} * {scale} / ((1 - {v}) * (1 - {v})) / {points}))")


def digits(p: str) -> str:
    return f"CAST(printf('%.4e', CAST({p} AS DOUBLE)) AS DOUBLE)"


def check_student(rho: str, n: str) -> str:
    df = f"({n} - 2)"
    density = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0) - ({df} + 1) / 2.0 * ln(1 + [y] * [y] / {df})) / sqrt({df} * pi())"
    return "2 * " + check_tail(density, f"(abs({rho}) * sqrt({df} / (1 - {rho} * {rho})))", 1.0)


def check_normal(n1: str, n2: str) -> str:
    n = f"({n1} + {n2})::DOUBLE"
    z = f"((u - {n1}::DOUBLE * {n2} / 2 - 0.5) / sqrt({n1}::DOUBLE * {n2} / 12 * (({n} + 1) - tie_sum / ({n} * ({n} - 1)))))"
    tail = check_tail("exp(-[y] * [y] / 2) / sqrt(2 * pi())", f"abs({z})", 1.0)
    return f"CASE WHEN {z} >= 0 THEN {tail} ELSE 1 - {tail} END"


def check_chi2(h: str, groups: str) -> str:
    a = f"(({groups} - 1) / 2.0)"
    return check_tail(f"exp(({a} - 1) * ln([y] / 2) - [y] / 2 - lgamma({a})) / 2", h)


def significant(df: DataFrame) -> DataFrame:
    """p-values to five significant digits."""
    return df.withColumn("p_value", F.when(F.col("p_value").isNotNull(), F.format_string("%.4e", "p_value").cast("double")))


REVIEW_PAIRS = {
    "Delivery Delay vs Review Score": ("delay_days", "review_score"),
    "Freight Value vs Review Score": ("freight_value", "review_score"),
    "Price vs Review Score": ("price", "review_score"),
}
CATEGORY_PAIRS = {
    "Complaint Rate vs Avg Rating": ("neg_review_rate", "avg_review_score"),
    "Negative Sentiment Rate vs Avg Rating": ("neg_sentiment_rate", "avg_review_score"),
}


def spearman_review(star: TradeStar) -> DataFrame:
    return statistics.spearman_set(delivered_reviews(star), REVIEW_PAIRS)


def spearman_category(star: TradeStar) -> DataFrame:
    reliable = business.category_metrics(star).where("confidence = 'HIGH'")
    return statistics.spearman_set(reliable, CATEGORY_PAIRS, x_bounded=True, y_bounded=True)


def check_spearman_review(rho: str = "round(corr(rx, ry), 6)") -> str:
    return " UNION ALL ".join([
        check_rho("Delivery Delay vs Review Score", "delay_days", "score", "dr", rho),
        check_rho("Freight Value vs Review Score", "freight", "score", "dr", rho),
        check_rho("Price vs Review Score", "price", "score", "dr", rho)])


def check_spearman_category(rho: str = "round(corr(rx, ry), 6)") -> str:
    return " UNION ALL ".join([
        check_rho("Complaint Rate vs Avg Rating", "neg_review_rate", "avg_review_score", "hi", rho),
        check_rho("Negative Sentiment Rate vs Avg Rating", "neg_sentiment_rate", "avg_review_score", "hi", rho)])


CHECK_RELIABLE = CHECK_STATS + """
    , hi AS (SELECT category, avg(is_neg_review) AS neg_review_rate, avg(is_neg_sentiment) AS neg_sentiment_rate,
                    avg(review_score) AS avg_review_score FROM cat GROUP BY 1 HAVING count(*) >= 100) """
CHECK_LATE_TEST = CHECK_STATS + f"""
    , mr AS (SELECT *, {check_rank('score')} AS rk FROM dr),
    mt AS (SELECT sum(t::DOUBLE ** 3 - t) AS tie_sum FROM (SELECT count(*) AS t FROM dr GROUP BY score)),
    mw AS (SELECT count(*) FILTER (WHERE is_late = 0) AS ontime_n, count(*) FILTER (WHERE is_late = 1) AS late_n,
           round(avg(score) FILTER (WHERE is_late = 0), 6) AS ontime_mean, round(avg(score) FILTER (WHERE is_late = 1), 6) AS late_mean,
           sum(rk) FILTER (WHERE is_late = 0) - count(*) FILTER (WHERE is_late = 0) * (count(*) FILTER (WHERE is_late = 0) + 1) / 2::DOUBLE AS u,
           (SELECT tie_sum FROM mt) AS tie_sum, round(avg(is_neg_review) FILTER (WHERE is_late = 0), 6) AS ontime_neg_review_rate,
           round(avg(is_neg_review) FILTER (WHERE is_late = 1), 6) AS late_neg_review_rate FROM mr)"""
CHECK_FREIGHT_TEST = CHECK_STATS + f"""
    , m AS (SELECT median(freight) AS mf FROM dr), mr AS (SELECT *, freight <= mf AS low, {check_rank('score')} AS rk FROM dr, m),
    mt AS (SELECT sum(t::DOUBLE ** 3 - t) AS tie_sum FROM (SELECT count(*) AS t FROM dr GROUP BY score)),
    mw AS (SELECT count(*) FILTER (WHERE low) AS low_n, count(*) FILTER (WHERE NOT low) AS high_n,
           round(avg(score) FILTER (WHERE low), 6) AS low_mean, round(avg(score) FILTER (WHERE NOT low), 6) AS high_mean,
           sum(rk) FILTER (WHERE low) - count(*) FILTER (WHERE low) * (count(*) FILTER (WHERE low) + 1) / 2::DOUBLE AS u,
           (SELECT tie_sum FROM mt) AS tie_sum, round(min(mf), 6) AS median_freight FROM mr)"""
add("spearman_review", lambda s: rounded(spearman_review(s), "rho"), CHECK_STATS + " " + check_spearman_review())
add("spearman_category", lambda s: rounded(spearman_category(s), "rho"), CHECK_RELIABLE + check_spearman_category())
add("mannwhitney_late", lambda s: rounded(statistics.mannwhitney_late(delivered_reviews(s)),
    "ontime_mean", "late_mean", "ontime_neg_review_rate", "late_neg_review_rate"), CHECK_LATE_TEST + " SELECT * FROM mw")
add("mannwhitney_freight", lambda s: rounded(statistics.mannwhitney_freight(delivered_reviews(s)),
    "low_mean", "high_mean", "median_freight"), CHECK_FREIGHT_TEST + " SELECT * FROM mw")


def price_banded(star: TradeStar) -> DataFrame:
    return delivered_reviews(star).withColumn(
        "price_band", right_closed_bin(F.col("price"), PRICE_BINS, PRICE_LABELS))


CHECK_BANDS = CHECK_STATS + """, pb AS (SELECT score, CASE WHEN price <= 0 THEN NULL WHEN price <= 100000 THEN '<50'
    WHEN price <= 200000 THEN '50-150' WHEN price <= 400000 THEN '150-500' ELSE '>500' END AS g FROM dr)"""


def check_kruskal(table: str, select: str = "n_groups, n_rows, round(h, 5) AS h") -> str:
    return f"""
    , kr AS (SELECT g, score, {check_rank('score')} AS rk FROM {table} WHERE g IS NOT NULL),
    kt AS (SELECT sum(t::DOUBLE ** 3 - t) AS tie_sum FROM (SELECT count(*) AS t FROM kr GROUP BY score)),
    ks AS (SELECT g, count(*)::DOUBLE AS n, sum(rk) AS rs FROM kr GROUP BY 1),
    kk AS (SELECT count(*) AS n_groups, sum(n)::BIGINT AS n_rows, sum(n) AS nn, sum(rs * rs / n) AS ss FROM ks),
    kw AS (SELECT n_groups, n_rows, (12 / (nn * (nn + 1)) * ss - 3 * (nn + 1)) / (1 - tie_sum / (nn ** 3 - nn)) AS h FROM kk, kt)
    SELECT {select} FROM kw"""


add("kruskal_price_bands", lambda s: rounded(
    statistics.kruskal(price_banded(s), "price_band", "review_score", bounded=True), "h", digits=5), CHECK_BANDS + check_kruskal("pb"))
add("price_band_scores", lambda s: rounded(statistics.group_means(
    price_banded(s), "price_band", "review_score"), "mean"), CHECK_BANDS + """
    SELECT g AS price_band, count(*) AS n, round(avg(score), 6) AS mean FROM pb WHERE g IS NOT NULL GROUP BY 1""")


def reliable_category_scores(star: TradeStar, rows: DataFrame | None = None) -> DataFrame:
    rows = (grain.review_level_by(star, "category") if rows is None else rows).select("category", "review_score")
    enough = rows.groupBy("category").agg(F.count("*").alias("n")).where("n >= 100").select("category")
    return rows.join(enough, "category", "left_semi")


CHECK_CATEGORY_SCORES = CHECK_STATS + """
    , cg AS (SELECT category AS g, review_score AS score FROM cat
             WHERE category IN (SELECT category FROM cat GROUP BY 1 HAVING count(*) >= 100))"""
add("kruskal_categories", lambda s: rounded(
    statistics.kruskal(reliable_category_scores(s), "category", "review_score", bounded=True), "h", digits=5),
    CHECK_CATEGORY_SCORES + check_kruskal("cg"))
add("extreme_categories", lambda s: rounded(
    statistics.extreme_categories(business.category_metrics(s)), "avg_review_score", "neg_review_rate"), CHECK_CATEGORIES + """
    , hi AS (SELECT category, count(*) AS review_count, avg(review_score) AS a, avg(is_neg_review) AS r FROM cat GROUP BY 1 HAVING count(*) >= 100)
    SELECT * FROM (SELECT category, review_count, round(a, 6) AS avg_review_score, round(r, 6) AS neg_review_rate, 'top' AS side FROM hi ORDER BY a DESC, category LIMIT 5)
    UNION ALL SELECT * FROM (SELECT category, review_count, round(a, 6), round(r, 6), 'bottom' FROM hi ORDER BY a, category LIMIT 5)""")
add("logit_negative_review", lambda s: statistics.logit_negative_review(delivered_reviews(s)))
CHECK_RHO_P = f"SELECT pair, round(rho, 6) AS rho, n, {digits(check_student('rho', 'n'))} AS p_value FROM sp"
H_WITH_P = f"n_groups, n_rows, round(h, 5) AS h, {digits(check_chi2('h', 'n_groups'))} AS p_value"
add("spearman_p_values", lambda s: significant(rounded(statistics.spearman_with_p(spearman_review(s)), "rho")),
    CHECK_STATS + f", sp AS ({check_spearman_review('corr(rx, ry)')}) {CHECK_RHO_P}")
add("spearman_category_p_values", lambda s: significant(rounded(statistics.spearman_with_p(spearman_category(s)), "rho")),
    CHECK_RELIABLE + f", sp AS ({check_spearman_category('corr(rx, ry)')}) {CHECK_RHO_P}")
add("mannwhitney_p_value", lambda s: significant(rounded(statistics.mannwhitney_with_p(
    statistics.mannwhitney_late(delivered_reviews(s)), "ontime_n", "late_n"),
    "ontime_mean", "late_mean", "ontime_neg_review_rate", "late_neg_review_rate")),
    CHECK_LATE_TEST + f" SELECT *, {digits(check_normal('ontime_n', 'late_n'))} AS p_value FROM mw")
add("mannwhitney_freight_p_value", lambda s: significant(rounded(statistics.mannwhitney_with_p(
    statistics.mannwhitney_freight(delivered_reviews(s)), "low_n", "high_n"), "low_mean", "high_mean", "median_freight")),
    CHECK_FREIGHT_TEST + f" SELECT *, {digits(check_normal('low_n', 'high_n'))} AS p_value FROM mw")
add("kruskal_categories_p_value", lambda s: significant(rounded(statistics.kruskal_with_p(
    statistics.kruskal(reliable_category_scores(s), "category", "review_score", bounded=True)), "h", digits=5)),
    CHECK_CATEGORY_SCORES + check_kruskal("cg", H_WITH_P))
add("kruskal_p_value", lambda s: significant(rounded(statistics.kruskal_with_p(
    statistics.kruskal(price_banded(s), "price_band", "review_score", bounded=True)), "h", digits=5)),
    CHECK_BANDS + check_kruskal("pb", H_WITH_P))

# --- delivery, exposure, priorities ----------------------------------------------------
add("late_by_category", lambda s: rounded(business.late_by(
    grain.review_level_by(s, "category"), "category"), "late_rate"), CHECK_GRAIN + """
    SELECT category, count(*) AS n, round(avg(is_late), 6) AS late_rate FROM cat WHERE is_late IS NOT NULL GROUP BY 1
    HAVING count(*) >= 100 ORDER BY avg(is_late) DESC, category LIMIT 10""")
add("late_by_state", lambda s: rounded(business.late_by(grain.review_level(s), "state"), "late_rate"), CHECK_GRAIN + """
    SELECT state, count(*) AS n, round(avg(is_late), 6) AS late_rate FROM rl WHERE is_late IS NOT NULL AND state IS NOT NULL
    GROUP BY 1 HAVING count(*) >= 100 ORDER BY avg(is_late) DESC, state LIMIT 10""")
CHECK_LATENESS = CHECK_GRAIN + """, al AS (
  SELECT aspect, count(*) FILTER (WHERE is_late = 0) AS on_time, count(*) FILTER (WHERE is_late = 1) AS late, count(*) AS total,
         round(count(*) FILTER (WHERE is_late = 1) * 100::DOUBLE / count(*), 1) AS late_share
  FROM rl JOIN b_aspects USING (order_id) WHERE is_late IS NOT NULL AND is_neg_sentiment = 1 GROUP BY 1)"""
add("aspect_by_lateness", lambda s: business.aspect_by_lateness(grain.review_level(s)), CHECK_LATENESS + " SELECT * FROM al")
CHECK_EXPOSURE = CHECK_GRAIN + """, ex AS (
  SELECT sum(v)::DOUBLE AS affected_order_value, count(*) AS affected_orders
  FROM (SELECT order_id, max(order_value) AS v FROM rl WHERE is_neg_sentiment = 1 GROUP BY 1))"""
add("commercial_exposure", lambda s: business.commercial_exposure(grain.review_level(s)), CHECK_EXPOSURE + " SELECT * FROM ex")
CHECK_SENSITIVITY = CHECK_EXPOSURE + """, sens AS (
  SELECT impact_pct, round(affected_order_value * impact_pct / 100, 2) AS exposure
  FROM ex, (SELECT unnest([1::DOUBLE, 2, 5, 10, 15, 20]) AS impact_pct))"""
add("exposure_sensitivity", lambda s: business.exposure_sensitivity(
    business.commercial_exposure(grain.review_level(s))), CHECK_SENSITIVITY + " SELECT * FROM sens")
CHECK_PRIORITY = CHECK_CATEGORIES + """, hc AS (
  SELECT category, count(*) AS review_count, avg(is_neg_review) AS neg_review_rate, avg(is_neg_sentiment) AS neg_sentiment_rate,
         sum(order_value)::DOUBLE / count(*) AS avg_order_value, sum(item_value)::DOUBLE AS total_value
  FROM cat GROUP BY 1 HAVING count(*) >= 100),
md AS (SELECT median(neg_sentiment_rate) AS mr, median(total_value) AS mv FROM hc),
prio AS (SELECT category, review_count, round(neg_review_rate, 6) AS neg_review_rate, round(neg_sentiment_rate, 6) AS neg_sentiment_rate,
         round(avg_order_value, 6) AS avg_order_value, total_value, round(mr, 6) AS median_neg_sentiment_rate, mv AS median_total_value,
         CASE WHEN neg_sentiment_rate > mr THEN 'HIGH' ELSE 'LOW' END || ' Risk + ' ||
         CASE WHEN total_value > mv THEN 'HIGH' ELSE 'LOW' END || ' Exposure' AS segment FROM hc, md)"""
PRIORITY_RATES = ("neg_review_rate", "neg_sentiment_rate", "avg_order_value", "median_neg_sentiment_rate")
add("prioritization", lambda s: rounded(
    business.prioritization(business.category_metrics(s)), *PRIORITY_RATES), CHECK_PRIORITY + " SELECT * FROM prio")


def stage_metrics_bundle(star: TradeStar) -> DataFrame:
    """The results as one JSON document; every part is a small aggregated table."""
    reviews = written(grain.review_level(star), "review-level")
    delivered = written(statistics.delivered_totals(reviews), "delivered")
    banded = delivered.withColumn("price_band", right_closed_bin(F.col("price"), PRICE_BINS, PRICE_LABELS))
    # Five parts read the rows by category: joined once, from the written review rows.
    by_category = written(grain.review_level_by(star, "category", reviews), "category-rows")
    by_product = grain.review_level_by(star, "product_id", reviews)
    categories = written(business.category_metrics(star, rows=by_category), "categories")
    exposure = business.commercial_exposure(reviews)
    parts = {
        "review_level_rows": reviews.agg(F.count("*").alias("v")),
        "sample_sizes": business.sample_size_buckets(star, {"category": by_category, "product_id": by_product}),
        "correlations": statistics.spearman_with_p(statistics.spearman_set(delivered, REVIEW_PAIRS)),
        "category_correlations": statistics.spearman_with_p(statistics.spearman_set(
            categories.where("confidence = 'HIGH'"), CATEGORY_PAIRS, x_bounded=True, y_bounded=True)),
        "ontime_vs_late": statistics.mannwhitney_with_p(statistics.mannwhitney_late(delivered), "ontime_n", "late_n"),
        "freight": statistics.mannwhitney_with_p(statistics.mannwhitney_freight(delivered), "low_n", "high_n"),
        "price_bands": statistics.kruskal_with_p(statistics.kruskal(banded, "price_band", "review_score", bounded=True)),
        "price_band_scores": statistics.group_means(banded, "price_band", "review_score"),
        "category_comparison": statistics.kruskal_with_p(statistics.kruskal(
            reliable_category_scores(star, by_category), "category", "review_score", bounded=True)),
        "extreme_categories": statistics.extreme_categories(categories),
        "logit": statistics.logit_negative_review(delivered),
        "late_states": business.late_by(reviews, "state"),
        "late_categories": business.late_by(by_category, "category"),
        "aspect_by_delivery": business.aspect_by_lateness(reviews),
        "exposure": exposure,
        "sensitivity": business.exposure_sensitivity(exposure),
        "prioritization": business.prioritization(categories),
    }
    columns = []
    for name, df in parts.items():
        rows = df.select(F.struct("*").alias("r")).agg(F.sort_array(F.collect_list("r")).alias("rows"))
        columns.append(rows.scalar().alias(name))
    head = star.raw("region").agg(F.count("*").alias("_n"))
    return head.select(*columns).select(F.to_json(F.struct("*")).alias("document"))


add("stage_metrics_bundle", stage_metrics_bundle)
