"""Report, interactive table and fingerprint queries."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.functions.metrics import right_closed_bin
from orderloom.functions.vocabulary import PRICE_LABELS, SEGMENTS, TOPIC_NAMES
from orderloom.operators import business, explore, fingerprint, grain, quality, reporting, reviews_text, statistics, topics
from orderloom.operators import signals as language
from orderloom.plans.base import Registry
from orderloom.plans.business import (
    ASPECTS, CATEGORY_PAIRS, CHECK_BANDS, CHECK_CATEGORIES, CHECK_GRAIN, CHECK_LATE_TEST, CHECK_LATENESS, CHECK_PRIORITY,
    CHECK_SENSITIVITY, CHECK_STATS, PRICE_BINS, REVIEW_PAIRS, check_chi2, check_kruskal, check_normal, check_spearman_category,
    check_spearman_review, check_student, delivered_reviews, digits, significant, spearman_category, spearman_review,
)
from orderloom.plans.explore import rounded
from orderloom.plans.text import CHECK_SIGNALS, CHECK_TAGS, CHECK_TERMS, SIGNALS, STOP_WORDS, flagged, tagged
from orderloom.session import written
from orderloom.sources.tables import TradeStar

REPORTS = Registry()
add = REPORTS.add


# --- reconciliation -------------------------------------------------------------------
def reconcile(star: TradeStar) -> DataFrame:
    """Report totals against the tables they come from."""
    reviews = written(grain.review_level(star), "review-level")

    def total(df: DataFrame, label: str, column) -> DataFrame:
        return df.agg(column.cast("double").alias("value")).select(F.lit(label).alias("label"), "value")

    exported = quality.union_all([
        total(explore.score_distribution(star.reviews), "total_reviews", F.sum("n")),
        total(business.monthly_metrics(star), "monthly review_count", F.sum("review_count")),
        total(business.state_metrics(star), "state review_count", F.sum("review_count")),
        total(business.category_metrics(star), "category review_count", F.sum("review_count")),
        total(explore.seller_pareto(star.items), "item revenue", F.sum(F.col("total_revenue").cast("decimal(28,4)")))])
    source = quality.union_all([
        total(star.reviews, "total_reviews", F.count("*")),
        total(reviews, "monthly review_count", F.count("*")),
        total(reviews, "state review_count", F.count("*")),
        total(reviews, "category review_count", F.count("*")),
        total(star.items, "item revenue", F.sum(F.col("price") + F.col("freight_value")))])
    result = quality.reconcile(exported, source, {"state review_count": 0.002, "item revenue": 1e-9})
    return result.withColumns({c: F.round(c, 6) for c in ("exported", "source", "rel_diff")})


add("reconcile", reconcile, CHECK_GRAIN + """
    , v AS (
    SELECT 'total_reviews' AS label, (SELECT count(*) FROM b_reviews)::DOUBLE AS e, (SELECT count(*) FROM b_reviews)::DOUBLE AS s, 0::DOUBLE AS tol
    UNION ALL SELECT 'monthly review_count', (SELECT count(*) FROM rl), (SELECT count(*) FROM rl), 0
    UNION ALL SELECT 'state review_count', (SELECT count(*) FROM rl WHERE state IS NOT NULL), (SELECT count(*) FROM rl), 0.002
    UNION ALL SELECT 'category review_count', (SELECT count(*) FROM cat), (SELECT count(*) FROM rl), 0
    UNION ALL SELECT 'item revenue', (SELECT sum(price + freight_value)::DOUBLE FROM b_items), (SELECT sum(price + freight_value)::DOUBLE FROM b_items), 0)
    SELECT label, round(e, 6) AS exported, round(s, 6) AS source, round(abs(e - s) / greatest(abs(s), 1), 6) AS rel_diff,
           abs(e - s) / greatest(abs(s), 1) <= tol AS ok FROM v""")


# --- headlines --------------------------------------------------------------------------
def summary(star: TradeStar) -> DataFrame:
    return reviews_text.aspect_summary(tagged(star))


CHECK_SUMMARY = CHECK_TAGS + """, sm AS (SELECT aspect, count(*) AS total_mentions, count(*) FILTER (WHERE sentiment_label = 'Negative') AS negative,
  count(*) FILTER (WHERE sentiment_label = 'Neutral') AS neutral, count(*) FILTER (WHERE sentiment_label = 'Positive') AS positive FROM tags GROUP BY 1),
rep AS (SELECT *, round(negative * 100::DOUBLE / total_mentions, 1) AS neg_pct, round(positive * 100::DOUBLE / total_mentions, 1) AS pos_pct FROM sm)"""
add("headline_aspects", lambda s: reporting.headline_aspects(summary(s), 2), CHECK_SUMMARY + """
    , n AS (SELECT aspect, total_mentions, negative, neg_pct, round(negative * 100::DOUBLE / sum(negative) OVER (), 1) AS share_of_negative_pct,
              row_number() OVER (ORDER BY negative DESC, aspect) AS c, row_number() OVER (ORDER BY negative::DOUBLE / total_mentions DESC, aspect) AS r
            FROM rep WHERE aspect <> 'Uncategorized')
    SELECT aspect, total_mentions, negative, share_of_negative_pct, neg_pct, c <= 2 AS is_top_by_negative, r = 1 AS is_highest_rate
    FROM n WHERE c <= 2 OR r = 1""")
add("headline_late", lambda s: reporting.headline_late(s.orders), """
    SELECT count(*) AS delivered_orders, count(*) FILTER (WHERE is_late = 1) AS late_orders,
           round(count(*) FILTER (WHERE is_late = 1) * 100::DOUBLE / count(*), 1) AS late_pct FROM b_delay WHERE delivered_ts IS NOT NULL""")


def exposure(star: TradeStar) -> DataFrame:
    return business.commercial_exposure(grain.review_level(star))


add("headline_exposure", lambda s: reporting.headline_exposure(exposure(s), business.exposure_sensitivity(exposure(s))),
    CHECK_SENSITIVITY + """ SELECT affected_order_value, affected_orders,
        (SELECT exposure FROM sens WHERE impact_pct = 5) AS at_pct_exposure FROM ex""")


def priorities(star: TradeStar) -> DataFrame:
    return business.prioritization(business.category_metrics(star))


add("act_first", lambda s: reporting.act_first(priorities(s)), CHECK_PRIORITY + f"""
    SELECT category, round(hc.neg_sentiment_rate, 4) AS neg_sentiment_rate, hc.review_count, count(*) OVER () AS segment_size
    FROM prio JOIN hc USING (category) WHERE segment = '{SEGMENTS[0]}' ORDER BY hc.neg_sentiment_rate DESC, category LIMIT 5""")

# --- report tables ----------------------------------------------------------------------
CHECK_CATEGORY_REPORT = CHECK_CATEGORIES + """, crep AS (
  SELECT category, review_count, round(avg_review_score, 3) AS avg_review_score, round(neg_review_rate, 4) AS neg_review_rate,
         round(neg_sentiment_rate, 4) AS neg_sentiment_rate, round(avg_item_price, 2) AS avg_item_price, round(avg_freight, 2) AS avg_freight,
         round(late_delivery_rate, 4) AS late_delivery_rate, coalesce(top_complaint_aspect, '') AS top_complaint_topic, confidence,
         review_count < 100 AS low_n FROM cmx)"""


def categories(star: TradeStar) -> DataFrame:
    return reporting.category_report(business.category_metrics(star))


add("category_report", categories, CHECK_CATEGORY_REPORT + " SELECT * FROM crep")
add("complaint_heatmap", lambda s: reporting.complaint_heatmap(grain.review_level_by(s, "category"), ASPECTS), CHECK_GRAIN + """
    , big AS (SELECT category, count(*) AS review_count FROM cat GROUP BY 1 HAVING count(*) >= 100 ORDER BY 2 DESC, 1 LIMIT 20)
    SELECT category, max(review_count) AS review_count, """ + ", ".join(
    f"""coalesce(round(avg(is_neg_sentiment) FILTER (WHERE aspect = '{a}') * 100, 1), 0) AS "{a}" """ for a in ASPECTS if a != "Uncategorized") + """
    FROM big JOIN cat USING (category) JOIN b_aspects USING (order_id) GROUP BY 1""")
add("unexpected_aspects", lambda s: reporting.unexpected_aspects(s.scored_reviews, ("Returned", "Uncategorized")), """
    SELECT aspect, count(*) AS mentions FROM b_aspects JOIN b_scored USING (order_id) WHERE aspect NOT IN ('Returned', 'Uncategorized') GROUP BY 1""")


def delivery_tables(star: TradeStar) -> DataFrame:
    reviews = written(grain.review_level(star), "review-level")
    return reporting.delivery_report(
        business.late_by(reviews, "state"), business.late_by(grain.review_level_by(star, "category"), "category"),
        business.aspect_by_lateness(reviews), business.monthly_metrics(star))


add("delivery_report", delivery_tables, CHECK_LATENESS + """
    , st AS (SELECT state AS name, count(*) AS n, avg(is_late) AS r FROM rl WHERE is_late IS NOT NULL AND state IS NOT NULL GROUP BY 1
             HAVING count(*) >= 100 ORDER BY r DESC, 1 LIMIT 10),
    ct AS (SELECT category AS name, count(*) AS n, avg(is_late) AS r FROM cat WHERE is_late IS NOT NULL GROUP BY 1
           HAVING count(*) >= 100 ORDER BY r DESC, 1 LIMIT 10),
    mo AS (SELECT order_month AS name, count(*) AS n, avg(is_neg_sentiment) AS r FROM rl GROUP BY 1)
    SELECT 'state_late_rates' AS section, name, 'late_rate_pct' AS metric, round(r * 100, 2) AS value FROM st
    UNION ALL SELECT 'state_late_rates', name, 'review_count', n::DOUBLE FROM st
    UNION ALL SELECT 'category_late_rates', name, 'late_rate_pct', round(r * 100, 2) FROM ct
    UNION ALL SELECT 'category_late_rates', name, 'review_count', n::DOUBLE FROM ct
    UNION ALL SELECT 'aspect_by_delivery', aspect, 'on_time', on_time::DOUBLE FROM al
    UNION ALL SELECT 'aspect_by_delivery', aspect, 'late', late::DOUBLE FROM al
    UNION ALL SELECT 'monthly_trends', name, 'review_count', n::DOUBLE FROM mo
    UNION ALL SELECT 'monthly_trends', name, 'neg_sentiment_rate', round(r, 4) FROM mo""")
add("sensitivity_report", lambda s: reporting.sensitivity_report(business.exposure_sensitivity(exposure(s))),
    CHECK_SENSITIVITY + " SELECT impact_pct, impact_pct::INT || '% impact assumption' AS label, exposure FROM sens")
CHECK_PRIORITY_REPORT = CHECK_PRIORITY + """, prep AS (
  SELECT category, segment, round(hc.neg_sentiment_rate, 4) AS neg_sentiment_rate, round(hc.neg_review_rate, 4) AS neg_review_rate,
         round(hc.total_value, 2) AS total_value, hc.review_count, hc.review_count < 100 AS low_n FROM prio JOIN hc USING (category))"""


def priority_report(star: TradeStar) -> DataFrame:
    return reporting.prioritization_report(priorities(star))


add("prioritization_report", priority_report, CHECK_PRIORITY_REPORT + " SELECT * FROM prep")


def statistics_tables(star: TradeStar, odds: bool = False) -> DataFrame:
    delivered = written(delivered_reviews(star), "delivered")
    banded = delivered.withColumn("price_band", right_closed_bin(F.col("price"), PRICE_BINS, PRICE_LABELS))
    correlations = statistics.spearman_set(delivered, REVIEW_PAIRS).unionByName(spearman_category(star))
    report = reporting.stats_report(
        statistics.spearman_with_p(correlations),
        statistics.mannwhitney_with_p(statistics.mannwhitney_late(delivered), "ontime_n", "late_n"),
        statistics.kruskal_with_p(statistics.kruskal(banded, "price_band", "review_score", bounded=True)),
        statistics.group_means(banded, "price_band", "review_score"),
        statistics.logit_negative_review(delivered) if odds else None)
    return significant(rounded(rounded(report, "mean"), "statistic", digits=5))


add("stats_report", statistics_tables, CHECK_BANDS + """
    , hi AS (SELECT category, avg(is_neg_review) AS neg_review_rate, avg(is_neg_sentiment) AS neg_sentiment_rate,
                    avg(review_score) AS avg_review_score FROM cat GROUP BY 1 HAVING count(*) >= 100)""" + f"""
    , sp AS ({check_spearman_review('corr(rx, ry)')} UNION ALL {check_spearman_category('corr(rx, ry)')})
    """ + CHECK_LATE_TEST[len(CHECK_STATS):] + check_kruskal("pb", "*").replace("SELECT * FROM kw", "") + f""", rep AS (
    SELECT 'correlations' AS section, pair AS name, rho AS statistic, n, NULL AS mean, {check_student('rho', 'n')} AS p_value FROM sp
    UNION ALL SELECT 'ontime_vs_late', 'Mann-Whitney U', u, ontime_n + late_n, NULL, {check_normal('ontime_n', 'late_n')} FROM mw
    UNION ALL SELECT 'ontime_vs_late', 'on time', NULL, ontime_n, ontime_mean, NULL FROM mw
    UNION ALL SELECT 'ontime_vs_late', 'late', NULL, late_n, late_mean, NULL FROM mw
    UNION ALL SELECT 'price_bands', 'Kruskal-Wallis H', h, n_rows, NULL, {check_chi2('h', 'n_groups')} FROM kw
    UNION ALL SELECT 'price_bands', g, NULL, count(*), avg(score), NULL FROM pb WHERE g IS NOT NULL GROUP BY g)
    SELECT section, name, round(statistic::DOUBLE, 5) AS statistic, n, round(mean::DOUBLE, 6) AS mean, {digits('p_value')} AS p_value, NULL::DOUBLE AS odds_ratio,
           CASE WHEN p_value = 0 THEN '< 1e-300' ELSE printf('%.2e', p_value) END AS p_label, p_value < 0.05 AS significant FROM rep""")
add("stats_report_odds", lambda s: statistics_tables(s, odds=True))
add("aspect_report", lambda s: reporting.aspect_report(summary(s)), CHECK_SUMMARY + " SELECT * FROM rep")


def topic_tables(star: TradeStar) -> DataFrame:
    """Topics of all scored reviews; their terms come from the texts of the same orders."""
    scored = star.scored_reviews.select("order_id", "topic_id")
    terms = topics.cluster_terms(star.text_reviews.join(scored, "order_id"), STOP_WORDS, top=10)
    ranked = terms.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("r"))  # ten a topic
    sizes = scored.groupBy("topic_id").agg(F.count("*").alias("review_count"))
    found = sizes.join(ranked.select("topic_id", F.col("r.term").alias("representative_terms")), "topic_id", "left")
    return reporting.topic_report(topics.topic_dimension(found)).withColumn("top_terms", F.array_join("top_terms", ", "))


add("topic_report", topic_tables, CHECK_TERMS + ", names AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{n}')" for i, n in TOPIC_NAMES.items()) + """) t(topic_id, label)),
    placed AS (SELECT topic_id, term FROM terms JOIN b_text ON doc = review_id JOIN b_scored USING (order_id)),
    c AS (SELECT topic_id, term, count(*) AS tf FROM placed GROUP BY 1, 2),
    voc AS (SELECT term, count(*) AS df FROM c GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 5000),
    nc AS (SELECT count(DISTINCT topic_id) AS n FROM b_text JOIN b_scored USING (order_id)),
    raw2 AS (SELECT topic_id, term, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS raw FROM c JOIN voc USING (term), nc),
    sc AS (SELECT topic_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY topic_id)), 9) AS score FROM raw2),
    rk AS (SELECT topic_id, term, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, term) AS rank FROM sc QUALIFY rank <= 10),
    tt AS (SELECT topic_id, string_agg(term, ', ' ORDER BY rank) AS top_terms FROM rk GROUP BY 1),
    sz AS (SELECT topic_id, count(*) AS review_count FROM b_scored GROUP BY 1)
    SELECT topic_id, label, review_count, top_terms FROM sz JOIN names USING (topic_id) LEFT JOIN tt USING (topic_id)""")
add("score_histogram", lambda s: reporting.score_histogram(s.reviews),
    "SELECT review_score, count(*) AS n FROM b_reviews GROUP BY 1")
add("signals_report", lambda s: reporting.signals_report(language.signals_by_type(flagged(s), list(SIGNALS)).withColumn(
    "patterns", F.lit("kept out of the report"))), CHECK_SIGNALS + " UNION ALL ".join(f"""
    SELECT '{n}' AS signal, count(*) FILTER (WHERE "{n}") AS reviews, round(avg(review_score) FILTER (WHERE "{n}"), 2) AS avg_review_score,
           round(count(*) FILTER (WHERE "{n}" AND sentiment_label = 'Negative') * 100::DOUBLE / count(*) FILTER (WHERE "{n}"), 1) AS negative_sentiment_pct
    FROM sg""" for n in SIGNALS))

# --- interactive tables ------------------------------------------------------------------
add("category_filter", lambda s: reporting.category_filter(categories(s), "HIGH", False),
    CHECK_CATEGORY_REPORT + " SELECT * FROM crep WHERE confidence = 'HIGH' AND NOT low_n")
add("category_search_sort", lambda s: reporting.category_search(categories(s), " RAND#1", "avg_item_price", False),
    CHECK_CATEGORY_REPORT + " SELECT * FROM crep WHERE contains(lower(category), 'rand#1')")
add("top15_complaint", lambda s: reporting.top_complaints(categories(s)).withColumn(
    "negative_pct", F.round("negative_pct", 4)), CHECK_CATEGORY_REPORT + """
    SELECT category, upper(category[1]) || category[2:] AS name, round(neg_sentiment_rate * 100, 4) AS negative_pct
    FROM crep WHERE NOT low_n ORDER BY neg_sentiment_rate DESC, category LIMIT 15""")
add("price_vs_complaint", lambda s: reporting.price_vs_complaint(categories(s)).withColumn(
    "negative_pct", F.round("negative_pct", 4)), CHECK_CATEGORY_REPORT + """
    SELECT upper(category[1]) || category[2:] AS name, avg_item_price, round(neg_sentiment_rate * 100, 4) AS negative_pct, review_count
    FROM crep WHERE NOT low_n""")
add("monthly_reliable", lambda s: reporting.monthly_reliable(business.monthly_metrics(s), 185).withColumn(
    "neg_pct", F.round("neg_pct", 6)), CHECK_GRAIN + """
    SELECT order_month, count(*) AS review_count, count(*) >= 185 AS reliable,
           CASE WHEN count(*) >= 185 THEN round(avg(is_neg_sentiment) * 100, 6) END AS neg_pct FROM rl GROUP BY 1""")
add("aspect_late_share", lambda s: reporting.aspect_late_share(business.aspect_by_lateness(grain.review_level(s))).withColumn(
    "late_share", F.round("late_share", 6)), CHECK_LATENESS + """
    SELECT aspect, on_time, late, total, round(late * 100::DOUBLE / total, 6) AS late_share FROM al WHERE aspect <> 'Uncategorized'""")
add("aspect_rankings", lambda s: reporting.aspect_rankings(reporting.aspect_report(summary(s))), CHECK_SUMMARY + """
    SELECT aspect, total_mentions, negative AS negative_mentions, neg_pct, row_number() OVER (ORDER BY negative DESC, aspect)::INT AS rank_by_mentions,
           round(negative * 100::DOUBLE / sum(negative) OVER (), 1) AS share_of_negative_pct,
           row_number() OVER (ORDER BY neg_pct DESC, aspect)::INT AS rank_by_rate FROM rep WHERE aspect <> 'Uncategorized'""")
add("reliable_categories", lambda s: reporting.reliable_categories(categories(s)),
    CHECK_CATEGORY_REPORT + " SELECT * EXCLUDE (low_n, confidence) FROM crep WHERE NOT low_n")
add("segment_order", lambda s: reporting.segment_order(priority_report(s)), CHECK_PRIORITY_REPORT + f"""
    SELECT *, row_number() OVER (ORDER BY list_position({list(SEGMENTS)}, segment), neg_sentiment_rate DESC, category)::INT AS position FROM prep""")
add("correlation_split", lambda s: reporting.correlation_split(
    spearman_review(s).unionByName(spearman_category(s))).select("pair", "n", "level"), CHECK_STATS + ", cp AS (" + " UNION ALL ".join(
    [f"SELECT '{p}' AS pair, (SELECT count(*) FROM dr) AS n" for p in REVIEW_PAIRS]
    + [f"SELECT '{p}', (SELECT count(*) FROM cmx WHERE confidence = 'HIGH')" for p in CATEGORY_PAIRS])
    + ") SELECT pair, n, CASE WHEN n > 1000 THEN 'review' ELSE 'category' END AS level FROM cp")
add("rate_step", lambda s: business.category_metrics(s).select(
    "category", reporting.rate_step(F.col("late_delivery_rate"), 0.1, 0.3).alias("step")), CHECK_CATEGORIES + """
    SELECT category, (4 - round(least(1::DOUBLE, greatest(0::DOUBLE, (late_delivery_rate - 0.1::DOUBLE) / (0.3::DOUBLE - 0.1::DOUBLE))) * 4))::INT AS step FROM cmx""")
add("state_names", lambda s: reporting.with_state_names(
    business.state_metrics(s).select("state", "review_count"), {"NATION_1": "First", "NATION_2": "Second"}), CHECK_GRAIN + """
    SELECT state, count(*) AS review_count, CASE state WHEN 'NATION_1' THEN 'First' WHEN 'NATION_2' THEN 'Second' ELSE state END AS state_name
    FROM rl WHERE state IS NOT NULL GROUP BY 1""")
add("dataset_facts", lambda s: reporting.dataset_facts({
    "orders": (s.orders, F.count("*")), "unique_customers": (s.customers, F.count_distinct("customer_unique_id")),
    "order_items": (s.items, F.count("*")), "reviews": (s.reviews, F.count("*")),
    "text_reviews": (s.text_reviews, F.count("*")), "products": (s.products, F.count("*")),
    "sellers": (s.sellers, F.count("*")), "delivered_orders": (s.orders, F.count("delivered_ts")),
}, s.raw("region").agg(F.count("*"))), """
    SELECT (SELECT count(*) FROM b_orders) AS orders, (SELECT count(DISTINCT customer_unique_id) FROM b_customers) AS unique_customers,
           (SELECT count(*) FROM b_items) AS order_items, (SELECT count(*) FROM b_reviews) AS reviews, (SELECT count(*) FROM b_text) AS text_reviews,
           (SELECT count(*) FROM b_products) AS products, (SELECT count(*) FROM b_sellers) AS sellers,
           (SELECT count(delivered_ts) FROM b_orders) AS delivered_orders""")

# --- fingerprints ------------------------------------------------------------------------
FINGERPRINTED = {
    "region": "r_name string, r_regionkey int",
    "nation": "n_name string, n_nationkey int, n_regionkey int",
    "customer": "c_acctbal double, c_custkey bigint, c_mktsegment string, c_name string, c_nationkey int",
    "supplier": "s_acctbal double, s_name string, s_nationkey int, s_suppkey bigint",
    "part": "p_brand string, p_name string, p_partkey bigint, p_retailprice double, p_size int, p_type string",
    "orders": "o_custkey bigint, o_orderdate timestamp_ntz, o_orderkey bigint, o_orderpriority string, o_orderstatus string, "
              "o_totalprice double",
    "lineitem": "l_discount double, l_extendedprice double, l_linenumber int, l_linestatus string, l_orderkey bigint, "
                "l_partkey bigint, l_quantity double, l_returnflag string, l_shipdate timestamp_ntz, l_suppkey bigint, l_tax double",
    "events": "event_id bigint, event_type string, props string, ts timestamp_ntz, user_id bigint, value double",
    "documents": "doc_id bigint, lang string, n_chars bigint, source string, text string",
    "embeddings": "embedding array<float>, label int, vec_id bigint",
    "pages": "html string, page_id bigint, url string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, role string, text string, turn bigint",
}


def check_double(x: str) -> str:
    g = f"floor(log2(abs({x})))"
    h = f"floor({g} / 2)"
    scaled = f"(abs({x}) / pow(2.0::DOUBLE, {h}) / pow(2.0::DOUBLE, {g} - {h}))"
    fix = f"(CASE WHEN {scaled} >= 2 THEN 1 WHEN {scaled} < 1 THEN -1 ELSE 0 END)"
    sign = f"CASE WHEN {x} < 0 THEN '-' ELSE '' END"
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN isnan({x}) THEN 'nan' WHEN isinf({x}) THEN {sign} || 'inf' "
            f"WHEN {x} = 0 THEN CASE WHEN ({x})::VARCHAR LIKE '-%' THEN '-0' ELSE '0' END ELSE {sign} || "
            f"({scaled} / pow(2.0::DOUBLE, {fix}) * pow(2.0::DOUBLE, 52))::BIGINT || 'p' || ({g}::INT + {fix}) END")


def check_framed(text: str) -> str:
    return f"coalesce(length({text}) || ':' || {text}, '~')"


def check_cell(name: str, kind: str) -> str:
    if kind == "double":
        return check_double(name)
    if kind == "timestamp_ntz":
        return f"epoch_us({name})::VARCHAR"
    if kind == "array<float>":
        return f"'[' || array_to_string(list_transform({name}, lambda x : {check_framed(check_double('x::DOUBLE'))}), '') || ']'"
    return f"{name}::VARCHAR"


def check_fingerprint(table: str, source: str | None = None) -> str:
    fields = [f.split(" ") for f in FINGERPRINTED[table].split(", ")]
    cells = ", ".join(check_framed(f"({check_cell(*f)})") for f in fields)
    layout = hashlib.sha256(",".join(" ".join(f) for f in fields).encode()).hexdigest()[:16]
    sums = " || '-' || ".join(
        f"coalesce(sum(('0x' || substr(d, {16 * k + 1}, 16))::UBIGINT), 0)::VARCHAR" for k in range(4))
    return (f"SELECT '{table}' AS name, count(*) AS rows, {sums} || '-{layout}' AS fingerprint "
            f"FROM (SELECT sha256(concat({cells})) AS d FROM {source or table})")


add("table_fingerprint", lambda s: fingerprint.manifest({t: s.raw(t) for t in FINGERPRINTED}),
    " UNION ALL ".join(check_fingerprint(t) for t in FINGERPRINTED))


def fingerprint_diff(star: TradeStar) -> DataFrame:
    """The recorded set against tables of which one was edited, one removed and one added."""
    recorded = fingerprint.manifest({t: star.raw(t) for t in ("nation", "orders", "supplier")})
    edited = star.raw("supplier").withColumn(
        "s_acctbal", F.col("s_acctbal") + F.when(F.col("s_suppkey") == 7, 0.01).otherwise(0.0))
    current = fingerprint.manifest({"nation": star.raw("nation").repartition(3), "supplier": edited, "region": star.raw("region")})
    return fingerprint.manifest_differences(recorded, current)


add("fingerprint_diff", fingerprint_diff, """SELECT name, CASE WHEN name = 'nation' AND (SELECT count(*) FROM nation) > 0 THEN 'unchanged'
    WHEN name = 'supplier' AND (SELECT count(*) FROM supplier WHERE s_suppkey = 7) > 0 THEN 'modified' WHEN name = 'orders' THEN 'missing' ELSE 'untracked' END AS status
    FROM (VALUES ('nation'), ('orders'), ('supplier'), ('region')) t(name)""")
