"""The batch stages, each from stored tables to stored tables.

``if_missing=True`` leaves tables alone that exist already, so a broken-off run can be
taken up again; otherwise they are overwritten.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.functions.metrics import right_closed_bin
from orderloom.functions.vocabulary import ASPECT_PATTERNS, NO_ASPECT, PRICE_BINS, PRICE_LABELS, SIGNAL_PATTERNS
from orderloom.operators import business, features, grain, modeling, reporting, reviews_text, signals, statistics, topics
from orderloom.session import written
from orderloom.sources import files
from orderloom.sources.tables import MarketplaceStar


def _mode(if_missing: bool) -> str:
    return "ignore" if if_missing else "overwrite"


def build_star(spark: SparkSession, raw_paths: Mapping[str, str], folder: str, if_missing: bool = False) -> MarketplaceStar:
    """Raw CSV files to the eight star tables."""
    files.write_parquet_set(modeling.build_star(files.read_raw_set(spark, raw_paths)), folder, _mode(if_missing))
    return MarketplaceStar(spark, folder)


def build_features(star: MarketplaceStar, if_missing: bool = False) -> DataFrame:
    files.write_parquet_set({"features_orders": features.order_features(star)}, star.folder, _mode(if_missing))
    return star.raw("features_orders")


def score_reviews(
    star: MarketplaceStar, load_scorer: Callable[[], reviews_text.Scorer] | None = None,
    load_encoder: Callable | None = None, stop_words: Sequence[str] | None = None,
    topic_count: int = 8, min_df: int = 5, max_iter: int = 300, if_missing: bool = False,
) -> DataFrame:
    """Sentiment, topics and aspects of all text reviews to ``nlp_reviews`` and ``dim_topics``."""
    stop_words = StopWordsRemover.loadDefaultStopWords("portuguese") if stop_words is None else stop_words
    keys = list(reviews_text.KEYS)
    docs = reviews_text.text_reviews(star.reviews)
    scores = written(reviews_text.score_with_model(
        docs, load_scorer or reviews_text.word_share_scorer()), "sentiment")
    scored = reviews_text.with_aspects(
        reviews_text.with_lexicon_sentiment(docs).join(scores.drop("error"), keys), ASPECT_PATTERNS)
    vectors, names = topics.tfidf_vectors(docs, topics.tfidf_vocabulary(docs, stop_words, min_df=min_df), stop_words)
    factor_topics = topics.nmf_topics(vectors, names, topic_count, max_iter)[0]
    embeddings = topics.encode_with_model(docs, load_encoder) if load_encoder else topics.hashed_embeddings(docs)
    clusters = written(topics.embedding_topics(written(embeddings, "embeddings"), topic_count, keys=keys), "clusters")
    clustered = docs.join(clusters, keys)
    labels = written(topics.topic_labels(
        topics.cluster_terms(clustered, stop_words), clusters.groupBy("topic_id").agg(F.count("*").alias("review_count"))),
        "topic-labels")
    files.write_parquet_set({
        "nlp_reviews": reviews_text.assemble_scored_reviews(scored, factor_topics, clusters, labels),
        "dim_topics": labels}, star.folder, _mode(if_missing))
    return star.raw("nlp_reviews")


REVIEW_PAIRS = {
    "Delivery Delay vs Review Score": ("delay_days", "review_score"),
    "Freight Value vs Review Score": ("freight_value", "review_score"),
    "Price vs Review Score": ("price", "review_score")}
CATEGORY_PAIRS = {
    "Complaint Rate vs Avg Rating": ("neg_review_rate", "avg_review_score"),
    "Negative Sentiment Rate vs Avg Rating": ("neg_sentiment_rate", "avg_review_score")}


def statistical_tests(reviews: DataFrame, categories: DataFrame, category_rows: DataFrame, with_model: bool) -> dict[str, DataFrame]:
    """All tests: the report table, the freight split, the comparison of categories and its extremes."""
    delivered = written(statistics.delivered_totals(reviews), "delivered")
    banded = delivered.withColumn("price_band", right_closed_bin(F.col("price"), PRICE_BINS, PRICE_LABELS))
    reliable = categories.where("confidence = 'HIGH'")
    correlations = statistics.spearman_set(delivered, REVIEW_PAIRS).unionByName(
        statistics.spearman_set(reliable, CATEGORY_PAIRS, x_bounded=True, y_bounded=True))
    return {
        "statistics": reporting.stats_report(
            statistics.spearman_with_p(correlations),
            statistics.mannwhitney_with_p(statistics.mannwhitney_late(delivered), "ontime_n", "late_n"),
            statistics.kruskal_with_p(statistics.kruskal(banded, "price_band", "review_score", bounded=True)),
            statistics.group_means(banded, "price_band", "review_score"),
            statistics.logit_negative_review(delivered) if with_model else None),
        "freight_comparison": statistics.mannwhitney_with_p(statistics.mannwhitney_freight(delivered), "low_n", "high_n"),
        "category_comparison": statistics.kruskal_with_p(statistics.kruskal(
            category_rows.join(reliable.select("category"), "category", "left_semi"), "category", "review_score", bounded=True)),
        "extreme_categories": statistics.extreme_categories(categories),
    }


def analyse(
    star: MarketplaceStar, folder: str, min_category: int = 100, min_seller: int = 30,
    aspects: Sequence[str] = (*ASPECT_PATTERNS, NO_ASPECT), with_model: bool = True,
) -> dict[str, DataFrame]:
    """Group metrics, complaints, tests, exposure, priorities and language signals as CSV tables.

    ``with_model=False`` leaves out the logistic model, which needs delivered reviews of both outcomes.
    """
    categories = written(business.category_metrics(star, min_category), "category-metrics")
    rows = written(grain.review_level_by(star, "category"), "category-rows")
    reviews = written(grain.review_level(star), "review-level")
    # Five tables read the flags: fold and match the texts once.
    flagged = written(signals.flag_signals(reviews_text.text_reviews(star.raw("nlp_reviews"))), "flagged")
    exposure = business.commercial_exposure(reviews)
    results = {
        "agg_category": categories,
        "agg_seller": business.seller_metrics(star, min_seller),
        "agg_state": business.state_metrics(star),
        "agg_monthly": business.monthly_metrics(star),
        "agg_quarterly": business.quarterly_metrics(star),
        "complaint_matrix": business.complaint_matrix(rows, aspects, min_category),
        "complaint_matrix_long": business.complaint_matrix_long(rows),
        "late_by_state": business.late_by(reviews, "state", min_category),
        "aspect_by_lateness": business.aspect_by_lateness(reviews),
        "late_by_category": business.late_by(rows, "category", min_category),
        "commercial_exposure": exposure,
        "exposure_sensitivity": business.exposure_sensitivity(exposure),
        "business_prioritization": business.prioritization(categories),
        "fraud_signals": signals.signals_overall(flagged),
        "fraud_signals_by_type": signals.signals_by_type(flagged, list(SIGNAL_PATTERNS)),
        "fraud_sellers": signals.signal_rank(flagged, star.items, "seller_id", min_seller),
        "fraud_categories": signals.signal_rank(flagged, grain.items_with_category(star), "category", min_category),
        "fraud_examples": signals.signal_examples(flagged, list(SIGNAL_PATTERNS)),
        **statistical_tests(reviews, categories, rows, with_model),
    }
    for name, table in results.items():
        files.write_csv(table, f"{folder}/{name}")
    return results
