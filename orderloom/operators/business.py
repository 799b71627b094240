"""Category, seller, state and period metrics, complaints, exposure and priorities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.metrics import confidence, share_pct
from orderloom.functions.vocabulary import IMPACT_PERCENTS, NO_ASPECT, SEGMENTS
from orderloom.operators import grain
from orderloom.operators.quality import union_all
from orderloom.sources.tables import Star


def sample_size_buckets(star: Star, rows: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """How many products and categories fall into each review-count bucket.

    ``rows``: per key the rows of ``review_level_by``, where they are already written.
    """
    n = F.col("n_reviews")
    buckets = {
        "product": ("product_id", [("1 review", n == 1), ("2-9", (n >= 2) & (n < 10)),
                                   ("10-29", (n >= 10) & (n < 30)), ("30+", n >= 30)]),
        "category": ("category", [("<30", n < 30), ("30-99", (n >= 30) & (n < 100)), ("100+", n >= 100)]),
    }
    parts = []
    for level, (key, cases) in buckets.items():
        found = (rows or {}).get(key)
        sizes = (grain.review_level_by(star, key) if found is None else found).groupBy(key).agg(F.count("*").alias("n_reviews"))
        counted = sizes.agg(*[F.count_if(test).alias(name) for name, test in cases])
        parts.append(counted.unpivot([], [name for name, _ in cases], "bucket", "groups").withColumn(
            "level", F.lit(level)))
    return union_all(parts)


def misleading_example(
    star: Star, low_max: int = 2, high_min: int = 50, rate_low: float = 0.15, rate_high: float = 0.30
) -> DataFrame:
    """A product whose few reviews are all negative beside one with many; no row when absent."""
    per_product = grain.review_level_by(star, "product_id").groupBy("product_id").agg(
        F.count("*").alias("n_reviews"), F.avg("is_neg_review").alias("neg_rate"))
    rate = F.col("neg_rate")
    low = per_product.where((F.col("n_reviews") <= low_max) & (rate == 1.0)).orderBy("product_id").limit(1)
    high = per_product.where((F.col("n_reviews") >= high_min) & rate.between(rate_low, rate_high)) \
        .orderBy("product_id").limit(1)
    return low.withColumn("example", F.lit("low N")).unionByName(high.withColumn("example", F.lit("high N")))


def top_topic(rows: DataFrame, key: str = "category") -> DataFrame:
    """Most frequent topic per group, the smaller label on a tie."""
    counts = rows.groupBy(key, "topic_label").agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(
        F.min_by("topic_label", F.struct(-F.col("n"), F.col("topic_label"))).alias("top_topic"))


def aspect_rows(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode("extracted_aspects").alias("aspect"))


def top_complaint_aspect(rows: DataFrame, key: str = "category") -> DataFrame:
    """Most frequent aspect among negative reviews per group, without the fallback."""
    counts = aspect_rows(rows.where("is_neg_sentiment = 1"), key).where(F.col("aspect") != NO_ASPECT) \
        .groupBy(key, "aspect").agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(
        F.min_by("aspect", F.struct(-F.col("n"), F.col("aspect"))).alias("top_complaint_aspect"))


def category_metrics(star: Star, min_reviews: int = 100, rows: DataFrame | None = None) -> DataFrame:
    """Measures, leading topic and leading complaint per category.

    Measures and topic come from one pass: the parts are summed per (category, topic) and
    those few rows once more per category. ``rows``: those of ``review_level_by``, where they are already written.
    """
    rows = grain.review_level_by(star, "category") if rows is None else rows
    per_topic = rows.groupBy("category", "topic_label").agg(*grain.metric_parts())
    leading = F.min_by("topic_label", F.struct(-F.col("review_count"), F.col("topic_label"))).alias("top_topic")
    measured = per_topic.groupBy("category").agg(leading, *grain.add_parts()).select(
        "category", *grain.measures_of_parts(), "top_topic")
    return measured.join(top_complaint_aspect(rows), "category", "left").withColumn(
        "confidence", confidence(F.col("review_count"), min_reviews))


def seller_metrics(star: Star, min_reviews: int = 30) -> DataFrame:
    return grain.group_metrics(grain.review_level_by(star, "seller_id"), "seller_id").withColumn(
        "confidence", confidence(F.col("review_count"), min_reviews))


def state_metrics(star: Star) -> DataFrame:
    return grain.group_metrics(grain.review_rows(star).where("state is not null"), "state")


def monthly_metrics(star: Star) -> DataFrame:
    return grain.group_metrics(grain.review_rows(star), "order_month")


def quarterly_metrics(star: Star) -> DataFrame:
    return grain.group_metrics(grain.review_rows(star), "order_quarter")


def complaint_matrix_long(rows: DataFrame, key: str = "category") -> DataFrame:
    """Mentions, negative mentions and complaint rate per (group, aspect)."""
    return aspect_rows(rows, key, "is_neg_sentiment").groupBy(key, "aspect").agg(
        F.count("*").alias("mention_count"),
        F.sum("is_neg_sentiment").alias("neg_count"),
    ).withColumn("complaint_rate", F.col("neg_count") / F.col("mention_count"))


def complaint_matrix(
    rows: DataFrame, aspects: Sequence[str], min_reviews: int = 100, key: str = "category"
) -> DataFrame:
    """Complaint rates as one column per aspect, 0 without mentions, for groups with enough reviews."""
    enough = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= min_reviews).select(key)
    wide = complaint_matrix_long(rows, key).groupBy(key).pivot("aspect", list(aspects)).agg(
        F.max("complaint_rate"))
    return wide.join(enough, key, "left_semi").na.fill(0.0, list(aspects))


def late_by(rows: DataFrame, key: str, min_reviews: int = 100, top: int = 10) -> DataFrame:
    """Late rate of delivered reviews per group with enough of them, worst first."""
    grouped = rows.where(F.col("is_late").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("n"), F.avg("is_late").alias("late_rate"))
    return grouped.where(F.col("n") >= min_reviews).orderBy(F.desc("late_rate"), key).limit(top)


def aspect_by_lateness(reviews: DataFrame) -> DataFrame:
    """Aspect mentions of negative, delivered reviews, on time against late."""
    negative = reviews.where("is_late is not null and is_neg_sentiment = 1")
    return aspect_rows(negative, "is_late").groupBy("aspect").agg(
        F.count_if(F.col("is_late") == 0).alias("on_time"),
        F.count_if(F.col("is_late") == 1).alias("late"),
    ).withColumn("total", F.col("on_time") + F.col("late")).withColumn(
        "late_share", F.round(share_pct(F.col("late"), F.col("total")), 1))


def commercial_exposure(reviews: DataFrame) -> DataFrame:
    """Value of orders with a negative review, every order once."""
    per_order = reviews.where("is_neg_sentiment = 1").groupBy("order_id").agg(
        F.max("order_value").alias("order_value"))
    return per_order.agg(
        F.coalesce(F.sum("order_value").cast("double"), F.lit(0.0)).alias("affected_order_value"),
        F.count("*").alias("affected_orders"))


def exposure_sensitivity(exposure: DataFrame, percents: Sequence[float] = IMPACT_PERCENTS) -> DataFrame:
    rates = F.array(*[F.lit(float(p)) for p in percents])
    return exposure.select("affected_order_value", F.explode(rates).alias("impact_pct")).select(
        "impact_pct", F.round(F.col("affected_order_value") * F.col("impact_pct") / 100.0, 2).alias("exposure"))


def prioritization(categories: DataFrame) -> DataFrame:
    """Quadrant of each reliable category around the two medians; the median itself is LOW.

    The medians are taken over category rows, one per category of the shop.
    """
    reliable = categories.where("confidence = 'HIGH'").withColumn("total_value", F.col("total_item_value"))
    everything = Window.partitionBy(F.lit(0))
    risky = F.col("neg_sentiment_rate") > F.col("median_neg_sentiment_rate")
    exposed = F.col("total_value") > F.col("median_total_value")
    segment = (
        F.when(risky & exposed, SEGMENTS[0]).when(risky, SEGMENTS[1])
        .when(exposed, SEGMENTS[2]).otherwise(SEGMENTS[3]))
    return reliable.select(
        "category", "review_count", "neg_review_rate", "neg_sentiment_rate", "avg_order_value", "total_value",
        F.median("neg_sentiment_rate").over(everything).alias("median_neg_sentiment_rate"),
        F.median("total_value").over(everything).alias("median_total_value"),
    ).withColumn("segment", segment)
