"""Review grains: review x item, one row per review, one row per (group, review).

Items are summed to the wanted grain before they meet the reviews, so no join fans out
and a review on a three-item order counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.metrics import (
    delay_days, late_flag, month_of, negative_label_flag, neg_review_flag, quarter_of,
)
from orderloom.sources.tables import Star

AVERAGE = "decimal(24,8)"  # averages that are averaged again are kept exact
UNKNOWN = "unknown"
REVIEW_COLUMNS = (
    "review_id", "order_id", "review_score", "sentiment_label", "topic_label", "extracted_aspects",
    "is_late", "delay_days", "state", "order_month", "order_quarter", "is_neg_review", "is_neg_sentiment",
)


def review_heads(star: Star, reviews: str = "scored_reviews") -> DataFrame:
    """Reviews with their order's dates and customer state; reviews without an order drop out."""
    orders = star["orders"].select(
        "order_id", "customer_id", "purchase_ts",
        delay_days(F.col("delivered_ts"), F.col("estimated_ts")).alias("delay_days"))
    customers = star["customers"].select("customer_id", "state")
    return (
        star[reviews].join(orders, "order_id").join(customers, "customer_id", "left")
        .select(
            "review_id", "order_id", "review_score", "sentiment_label", "topic_label", "extracted_aspects",
            late_flag(F.col("delay_days")).alias("is_late"), "delay_days", "state",
            month_of(F.col("purchase_ts")).alias("order_month"),
            quarter_of(F.col("purchase_ts")).alias("order_quarter"),
            neg_review_flag(F.col("review_score")).alias("is_neg_review"),
            negative_label_flag(F.col("sentiment_label")).alias("is_neg_sentiment"),
        )
    )


def items_with_category(star: Star) -> DataFrame:
    """Items with the category of their product, ``unknown`` where it has none."""
    products = star["products"].select("product_id", "category")
    return star["items"].join(products, "product_id", "left").withColumn(
        "category", F.coalesce("category", F.lit(UNKNOWN)))


def item_value() -> Column:
    return F.col("price") + F.col("freight_value")


def review_item_fact(star: Star) -> DataFrame:
    """The review x order item frame."""
    items = items_with_category(star).select(
        "order_id", "item_id", "product_id", "seller_id", "category", "price", "freight_value",
        item_value().alias("item_value"))
    return review_heads(star).join(items, "order_id")


def order_totals(star: Star) -> DataFrame:
    return star["items"].groupBy("order_id").agg(
        F.sum("price").alias("order_items_price"),
        F.sum("freight_value").alias("order_freight"),
        F.sum(item_value()).alias("order_value"),
        F.count("*").alias("n_items"))


def review_level(star: Star) -> DataFrame:
    """One row per review of an order with items."""
    return review_heads(star).join(order_totals(star), "order_id")


def group_items(star: Star, key: str) -> DataFrame:
    """Item value and mean price and freight per (order, key)."""
    source = items_with_category(star) if key == "category" else star["items"]
    return source.groupBy("order_id", key).agg(
        F.sum(item_value()).alias("item_value"),
        (F.sum("price").cast("double") / F.count("*")).cast(AVERAGE).alias("avg_item_price"),
        (F.sum("freight_value").cast("double") / F.count("*")).cast(AVERAGE).alias("avg_freight"))


def review_level_by(star: Star, key: str, level: DataFrame | None = None) -> DataFrame:
    """One row per (key, review), with the whole order's value beside the group's own.

    ``level``: the rows of ``review_level``, where they are already written.
    """
    if level is not None:
        return level.select(*REVIEW_COLUMNS, "order_value").join(group_items(star, key), "order_id")
    values = star["items"].groupBy("order_id").agg(F.sum(item_value()).alias("order_value"))
    return review_heads(star).join(values, "order_id").join(group_items(star, key), "order_id")


def review_rows(star: Star) -> DataFrame:
    """Review level in the column layout that ``group_metrics`` reads."""
    return review_level(star).select(
        *REVIEW_COLUMNS, "order_value", F.col("order_value").alias("item_value"),
        (F.col("order_items_price").cast("double") / F.col("n_items")).cast(AVERAGE).alias("avg_item_price"),
        (F.col("order_freight").cast("double") / F.col("n_items")).cast(AVERAGE).alias("avg_freight"))


MEANS = {  # name -> column averaged over the rows of a group
    "avg_review_score": "review_score", "neg_review_rate": "is_neg_review", "neg_sentiment_rate": "is_neg_sentiment",
    "avg_order_value": "order_value", "avg_item_price": "avg_item_price", "avg_freight": "avg_freight",
    "late_delivery_rate": "is_late",
}


def metric_parts() -> list[Column]:
    """Sums and counts that the measures are made of; they add up over subgroups."""
    parts = [F.count("*").alias("review_count"), F.sum("item_value").alias("total_item_value")]
    for name, column in MEANS.items():
        parts += [F.sum(column).alias(f"_s_{name}"), F.count(column).alias(f"_n_{name}")]
    return parts


def add_parts() -> list[Column]:
    """Totals of the parts of subgroups."""
    names = ["review_count", "total_item_value", *[f"_{k}_{n}" for n in MEANS for k in "sn"]]
    return [F.sum(n).alias(n) for n in names]


def measures_of_parts() -> list[Column]:
    """The ten measures. Sums of decimals and of small integers are exact, so the means do
    not depend on the order of partitions."""
    means = [F.try_divide(F.col(f"_s_{n}").cast("double"), F.col(f"_n_{n}")).alias(n) for n in MEANS]
    return [F.col("review_count"), *means, F.col("_n_late_delivery_rate").alias("delivered_reviews"),
            F.col("total_item_value").cast("double").alias("total_item_value")]


def group_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """Ten measures per group over rows at (group, review) grain."""
    return rows.groupBy(*keys).agg(*metric_parts()).select(*keys, *measures_of_parts())
