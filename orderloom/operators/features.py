"""Order feature table: one row per order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.metrics import delay_days
from orderloom.functions.vocabulary import DELAY_FENCE_DAYS
from orderloom.operators.modeling import payments_by_order
from orderloom.operators.ordering import iqr_fences
from orderloom.session import written
from orderloom.sources.tables import Star

ITEM_TIE_BREAK = ("item_id", "product_id", "seller_id", "shipping_limit_date")


def delivery_delay(orders: DataFrame) -> DataFrame:
    return orders.select(
        "order_id", delay_days(F.col("delivered_ts"), F.col("estimated_ts")).alias("delivery_delay_days"))


def freight_ratio(price: Column, freight: Column) -> Column:
    """Freight per unit of price; NULL unless the price is positive."""
    return F.when(price > 0, freight.cast("double") / price.cast("double"))


def order_items_agg(items: DataFrame) -> DataFrame:
    """Price, freight, item and seller counts per order, and the top item's keys.

    The top item is the one with the highest price; its product and seller come out of
    the same aggregation, so the dimensions are joined at order grain later.
    """
    top = F.min_by(
        F.struct("seller_id", "product_id"),
        F.struct((-F.col("price")).alias("p"), *ITEM_TIE_BREAK))
    return items.groupBy("order_id").agg(
        F.sum("price").alias("total_price"),
        F.sum("freight_value").alias("total_freight"),
        F.count("item_id").alias("items_per_order"),
        F.count_distinct("seller_id").alias("distinct_sellers_per_order"),
        top.alias("top_item"),
    ).select(
        "order_id", "total_price", "total_freight", "items_per_order", "distinct_sellers_per_order",
        (F.col("total_price") + F.col("total_freight")).alias("order_total_value"),
        freight_ratio(F.col("total_price"), F.col("total_freight")).alias("freight_ratio"),
        F.col("top_item.seller_id").alias("top_seller_id"),
        F.col("top_item.product_id").alias("top_product_id"),
    )


def order_payment_features(payments: DataFrame) -> DataFrame:
    return payments_by_order(payments).select(
        "order_id",
        F.col("payment_installments_max").alias("payment_installments"),
        F.col("primary_payment_type").alias("payment_type"),
    )


def order_review_features(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("order_id").agg(
        F.avg("review_score").alias("review_score"),
        F.bool_or(F.col("review_comment_message").isNotNull()).alias("has_review_text"),
    )


def dominant_seller_state(items: DataFrame, sellers: DataFrame) -> DataFrame:
    top = order_items_agg(items).select("order_id", F.col("top_seller_id").alias("seller_id"))
    return top.join(sellers.select("seller_id", F.col("state").alias("seller_state")), "seller_id", "left") \
        .select("order_id", "seller_state")


def dominant_category(items: DataFrame, products: DataFrame) -> DataFrame:
    top = order_items_agg(items).select("order_id", F.col("top_product_id").alias("product_id"))
    return top.join(products.select("product_id", F.col("category").alias("product_category")),
                    "product_id", "left").select("order_id", "product_category")


def is_interstate(customer_state: Column, seller_state: Column) -> Column:
    """Different states; NULL when either is unknown."""
    return customer_state != seller_state


def above(value: Column, fence: Column) -> Column:
    """True above the fence; a NULL value is not an outlier."""
    return F.coalesce(value > fence, F.lit(False))


def order_features(star: Star, delay_fence: float | None = DELAY_FENCE_DAYS, multiplier: float = 1.5) -> DataFrame:
    """The 20-column feature table. ``delay_fence=None`` computes the fence from the data."""
    base = star["orders"].select(
        "order_id", "customer_id", "order_status",
        F.col("purchase_ts").alias("order_purchase_timestamp"),
        delay_days(F.col("delivered_ts"), F.col("estimated_ts")).alias("delivery_delay_days"),
    )
    customers = star["customers"].select("customer_id", F.col("state").alias("customer_state"))
    sellers = star["sellers"].select(F.col("seller_id").alias("top_seller_id"), F.col("state").alias("seller_state"))
    products = star["products"].select(
        F.col("product_id").alias("top_product_id"), F.col("category").alias("product_category"))
    # The per-order items are read twice below: aggregated once and written.
    per_order = written(order_items_agg(star["items"]), "order-items")
    joined = (
        base
        .join(per_order, "order_id", "left")
        .join(order_payment_features(star["payments_raw"]), "order_id", "left")
        .join(order_review_features(star["reviews"]), "order_id", "left")
        .join(customers, "customer_id", "left")
        .join(sellers, "top_seller_id", "left")
        .join(products, "top_product_id", "left")
        .withColumn("order_total_value", F.col("order_total_value").cast("double"))
    )
    # One ordered pass gives every fence: the measures are told apart by name.
    measures = ["order_total_value", "freight_ratio"] + ([] if delay_fence is not None else ["delivery_delay_days"])
    totals = per_order.select(
        F.col("order_total_value").cast("double").alias("order_total_value"), "freight_ratio")
    long = totals.unpivot([], ["order_total_value", "freight_ratio"], "measure", "value")
    if delay_fence is None:
        long = long.unionByName(base.select(
            F.lit("delivery_delay_days").alias("measure"), F.col("delivery_delay_days").alias("value")))
    fences = iqr_fences(long, "value", multiplier, by=["measure"]).groupBy().pivot("measure", measures).agg(
        F.max("upper_fence"))
    limits = fences.select(F.struct(*measures).alias("limits")).scalar()  # one subquery for all

    def fence(measure: str) -> Column:
        return limits.getField(measure)

    delay_limit = F.lit(delay_fence) if delay_fence is not None else fence("delivery_delay_days")
    return joined.select(
        "order_id", "customer_id", "order_status", "order_purchase_timestamp", "delivery_delay_days",
        "order_total_value", "freight_ratio", "items_per_order", "distinct_sellers_per_order",
        "payment_installments", "payment_type", "review_score", "has_review_text",
        "customer_state", "seller_state",
        is_interstate(F.col("customer_state"), F.col("seller_state")).alias("is_interstate_order"),
        "product_category",
        above(F.col("order_total_value"), fence("order_total_value")).alias("is_value_outlier"),
        above(F.col("freight_ratio"), fence("freight_ratio")).alias("is_freight_ratio_outlier"),
        above(F.col("delivery_delay_days"), delay_limit).alias("is_delay_outlier"),
    )


def null_report(df: DataFrame) -> DataFrame:
    """(column_name, null_count, null_pct) for every column, from one pass."""
    counts = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot(["_rows"], df.columns, "column_name", "null_count").select(
        "column_name", "null_count",
        F.round(F.try_divide(F.col("null_count") * 100.0, F.col("_rows")), 4).alias("null_pct"))
