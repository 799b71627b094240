"""Cleaning and star-schema modelling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.vocabulary import TRANSLATION_PATCHES
from orderloom.operators.ordering import quantiles

# --- Fixed values: conformed dimension names --------------------------------------
CUSTOMER_NAMES = {
    "customer_zip_code_prefix": "zip_code_prefix", "customer_city": "city", "customer_state": "state",
}
SELLER_NAMES = {
    "seller_zip_code_prefix": "zip_code_prefix", "seller_city": "city", "seller_state": "state",
}
GEOLOCATION_NAMES = {
    "geolocation_zip_code_prefix": "zip_code_prefix", "geolocation_lat": "lat",
    "geolocation_lng": "lng", "geolocation_city": "city", "geolocation_state": "state",
}


def conform(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def drop_exact_duplicates(df: DataFrame, sequence: str | None = None) -> DataFrame:
    """One row per distinct content; with ``sequence`` the earliest sequence is kept."""
    if sequence is None:
        return df.dropDuplicates()
    content = [c for c in df.columns if c != sequence]
    return df.groupBy(*content).agg(F.min(sequence).alias(sequence))


def representative_point(
    geo: DataFrame, key: str = "zip_code_prefix", sequence: str = "seq"
) -> DataFrame:
    """One row per zip: median coordinates, city and state of the earliest row."""
    unique = drop_exact_duplicates(geo, sequence)
    # The earliest row's names; the pair is part of the order so that ties cannot differ.
    names = unique.groupBy(key).agg(
        F.min_by(F.struct("city", "state"), F.struct(sequence, "city", "state")).alias("first"))
    # Both coordinates go through one ordered pass, told apart by name.
    points = unique.unpivot([key], ["lat", "lng"], "axis", "position")
    medians = quantiles(points, "position", {"median": 0.5}, by=[key, "axis"])
    flat = medians.groupBy(key).agg(
        F.max(F.when(F.col("axis") == "lat", F.col("median"))).alias("lat"),
        F.max(F.when(F.col("axis") == "lng", F.col("median"))).alias("lng"),
    )
    return flat.join(names, key).select(key, "lat", "lng", "first.city", "first.state")


def patch_translation(
    translation: DataFrame, patches: Mapping[str, str] = TRANSLATION_PATCHES
) -> DataFrame:
    """The two-column lookup with the patch rows; a patched key replaces the lookup's own rows."""
    extra = translation.sparkSession.createDataFrame(list(patches.items()), translation.schema)
    key = translation.columns[0]
    # The patches are a parameter: the broadcast has their number of rows.
    return translation.join(F.broadcast(extra.select(key)), key, "left_anti").unionByName(extra)


def translate_categories(
    products: DataFrame, translation: DataFrame,
    key: str = "category_raw", name: str = "category_english", fallback: str = "unknown",
) -> DataFrame:
    """English category per product, the fallback where the lookup has none."""
    joined = products.join(translation, key, "left")
    return joined.withColumn("imputed", F.col(name).isNull()).withColumn(
        name, F.coalesce(name, F.lit(fallback)))


def payments_by_order(
    payments: DataFrame, tie_break: Sequence[str | Column] = ("payment_sequential",)
) -> DataFrame:
    """Totals and the type of the largest payment per order, in one aggregation.

    On equal values the payment that comes first by ``tie_break`` wins, then the
    smaller type name.
    """
    largest = F.min_by("payment_type", F.struct((-F.col("payment_value")).alias("v"), *tie_break, "payment_type"))
    return payments.groupBy("order_id").agg(
        F.sum("payment_value").alias("total_payment_value"),
        F.max("payment_installments").alias("payment_installments_max"),
        F.count_distinct("payment_type").alias("n_payment_methods"),
        largest.alias("primary_payment_type"),
    )


def primary_payment(payments: DataFrame, tie_break: Sequence[str | Column] = ("payment_sequential",)) -> DataFrame:
    return payments.groupBy("order_id").agg(
        F.min_by("payment_type", F.struct((-F.col("payment_value")).alias("v"), *tie_break, "payment_type"))
        .alias("primary_payment_type"))


def coerce_timestamps(df: DataFrame, columns: Sequence[str], fmt: str | None = None) -> DataFrame:
    """Parse string columns; text that is no timestamp becomes NULL."""
    fmt_col = F.lit(fmt) if fmt else None
    parse = (lambda c: F.try_to_timestamp(c, fmt_col)) if fmt else F.try_to_timestamp
    return df.withColumns({c: parse(F.col(c)).cast("timestamp_ntz") for c in columns})


def text_coverage(reviews: DataFrame, text: str = "review_comment_message") -> DataFrame:
    return reviews.agg(
        F.count("*").alias("total_reviews"),
        F.count(text).alias("reviews_with_text"),
        F.round(F.count(text) * F.lit(100.0) / F.count("*"), 2).alias("text_coverage_pct"),
    )


def build_star(raw: Mapping[str, DataFrame], sequence: str = "seq") -> dict[str, DataFrame]:
    """All eight star tables from the raw sources.

    ``raw['geolocation']`` must carry the ingest sequence column, since "first city of
    a zip" has no other order to refer to.
    """
    return {
        "fact_orders": raw["orders"],
        "fact_order_items": coerce_timestamps(raw["items"], ["shipping_limit_date"]),
        "fact_order_reviews": coerce_timestamps(
            raw["reviews"], ["review_creation_date", "review_answer_timestamp"]),
        "dim_customers": conform(raw["customers"], CUSTOMER_NAMES),
        "dim_products": translate_categories(
            raw["products"], patch_translation(raw["translation"]),
            "product_category_name", "product_category_name_english").drop("imputed"),
        "dim_sellers": conform(raw["sellers"], SELLER_NAMES),
        "dim_payments": payments_by_order(raw["payments"]),
        "dim_geolocation": representative_point(
            conform(raw["geolocation"], GEOLOCATION_NAMES), sequence=sequence),
    }
