"""Parquet scans and the binding of physical tables to the logical star.

``Star`` is the input contract of every operator: a set of DataFrames with the
logical column names. ``star_from_parquet`` reads a folder that already holds the
star tables; ``star_from_trade_tables`` maps TPC-H-like trade tables onto it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
RATE = "decimal(4,2)"


def scan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@dataclass
class Star:
    """The logical tables; missing ones are simply not set."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def star_from_parquet(spark: SparkSession, folder: str, names: dict[str, str]) -> Star:
    """Read star tables by logical name -> path under ``folder``."""
    return Star(spark, {key: spark.read.parquet(f"{folder}/{path}") for key, path in names.items()})


class MarketplaceStar(Star):
    """Star over the tables that ``modeling.build_star`` writes, in a folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark)
        self.folder = folder

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    @cached_property
    def orders(self) -> DataFrame:
        return self.raw("fact_orders").select(
            "order_id", "customer_id", "order_status",
            F.col("order_purchase_timestamp").alias("purchase_ts"),
            F.col("order_estimated_delivery_date").alias("estimated_ts"),
            F.col("order_delivered_customer_date").alias("delivered_ts"))

    @cached_property
    def items(self) -> DataFrame:
        return self.raw("fact_order_items").select(
            "order_id", F.col("order_item_id").alias("item_id"), "product_id", "seller_id", "shipping_limit_date",
            F.col("price").cast(MONEY).alias("price"), F.col("freight_value").cast(MONEY).alias("freight_value"))

    @cached_property
    def customers(self) -> DataFrame:
        return self.raw("dim_customers")

    @cached_property
    def sellers(self) -> DataFrame:
        return self.raw("dim_sellers").select("seller_id", "state")

    @cached_property
    def products(self) -> DataFrame:
        return self.raw("dim_products").select(
            "product_id", F.col("product_category_name_english").alias("category"))

    @cached_property
    def payments_raw(self) -> DataFrame:
        """The order-level payments in the layout of raw ones, one row per order."""
        return self.raw("dim_payments").select(
            "order_id", F.col("primary_payment_type").alias("payment_type"),
            F.col("payment_installments_max").alias("payment_installments"),
            F.col("total_payment_value").cast(MONEY).alias("payment_value"), F.lit(1).alias("payment_sequential"))

    @cached_property
    def reviews(self) -> DataFrame:
        return self.raw("fact_order_reviews").select(
            "review_id", "order_id", "review_score", "review_comment_message")

    @cached_property
    def scored_reviews(self) -> DataFrame:
        return self.raw("nlp_reviews").withColumnRenamed("emb_topic_id", "topic_id")


class TradeStar(Star):
    """Star over trade tables (orders, lineitem, customer, ...) of one folder.

    Money columns are cast to decimals factor by factor, so sums are exact and do not
    depend on the order in which partitions are added.
    """

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark)
        self.folder = folder

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    def raw(self, name: str) -> DataFrame:
        return scan(self.spark, self.folder, name)

    @cached_property
    def items(self) -> DataFrame:
        price = F.col("l_extendedprice").cast(MONEY)
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            price.alias("price"),
            (price * F.col("l_tax").cast(RATE)).alias("freight_value"),
        )

    @cached_property
    def order_line_facts(self) -> DataFrame:
        """One row per order with lines: first ship date and the aspect flags."""
        return self.raw("lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(
            F.min("l_shipdate").alias("first_ship"),
            F.max((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05)).alias("returned"),
            F.max(F.col("l_quantity") > 45).alias("large"),
            F.max(F.col("l_tax") > 0.06).alias("taxed"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        head = self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderstatus").alias("order_status"),
            F.col("o_orderdate").alias("purchase_ts"),
            F.col("o_orderdate").alias("estimated_ts"),
        )
        shipped = self.order_line_facts.select("order_id", "first_ship")
        return head.join(shipped, "order_id", "left").select(
            "order_id", "customer_id", "order_status", "purchase_ts", "estimated_ts",
            F.when(F.col("order_status") != "P", F.col("first_ship")).alias("delivered_ts"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        nation = self.raw("nation").select(F.col("n_nationkey"), F.col("n_name").alias("state"))
        return (
            self.raw("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(
                F.col("c_custkey").alias("customer_id"),
                F.col("c_name").alias("customer_unique_id"),
                (F.col("c_custkey") % 50).alias("zip_code_prefix"),
                F.col("c_mktsegment").alias("city"),
                "state",
            )
        )

    @cached_property
    def sellers(self) -> DataFrame:
        nation = self.raw("nation").select(F.col("n_nationkey"), F.col("n_name").alias("state"))
        return (
            self.raw("supplier")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .select(F.col("s_suppkey").alias("seller_id"), "state")
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"),
            F.when(F.col("p_partkey") % 50 != 0, F.col("p_brand")).alias("category"),
        )

    @cached_property
    def raw_products(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category_raw")
        )

    @cached_property
    def translation(self) -> DataFrame:
        """Lookup taken from the data: every raw category except the last two by name."""
        names = self.raw("part").select(F.col("p_type").alias("category_raw")).distinct()
        return names.where(~F.col("category_raw").isin("STANDARD", "SMALL")).select(
            "category_raw", F.initcap(F.lower("category_raw")).alias("category_english")
        )

    @cached_property
    def payments_raw(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.concat("l_returnflag", "l_linestatus").alias("payment_type"),
            F.col("l_quantity").cast("int").alias("payment_installments"),
            F.col("l_extendedprice").cast(MONEY).alias("payment_value"),
            F.col("l_linenumber").alias("payment_sequential"),
        )

    @cached_property
    def geolocation_raw(self) -> DataFrame:
        """Customer points, each delivered twice, with the ingest sequence."""
        nation = self.raw("nation").select(F.col("n_nationkey"), F.col("n_name").alias("state"))
        points = (
            self.raw("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(
                F.col("c_custkey").alias("seq"),
                (F.col("c_custkey") % 50).alias("zip_code_prefix"),
                F.col("c_acctbal").alias("lat"),
                F.col("c_nationkey").cast("double").alias("lng"),
                F.col("c_mktsegment").alias("city"),
                "state",
            )
        )
        return points.unionByName(points)

    @cached_property
    def reviews(self) -> DataFrame:
        """One review per order; the message comes from the document of the same number."""
        texts = self.raw("documents").select(F.col("doc_id"), F.col("text"))
        return (
            self.raw("orders")
            .join(texts, F.col("o_orderkey") == F.col("doc_id"), "left")
            .select(
                (F.col("o_orderkey") * 10).alias("review_id"),
                F.col("o_orderkey").alias("order_id"),
                (F.lit(1) + (F.col("o_orderkey") * 7 + F.col("o_custkey")) % 5).cast("int").alias("review_score"),
                F.col("text").alias("review_comment_message"),
            )
        )

    @cached_property
    def scored_reviews(self) -> DataFrame:
        """Reviews with sentiment, topic and aspects, one per order."""
        label = (
            F.when(F.col("o_orderpriority") == "1-URGENT", "Negative")
            .when(F.col("o_orderpriority") == "2-HIGH", "Neutral")
            .otherwise("Positive")
        )
        found = F.array_compact(F.array(
            F.when(F.col("returned"), F.lit("Returned")),
            F.when(F.col("large"), F.lit("Large quantity")),
            F.when(F.col("taxed"), F.lit("High tax")),
        ))
        flags = self.order_line_facts.select("order_id", "returned", "large", "taxed")
        return (
            self.raw("orders")
            .withColumnRenamed("o_orderkey", "order_id")
            .join(flags, "order_id", "left")
            .select(
                (F.col("order_id") * 10).alias("review_id"),
                "order_id",
                (F.lit(1) + (F.col("order_id") * 7 + F.col("o_custkey")) % 5).cast("int").alias("review_score"),
                label.alias("sentiment_label"),
                (F.col("o_custkey") % 8).cast("int").alias("topic_id"),
                F.concat(F.lit("Topic "), (F.col("o_custkey") % 8).cast("string")).alias("topic_label"),
                F.when(F.size(found) > 0, found)
                .otherwise(F.array(F.lit("Uncategorized")))
                .alias("extracted_aspects"),
            )
        )

    @cached_property
    def text_reviews(self) -> DataFrame:
        """One review per document, with whole texts; some orders get two reviews."""
        labels = self.raw("labels")
        d = F.col("doc_id")
        label = (
            F.when((F.col("toxic") == 1) | (F.col("quality") == 0), "Negative")
            .when(F.col("quality").isNull(), "Neutral")
            .otherwise("Positive")
        )
        return (
            self.raw("documents").select("doc_id", "text", "lang", "n_chars")
            .join(labels, "doc_id", "left")
            .select(
                d.alias("review_id"),
                (d - F.when(d % 10 == 1, 1).otherwise(0)).alias("order_id"),
                (F.lit(1) + (d * 7 + F.col("n_chars")) % 5).cast("int").alias("review_score"),
                F.col("text").alias("review_comment_message"),
                F.col("lang"),
                label.alias("sentiment_label"),
            )
        )
