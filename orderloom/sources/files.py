"""CSV, JSON and Parquet sources and sinks, presence checks and the view catalogue."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: raw file columns ----------------------------------------------
RAW_SCHEMAS = {
    "customers": "customer_id string, customer_unique_id string, customer_zip_code_prefix int, "
                 "customer_city string, customer_state string",
    "geolocation": "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double, "
                   "geolocation_city string, geolocation_state string",
    "items": "order_id string, order_item_id int, product_id string, seller_id string, "
             "shipping_limit_date string, price double, freight_value double",
    "payments": "order_id string, payment_sequential int, payment_type string, "
                "payment_installments int, payment_value double",
    "reviews": "review_id string, order_id string, review_score int, review_comment_title string, "
               "review_comment_message string, review_creation_date string, review_answer_timestamp string",
    "orders": "order_id string, customer_id string, order_status string, "
              "order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz, "
              "order_delivered_carrier_date timestamp_ntz, order_delivered_customer_date timestamp_ntz, "
              "order_estimated_delivery_date timestamp_ntz",
    "products": "product_id string, product_category_name string, product_name_lenght int, "
                "product_description_lenght int, product_photos_qty int, product_weight_g int, "
                "product_length_cm int, product_height_cm int, product_width_cm int",
    "sellers": "seller_id string, seller_zip_code_prefix int, seller_city string, seller_state string",
    "translation": "product_category_name string, product_category_name_english string",
}


def read_csv(
    spark: SparkSession, path: str, schema: str | T.StructType, line_breaks: bool = True
) -> DataFrame:
    """CSV with a header and doubled quotes, against a stated schema.

    A header that names other columns, or the same in another order, stops the read. Rows that do
    not fit the schema have NULL cells; ``bad_rows`` counts them.

    Files whose texts hold line breaks cannot be split; pass ``line_breaks=False`` for the
    others, so that one large file is read by many tasks.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("multiLine", line_breaks)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def bad_rows(spark: SparkSession, sources: Mapping[str, tuple[str, str]], line_breaks: bool = True) -> DataFrame:
    """(source, rows, bad): rows with a cell that does not parse, or with too few or too many cells.

    ``sources`` has a path and a schema per name.
    """
    parts = []
    for name, (path, schema) in sources.items():
        rows = (spark.read.schema(f"{schema}, _malformed string").option("header", True)
                .option("multiLine", line_breaks).option("quote", '"').option("escape", '"')
                .option("columnNameOfCorruptRecord", "_malformed").csv(path))
        # The reader only parses cells that the query uses: the hash, which is always in range, uses all.
        parsed = F.hash(*[c for c in rows.columns if c != "_malformed"]) >= F.lit(-(2**31))
        parts.append(rows.agg(F.count("*").alias("rows"), F.count_if(parsed & F.col("_malformed").isNotNull()).alias("bad"))
                     .select(F.lit(name).alias("source"), "rows", "bad"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def read_raw_set(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """All raw CSV sources by logical name, dates parsed by the schema.

    The geolocation rows get a sequence in file order, since "the first city of a zip"
    refers to it.
    """
    tables = {
        name: read_csv(spark, path, RAW_SCHEMAS[name], line_breaks=name == "reviews")
        for name, path in paths.items()}
    if "geolocation" in tables:
        tables["geolocation"] = tables["geolocation"].withColumn("seq", F.struct(
            F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
            F.monotonically_increasing_id().alias("row")))
    return tables


def source_counts(sources: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """(source, present, rows) for every expected source; a missing one has NULL rows."""
    parts: list[DataFrame] = []
    spark: SparkSession | None = None
    missing: list[str] = []
    for name, load in sources.items():
        try:
            df = load()
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            missing.append(name)
            continue
        spark = df.sparkSession
        parts.append(df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("source"), F.lit(True).alias("present"), "rows"))
    if spark is None:
        raise FileNotFoundError(f"none of the sources exist: {sorted(missing)}")
    if missing:
        parts.append(spark.createDataFrame(
            [(name, False, None) for name in missing], "source string, present boolean, rows long"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def require_sources(counts: DataFrame) -> None:
    """Stop when an expected source is absent."""
    absent = [row.source for row in counts.where(~F.col("present")).select("source").collect()]
    if absent:
        raise FileNotFoundError(f"missing sources: {sorted(absent)}")


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a written table's job was committed: its success marker is there."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def write_parquet_set(tables: Mapping[str, DataFrame], folder: str, mode: str = "overwrite") -> dict[str, str]:
    """One Parquet folder per table; ``mode='ignore'`` keeps tables that were written completely."""
    written = {}
    for name, df in tables.items():
        written[name] = f"{folder}/{name}"
        if mode == "ignore" and is_complete(df.sparkSession, written[name]):
            continue
        df.write.mode("overwrite" if mode == "ignore" else mode).parquet(written[name])
    return written


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """One JSON document per row; keys with NULL values are kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
    return path


def as_documents(df: DataFrame, column: str = "document") -> DataFrame:
    """Each row as one JSON string."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(column))


def register_views(spark: SparkSession, tables: Mapping[str, Callable[[], DataFrame] | DataFrame]) -> list[str]:
    """Temp view per table; a table whose path does not exist is skipped."""
    made = []
    for name, table in tables.items():
        try:
            df = table() if callable(table) else table
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        df.createOrReplaceTempView(name)
        made.append(name)
    return made
