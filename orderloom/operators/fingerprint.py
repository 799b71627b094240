"""Fingerprints of result tables and files, and their comparison with a recorded set."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.operators.quality import union_all

LIMBS = 4                    # a digest's 256 bits are summed as four 64-bit numbers


def cell_text(column: Column, kind: T.DataType) -> Column:
    """A value as text that keeps all of it and does not depend on engine settings; NULL stays NULL.

    Integers, decimals and strings stand for themselves. A double is its exact value (a whole
    multiple of a power of two), with NaN, the infinities and both zeros apart. Times are
    microseconds, dates days; nested values list their parts.
    """
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return exact_double(column.cast("double"))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("string")
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column).cast("string")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(column)
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: framed(cell_text(x, kind.elementType))), ""),
                        F.lit("]"))
    if isinstance(kind, T.MapType):
        entries = T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]))
        return cell_text(F.array_sort(F.map_entries(column)), entries)
    if isinstance(kind, T.StructType):
        parts = F.concat(*[framed(cell_text(column[f.name], f.dataType)) for f in kind.fields], F.lit("}"))
        return F.when(column.isNotNull(), F.concat(F.lit("{"), parts))
    return column.cast("string")


def exact_double(value: Column) -> Column:
    """Sign, whole mantissa and binary exponent of a double.

    ``frexp`` by halving: the exponent comes from the logarithm and is corrected by one step, the
    mantissa times 2**53 is whole. Scaling goes in two steps, so tiny and huge values stay finite.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(size)).cast("int")
    half = F.floor(guess / 2).cast("int")
    scaled = size / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), guess - half)
    fix = F.when(scaled >= 2.0, 1).when(scaled < 1.0, -1).otherwise(0)
    mantissa = (scaled / F.pow(F.lit(2.0), fix) * F.lit(2.0**52)).cast("long")
    sign = F.when(value < 0, "-").otherwise("")
    plain = F.concat(sign, mantissa.cast("string"), F.lit("p"), (guess + fix).cast("string"))
    return (F.when(value.isNull(), F.lit(None).cast("string")).when(F.isnan(value), "nan")
            .when(size == float("inf"), F.concat(sign, F.lit("inf")))
            .when(value == 0, F.when(value.cast("string") == "-0.0", "-0").otherwise("0")).otherwise(plain))


def framed(text: Column) -> Column:
    """Length and text, so that no neighbour can be mistaken for a part of it; NULL has a mark of its own."""
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~"))


def row_digest(df: DataFrame) -> Column:
    """SHA-256 over all columns, by name."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return F.sha2(F.concat(*[framed(cell_text(F.col(f"`{f.name}`"), f.dataType)) for f in fields]), 256)


def layout(df: DataFrame) -> str:
    """Column names and types, by name."""
    return ",".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted(df.schema.fields, key=lambda f: f.name))


def table_fingerprint(df: DataFrame, name: str) -> DataFrame:
    """(name, rows, fingerprint): the sums of the row digests' quarters, and a digest of the layout.

    A sum does not depend on row order, and unlike a parity it notices repeated rows. A table
    without columns counts its rows only.
    """
    limbs = [F.conv(F.substring("d", 16 * k + 1, 16), 16, 10).cast("decimal(20,0)") for k in range(LIMBS)]
    sums = [F.coalesce(F.sum(x), F.lit(0)).cast("string") for x in limbs]
    digests = df.select(row_digest(df).alias("d")) if df.columns else df.select(F.lit("0" * 64).alias("d"))
    return digests.agg(F.count("*").alias("rows"), F.concat_ws("-", *sums).alias("sums")).select(
        F.lit(name).alias("name"), "rows",
        F.concat("sums", F.lit("-"), F.left(F.sha2(F.lit(layout(df)), 256), F.lit(16))).alias("fingerprint"))


def manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    return union_all([table_fingerprint(df, name) for name, df in tables.items()])


def file_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, rows, fingerprint) per result file, rows being its bytes; every file is one row
    of a task, so this is for report documents, not for table data."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option(
        "recursiveFileLookup", "true").load(path)
    return files.select(
        F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("rows"),
        F.sha2("content", 256).alias("fingerprint"))


def manifest_differences(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(name, status): modified, missing, untracked or unchanged."""
    left = recorded.select("name", F.struct("rows", "fingerprint").alias("was"))
    right = current.select("name", F.struct("rows", "fingerprint").alias("now"))
    status = (
        F.when(F.col("was").isNull(), "untracked").when(F.col("now").isNull(), "missing")
        .when(F.col("was") != F.col("now"), "modified").otherwise("unchanged"))
    return left.join(right, "name", "full").select("name", status.alias("status"))
