"""Row audits, key and reference checks, and metric reconciliation.

Every function reports violations as rows; none of them stops a job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row_audit(steps: Mapping[str, DataFrame]) -> DataFrame:
    """(step, rows), one aggregate per step."""
    return union_all([
        df.agg(F.count("*").alias("rows")).select(F.lit(step).alias("step"), "rows")
        for step, df in steps.items()
    ])


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def key_uniqueness(checks: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """(check, n_rows, n_keys, n_duplicated_keys, is_unique) per table and key."""
    parts = []
    for name, (df, keys) in checks.items():
        per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
        parts.append(per_key.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            F.count("*").alias("n_keys"),
            F.count_if(F.col("n") > 1).alias("n_duplicated_keys"),
        ).select(
            F.lit(name).alias("check_name"), "*",
            (F.col("n_duplicated_keys") == 0).alias("is_unique")))
    return union_all(parts)


def orphan_counts(checks: Mapping[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(reference, orphans): child rows whose key has no parent."""
    parts = []
    for name, (child, child_key, parent, parent_key) in checks.items():
        parents = parent.select(F.col(parent_key).alias("_parent"))
        orphans = child.select(child_key).join(parents, F.col(child_key) == F.col("_parent"), "left_anti")
        parts.append(orphans.agg(F.count("*").alias("orphans")).select(
            F.lit(name).alias("reference"), "orphans"))
    return union_all(parts)


def join_cardinality(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows before and after a left join, and whether the join kept one row per row.

    Counted from key frequencies on the right, so the join result is never built.
    """
    matches = right.groupBy(key).agg(F.count("*").alias("_m"))
    return left.select(key).join(matches, key, "left").agg(
        F.count("*").alias("rows_before"),
        F.sum(F.coalesce("_m", F.lit(1))).alias("rows_after"),
    ).withColumn("one_to_one", F.col("rows_before") == F.col("rows_after"))


def reconcile(
    exported: DataFrame, source: DataFrame, tolerance: Mapping[str, float] | float = 0.0
) -> DataFrame:
    """Compare (label, value) tables: relative difference against a tolerance.

    A label missing on either side is a failure.
    """
    diff = F.abs(F.col("exported") - F.col("source")) / F.greatest(F.abs(F.col("source")), F.lit(1.0))
    if isinstance(tolerance, Mapping):
        limit: Column = F.lit(0.0)
        for label, value in tolerance.items():
            limit = F.when(F.col("label") == label, F.lit(float(value))).otherwise(limit)
    else:
        limit = F.lit(float(tolerance))
    left = exported.select("label", F.col("value").cast("double").alias("exported"))
    right = source.select("label", F.col("value").cast("double").alias("source"))
    return left.join(right, "label", "full").withColumn("rel_diff", diff).withColumn(
        "ok", F.coalesce(F.col("rel_diff") <= limit, F.lit(False)))
