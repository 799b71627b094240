"""Running totals, exact quantiles and average ranks without a single-task sort.

Each function first collapses equal values to (value, count). The collapsed rows are
range-partitioned over the whole order, so a hot group is split over many tasks, and a
running total is the total of the earlier partitions plus a running sum inside the
partition. ``bounded=True`` is for columns with a small fixed domain (review scores,
category rows of a report): there the collapsed rows of a group fit one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.session import checkpointed




def running_totals(
    df: DataFrame,
    order: Sequence[str | Column],
    sums: dict[str, str],
    by: Sequence[str] = (),
    bounded: bool = False,
) -> DataFrame:
    """Add, per entry ``column -> name``, the inclusive running total ``name`` and ``name_total``.

    ``order`` must identify a row within its group, so that the result is unique.
    """
    by = list(by)
    if bounded:
        whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        upto = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(
            "*",
            *[F.sum(c).over(upto).alias(n) for c, n in sums.items()],
            *[F.sum(c).over(whole).alias(f"{n}_total") for c, n in sums.items()],
        )

    # No partition count is given, so adaptive execution sizes the ranges to the data; it
    # only ever merges neighbours, which keeps the ranges in order.
    spread = checkpointed(
        df.repartitionByRange(*[F.col(k) for k in by], *order).withColumn("_part", F.spark_partition_id()))
    # At most one row per group and partition: small, whatever the group sizes.
    pieces = spread.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_{n}") for c, n in sums.items()])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = pieces.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)],
        F.col("_part").alias("_p"),
        *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in sums.values()],
        *[F.sum(f"_{n}").over(group).alias(f"{n}_total") for n in sums.values()],
    )
    on = spread["_part"] == bases["_p"]
    for i, key in enumerate(by):
        on = on & spread[key].eqNullSafe(bases[f"_k{i}"])
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return spread.join(bases, on).select(
        *[spread[c] for c in df.columns],
        *[(F.col(f"_base_{n}") + F.sum(c).over(inside)).alias(n) for c, n in sums.items()],
        *[F.col(f"{n}_total") for n in sums.values()],
    )


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))


def ranked_values(df: DataFrame, value: str, by: Sequence[str] = (), bounded: bool = False) -> DataFrame:
    """(group, value, n, _upto, _upto_total): distinct values with their running count."""
    return running_totals(value_counts(df, value, by), [F.col(value)], {"n": "_upto"}, by, bounded)


def value_at(value: str, position: Column) -> Column:
    """Aggregate over ranked values: the value at a zero-based position of its group."""
    inside = (F.col("_upto") - F.col("n") <= position) & (position < F.col("_upto"))
    return F.max(F.when(inside, F.col(value).cast("double")))


def quantiles_of(ranked: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    picks, finals = [], []
    for name, p in probs.items():
        position = (F.col("_upto_total") - 1) * F.lit(float(p))
        picks += [
            value_at(value, F.floor(position)).alias(f"_lo_{name}"),
            value_at(value, F.ceil(position)).alias(f"_hi_{name}"),
            F.max(position - F.floor(position)).alias(f"_w_{name}"),
        ]
        low, high, weight = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_w_{name}")
        finals.append((low + (high - low) * weight).alias(name))
    return ranked.groupBy(*by).agg(*picks).select(*by, *finals)


def quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (), bounded: bool = False
) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per group (name -> probability)."""
    return quantiles_of(ranked_values(df, value, by, bounded), value, probs, by)


def median_of(df: DataFrame, value: str, by: Sequence[str] = (), bounded: bool = False) -> DataFrame:
    return quantiles(df, value, {"median": 0.5}, by, bounded)


def fences_of(ranked: DataFrame, value: str, multiplier: float = 1.5, by: Sequence[str] = ()) -> DataFrame:
    quartiles = quantiles_of(ranked, value, {"q1": 0.25, "q3": 0.75}, by)
    iqr = F.col("q3") - F.col("q1")
    return quartiles.select(
        *by, "q1", "q3", iqr.alias("iqr"),
        (F.col("q1") - multiplier * iqr).alias("lower_fence"),
        (F.col("q3") + multiplier * iqr).alias("upper_fence"),
    )


def iqr_fences(
    df: DataFrame, value: str, multiplier: float = 1.5, by: Sequence[str] = (), bounded: bool = False
) -> DataFrame:
    """Q1, Q3, IQR and both fences."""
    return fences_of(ranked_values(df, value, by, bounded), value, multiplier, by)


def average_ranks(
    counts: DataFrame, value: str, n: str = "n", by: Sequence[str] = (), bounded: bool = False
) -> DataFrame:
    """Add ``avg_rank`` (ties share it) and ``rows_total`` to rows of (group, value, count)."""
    ranked = running_totals(counts, [F.col(value)], {n: "_upto"}, by, bounded)
    return ranked.select(
        *by, value, n,
        (F.col("_upto") - (F.col(n) - 1) / F.lit(2.0)).alias("avg_rank"),
        F.col("_upto_total").alias("rows_total"),
    )
