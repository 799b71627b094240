"""Rank statistics and the logistic model.

Rows are collapsed to distinct values with counts before anything is ranked. The
p-values are native expressions (``functions.tails``) on the results; the logistic
coefficients, which are on the driver anyway, use ``functions.significance``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions import significance, tails
from orderloom.operators.ordering import average_ranks, median_of
from orderloom.session import checkpointed


def spearman_set(
    df: DataFrame, pairs: dict[str, tuple[str, str]], x_bounded: bool = False, y_bounded: bool = False
) -> DataFrame:
    """(pair, rho, n) per named column pair, all pairs in one scan.

    ``*_bounded`` marks sides with a small fixed domain. The distinct (x, y) pairs are
    written once, since both rankings and the final sums read them.
    """
    cells = F.array(*[
        F.struct(F.lit(label).alias("pair"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        for label, (x, y) in pairs.items()])
    long = df.select(F.explode(cells).alias("r")).select("r.*").where("x is not null and y is not null")
    joint = checkpointed(long.groupBy("pair", "x", "y").agg(F.count("*").alias("c")))

    def ranks(side: str, bounded: bool) -> DataFrame:
        sizes = joint.groupBy("pair", side).agg(F.sum("c").alias("n"))
        return average_ranks(sizes, side, by=["pair"], bounded=bounded)

    rx = ranks("x", x_bounded).select("pair", "x", F.col("avg_rank").alias("rx"), F.col("rows_total").alias("total"))
    ry = ranks("y", y_bounded).select("pair", "y", F.col("avg_rank").alias("ry"))
    middle = (F.col("total") + 1) / F.lit(2.0)
    dx, dy = F.col("rx") - middle, F.col("ry") - middle
    sums = joint.join(rx, ["pair", "x"]).join(ry, ["pair", "y"]).groupBy("pair").agg(
        F.sum("c").alias("n"),
        F.sum(F.col("c") * dx * dy).alias("xy"),
        F.sum(F.col("c") * dx * dx).alias("xx"),
        F.sum(F.col("c") * dy * dy).alias("yy"))
    return sums.select(
        "pair", F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("rho"), "n")


def _ranked_cells(df: DataFrame, group: str, value: str, bounded: bool, carry: str | None = None) -> DataFrame:
    """(group, value, c, n, avg_rank, ties): c rows of the group hold the value, n rows in all.

    ``ties`` adds up to the sum of t^3 - t over the tied values. ``carry`` is summed along.
    """
    extra = [F.sum(carry).alias("carried")] if carry else []
    cells = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group, value).agg(
        F.count("*").alias("c"), *extra)
    sizes = cells.groupBy(value).agg(F.sum("c").alias("n"))
    n = F.col("n").cast("double")
    return cells.join(average_ranks(sizes, value, bounded=bounded), value).withColumn(
        "ties", F.col("c") * (n * n - 1))


def delivered_totals(reviews: DataFrame) -> DataFrame:
    """Review-level rows of delivered orders with the order's totals as doubles: what the tests compare."""
    return reviews.where("delay_days is not null").select(
        "review_id", "order_id", "review_score", "is_late", "delay_days", "is_neg_review",
        F.col("order_items_price").cast("double").alias("price"),
        F.col("order_freight").cast("double").alias("freight_value"))


def group_means(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"))


def mannwhitney(
    df: DataFrame, first: str, value: str, bounded: bool = False, carry: str | None = None
) -> DataFrame:
    """U of the rows where the boolean ``first`` holds against the others.

    ``carry`` adds the mean of that column on both sides as ``rate1`` and ``rate2``.
    """
    cells = _ranked_cells(df, first, value, bounded, carry)

    def side(flag: bool, amount: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col(first) == F.lit(flag), amount)), F.lit(0))

    total = F.col("c") * F.col(value)
    rates = [side(True, F.col("carried")).alias("k1"), side(False, F.col("carried")).alias("k2")] if carry else []
    sums = cells.agg(
        side(True, F.col("c")).alias("n1"), side(False, F.col("c")).alias("n2"),
        side(True, total).alias("s1"), side(False, total).alias("s2"),
        side(True, F.col("c") * F.col("avg_rank")).alias("r1"), F.sum("ties").alias("tie_sum"), *rates)
    return sums.select(
        "n1", "n2",
        F.try_divide(F.col("s1").cast("double"), F.col("n1")).alias("mean1"),
        F.try_divide(F.col("s2").cast("double"), F.col("n2")).alias("mean2"),
        (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / F.lit(2.0)).alias("u"), "tie_sum",
        *([F.try_divide(F.col("k1").cast("double"), F.col("n1")).alias("rate1"),
           F.try_divide(F.col("k2").cast("double"), F.col("n2")).alias("rate2")] if carry else []))


def mannwhitney_late(reviews: DataFrame) -> DataFrame:
    """On-time against late review scores, with the negative review rate of both."""
    delivered = reviews.where("is_late is not null").withColumn("on_time", F.col("is_late") == 0)
    return mannwhitney(delivered, "on_time", "review_score", bounded=True, carry="is_neg_review").withColumnsRenamed({
        "n1": "ontime_n", "n2": "late_n", "mean1": "ontime_mean", "mean2": "late_mean",
        "rate1": "ontime_neg_review_rate", "rate2": "late_neg_review_rate"})


def mannwhitney_freight(reviews: DataFrame, freight: str = "freight_value") -> DataFrame:
    """Scores of low-freight against high-freight reviews, split at the exact median."""
    delivered = reviews.where("is_late is not null")
    middle = median_of(delivered, freight).select("median").scalar()
    split = delivered.withColumn("low_freight", F.col(freight) <= middle)
    return mannwhitney(split, "low_freight", "review_score", bounded=True).withColumnsRenamed({
        "n1": "low_n", "n2": "high_n", "mean1": "low_mean", "mean2": "high_mean",
    }).withColumn("median_freight", middle)


def kruskal(df: DataFrame, group: str, value: str, bounded: bool = False) -> DataFrame:
    """Tie-corrected H, group count and row count."""
    per_group = _ranked_cells(df, group, value, bounded).groupBy(group).agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("avg_rank")).alias("rank_sum"), F.sum("ties").alias("ties"))
    n = F.col("n_rows").cast("double")
    raw = F.lit(12.0) / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    correction = F.lit(1.0) - F.col("tie_sum") / (n * n * n - n)
    return per_group.agg(
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s"),
        F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.sum("ties").alias("tie_sum"),
    ).select("n_groups", "n_rows", F.try_divide(raw, correction).alias("h"))


def extreme_categories(categories: DataFrame, count: int = 5) -> DataFrame:
    """Reliable categories with the highest and lowest mean score."""
    rows = categories.where("confidence = 'HIGH'").select(
        "category", "review_count", "avg_review_score", "neg_review_rate")
    top = rows.orderBy(F.desc("avg_review_score"), "category").limit(count).withColumn("side", F.lit("top"))
    low = rows.orderBy("avg_review_score", "category").limit(count).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


def logit_negative_review(
    df: DataFrame, predictors: Sequence[str] = ("delay_days", "price", "freight_value"),
    label: str = "is_neg_review", max_iter: int = 50,
) -> DataFrame:
    """Coefficient, odds ratio, z and p per predictor, with pseudo R² and n.

    The fit is a distributed IRLS; only the coefficient table reaches the driver. The
    p-values are recomputed from z, since the fitted model rounds very small ones to 0.
    """
    complete = df.select(F.col(label).cast("double").alias("label"), *[
        F.col(p).cast("double").alias(p) for p in predictors]).na.drop()
    # The fit reads its rows once per iteration: cut off whatever joins produced them.
    rows = checkpointed(VectorAssembler(inputCols=list(predictors), outputCol="features").transform(
        complete).select("label", "features"))
    model = GeneralizedLinearRegression(
        family="binomial", link="logit", maxIter=max_iter, tol=1e-10).fit(rows)
    summary = model.summary
    names = [*predictors, "const"]
    values = [*model.coefficients.toArray().tolist(), model.intercept]
    result = []
    for name, value, error in zip(names, values, summary.coefficientStandardErrors):
        z = value / error
        result.append((
            name, float(value), math.exp(value), float(z), significance.normal_two_sided(z),
            1.0 - summary.deviance / summary.nullDeviance, int(summary.numInstances)))
    return df.sparkSession.createDataFrame(
        result, "predictor string, coef double, odds_ratio double, z double, p_value double, "
                "pseudo_r2 double, n_obs long")


def spearman_with_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p_value", tails.spearman_p(F.col("rho"), F.col("n")))


def mannwhitney_with_p(df: DataFrame, n1: str, n2: str) -> DataFrame:
    return df.withColumn("p_value", tails.mannwhitney_upper(F.col("u"), F.col(n1), F.col(n2), F.col("tie_sum")))


def kruskal_with_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p_value", F.when(F.col("n_groups") > 1, tails.chi2_upper(F.col("h"), F.col("n_groups") - 1)))
