"""Exploratory summaries of volume, revenue, delivery, scores and concentration.

Windows without a partition run only over rows that were already aggregated to a
vocabulary of fixed size (states, categories, calendar weeks). Seller, city and product
tables use ``ordering`` instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from orderloom.functions.metrics import delay_days, month_of, right_closed_bin, share_pct, week_start
from orderloom.functions.vocabulary import CONCENTRATION_PERCENTS, DELAY_BINS, DELAY_LABELS
from orderloom.operators.ordering import fences_of, median_of, quantiles, quantiles_of, ranked_values, running_totals, value_at
from orderloom.operators.quality import union_all
from orderloom.session import written

def everything() -> WindowSpec:
    """One group of all rows; for small aggregated tables only."""
    return Window.partitionBy(F.lit(0))


def with_delay(orders: DataFrame) -> DataFrame:
    """Delivered orders with their fractional delay."""
    return orders.where(F.col("delivered_ts").isNotNull()).withColumn(
        "delay_days", delay_days(F.col("delivered_ts"), F.col("estimated_ts")))


def monthly_volume(orders: DataFrame) -> DataFrame:
    return orders.groupBy(month_of(F.col("purchase_ts")).alias("order_month")).agg(
        F.count("*").alias("order_count"))


def month_gaps(orders: DataFrame) -> DataFrame:
    """Months between the first and the last one that have no order."""
    month = F.trunc(F.col("purchase_ts").cast("date"), "month")
    seen = orders.select(month.alias("m")).where("m is not null").distinct()
    span = seen.agg(F.min("m").alias("lo"), F.max("m").alias("hi")).where("lo is not null")
    every = span.select(F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("m"))
    return every.join(seen, "m", "left_anti").select(month_of(F.col("m")).alias("missing_month"))


def weekly_volume(orders: DataFrame) -> DataFrame:
    return orders.groupBy(week_start(F.col("purchase_ts")).alias("week_start")).agg(
        F.count("*").alias("order_count"))


def weekly_anomalies(orders: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """Weeks outside mean ± sigmas · sample standard deviation of the weekly counts."""
    stats = weekly_volume(orders).select(
        "week_start", "order_count",
        F.avg("order_count").over(everything()).alias("weekly_mean"),
        F.stddev_samp("order_count").over(everything()).alias("weekly_std"))
    return stats.where(F.abs(F.col("order_count") - F.col("weekly_mean")) > sigmas * F.col("weekly_std"))


def describe(long: DataFrame, percentiles: Sequence[float], by: str = "measure", value: str = "value") -> DataFrame:
    """count, mean, std, min, max and exact percentiles per measure of a long table."""
    # Moments and percentiles read the stacked measures, so their sources are evaluated once.
    long = written(long.select(by, value), "measures")
    moments = long.groupBy(by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    names = {f"p{int(round(p * 100)):02d}": p for p in percentiles}
    return moments.join(quantiles(long, value, names, by=[by]), by)


def measures(**columns: tuple[DataFrame, object]) -> DataFrame:
    """Stack (DataFrame, column) pairs into (measure, value)."""
    return union_all([
        df.select(F.lit(name).alias("measure"), F.lit(column).cast("double").alias("value")
                  if not isinstance(column, str) else F.col(column).cast("double").alias("value"))
        for name, (df, column) in columns.items()])


def item_revenue() -> Column:
    return F.col("price") + F.col("freight_value")


def revenue_by_category(items: DataFrame, products: DataFrame, top: int = 20) -> DataFrame:
    """Revenue, orders, items and revenue share of the top categories; unknown categories are left out."""
    # One aggregation on (category, order): a product has few items of one order, so summing those first only costs memory.
    known = products.where(F.col("category").isNotNull()).select("product_id", "category")
    per_order = items.join(known, "product_id").groupBy("category", "order_id").agg(
        F.sum(item_revenue()).alias("revenue"), F.count("*").alias("n"))
    grouped = per_order.groupBy("category").agg(
        F.sum("revenue").alias("total_revenue"),
        F.count("order_id").alias("order_count"),
        F.sum("n").alias("item_count"))
    return grouped.select(
        "category", F.col("total_revenue").cast("double").alias("total_revenue"), "order_count", "item_count",
        share_pct(F.col("total_revenue"), F.sum("total_revenue").over(everything())).alias("pct_revenue"),
    ).orderBy(F.desc("total_revenue"), "category").limit(top)


def revenue_by_state(items: DataFrame, orders: DataFrame, customers: DataFrame) -> DataFrame:
    per_order = items.groupBy("order_id").agg(F.sum(item_revenue()).alias("revenue"))
    placed = orders.select("order_id", "customer_id").join(customers.select("customer_id", "state"), "customer_id")
    grouped = per_order.join(placed, "order_id").where("state is not null").groupBy("state").agg(
        F.sum("revenue").alias("total_revenue"), F.count("*").alias("order_count"))
    return grouped.select(
        "state", F.col("total_revenue").cast("double").alias("total_revenue"), "order_count",
        share_pct(F.col("total_revenue"), F.sum("total_revenue").over(everything())).alias("pct_revenue"))


def revenue_by_payment_type(order_payments: DataFrame) -> DataFrame:
    grouped = order_payments.groupBy("primary_payment_type").agg(
        F.sum("total_payment_value").alias("total_payment"), F.count("order_id").alias("order_count"))
    return grouped.select(
        "primary_payment_type", F.col("total_payment").cast("double").alias("total_payment"), "order_count",
        share_pct(F.col("total_payment"), F.sum("total_payment").over(everything())).alias("pct_payment"))


def delivery_summary(orders: DataFrame) -> DataFrame:
    delay = delay_days(F.col("delivered_ts"), F.col("estimated_ts"))
    counts = orders.agg(
        F.count("*").alias("total_orders"),
        F.count("delivered_ts").alias("delivered"),
        F.count_if(F.col("delivered_ts").isNull()).alias("undelivered"),
        F.count_if(delay <= 0).alias("on_time"),
        F.count_if(delay > 0).alias("late"))
    return counts.select(
        "*", share_pct(F.col("on_time"), F.col("delivered")).alias("on_time_pct"),
        share_pct(F.col("late"), F.col("delivered")).alias("late_pct"))


def delay_rate_by_state(orders: DataFrame, customers: DataFrame) -> DataFrame:
    joined = with_delay(orders).join(customers.select("customer_id", "state"), "customer_id", "left")
    return joined.where("state is not null").groupBy("state").agg(
        F.count("*").alias("total_orders"), F.count_if(F.col("delay_days") > 0).alias("late_orders"),
    ).withColumn("delay_rate_pct", share_pct(F.col("late_orders"), F.col("total_orders")))


def delay_rate_by_category(
    orders: DataFrame, items: DataFrame, products: DataFrame, min_items: int = 50, top: int = 20
) -> DataFrame:
    """Item-grain late rate per category with enough items, worst first."""
    per_product = items.groupBy("order_id", "product_id").agg(F.count("*").alias("n"))
    joined = (
        with_delay(orders).select("order_id", "delay_days").join(per_product, "order_id")
        .groupBy("product_id").agg(
            F.sum("n").alias("n"), F.sum(F.when(F.col("delay_days") > 0, F.col("n")).otherwise(0)).alias("late"))
        .join(products.where("category is not null"), "product_id"))
    return joined.groupBy("category").agg(
        F.sum("n").alias("total_items"), F.sum("late").alias("late_items"),
    ).where(F.col("total_items") >= min_items).withColumn(
        "delay_rate_pct", share_pct(F.col("late_items"), F.col("total_items"))
    ).orderBy(F.desc("delay_rate_pct"), "category").limit(top)


def score_distribution(reviews: DataFrame) -> DataFrame:
    """Count and share per score, with the overall mean, median and deviation beside it.

    All of it comes from the counts, one row per score.
    """
    counts = reviews.where("review_score is not null").groupBy("review_score").agg(F.count("*").alias("n"))
    n, score = F.col("n"), F.col("review_score")
    total = F.sum(n).over(everything())
    spread = counts.select(
        "review_score", "n", total.alias("total"),
        (F.sum(n * score).over(everything()).cast("double") / total).alias("mean_score"))
    deviation = F.col("n") * (F.col("review_score") - F.col("mean_score")) ** 2
    ranked = running_totals(counts, ["review_score"], {"n": "_upto"}, bounded=True)
    median = quantiles_of(ranked, "review_score", {"median": 0.5})
    return spread.select(
        "review_score", "n", share_pct(F.col("n"), F.col("total")).alias("pct"), "mean_score",
        median.select("median").scalar().alias("median_score"),
        F.sqrt(F.try_divide(F.sum(deviation).over(everything()), F.col("total") - 1)).alias("std_score"))


def score_by_category(
    reviews: DataFrame, items: DataFrame, products: DataFrame, min_reviews: int = 30, edge: int = 15
) -> DataFrame:
    """Scores by category of the order's first item, the lowest and highest ``edge`` groups."""
    first_item = items.groupBy("order_id").agg(
        F.min_by("product_id", F.struct("item_id", "product_id", "seller_id")).alias("product_id"))
    tagged = reviews.select("order_id", "review_score").join(first_item, "order_id").join(
        products.where("category is not null"), "product_id").select("category", "review_score")
    grouped = tagged.groupBy("category").agg(
        F.avg("review_score").alias("mean_score"), F.count("review_score").alias("review_count"))
    ranked = grouped.where(F.col("review_count") >= min_reviews).join(
        median_of(tagged, "review_score", ["category"], bounded=True), "category").select(
        "category", "mean_score", F.col("median").alias("median_score"), "review_count")
    low = ranked.orderBy("mean_score", "category").limit(edge).withColumn("edge", F.lit("bottom"))
    high = ranked.orderBy(F.desc("mean_score"), F.desc("category")).limit(edge).withColumn("edge", F.lit("top"))
    return low.unionByName(high)


def score_by_delay_bucket(
    reviews: DataFrame, orders: DataFrame,
    edges: Sequence[float] = DELAY_BINS, labels: Sequence[str] = DELAY_LABELS,
) -> DataFrame:
    bucketed = reviews.select("order_id", "review_score").join(
        with_delay(orders).select("order_id", "delay_days"), "order_id").select(
        right_closed_bin(F.col("delay_days"), edges, labels).alias("delay_bucket"), "review_score")
    score = F.col("review_score")
    grouped = bucketed.groupBy("delay_bucket").agg(
        F.avg(score).alias("mean_score"), F.stddev_samp(score).alias("std_score"),
        F.count(score).alias("review_count"),
        share_pct(F.count_if(score == 1), F.count("*")).alias("pct_score_1"),
        share_pct(F.count_if(score == 5), F.count("*")).alias("pct_score_5"))
    medians = median_of(bucketed, "review_score", ["delay_bucket"], bounded=True)
    return grouped.join(medians.withColumnRenamed("median", "median_score"), "delay_bucket")


def score_ontime_late(reviews: DataFrame, orders: DataFrame) -> DataFrame:
    split = reviews.select("order_id", "review_score").join(
        with_delay(orders).select("order_id", "delay_days"), "order_id").select(
        (F.col("delay_days") <= 0).alias("on_time"), "review_score")
    grouped = split.groupBy("on_time").agg(
        F.avg("review_score").alias("mean_score"), F.count("review_score").alias("review_count"))
    return grouped.join(median_of(split, "review_score", ["on_time"], bounded=True), "on_time").select(
        "on_time", "mean_score", F.col("median").alias("median_score"), "review_count")


def orders_by_state(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Count, share and cumulative share per state, largest first."""
    grouped = orders.select("customer_id").join(customers.select("customer_id", "state"), "customer_id") \
        .where("state is not null").groupBy("state").agg(F.count("*").alias("order_count"))
    total = F.sum("order_count").over(everything())
    upto = everything().orderBy(F.desc("order_count"), "state").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return grouped.select(
        "state", "order_count", share_pct(F.col("order_count"), total).alias("pct"),
        share_pct(F.sum("order_count").over(upto), total).alias("cumulative_pct"))


def top_cities(orders: DataFrame, customers: DataFrame, top: int = 20) -> DataFrame:
    grouped = orders.select("customer_id").join(
        customers.select("customer_id", "state", "city"), "customer_id").where(
        "state is not null and city is not null").groupBy("state", "city").agg(F.count("*").alias("order_count"))
    total = grouped.agg(F.sum("order_count")).scalar()
    return grouped.orderBy(F.desc("order_count"), "state", "city").limit(top).withColumn(
        "pct", share_pct(F.col("order_count"), total))


def geo_coverage(customers: DataFrame, geo: DataFrame, key: str = "zip_code_prefix") -> DataFrame:
    """Customers whose zip is in the geolocation table, and distinct zips on both sides."""
    known = geo.select(key).distinct()
    per_zip = customers.groupBy(key).agg(F.count("*").alias("n"))
    covered = per_zip.join(known.withColumn("hit", F.lit(True)), key, "left")
    return covered.agg(
        F.sum("n").alias("customers"),
        F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("covered_customers"),
        F.count(key).alias("customer_zips"),
    ).select(
        "*", known.agg(F.count(key)).scalar().alias("geo_zips"),
        share_pct(F.col("covered_customers"), F.col("customers")).alias("covered_pct"))


def seller_totals(items: DataFrame) -> DataFrame:
    per_order = items.groupBy("seller_id", "order_id").agg(
        F.sum(item_revenue()).alias("revenue"), F.count("*").alias("n"))
    return per_order.groupBy("seller_id").agg(
        F.count("*").alias("order_count"), F.sum("n").alias("item_count"),
        F.sum("revenue").alias("total_revenue"))


def seller_pareto(items: DataFrame, order_by: str = "total_revenue") -> DataFrame:
    """Cumulative shares over sellers, ranked by revenue (or by ``order_count``)."""
    ranked = running_totals(
        seller_totals(items), [F.desc(order_by), F.col("seller_id")],
        {"total_revenue": "_rev", "order_count": "_ord"})
    return ranked.select(
        "seller_id", "order_count", "item_count", F.col("total_revenue").cast("double").alias("total_revenue"),
        share_pct(F.col("total_revenue"), F.col("_rev_total")).alias("pct_revenue"),
        share_pct(F.col("_rev"), F.col("_rev_total")).alias("cum_pct_revenue"),
        share_pct(F.col("order_count"), F.col("_ord_total")).alias("pct_orders"),
        share_pct(F.col("_ord"), F.col("_ord_total")).alias("cum_pct_orders"))


def seller_concentration(pareto: DataFrame, thresholds: Sequence[float] = CONCENTRATION_PERCENTS) -> DataFrame:
    """Sellers needed to reach each share of revenue and of orders."""
    counted = pareto.agg(
        F.count("*").alias("sellers"),
        *[(F.count_if(F.col(f"cum_pct_{m}") <= t) + 1).alias(f"{m}_{i}")
          for i, t in enumerate(thresholds) for m in ("revenue", "orders")])
    rows = [F.struct(
        F.lit(float(t)).alias("threshold_pct"),
        F.col(f"revenue_{i}").alias("sellers_for_revenue"),
        F.col(f"orders_{i}").alias("sellers_for_orders")) for i, t in enumerate(thresholds)]
    return counted.select("sellers", F.explode(F.array(*rows)).alias("r")).select(
        "r.*", share_pct(F.col("r.sellers_for_revenue"), F.col("sellers")).alias("pct_sellers_revenue"),
        share_pct(F.col("r.sellers_for_orders"), F.col("sellers")).alias("pct_sellers_orders"))


def iqr_outlier_report(long: DataFrame, multiplier: float = 1.5, top: int = 5) -> DataFrame:
    """Fences, counts outside them, extremes and the largest values per measure.

    Everything after the first pass reads the ranked distinct values, not the rows.
    """
    ranked = ranked_values(long, "value", by=["measure"])
    fences = fences_of(ranked, "value", multiplier, by=["measure"])
    n, value = F.col("n"), F.col("value")
    # One row per measure on the right: the number of measures is fixed by the caller.
    counted = ranked.join(F.broadcast(fences), "measure").groupBy("measure").agg(
        F.sum(n).alias("n"),
        F.sum(F.when(value < F.col("lower_fence"), n).otherwise(0)).alias("low_outliers"),
        F.sum(F.when(value > F.col("upper_fence"), n).otherwise(0)).alias("high_outliers"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        *[value_at("value", F.col("_upto_total") - i).alias(f"top_{i}") for i in range(1, top + 1)])
    return fences.join(counted, "measure")


def histogram_clipped(orders: DataFrame, low: float = -30, high: float = 60, bins: int = 90) -> DataFrame:
    """Delay histogram over [low, high]; values outside are counted in the edge bins."""
    clipped = F.least(F.greatest(F.col("delay_days"), F.lit(float(low))), F.lit(float(high)))
    bucket = F.least(F.width_bucket(clipped, F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins))
    width = (high - low) / bins
    return with_delay(orders).groupBy(bucket.cast("long").alias("bin")).agg(F.count("*").alias("n")).select(
        "bin", (F.lit(float(low)) + (F.col("bin") - 1) * F.lit(width)).alias("bin_start"), "n")


def boxplot_stats(orders: DataFrame, whisker: float = 1.5) -> DataFrame:
    """Quartiles, and the most extreme values inside the fences."""
    delays = with_delay(orders).select("delay_days")
    box = quantiles(delays, "delay_days", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    low = box.select(F.col("q1") - whisker * (F.col("q3") - F.col("q1"))).scalar()
    high = box.select(F.col("q3") + whisker * (F.col("q3") - F.col("q1"))).scalar()
    inside = delays.where((F.col("delay_days") >= low) & (F.col("delay_days") <= high))
    return inside.agg(
        F.min("delay_days").alias("whisker_low"), F.max("delay_days").alias("whisker_high")
    ).select("*", *[box.select(c).scalar().alias(c) for c in ("q1", "median", "q3")])
