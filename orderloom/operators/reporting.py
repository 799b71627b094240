"""Report tables: small, rounded projections of the analysis results.

Inputs are aggregated tables whose rows are categories, states, aspects, months or
topics, so ordering and windows over all rows are cheap here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from orderloom.functions.metrics import share_pct
from orderloom.functions.vocabulary import NO_ASPECT, SEGMENTS, STATE_NAMES
from orderloom.operators.business import complaint_matrix_long
from orderloom.operators.quality import union_all


def _all_rows() -> WindowSpec:
    return Window.partitionBy(F.lit(0))


# --- headlines ----------------------------------------------------------------------
def headline_aspects(summary: DataFrame, top: int = 3) -> DataFrame:
    """Aspects with the most negative mentions and the one with the highest negative rate."""
    named = summary.where(F.col("aspect") != NO_ASPECT).select(
        "aspect", "total_mentions", "negative",
        F.round(share_pct(F.col("negative"), F.sum("negative").over(_all_rows())), 1).alias("share_of_negative_pct"),
        F.round(share_pct(F.col("negative"), F.col("total_mentions")), 1).alias("neg_pct"),
        F.row_number().over(_all_rows().orderBy(F.desc("negative"), "aspect")).alias("by_count"),
        F.row_number().over(_all_rows().orderBy(
            F.desc(F.col("negative") / F.col("total_mentions")), "aspect")).alias("by_rate"))
    return named.where((F.col("by_count") <= top) | (F.col("by_rate") == 1)).select(
        "aspect", "total_mentions", "negative", "share_of_negative_pct", "neg_pct",
        (F.col("by_count") <= top).alias("is_top_by_negative"), (F.col("by_rate") == 1).alias("is_highest_rate"))


def headline_late(orders: DataFrame) -> DataFrame:
    both = orders.where("delivered_ts is not null and estimated_ts is not null")
    late = F.count_if(F.col("delivered_ts") > F.col("estimated_ts"))
    return both.agg(
        F.count("*").alias("delivered_orders"), late.alias("late_orders"),
        F.round(share_pct(late, F.count("*")), 1).alias("late_pct"))


def headline_exposure(exposure: DataFrame, sensitivity: DataFrame, at_pct: float = 5.0) -> DataFrame:
    chosen = sensitivity.where(F.col("impact_pct") == at_pct).select("exposure").scalar()
    return exposure.select("affected_order_value", "affected_orders", chosen.alias("at_pct_exposure"))


def act_first(priorities: DataFrame, top: int = 5) -> DataFrame:
    """The leading categories of the high-risk, high-exposure quadrant and its size."""
    urgent = priorities.where(F.col("segment") == SEGMENTS[0])
    return urgent.select(
        "category", F.round("neg_sentiment_rate", 4).alias("neg_sentiment_rate"), "review_count",
        F.count("*").over(_all_rows()).alias("segment_size"), F.col("neg_sentiment_rate").alias("_rate"),
    ).orderBy(F.desc("_rate"), "category").limit(top).drop("_rate")


# --- report tables --------------------------------------------------------------------
def category_report(categories: DataFrame, min_reviews: int = 100) -> DataFrame:
    digits = {"avg_review_score": 3, "neg_review_rate": 4, "neg_sentiment_rate": 4, "avg_item_price": 2,
              "avg_freight": 2, "late_delivery_rate": 4}
    return categories.select(
        "category", "review_count", *[F.round(c, d).alias(c) for c, d in digits.items()],
        F.coalesce("top_complaint_aspect", F.lit("")).alias("top_complaint_topic"), "confidence",
        (F.col("review_count") < min_reviews).alias("low_n")).orderBy(F.desc("neg_sentiment_rate"), "category")


def unexpected_aspects(rows: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Aspects that no report column is made for; any row is an error."""
    return rows.select(F.explode("extracted_aspects").alias("aspect")).where(
        ~F.col("aspect").isin(*expected)).groupBy("aspect").agg(F.count("*").alias("mentions"))


def complaint_heatmap(
    rows: DataFrame, aspects: Sequence[str], min_reviews: int = 100, top: int = 20, key: str = "category"
) -> DataFrame:
    """Complaint percentages of the groups with the most reviews, one column per named aspect."""
    named = [a for a in aspects if a != NO_ASPECT]
    largest = rows.groupBy(key).agg(F.count("*").alias("review_count")).where(
        F.col("review_count") >= min_reviews).orderBy(F.desc("review_count"), key).limit(top)
    wide = complaint_matrix_long(rows, key).groupBy(key).pivot("aspect", named).agg(
        F.max(F.round(F.col("complaint_rate") * 100.0, 1)))
    return largest.join(wide, key, "left").na.fill(0.0, named)


def late_report(late: DataFrame, key: str) -> DataFrame:
    return late.select(key, F.round(F.col("late_rate") * 100.0, 2).alias("late_rate_pct"), F.col("n").alias("review_count"))


def delivery_report(late_states: DataFrame, late_categories: DataFrame, aspects: DataFrame, months: DataFrame) -> DataFrame:
    """The four delivery tables stacked as (section, name, metric, value)."""
    def stack(df: DataFrame, section: str, name: str, columns: Mapping[str, Column]) -> DataFrame:
        wide = df.select(F.col(name).alias("name"), *[c.cast("double").alias(n) for n, c in columns.items()])
        return wide.unpivot(["name"], list(columns), "metric", "value").withColumn("section", F.lit(section))

    parts = [
        stack(late_report(late_states, "state"), "state_late_rates", "state",
              {"late_rate_pct": F.col("late_rate_pct"), "review_count": F.col("review_count")}),
        stack(late_report(late_categories, "category"), "category_late_rates", "category",
              {"late_rate_pct": F.col("late_rate_pct"), "review_count": F.col("review_count")}),
        stack(aspects, "aspect_by_delivery", "aspect", {"on_time": F.col("on_time"), "late": F.col("late")}),
        stack(months, "monthly_trends", "order_month", {
            "review_count": F.col("review_count"), "neg_sentiment_rate": F.round("neg_sentiment_rate", 4)}),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def sensitivity_report(sensitivity: DataFrame) -> DataFrame:
    label = F.concat(F.col("impact_pct").cast("int").cast("string"), F.lit("% impact assumption"))
    return sensitivity.select("impact_pct", label.alias("label"), "exposure")


def prioritization_report(priorities: DataFrame, min_reviews: int = 100) -> DataFrame:
    return priorities.select(
        "category", "segment", F.round("neg_sentiment_rate", 4).alias("neg_sentiment_rate"),
        F.round("neg_review_rate", 4).alias("neg_review_rate"), F.round("total_value", 2).alias("total_value"),
        "review_count", (F.col("review_count") < min_reviews).alias("low_n"))


def p_label(p: Column) -> Column:
    return F.when(p == 0, "< 1e-300").when(p.isNotNull(), F.format_string("%.2e", p))


TEST_COLUMNS = ("section", "name", "statistic", "n", "mean", "p_value", "odds_ratio")


def _section(section: str, df: DataFrame, **columns: Column) -> DataFrame:
    """Rows of one part of the statistics report; columns it does not have are NULL."""
    kinds = {"name": "string", "n": "long"}
    return df.select(F.lit(section).alias("section"), *[
        columns.get(c, F.lit(None)).cast(kinds.get(c, "double")).alias(c) for c in TEST_COLUMNS[1:]])


def stats_report(
    correlations: DataFrame, lateness: DataFrame, bands: DataFrame, band_scores: DataFrame,
    logit: DataFrame | None = None, alpha: float = 0.05,
) -> DataFrame:
    """All tests of the analysis in one table, with readable p-values and a significance flag.

    Sections: rank correlations, on-time against late scores (test and both means), price bands (test and
    the mean of each band) and, if given, the logistic model's coefficients and odds ratios. Inputs are
    results of ``statistics``, a few rows each.
    """
    both = F.col("ontime_n") + F.col("late_n")
    sides = lateness.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.col(f"{column}_n").alias("n"), F.col(f"{column}_mean").alias("mean"))
        for name, column in (("on time", "ontime"), ("late", "late"))])).alias("r")).select("r.*")
    parts = [
        _section("correlations", correlations, name=F.col("pair"), statistic=F.col("rho"), n=F.col("n"), p_value=F.col("p_value")),
        _section("ontime_vs_late", lateness, name=F.lit("Mann-Whitney U"), statistic=F.col("u"), n=both, p_value=F.col("p_value")),
        _section("ontime_vs_late", sides, name=F.col("name"), n=F.col("n"), mean=F.col("mean")),
        _section("price_bands", bands, name=F.lit("Kruskal-Wallis H"), statistic=F.col("h"), n=F.col("n_rows"), p_value=F.col("p_value")),
        _section("price_bands", band_scores, name=F.col(band_scores.columns[0]), n=F.col("n"), mean=F.col("mean")),
    ]
    if logit is not None:
        parts.append(_section("logistic_regression", logit, name=F.col("predictor"), statistic=F.col("coef"), n=F.col("n_obs"),
                              p_value=F.col("p_value"), odds_ratio=F.col("odds_ratio")))
        parts.append(_section("logistic_regression", logit.where("predictor = 'const'"), name=F.lit("pseudo R2"),
                              statistic=F.col("pseudo_r2"), n=F.col("n_obs")))
    return union_all(parts).withColumn("p_label", p_label(F.col("p_value"))).withColumn(
        "significant", F.col("p_value") < alpha)


def aspect_report(summary: DataFrame) -> DataFrame:
    return summary.where("total_mentions > 0").select(
        "aspect", "total_mentions", "negative", "neutral", "positive",
        F.round(share_pct(F.col("negative"), F.col("total_mentions")), 1).alias("neg_pct"),
        F.round(share_pct(F.col("positive"), F.col("total_mentions")), 1).alias("pos_pct"),
    ).orderBy(F.desc("neg_pct"), "aspect")


def topic_report(topics: DataFrame, terms: int = 10) -> DataFrame:
    return topics.select(
        "topic_id", F.col("business_topic_name").alias("label"), "review_count",
        F.slice("representative_terms", 1, terms).alias("top_terms"))


def score_histogram(reviews: DataFrame) -> DataFrame:
    return reviews.where("review_score is not null").groupBy("review_score").agg(F.count("*").alias("n"))


def signals_report(by_signal: DataFrame) -> DataFrame:
    """Signal results without the patterns that produced them."""
    return by_signal.drop("patterns")


# --- interactive tables ----------------------------------------------------------------
def readable(name: Column) -> Column:
    """Underscores become spaces, the first letter a capital."""
    plain = F.trim(F.replace(name, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.left(plain, F.lit(1))), F.right(plain, F.length(plain) - 1))


def category_filter(report: DataFrame, confidence: str | None = None, low_n: bool | None = None) -> DataFrame:
    if confidence and confidence != "all":
        report = report.where(F.col("confidence") == confidence)
    if low_n is not None:
        report = report.where(F.col("low_n") == low_n)
    return report


def category_search(report: DataFrame, search: str = "", sort_by: str = "neg_sentiment_rate", descending: bool = True) -> DataFrame:
    wanted = search.strip().lower()
    if wanted:
        report = report.where(F.contains(F.lower(readable(F.col("category"))), F.lit(wanted)))
    return report.orderBy(F.desc(sort_by) if descending else F.asc(sort_by), "category")


def top_complaints(report: DataFrame, top: int = 15) -> DataFrame:
    return report.where("not low_n").orderBy(F.desc("neg_sentiment_rate"), "category").limit(top).select(
        "category", readable(F.col("category")).alias("name"), (F.col("neg_sentiment_rate") * 100.0).alias("negative_pct"))


def price_vs_complaint(report: DataFrame) -> DataFrame:
    return report.where("not low_n").select(
        readable(F.col("category")).alias("name"), "avg_item_price",
        (F.col("neg_sentiment_rate") * 100.0).alias("negative_pct"), "review_count")


def monthly_reliable(months: DataFrame, min_reviews: int = 100) -> DataFrame:
    """Monthly rate in percent; NULL for months with too few reviews."""
    reliable = F.col("review_count") >= min_reviews
    return months.select(
        "order_month", "review_count", reliable.alias("reliable"),
        F.when(reliable, F.col("neg_sentiment_rate") * 100.0).alias("neg_pct"))


def aspect_late_share(aspects: DataFrame) -> DataFrame:
    total = F.col("on_time") + F.col("late")
    return aspects.where(F.col("aspect") != NO_ASPECT).select(
        "aspect", "on_time", "late", total.alias("total"), share_pct(F.col("late"), total).alias("late_share"),
    ).orderBy(F.desc("late_share"), "aspect")


def aspect_rankings(report: DataFrame) -> DataFrame:
    """Rank by negative mentions (with share) and rank by negative rate, without the fallback."""
    return report.where(F.col("aspect") != NO_ASPECT).select(
        "aspect", "total_mentions", F.col("negative").alias("negative_mentions"), "neg_pct",
        F.row_number().over(_all_rows().orderBy(F.desc("negative"), "aspect")).alias("rank_by_mentions"),
        F.round(share_pct(F.col("negative"), F.sum("negative").over(_all_rows())), 1).alias("share_of_negative_pct"),
        F.row_number().over(_all_rows().orderBy(F.desc("neg_pct"), "aspect")).alias("rank_by_rate"))


def reliable_categories(report: DataFrame) -> DataFrame:
    return report.where("not low_n").drop("low_n", "confidence")


def segment_order(report: DataFrame, segment: str | None = None, order: Sequence[str] = SEGMENTS) -> DataFrame:
    """Rows in the order of the segment list, worst rate first inside a segment."""
    chosen = report if segment is None else report.where(F.col("segment") == segment)
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("segment"))
    return chosen.withColumn("position", F.row_number().over(
        _all_rows().orderBy(place, F.desc("neg_sentiment_rate"), "category")))


def correlation_split(correlations: DataFrame, review_level_above: int = 1000) -> DataFrame:
    level = F.when(F.coalesce("n", F.lit(0)) > review_level_above, "review").otherwise("category")
    return correlations.withColumn("level", level)


def rate_step(rate: Column, low: float = 0.15, high: float = 0.35) -> Column:
    """A rate on a five-step scale: 4 at or under ``low``, 0 at or over ``high``."""
    position = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (rate - low) / (high - low)))
    return (F.lit(4) - F.round(position * 4)).cast("int")


def with_state_names(df: DataFrame, names: Mapping[str, str] = STATE_NAMES, key: str = "state") -> DataFrame:
    """Full state name beside the code, the code itself where the list has none."""
    lookup = df.sparkSession.createDataFrame(list(names.items()), f"{key} string, state_name string")
    return df.join(F.broadcast(lookup), key, "left").withColumn("state_name", F.coalesce("state_name", key))


def dataset_facts(counts: Mapping[str, tuple[DataFrame, Column]], base: DataFrame) -> DataFrame:
    """Headline counts in one row; ``base`` is any one-row table of the data set."""
    return base.select(*[df.agg(measure).scalar().alias(name) for name, (df, measure) in counts.items()])
