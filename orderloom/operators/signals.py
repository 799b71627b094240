"""Fraud and counterfeit language in review texts: mentions, not confirmed cases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.metrics import share_pct
from orderloom.functions.text import any_pattern, fold
from orderloom.functions.vocabulary import SIGNAL_PATTERNS

TEXT = "review_comment_message"
KEYS = ("review_id", "order_id")


def flag_signals(
    reviews: DataFrame, signals: Mapping[str, Sequence[str]] = SIGNAL_PATTERNS, text: str = TEXT
) -> DataFrame:
    """One boolean per signal and ``any_signal``, from the folded text."""
    flagged = reviews.withColumn("_folded", F.coalesce(fold(F.col(text)), F.lit(""))).withColumns({
        name: F.col("_folded").rlike("(?U)" + any_pattern(patterns)) for name, patterns in signals.items()})
    any_signal = F.lit(False)
    for name in signals:
        any_signal = any_signal | F.col(f"`{name}`")
    return flagged.withColumn("any_signal", any_signal).drop("_folded")


def signals_by_type(flagged: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Reviews, mean score and negative share per signal, zero rows kept."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("signal"), F.col(f"`{name}`").alias("hit")) for name in signals])
    long = flagged.select("review_score", "sentiment_label", F.explode(rows).alias("r"))
    hit = F.col("r.hit")
    return long.groupBy(F.col("r.signal").alias("signal")).agg(
        F.count_if(hit).alias("reviews"),
        F.round(F.avg(F.when(hit, F.col("review_score"))), 2).alias("avg_review_score"),
        F.round(share_pct(F.count_if(hit & (F.col("sentiment_label") == "Negative")), F.count_if(hit)), 1)
        .alias("negative_sentiment_pct"))


def signals_overall(flagged: DataFrame) -> DataFrame:
    hit = F.col("any_signal")
    return flagged.agg(
        F.count("*").alias("text_reviews"), F.count_if(hit).alias("flagged_reviews"),
        F.round(share_pct(F.count_if(hit), F.count("*")), 2).alias("flagged_pct"),
        F.round(F.avg(F.when(hit, F.col("review_score"))), 2).alias("flagged_avg_review_score"),
        F.round(F.avg("review_score"), 2).alias("all_avg_review_score"),
        F.round(share_pct(F.count_if(hit & (F.col("sentiment_label") == "Negative")), F.count_if(hit)), 1)
        .alias("flagged_negative_sentiment_pct"))


def signal_rank(flagged: DataFrame, items: DataFrame, key: str, minimum: int, top: int = 10) -> DataFrame:
    """Groups by share of flagged reviews, every review once per group."""
    per_order = items.select("order_id", key).distinct()
    grouped = flagged.select(*KEYS, "any_signal").join(per_order, "order_id").groupBy(key).agg(
        F.count("*").alias("reviews"), F.count_if("any_signal").alias("flagged"))
    rated = grouped.where((F.col("reviews") >= minimum) & (F.col("flagged") > 0)).withColumn(
        "rate_pct", F.round(share_pct(F.col("flagged"), F.col("reviews")), 2))
    return rated.orderBy(F.desc("rate_pct"), F.desc("flagged"), key).limit(top)


def signal_examples(
    flagged: DataFrame, signals: Sequence[str], count: int = 2, excerpt: int = 220, text: str = TEXT
) -> DataFrame:
    """The first reviews of each signal by key, as trimmed excerpts."""
    names = F.array_compact(F.array(*[F.when(F.col(f"`{n}`"), F.lit(n)) for n in signals]))
    rank = F.row_number().over(Window.partitionBy("signal").orderBy(*KEYS))
    return flagged.select(*KEYS, "review_score", text, F.explode(names).alias("signal")).withColumn(
        "position", rank).where(F.col("position") <= count).select(
        "signal", "position", *KEYS, "review_score", F.substring(F.trim(text), 1, excerpt).alias("text"))
