"""Sentiment, agreement, aspects and assembly of the scored review table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.metrics import expected_sentiment, share_pct
from orderloom.functions.text import lexicon_counts, lexicon_sentiment, tag_aspects
from orderloom.functions.vocabulary import ASPECT_PATTERNS, NEGATIVE_WORDS, POSITIVE_WORDS

TEXT = "review_comment_message"
KEYS = ("review_id", "order_id")
Scorer = Callable[[list[str]], list[tuple[str, float]]]


def text_reviews(reviews: DataFrame, text: str = TEXT) -> DataFrame:
    return reviews.where(F.col(text).isNotNull())


def with_lexicon_sentiment(
    reviews: DataFrame, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS,
    text: str = TEXT,
) -> DataFrame:
    up, down = lexicon_counts(F.col(text), positive, negative)
    label, score = lexicon_sentiment(F.col("_pos"), F.col("_neg"))
    return reviews.withColumns({"_pos": up, "_neg": down}).withColumns({
        "baseline_sentiment_label": label, "baseline_sentiment_score": score}).drop("_pos", "_neg")


def word_share_scorer(
    positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS
) -> Callable[[], Scorer]:
    """Factory of a small stand-in model: the share of positive words among listed ones."""
    up, down = frozenset(positive), frozenset(negative)

    def load() -> Scorer:
        def score(texts: list[str]) -> list[tuple[str, float]]:
            result = []
            for text in texts:
                words = set(text.lower().split())
                p, n = len(words & up), len(words & down)
                share = p / (p + n) if p + n else 0.5
                label = "positive" if share > 0.6 else "negative" if share < 0.4 else "neutral"
                result.append((label, max(share, 1.0 - share)))
            return result

        return score

    return load


def score_with_model(
    reviews: DataFrame, load_scorer: Callable[[], Scorer], batch_size: int = 32,
    clip: int | None = None, text: str = TEXT, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Label and score per review from a pluggable classifier.

    The scorer is loaded once per task and fed in batches; a failing batch gives NULL
    labels and the error text instead of made-up values. ``clip`` limits the characters a
    model sees; without it the model gets the whole text.
    """
    schema = reviews.select(*keys).schema.add("sentiment_label", "string").add(
        "sentiment_score", "double").add("error", "string")
    names = list(keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load_scorer()
        for frame in frames:
            labels: list[str | None] = []
            scores: list[float | None] = []
            errors: list[str | None] = []
            texts = [t if clip is None else t[:clip] for t in frame[text].fillna("").astype(str)]
            for start in range(0, len(texts), batch_size):
                batch = texts[start:start + batch_size]
                try:
                    found = scorer(batch)
                except Exception as error:  # noqa: BLE001 - reported per row
                    labels += [None] * len(batch)
                    scores += [None] * len(batch)
                    errors += [repr(error)] * len(batch)
                    continue
                for label, score in found:
                    low = label.lower()
                    labels.append("Negative" if "negative" in low else "Positive" if "positive" in low else "Neutral")
                    scores.append(round(float(score), 4))
                    errors.append(None)
            yield frame[names].assign(sentiment_label=labels, sentiment_score=scores, error=errors)

    return reviews.select(*keys, text).mapInPandas(run, schema)


def score_increment(
    reviews: DataFrame, store: str, load_scorer: Callable[[], Scorer], keys: Sequence[str] = KEYS, **options
) -> DataFrame:
    """Score the reviews that the store has not seen, append them, return the store.

    Rows whose scoring failed are not kept, so the next run tries them again.
    """
    spark = reviews.sparkSession
    try:
        todo = reviews.join(spark.read.parquet(store).select(*keys), list(keys), "left_anti")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        todo = reviews
    score_with_model(todo, load_scorer, keys=keys, **options).where("error is null").drop("error") \
        .write.mode("append").parquet(store)
    return spark.read.parquet(store)


def with_agreement(reviews: DataFrame, label: str = "sentiment_label") -> DataFrame:
    return reviews.withColumn("expected_sentiment", expected_sentiment(F.col("review_score"))).withColumn(
        "sentiment_agrees", F.col(label) == F.col("expected_sentiment"))


def agreement_rates(reviews: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Agreement with the expected label, overall (NULL score) and per score, for each label column."""
    expected = expected_sentiment(F.col("review_score"))
    grouped = reviews.rollup("review_score").agg(
        F.grouping("review_score").alias("_all"), F.count("*").alias("n"),
        *[F.count_if(F.col(label) == expected).alias(label) for label in labels])
    return grouped.where("_all = 1 or review_score is not null").unpivot(
        ["review_score", "n"], list(labels), "label_column", "agreeing").withColumn(
        "agreement_pct", share_pct(F.col("agreeing"), F.col("n")))


def mismatch_examples(reviews: DataFrame, count: int = 5, order: Sequence[str] = KEYS) -> DataFrame:
    """The first five-star negatives and one-star positives by key."""
    kind = (
        F.when((F.col("review_score") == 5) & (F.col("sentiment_label") == "Negative"), "5 stars, negative text")
        .when((F.col("review_score") == 1) & (F.col("sentiment_label") == "Positive"), "1 star, positive text"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(*order))
    return reviews.withColumn("kind", kind).where("kind is not null").withColumn("position", rank).where(
        F.col("position") <= count).select("kind", "position", *order, F.col(TEXT))


def with_aspects(
    reviews: DataFrame, patterns: Mapping[str, str] = ASPECT_PATTERNS, text: str = TEXT, unaccented: bool = False
) -> DataFrame:
    return reviews.withColumn("extracted_aspects", tag_aspects(F.col(text), patterns, unaccented=unaccented))


def aspect_sentiment_rows(reviews: DataFrame, excerpt: int = 100, text: str = TEXT) -> DataFrame:
    """One row per (review, aspect) with a short excerpt for display."""
    return reviews.select(
        *KEYS, F.explode("extracted_aspects").alias("aspect"),
        F.col("sentiment_label").alias("aspect_sentiment"),
        F.substring(text, 1, excerpt).alias("review_excerpt"))


def aspect_summary(reviews: DataFrame, small_sample: int = 100) -> DataFrame:
    """Mentions per aspect and sentiment; aspects nobody mentions do not appear."""
    label = F.col("sentiment_label")
    return reviews.select("sentiment_label", F.explode("extracted_aspects").alias("aspect")).groupBy("aspect").agg(
        F.count("*").alias("total_mentions"),
        F.count_if(label == "Negative").alias("negative"),
        F.count_if(label == "Neutral").alias("neutral"),
        F.count_if(label == "Positive").alias("positive"),
    ).withColumn("small_sample_flag", F.col("total_mentions") < small_sample)


def label_distribution(reviews: DataFrame, labels: Sequence[str]) -> DataFrame:
    return reviews.unpivot([], list(labels), "label_column", "label").groupBy("label_column", "label").agg(
        F.count("*").alias("n"))


def assemble_scored_reviews(
    reviews: DataFrame, tfidf_topics: DataFrame, embedding_topics: DataFrame, topic_labels: DataFrame
) -> DataFrame:
    """The 14-column scored review table from its parts, keyed by review and order."""
    keys = list(KEYS)
    joined = (
        with_agreement(reviews)
        .join(tfidf_topics.select(*keys, F.col("topic_id").alias("tfidf_topic_id")), keys, "left")
        .join(embedding_topics.select(*keys, F.col("topic_id").alias("emb_topic_id")), keys, "left")
        .join(topic_labels.select(F.col("topic_id").alias("emb_topic_id"), "topic_label"), "emb_topic_id", "left"))
    return joined.select(
        *keys, "review_score", TEXT, "baseline_sentiment_label", "baseline_sentiment_score",
        "sentiment_label", "sentiment_score", "tfidf_topic_id", "emb_topic_id",
        F.coalesce("topic_label", F.concat(F.lit("Topic "), F.col("emb_topic_id").cast("string"))).alias("topic_label"),
        "extracted_aspects", "expected_sentiment", "sentiment_agrees")

