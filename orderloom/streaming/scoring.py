"""Incremental review scoring as a stream over arriving files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from orderloom.operators.reviews_text import KEYS, Scorer, score_with_model


def score_new_files(
    spark: SparkSession, source: str, schema, store: str, checkpoint: str,
    load_scorer: Callable[[], Scorer], keys: Sequence[str] = KEYS,
) -> StreamingQuery:
    """Score every file that arrived since the last run, append to the store, then stop.

    The checkpoint remembers the files, so a run that died is taken up where it was and a
    repeated run does no work.
    """
    arriving: DataFrame = spark.readStream.schema(schema).parquet(source)
    scored = score_with_model(arriving, load_scorer, keys=keys)
    return (
        scored.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).option("path", store)
        .trigger(availableNow=True).start())


def run_to_end(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
