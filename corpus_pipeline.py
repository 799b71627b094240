"""From raw documents to packed training sequences: five stages, each written and read again.

Toxic documents go, one document of each near-duplicate group stays, personal data is masked, the
sources are mixed to their target weights in training order, and the mix is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderloom.llm import curriculum, packing, parity, private_data, toxicity
from orderloom.llm.common import table
from orderloom.session import written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return parity.deduplicated(docs)


def mask_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return private_data.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curriculum.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_sequences(docs, packing.public_tokenizer())


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("private_data", mask_private_data),
    ("curriculum_mix", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # the tokenizer and the trained models are outside SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
