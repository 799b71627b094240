"""The registered queries of this subpackage, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderloom.llm import (
    checks, crosstoken, curriculum, lattice, lexicon, licenses, packing, parity, private_data, recompress, resampling,
    spotsigs, toxicity, turnrepair,
)
from orderloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if check:
            CHECKS[name] = check
        return build

    return register


@query("op10_curriculum_mix")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return curriculum.op10(table(spark, folder, "documents"))


@query("op4_pack_sequences")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_sequences(table(spark, folder, "documents"), packing.public_tokenizer())


@query("op8_parity_join", checks.SHINGLE_COMPONENTS)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return parity.linked(table(spark, folder, "documents"))


@query("op9_recompression_dedup", checks.KEPT_WORDS)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return recompress.repeats(table(spark, folder, "documents"))


@query("op6_private_spans")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return private_data.spans(table(spark, folder, "documents"))


@query("op7_toxicity_chain")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, folder, "labels")))


@query("op3_lattice_links", checks.VECTOR_LINKS)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.linked(table(spark, folder, "embeddings"))


@query("op2_spot_signatures", checks.SPOT_SIGNATURES)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return spotsigs.edited_likeness(table(spark, folder, "documents"))


@query("op1_importance_resampling")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_license_digests", checks.LICENSES)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query("op11_transducer_codec")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return lexicon.op11(table(spark, folder, "documents"), packing.public_tokenizer())


@query("op12_token_anchors")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return crosstoken.aligned(
        table(spark, folder, "documents"), packing.public_tokenizer("byte_bpe_50k.json"), packing.public_tokenizer("piece_bpe_32k.model"))


@query("op13_turn_repair", checks.TURN_REPAIR)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return turnrepair.op13(table(spark, folder, "conversations"))
