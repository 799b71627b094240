"""License scan by canonical digests.

A text is lower-cased, copyright lines go, everything but letters and digits becomes a blank and
equivalent spellings one form; the digest of what remains is joined with the digests of known
licences. The units are the whole document, each of its lines and each run of its blocks, every one as
an entire text: a unit that only contains a licence does not match.

Blocks are what stands between lines without letters or digits (blank lines, bare comment marks). A
licence of k blocks is found in a longer document by its blocks' digests: each block is joined on its
digest, and k hits in k neighbouring places are a run. So a licence above code is found with no
unit built for every run, and a block costs one digest however long the licences are.

Defined cases. Null or empty text: nothing found. Null doc_id: scanned like any other. Repeated
doc_ids: their findings are joined, runs are those of one text. Units without letters or digits match nothing. Empty table: empty
result. Other columns: ignored.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm.license_texts import KNOWN, SPELLINGS

COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:©|\(c\)|copyright\s+(?:©|\(c\)|[0-9]|holder:)|all rights reserved)[^\n]*$"
HOLLOW = r"[^\p{L}\p{N}]+"
BETWEEN = r"\n(?:[^\p{L}\p{N}\n]*\n)+"    # lines without letters or digits
HINT = r"licen|permi|software|redistribut|warrant|copyright"   # looked for first, if every known text has one of these


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    # Words stand two blanks apart while spellings are replaced, so neighbours do not share one.
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, HOLLOW, "  ")), F.lit(" "))
    for kept, other in SPELLINGS:
        out = F.replace(out, F.lit(f" {_apart(other)} "), F.lit(f" {_apart(kept)} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def _apart(words: str) -> str:
    return words.replace(" ", "  ")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: Mapping[str, str] = KNOWN) -> DataFrame:
    """(license, digest): as many rows as known texts."""
    return spark.createDataFrame(list(known.items()), "license string, text string").select(
        "license", digest(F.col("text")).alias("digest"))


def blocks(text: Column) -> Column:
    """Canonical blocks of a text, those of copyright lines alone left out."""
    return F.filter(F.transform(F.split(text, BETWEEN), canonical), lambda b: b != "")


def known_blocks(spark: SparkSession, known: Mapping[str, str] = KNOWN) -> DataFrame:
    """(license, size, k, digest): a row for each block of each known text."""
    texts = spark.createDataFrame(list(known.items()), "license string, text string").select(
        "license", blocks(F.col("text")).alias("b"))
    return texts.select("license", F.size("b").alias("size"), F.posexplode("b").alias("k", "block")).select(
        "license", "size", "k", F.sha2("block", 256).alias("digest"))


def runs(docs: DataFrame, known: Mapping[str, str] = KNOWN) -> DataFrame:
    """(doc_id, license) of every known text that stands as a run of blocks in a document."""
    # The known texts are a parameter: the broadcast has their number of blocks.
    cut = docs.select("doc_id", F.xxhash64("text").alias("of"), F.posexplode(blocks(F.col("text"))).alias("place", "block"))
    hits = cut.select("doc_id", "of", "place", F.sha2("block", 256).alias("digest")).join(
        F.broadcast(known_blocks(docs.sparkSession, known)), "digest")
    return hits.groupBy("doc_id", "of", "license", "size", (F.col("place") - F.col("k")).alias("start")).agg(
        F.count_distinct("k").alias("n")).where("n = size").select("doc_id", "license").distinct()


def scan(docs: DataFrame, known: Mapping[str, str] = KNOWN) -> DataFrame:
    """doc_id, license (of the whole text), notices (of its lines and runs of blocks, sorted and joined by commas)."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hinted = all(re.search(HINT, t.lower()) for t in known.values())
    if hinted:
        texts = texts.where(F.lower("text").rlike(HINT))
    units = texts.select(
        "doc_id", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("text").alias("unit"))), F.transform(
            F.split("text", "\n"), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit"))))).alias("u"))
    units = units.select("doc_id", "u.whole", "u.unit")
    if hinted:
        units = units.where(F.lower("unit").rlike(HINT))
    # The known texts are a parameter: the broadcast has their number of rows.
    hits = units.select("doc_id", "whole", digest(F.col("unit")).alias("digest")).join(
        F.broadcast(known_digests(docs.sparkSession, known)), "digest").select("doc_id", "whole", "license")
    found = hits.unionByName(runs(texts, known).select("doc_id", F.lit(False).alias("whole"), "license")).groupBy("doc_id").agg(
        F.min(F.when(F.col("whole"), F.col("license"))).alias("license"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ",").alias("notices"))
    found = found.withColumnRenamed("doc_id", "_id")
    return docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", "license", F.coalesce("notices", F.lit("")).alias("notices"))
