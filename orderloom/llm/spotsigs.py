"""Document fingerprints by spot signatures, in DataFrame functions only.

Short words are the anchors: in every language they are the common ones. A signature is the chain of
the content words that follow an anchor; a text's first word starts a chain as well, and so does what
follows a seven-letter word, because lists and tables hold few short words. The fingerprint of a text
is the set of its signatures, written as sorted eight-digit hexadecimal hashes.

``near_pairs`` finds the pairs above a Jaccard threshold: equal fingerprints are one node, sets are
partitioned by their length so that only lengths whose ratio reaches the threshold meet, and only the
rarest signatures of a set, of which linked sets share at least one, are looked up.

Defined cases. Null or empty text, or text without content words: the empty fingerprint. Two empty
fingerprints are alike (1), an empty and a filled one are not (0). Null doc_id: after all others.
Equal doc_ids: ordered by text. Repeated rows: each has the other as next document. One document: it
is its own next one. Empty table: empty result. Other columns: ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm.common import written

CHAIN = 3                   # content words of a signature
SHORT = 3                   # letters of a common word at most
MARKED = 7                  # letters of a content word that also starts a chain after it
THRESHOLD = 0.75
BETWEEN = r"[^\p{L}\p{N}]+"


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the sorted distinct signature hashes of a text column."""
    words = df.withColumn("_w", F.filter(F.split(F.lower(text), BETWEEN), lambda w: w != ""))
    w = F.col("_w")

    def content(x: Column, i: Column) -> Column:
        before = F.length(F.get(w, i - 1))
        starts = (i == 0) | (before <= SHORT) | (before == MARKED)
        return F.when(F.length(x) > SHORT, F.concat(F.when(starts, "1").otherwise("0"), x))

    kept = words.withColumn("_c", F.filter(F.transform(w, content), lambda x: x.isNotNull()))
    c = F.col("_c")

    def chain(x: Column, i: Column) -> Column:
        parts = [F.substr(x, F.lit(2))] + [
            F.coalesce(F.substr(F.get(c, i + k), F.lit(2)), F.lit("")) for k in range(1, CHAIN)]
        return F.when(x.startswith("1"), F.conv(F.substring(F.md5(F.concat_ws(" ", *parts)), 1, 8), 16, 10).cast("long"))

    found = F.filter(F.transform(c, chain), lambda x: x.isNotNull())
    return kept.withColumn(name, F.array_sort(F.array_distinct(found))).drop("_w", "_c")


def shown(signatures: Column) -> Column:
    return F.lower(F.array_join(F.transform(signatures, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def _descending_parts(docs: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """Add ``part``: ranges of descending doc_id, cut at quantiles (one number per part reaches the driver)."""
    shares = [k / parts for k in range(1, parts)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] if shares else []
    cuts = sorted(set(cuts or []))
    step = max(1, math.isqrt(len(cuts)))
    coarse = cuts[step - 1 :: step]
    array = lambda xs: F.array(*map(F.lit, xs)).cast("array<long>")
    groups = F.size(F.filter(array(coarse), lambda b: b <= F.col("doc_id")))
    inner = F.size(F.filter(F.slice(array(cuts), F.col("_group") * step + 1, step), lambda b: b <= F.col("doc_id")))
    below = F.col("_group") * step + inner
    part = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(len(cuts) - below).cast("int")
    if not cuts:
        part = F.when(F.col("doc_id").isNull(), 1).otherwise(0)
        return docs.withColumn("part", part), 1
    return docs.withColumn("_group", groups).withColumn("part", part).drop("_group"), len(cuts) + 1


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text, part and ``last``: all documents, and behind each part the first one of the next part.

    Sorting a part and looking one row ahead then gives every document its next one.
    """
    base, _ = _descending_parts(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), parts)
    tops = base.groupBy("part").agg(F.max("doc_id").alias("top")).withColumnRenamed("part", "p")
    # One row per part, and its first document's text.
    heads = base.join(F.broadcast(tops), (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("top"))).groupBy(
        "part").agg(F.first("doc_id").alias("doc_id"), F.max("text").alias("text"))
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = F.struct("doc_id", "text")
    behind = heads.select("part", F.coalesce(F.lead(wanted).over(order), F.first(wanted).over(everything)).alias("n"))
    return base.withColumn("last", F.lit(0)).unionByName(
        behind.select("n.doc_id", "n.text", "part", F.lit(1).alias("last")))


def edited_likeness(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness to it and to the next document."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_signatures(with_next(docs, parts), "text", "sigs")
    order = Window.partitionBy("part").orderBy("last", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    ahead = F.lead(F.struct("text", "sigs")).over(order)
    seen = rows.select("doc_id", "text", "sigs", "last", ahead.alias("next")).where("last = 0")
    size = F.char_length("text")
    half = F.floor(size / 2).cast("int")
    seen = seen.select(
        "doc_id", "sigs", size.cast("long").alias("n_chars"), F.col("next.sigs").alias("next_sigs"),
        F.concat(F.substr("text", F.lit(1), size - half), F.substr(F.col("next.text"), F.lit(1), half)).alias("edited"))
    done = with_signatures(seen, "edited", "edited_sigs")
    return done.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        shown(F.col("sigs")).alias("fingerprint"), shown(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(membership: doc_id, node; pairs: a, b, likeness with a < b) over documents with a fingerprint."""
    sets = with_signatures(docs.select("doc_id", "text"), "text", "sigs").where("size(sigs) > 0")
    sets = written(sets.select("doc_id", F.xxhash64("sigs").alias("node"), "sigs"), "sets")
    nodes = sets.groupBy("node", "sigs").agg(F.count("*").alias("copies")).withColumn("n", F.size("sigs"))
    nodes = written(nodes, "nodes")
    spread = nodes.select("node", "n", F.explode("sigs").alias("sig"))
    rare = spread.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")
    # Signatures of one set only lead nowhere, but count for a set's place in the order.
    ranked = spread.join(rare, "sig", "left").withColumn("place", F.row_number().over(
        Window.partitionBy("node").orderBy(F.coalesce("df", F.lit(1)), "sig")))
    prefix = ranked.where(F.col("place") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).where("df > 1")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(threshold)) + 1e-9).cast("int")
    offered = prefix.select("sig", "node", "n", band.alias("band"))
    probes = offered.select(F.col("sig").alias("s"), F.col("node").alias("a"), F.col("n").alias("n_a"),
                            F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band_a"))
    close = (F.col("sig") == F.col("s")) & (F.col("band") == F.col("band_a")) & (F.col("a") < F.col("node"))
    pairs = offered.join(probes, close).where(
        F.least("n", "n_a") >= F.lit(threshold) * F.greatest("n", "n_a") - 1e-9).select("a", F.col("node").alias("b")).distinct()
    left = nodes.select(F.col("node").alias("a"), F.col("sigs").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("sigs").alias("sb"))
    found = pairs.join(left, "a").join(right, "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    return sets.select("doc_id", "node"), found.where(F.col("likeness") >= threshold)
