"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1. The integral of the schedule is its
share of the demand up to a point in time; inverting that integral turns a document's place in its
source into a training position, and a range sort by position gives the training order.

Targets. Sources in code point order (null last) get the weights in turn and share the total of all
sizes; no target exceeds ``max_epochs`` times its source, and what is over goes to the others by
weight until none is above. Whole passes over a source come first. The rest is filled in hashed
order: complete hash buckets, then the documents of one bucket that still fit, so the words taken
come within the smallest left-out document of that bucket to the target.

Defined cases. Null or empty text: size 0, taken 0. Null source: a source of its own, last. Rows
that are equal in all columns are numbered, and as many of them as fit get the copy more. Equal doc_ids with other content are documents of
their own. Empty table: empty result. Other columns are carried by ``mixed`` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm.common import BLANKS, row_key, written
from orderloom.operators.ordering import running_totals

WEIGHTS = (1.0, 2.0, 3.0)
SLOPES = (-0.5, 0.0, 0.5)     # of each weight's schedule 1 + slope * (2 t - 1): light sources fade, heavy ones grow
MAX_EPOCHS = 3
BUCKET_DOCS = 2000


def word_count(text: Column) -> Column:
    """Number of words, counted by their first characters."""
    return F.coalesce(F.regexp_count(text, F.lit(f"(?<![^{BLANKS}])[^{BLANKS}]")), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, slopes: Sequence[float] = SLOPES,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """(source, n_docs, source_size, weight, slope, target) from (source, size).

    The shares are filled like water: the level rises over the sources that are not full until the
    total is spent. A round aggregates the source table to three numbers.
    """
    totals = written(sizes.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("size").cast("double").alias("source_size")), "sources")
    ranked = running_totals(totals.withColumn("_one", F.lit(1)), [F.col("source").asc_nulls_last()], {"_one": "_rank"})
    turn = F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int") + 1
    sources = written(ranked.select(
        "source", "n_docs", "source_size",
        F.element_at(F.array(*map(F.lit, weights)), turn).alias("weight"),
        F.element_at(F.array(*map(F.lit, slopes)), turn).alias("slope")), "sources")
    limit = F.col("source_size") * max_epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0.0
    left, weight, full = total, None, F.lit(False)
    while total:
        row = sources.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, limit)),
                          F.sum(full.cast("int"))).first()
        now = (total - (row[1] or 0.0), row[0])
        if now == (left, weight) or not now[1]:
            break
        left, weight = now
        full = limit <= F.lit(left) * F.col("weight") / F.lit(weight)
    share = F.lit(left) * F.col("weight") / F.lit(weight) if total else F.lit(0.0)
    return sources.withColumn("target", F.least(share, limit))


def _fill(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket, in hashed order: as many of every group of equal rows as still fit, then the one exchange that helps most.

    When most of the bucket is wanted, the documents to leave out are chosen that way.
    """
    frame = frame.sort_values(["h", "doc_id"], kind="stable", na_position="last")
    size, rows = frame["size"].to_numpy().astype(float), frame["m"].to_numpy()
    room = float(frame["room"].iloc[0])
    inverse = room > (size * rows).sum() / 2
    left = (size * rows).sum() - room if inverse else room
    taken = np.zeros(len(frame), np.int64)
    for i, (own, m) in enumerate(zip(size.tolist(), rows.tolist())):
        taken[i] = min(m, int(left // own)) if own > 0 else 0
        left -= taken[i] * own
    if inverse:
        taken = rows - taken
    gap = room - (size * taken).sum()
    # One document more, one less, or one for another; 0 stands for none.
    out, into = np.flatnonzero(taken > 0), np.flatnonzero(taken < rows)
    change = np.append(size[into], 0)[:, None] - np.append(size[out], 0)[None, :]
    best = np.unravel_index(np.abs(gap - change).argmin(), change.shape)
    if abs(gap - change[best]) < abs(gap):
        taken[into[best[0] : best[0] + 1]] += 1
        taken[out[best[1] : best[1] + 1]] -= 1
    return frame.assign(c=taken).loc[taken > 0, ["doc_id", "h", "c", "m"]]


def schedule(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, slopes: Sequence[float] = SLOPES,
    max_epochs: int = MAX_EPOCHS, bucket_docs: int = BUCKET_DOCS,
) -> DataFrame:
    """One row per document row: doc_id, h, size, source_size, target, copies, positions.

    ``h`` identifies the row, ``positions`` has one training position in 0..1 per copy.
    """
    rows = written(docs.select("doc_id", row_key(docs).alias("h"), "source", word_count(F.col("text")).alias("size"),
                               F.monotonically_increasing_id().alias("row")), "sizes")
    targets = source_targets(rows, weights, slopes, max_epochs)
    parts = F.ceil(F.col("n_docs") / F.lit(bucket_docs)).cast("long")
    items = rows.groupBy("doc_id", "h", "source", "size").agg(F.count("*").alias("m"))
    same = [F.col("i.source").eqNullSafe(F.col("t.source"))]
    items = written(items.alias("i").join(targets.alias("t"), same).select(
        "i.*", "n_docs", "source_size", "slope", "target",
        (F.col("size") * F.col("m")).alias("mass"),
        F.pmod(F.shiftrightunsigned("h", 8), parts).alias("bucket"),
        F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") + 1e-9).otherwise(0.0))
        .cast("int").alias("passes")), "items")
    rest = F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0))
    # At most one row per bucket_docs documents is ordered within a source.
    sums = items.groupBy("source", "bucket").agg(F.sum("mass").alias("in_bucket"), F.first(rest).alias("rest"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)))
    placed = written(items.alias("i").join(
        sums.alias("s"), [F.col("i.source").eqNullSafe(F.col("s.source")), F.col("i.bucket") == F.col("s.bucket")])
        .select("i.*", "in_bucket", "rest", "before",
                (F.col("before") + F.coalesce(F.sum("mass").over(
                    Window.partitionBy("i.source", "i.bucket").orderBy("h", "doc_id")
                    .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("start")), "placed")
    whole = F.col("before") + F.col("in_bucket") <= F.col("rest")
    edge = (F.col("before") < F.col("rest")) & ~whole
    # One bucket of each source: bounded by bucket_docs.
    chosen = (placed.where(edge).select("source", "doc_id", "h", "size", "m", (F.col("rest") - F.col("before")).alias("room"))
              .groupBy("source").applyInPandas(_fill, "doc_id long, h long, c long, m long"))
    chosen = written(chosen.select(F.col("doc_id").alias("c_id"), F.col("h").alias("c_h"), "c", F.col("m").alias("c_m")), "chosen")
    one_of = [F.col("doc_id").eqNullSafe(F.col("c_id")), F.col("h") == F.col("c_h")]
    placed = placed.join(chosen, one_of, "left")
    # Of equal rows, ``c`` get one copy more: rows of such groups are numbered over all tasks.
    split = chosen.where("c < c_m")
    if split.isEmpty():
        rows = rows.withColumn("later", F.lit(False))
    else:
        numbered = running_totals(rows.join(split, one_of).select("doc_id", "h", "row", "c", F.lit(1).alias("_one")),
                                  [F.col("row")], {"_one": "_place"}, by=["doc_id", "h"])
        later = numbered.where("_place > c").select(F.col("row").alias("l_row"), F.lit(True).alias("later"))
        rows = rows.join(later, F.col("row") == F.col("l_row"), "left").withColumn("later", F.coalesce("later", F.lit(False)))
    more = F.when(whole | (F.coalesce("c", F.lit(0)) > 0), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.least(F.col("passes") + more, F.lit(max_epochs))).otherwise(0)
    middle = F.col("start") + F.col("mass") / 2
    u = lambda k: F.least((k * F.col("source_size") + middle) / F.col("target"), F.lit(1.0))
    at = lambda k: invert(u(k), F.col("slope"))
    planned = placed.select(
        F.col("doc_id").alias("p_id"), F.col("h").alias("p_h"), "source_size", "target", copies.alias("copies"), "start",
        "mass", "slope", more.alias("more")).withColumn("positions", F.when(F.col("copies") > 0, F.transform(
            F.sequence(F.lit(0), F.col("copies") - 1), at)).otherwise(F.array().cast("array<double>")))
    own = F.when(F.col("later") & (F.col("copies") > 0), F.col("copies") - F.col("more")).otherwise(F.col("copies"))
    return rows.join(planned, [F.col("doc_id").eqNullSafe(F.col("p_id")), F.col("h") == F.col("p_h")]).select(
        "doc_id", "h", "size", "source_size", "target", own.cast("int").alias("copies"),
        F.slice("positions", F.lit(1), own.cast("int")).alias("positions"))


def invert(u: Column, slope: Column) -> Column:
    """The time at which the integral of 1 + slope * (2 t - 1) reaches ``u``."""
    flat = F.abs(slope) < 1e-9
    a = 1 - slope
    root = (F.sqrt(a * a + 4 * slope * u) - a) / (2 * F.when(flat, F.lit(1.0)).otherwise(slope))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(flat, u).otherwise(root)))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The training set: each document once per copy, range-sorted by training position."""
    plan = written(schedule(docs, **options).groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(
        F.max_by("positions", "copies").alias("positions"), F.max("copies").alias("most"), F.min("copies").alias("least"),
        (F.sum("copies") - F.min("copies") * F.count("*")).alias("k")).where("most > 0"), "plan")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), row_key(docs).alias("_key"))
    rows = rows.join(plan, [F.col("_row.doc_id").eqNullSafe(F.col("_id")), F.col("_key") == F.col("_h")])
    copies = rows.where("most = least").select("_row", "_key", F.explode("positions").alias("_position"))
    if not plan.where("most > least").isEmpty():
        # The first k of a group of equal rows have one copy more than the others.
        split = running_totals(rows.where("most > least").withColumn("_one", F.lit(1)).withColumn("_n", F.monotonically_increasing_id()),
                               [F.col("_n")], {"_one": "_place"}, by=["_id", "_h"])
        own = F.when(F.col("_place") <= F.col("k"), F.col("most")).otherwise(F.col("least")).cast("int")
        copies = copies.unionByName(split.select("_row", "_key", F.explode(F.slice("positions", F.lit(1), own)).alias("_position")))
    return copies.repartitionByRange("_position", "_key").sortWithinPartitions("_position", "_key").select("_row.*")


def op10(docs: DataFrame) -> DataFrame:
    """Words taken of each document."""
    return schedule(docs).select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"), "positions")
