"""Helpers shared by the operators: tables, batches, row identity, word lists, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderloom.session import checkpointed, written

BLANKS = r"\x20\x09-\x0D"          # the separators of words
BATCH_ROWS = 256                   # documents per Arrow batch: bounds a worker's memory for long texts


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def map_batches(
    df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str,
    rows: int = BATCH_ROWS,
) -> DataFrame:
    """``mapInArrow`` over small batches.

    The batch size is a session setting that Spark reads when the plan runs, so it is only ever
    lowered here, never set back.
    """
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(key, "10000"))
    if now <= 0 or now > rows:
        conf.set(key, str(rows))
    return df.mapInArrow(step, schema)


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def row_key(df: DataFrame) -> Column:
    """One number for equal rows; rows that differ in any column differ in it."""
    return F.xxhash64(*[F.coalesce(df[f"`{c}`"].cast("string"), F.lit("\x00null")) for c in df.columns])


def _byte_values(fold_case: bool) -> np.ndarray:
    """A random 64-bit number per byte; 0 for the separators."""
    values = np.random.default_rng(20_240_601).integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
    if fold_case:
        values[65:91] = values[97:123]
    values[[9, 10, 11, 12, 13, 32]] = 0
    return values


BYTES = {fold: _byte_values(fold) for fold in (False, True)}
BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(count: int) -> np.ndarray:
    factors = np.full(count, BASE, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


POWERS = _powers(4096)


def _names(data: np.ndarray, bounds: np.ndarray, fold_case: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of the words of several texts, and where each text's words begin and end."""
    global POWERS
    values = BYTES[fold_case]
    inside = BYTES_INSIDE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    firsts = bounds[:-1][bounds[:-1] < len(data)]
    begin[firsts] = inside[firsts]
    starts = np.flatnonzero(begin)
    if len(starts) == 0:
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    widths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data), dtype=np.int32)
    place -= np.repeat(starts.astype(np.int32), widths)
    most = int(widths.max())
    if most > len(POWERS):
        POWERS = _powers(most)
    terms = values[data[starts[0] :]]
    terms *= POWERS[place]
    return mix(np.add.reduceat(terms, starts - starts[0])), np.searchsorted(starts, bounds)


BYTES_INSIDE = BYTES[False] != 0


def named_slices(
    column: pa.Array, fold_case: bool = False, limit: int = 1 << 20,
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, names, begins): the words of texts ``first`` to ``last`` (exclusive) of a binary column.

    A word's name is a hash of its bytes, the same in every process; with ``fold_case`` A-Z count as
    a-z. Text k's words are ``names[begins[k - first] : begins[k - first + 1]]``. A slice holds
    ``limit`` bytes, or one text: that bounds the memory.
    """
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, len(column))
        part = data[offsets[first] : offsets[last]]
        names, begins = _names(part, offsets[first : last + 1] - offsets[first], fold_case)
        yield first, last, names, begins
        first = last


def sampled(df: DataFrame, key: Column, limit: int, spare: int = 1) -> DataFrame:
    """At most ``limit`` rows, those with the smallest keys (a hash) below a cut.

    The cut leaves about ``2 * spare * limit`` rows, so what the tasks send does not grow with the
    table; ``spare`` allows for filters that follow.
    """
    count = df.count()
    cut = min(1.0, 2 * spare * limit / max(count, 1))
    kept = df if cut == 1.0 else df.where(F.pmod(key, F.lit(1 << 31)) < int(cut * (1 << 31)))
    return kept.orderBy(F.pmod(key, F.lit(1 << 31)), *df.columns).limit(limit)


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, xor, shift), elementwise."""
    x = values ^ (values >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(names: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` names, by doubling; one value when there are fewer names."""
    n = len(names)
    if n == 0:
        return names
    size = min(size, n)
    total, have = None, 0
    power, width = names, 1
    left = size
    while left:
        if left & 1:
            if total is None:
                total, have = power, width
            else:
                total = mix(total[: n - have - width + 1] * np.uint64(0x9E3779B97F4A7C15) + power[have : n - width + 1])
                have += width
        left >>= 1
        if left:
            power = mix(power[: n - 2 * width + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + power[width : n - width + 1])
            width *= 2
    return total


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def batches(rows: Iterable, schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows (tuples) as record batches of at most ``size`` rows."""
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): for every id in ``edges`` (a, b) the smallest id it can reach.

    Large-star and small-star passes alternate until no edge changes. Every pass shuffles edges
    only, a hot node is spread by adaptive skew handling of the joins, and lineage is cut with
    reliable checkpoints. Only two counters per round reach the driver.
    """
    links = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                         .where("u <> v").distinct())
    known = None
    for _ in range(rounds):
        # Large star: every node sends its larger neighbours to its smallest neighbour or itself.
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # Small star: every node sends its smaller neighbours, and itself, to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        links = checkpointed(small)
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFFFF))).first()
        if tuple(seen) == known:
            break
        known = tuple(seen)
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    heads = links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(heads)


__all__ = ["BLANKS", "named_slices", "batches", "checkpointed", "components", "map_batches", "mix", "rolling", "row_key",
           "signed", "table", "text_bytes", "written", "Window", "F"]
