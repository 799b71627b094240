"""Structured Streaming variants of the request jobs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from orderloom.operators.requests import SlidingLog

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Start queries with list, map and timer state inside; the session's own setting comes back after.

    A query keeps the setting it was started with, in its checkpoint as well.
    """
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def event_time(requests: DataFrame, time: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP; Parquet may deliver TIMESTAMP_NTZ."""
    return requests.withColumn(time, F.col(time).cast("timestamp"))


def in_order(times: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, times))
    return times[order], ids[order]


class SlidingLimit(StatefulProcessor):
    """The sliding-log limit of one (route, client).

    The rows of a micro-batch come in chunks of any order. They are sorted in runs of ``run_rows``;
    when there are several, runs wait in the map state, cut into blocks, and are merged block by block. A
    task so holds one run, one block of every run and ``limit`` times, not the key's rows.
    """

    def __init__(self, limit: int, width: int, run_rows: int, block_rows: int):
        self.limit, self.width, self.run_rows, self.block_rows = limit, width, run_rows, block_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.admitted = handle.getListState("admitted", "ts long")
        self.last = handle.getValueState("last", "logged long, expires long")
        self.blocks = handle.getMapState("blocks", "run long, block long", "ts array<long>, event_id array<long>")

    def close(self) -> None:
        pass

    def runs(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        times, ids, held = [], [], 0
        for frame in rows:
            times.append(frame["ts"].astype("datetime64[us]").astype("int64").to_numpy())
            ids.append(frame["event_id"].to_numpy(np.int64))
            held += len(frame)
            if held >= self.run_rows:
                yield in_order(np.concatenate(times), np.concatenate(ids))
                times, ids, held = [], [], 0
        if held:
            yield in_order(np.concatenate(times), np.concatenate(ids))

    def store(self, run: int, times: np.ndarray, ids: np.ndarray) -> int:
        starts = range(0, len(times), self.block_rows)
        for block, at in enumerate(starts):
            part = slice(at, at + self.block_rows)
            self.blocks.updateValue((run, block), (times[part].tolist(), ids[part].tolist()))
        return len(starts)

    def take(self, run: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        times, ids = self.blocks.getValue((run, block))
        self.blocks.removeKey((run, block))
        return np.asarray(times, np.int64), np.asarray(ids, np.int64)

    def merged(self, sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Stored runs in one order: all rows up to the smallest end of the loaded blocks, again and again."""
        heads = {run: self.take(run, 0) for run in range(len(sizes))}
        following = dict.fromkeys(heads, 1)
        while heads:
            end = min((int(t[-1]), int(i[-1])) for t, i in heads.values())
            ready = []
            for run, (times, ids) in list(heads.items()):
                low, high = np.searchsorted(times, end[0], "left"), np.searchsorted(times, end[0], "right")
                cut = int(low + np.searchsorted(ids[low:high], end[1], "right"))
                ready.append((times[:cut], ids[:cut]))
                if cut < len(times):
                    heads[run] = (times[cut:], ids[cut:])
                elif following[run] < sizes[run]:
                    heads[run] = self.take(run, following[run])
                    following[run] += 1
                else:
                    del heads[run]
            yield in_order(*(np.concatenate(parts) for parts in zip(*ready)))

    def ordered(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes, waiting = [], None
        for run in self.runs(rows):
            if waiting is not None:
                sizes.append(self.store(len(sizes), *waiting))
            waiting = run
        if not sizes:
            yield waiting
            return
        sizes.append(self.store(len(sizes), *waiting))
        yield from self.merged(sizes)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        logged, expires = self.last.get() or (None, None) if self.last.exists() else (None, None)
        log = SlidingLog(self.limit, self.width, [t for t, in self.admitted.get()] if self.admitted.exists() else [], logged)
        newest = 0
        for times, ids in self.ordered(rows):
            verdicts = [log.offer(now) for now in times.tolist()]
            newest = int(times[-1])
            yield pd.DataFrame({
                "_key": key[0], "event_id": ids, "ts": pd.to_datetime(times, unit="us"),
                "blocked": [b for b, _ in verdicts], "logged": [due for _, due in verdicts]})
        if log.admitted:
            self.admitted.put([(t,) for t in log.admitted])
        else:
            self.admitted.clear()
        due = max((newest + self.width) // 1000, expires or 0, timerValues.getCurrentWatermarkInMs() + 1)
        if due != expires:
            if expires is not None:
                self.handle.deleteTimer(expires)
            self.handle.registerTimer(due)
        self.last.update((log.logged, due))

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark has passed the key's newest window: nothing of it can matter any more."""
        self.admitted.clear()
        self.last.clear()
        return iter(())


def stream_rate_limit(requests: DataFrame, limit: int, window_s: int, late_by: str = "1 hour",
                      run_rows: int = 100_000, block_rows: int = 2_000) -> DataFrame:
    """The sliding-log limit per (route, client) with at most ``limit`` times of state per key.

    The state of a key is dropped once the watermark has passed its window. Rows of one
    micro-batch are replayed in time order, ties by event_id, however many one key brings;
    rows older than the watermark are dropped. A null route or client is a key like others.
    Start the query inside ``keyed_state``.
    """
    # Keys are JSON texts: as pandas values, numbers beside nulls would become floats.
    keyed = event_time(requests).select(F.to_json(F.struct("route", "client")).alias("_key"), "event_id", "ts")
    decided = keyed.withWatermark("ts", late_by).groupBy("_key").transformWithStateInPandas(
        SlidingLimit(limit, window_s * 1_000_000, run_rows, block_rows),
        "_key string, event_id long, ts timestamp, blocked boolean, logged boolean", "Append", "EventTime")
    return decided.select(
        F.from_json("_key", requests.select("route", "client").schema).alias("k"), "*").select(
        "k.*", "event_id", "ts", "blocked", "logged")


def stream_volume(
    requests: DataFrame, window: str, slide: str | None = None, late_by: str = "1 hour",
    keys: Sequence[str] = ("route",),
) -> DataFrame:
    """Requests per window and key; a window is emitted when the watermark has passed it."""
    return event_time(requests).withWatermark("ts", late_by).groupBy(
        F.window("ts", window, slide), *keys).agg(F.count("*").alias("requests")).select(
        F.col("window.start").alias("window_start"), *keys, "requests")
