"""The sliding-log rate limit of one busy client, settled by many tasks in a logarithmic number of rounds.

Let C(t) be how many requests have passed up to time t, p(t) the last time at least a window before
t, and n(t) the requests at t. A request passes while fewer than ``limit`` passed in the window, so

    C(t) = min(C(previous time) + n(t), C(p(t)) + limit).

That is a shortest path: one edge from the previous time, one from p(t). A stretch of windows
therefore turns the values of C over the window before it into the values over its own last window by
a min-plus product, which is associative: stretches are summarised alone, summaries are combined with
those 1, 2, 4, ... stretches before them, and then each stretch is settled from the values before it.

A summary needs few numbers. C grows by at most ``limit`` over a window, so only path costs up to
``limit`` above the cheapest can win, and of the starting places with one cost only the earliest
counts: for each place in the last window, the cheapest cost and ``limit`` + 1 starting places.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.session import written

FAR = np.iinfo(np.int64).max // 4


def summary(before: np.ndarray, times: np.ndarray, counts: np.ndarray, limit: int, width: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(cost, starts) of the places of a stretch's last window, which begins at ``last``.

    Place 0 is just before that window, place i after its i-th time. ``starts[i, c]`` is the earliest
    place of the window before the stretch from which place i costs at most ``cost[i] + c``.
    """
    m = len(before)
    every = np.concatenate([before, times])
    back = np.searchsorted(every, every - width, side="right")
    cost = np.zeros(len(every) + 1, np.int64)
    starts = np.empty((len(every) + 1, limit + 1), np.int32)
    starts[: m + 1] = np.arange(m + 1)[:, None]
    for q, (n, p) in enumerate(zip(counts.tolist(), back[m:].tolist()), m + 1):
        step, jump = cost[q - 1] + n, cost[p] + limit
        near, far = (q - 1, p) if step <= jump else (p, q - 1)
        cost[q], shift = min(step, jump), abs(int(step - jump))
        starts[q] = starts[near]
        if shift <= limit:
            np.minimum(starts[q, shift:], starts[far, : limit + 1 - shift], out=starts[q, shift:])
    first = m + int(np.searchsorted(times, last))
    return cost[first:], starts[first:]


def carried(state: np.ndarray, cost: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Values over a stretch's last window from the values over the window before it."""
    values = (state[starts] + np.arange(starts.shape[1])).min(axis=1) + cost
    return values - values[0]


def joined(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Summary of stretch ``a`` followed by stretch ``b``."""
    (a_cost, a_starts), (b_cost, b_starts) = a, b
    levels = a_starts.shape[1]
    through = a_cost[b_starts] + np.arange(levels)          # cheapest cost by each level of b
    low = through.min(axis=1)
    starts = np.full(b_starts.shape, np.iinfo(np.int32).max, np.int32)
    for j in range(levels):
        left = np.arange(levels)[None, :] - (through[:, j] - low)[:, None]
        found = a_starts[b_starts[:, j][:, None], np.clip(left, 0, levels - 1)]
        np.minimum(starts, np.where(left >= 0, found, np.iinfo(np.int32).max), out=starts)
    return low + b_cost, starts


def settled(before: np.ndarray, state: np.ndarray, times: np.ndarray, counts: np.ndarray, limit: int, width: int) -> np.ndarray:
    """How many requests pass at each time of a stretch."""
    m = len(before)
    every = np.concatenate([before, times])
    back = np.searchsorted(every, every - width, side="right")[m:].tolist()
    total = state.tolist()
    for n, p in zip(counts.tolist(), back):
        total.append(min(total[-1] + n, total[p] + limit))
    return np.diff(np.asarray(total[m:], np.int64))


SUMMARY = "_key {key}, _run long, _stretch long, state array<long>, cost array<long>, starts array<int>"


def passed_counts(times: DataFrame, limit: int, width: int, rounds: int) -> DataFrame:
    """Add ``passed`` to rows (_key, _run, _stretch, _us, n, last, context) of distinct times.

    A run begins after a window in which all requests passed. Stretches are numbered from 0 within
    a run; ``last`` is where a stretch's last window begins. Context rows repeat the window before a
    stretch; those before stretch 0 all passed. Every stretch needs a row of its own (n may be 0).
    ``rounds``: stretches of the longest run are at most 2 ** rounds. A task holds one stretch.
    """
    group = ["_key", "_run", "_stretch"]
    key = times.schema["_key"].dataType.simpleString()

    def parts(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        rows = rows.sort_values("_us")
        return rows[rows["context"]], rows[~rows["context"]]

    def start(context: pd.DataFrame) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(context["n"].to_numpy(np.int64))])

    def summarise(rows: pd.DataFrame) -> pd.DataFrame:
        context, own = parts(rows)
        if own.empty:
            return pd.DataFrame(columns=[*group, "state", "cost", "starts"])
        state, cost, starts = None, None, None
        before, at, n = (x.to_numpy(np.int64) for x in (context["_us"], own["_us"], own["n"]))
        last = int(own["last"].iloc[0])
        if own["_stretch"].iloc[0] == 0:
            total = np.concatenate([start(context), start(context)[-1] + np.cumsum(settled(before, start(context), at, n, limit, width))])
            state = total[len(before) + int(np.searchsorted(at, last)) :]
            state = state - state[0]
        else:
            cost, starts = summary(before, at, n, limit, width, last)
            starts = starts.ravel()
        return pd.DataFrame({"_key": [rows["_key"].iloc[0]], "_run": own["_run"].iloc[:1].to_numpy(), "_stretch": own["_stretch"].iloc[:1].to_numpy(),
                             "state": [state], "cost": [cost], "starts": [starts]})

    def combine(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                later = np.asarray(row.cost, np.int64), np.asarray(row.starts, np.int32).reshape(-1, limit + 1)
                if row.a_state is not None:
                    out.append((carried(np.asarray(row.a_state, np.int64), *later), None, None))
                else:
                    cost, starts = joined((np.asarray(row.a_cost, np.int64), np.asarray(row.a_starts, np.int32).reshape(-1, limit + 1)), later)
                    out.append((None, cost, starts.ravel()))
            yield frame[group].assign(**{c: pd.Series([o[i] for o in out], index=frame.index, dtype=object)
                                         for i, c in enumerate(("state", "cost", "starts"))})

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        context, own = parts(rows)
        state = own["state"].iloc[0] if len(own) else None
        begin = start(context) if state is None else np.asarray(state, np.int64)
        passed = settled(context["_us"].to_numpy(np.int64), begin, own["_us"].to_numpy(np.int64), own["n"].to_numpy(np.int64), limit, width)
        return own[[*group, "_us"]].assign(passed=passed)

    schema = SUMMARY.format(key=key)
    found = written(times.groupBy(*group).applyInPandas(summarise, schema), "stretches")
    for r in range(rounds):
        earlier = found.select("_key", "_run", (F.col("_stretch") + 2 ** r).alias("_stretch"), F.col("state").alias("a_state"),
                               F.col("cost").alias("a_cost"), F.col("starts").alias("a_starts"))
        open_ones = found.where("state IS NULL").select(*group, "cost", "starts").join(earlier, group)
        found = written(found.where("state IS NOT NULL").unionByName(open_ones.mapInPandas(combine, schema)), "stretches")
    states = found.select("_key", "_run", (F.col("_stretch") + 1).alias("_stretch"), "state")
    return times.join(states, group, "left").groupBy(*group).applyInPandas(
        settle, f"_key {key}, _run long, _stretch long, _us long, passed long")


def stretches(cells: DataFrame, rows_each: int) -> DataFrame:
    """Add ``_stretch``, ``last_cell`` and ``alone`` (the run's only stretch) to (_key, _run, _cell, times).

    A stretch is neighbouring cells of about ``rows_each`` times.
    """
    run = Window.partitionBy("_key", "_run")
    before = F.sum("times").over(run.orderBy("_cell")) - F.col("times")
    dealt = cells.withColumn("_at", F.floor(before / F.lit(rows_each)))
    return dealt.withColumn("_stretch", F.dense_rank().over(run.orderBy("_at")).cast("long") - 1).withColumn(
        "last_cell", F.max("_cell").over(Window.partitionBy("_key", "_run", "_at"))).withColumn(
        "alone", F.max("_stretch").over(run) == 0).drop("_at")
