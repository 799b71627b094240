"""Request and event logs: redaction, pseudonyms, counts, volumes and the rate limit."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions import vocabulary as v
from orderloom.operators.limiting import passed_counts, stretches
from orderloom.session import written

REDACTED = "[REDACTED]"
KEYS = ("route", "client")


# --- text hygiene -----------------------------------------------------------------------
def redact(text: Column, patterns: Sequence[str] = v.SECRET_PATTERNS) -> Column:
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, REDACTED)
    return text


def shorten_paths(text: Column) -> Column:
    """Absolute paths keep only their last part."""
    for pattern in (v.WINDOWS_PATH, v.UNIX_PATH):
        text = F.regexp_replace(text, pattern, "…/$1")
    return text


def hide_paths(text: Column) -> Column:
    """Absolute paths become ``<path>``, for texts shown to users."""
    for pattern in v.HIDDEN_PATHS:
        text = F.regexp_replace(text, pattern, v.HIDDEN_PATH)
    return text


def client_pseudonym(identity: Column, salt: str, length: int = 12) -> Column:
    return F.concat(F.lit("client-"), F.left(F.sha2(F.concat(F.lit(salt), identity), 256), F.lit(length)))


def event_log(events: DataFrame, salt: str, clip: int = v.EVENT_DETAIL_CHARS,
              patterns: Sequence[str] = v.SECRET_PATTERNS) -> DataFrame:
    """Log rows with pseudonymous clients and redacted, shortened, clipped details.

    ``events`` has time, type, route, client and detail columns.
    """
    return events.select(
        "time", "type", "route", client_pseudonym(F.col("client").cast("string"), salt).alias("client"),
        F.left(shorten_paths(redact(F.col("detail"), patterns)), F.lit(clip)).alias("detail"))


def event_counts(events: DataFrame, types: Sequence[str] = v.EVENT_TYPES, column: str = "type") -> DataFrame:
    """Events per listed type, zeros kept; other types are not reported."""
    listed = events.sparkSession.createDataFrame([(t,) for t in types], "type string")
    counted = events.groupBy(F.col(column).alias("type")).agg(F.count("*").alias("n"))
    return listed.join(counted, "type", "left").na.fill(0, ["n"])


def recent_events(events: DataFrame, time: str = "time", tie: str = "event_id", limit: int = v.RECENT_EVENTS) -> DataFrame:
    return events.orderBy(F.desc(time), F.desc(tie)).limit(limit)


def oversize_requests(requests: DataFrame, limits: Mapping[str, float], size: str = "size") -> DataFrame:
    """Requests above the size limit of their route."""
    table = requests.sparkSession.createDataFrame(
        [(route, float(limit)) for route, limit in limits.items()], "route string, max_size double")
    return requests.join(F.broadcast(table), "route").where(F.col(size) > F.col("max_size"))  # one row per route


# --- volumes ----------------------------------------------------------------------------
def trailing_volume(
    requests: DataFrame, window_s: int, keys: Sequence[str] = KEYS, time: str = "ts", cell_windows: int = 64
) -> DataFrame:
    """Add ``in_window``: requests of the same keys in the trailing window, the row included.

    Time is cut into cells of many windows. A row close to the end of its cell is also
    handed to the next cell as context, so every cell is counted on its own and a client
    with most of the traffic is spread over as many tasks as it has cells.
    """
    width = window_s * 1_000_000
    cell_width = width * cell_windows
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    placed = requests.withColumn("_us", micros).withColumn("_cell", F.floor(F.col("_us") / F.lit(cell_width)))
    near_end = F.col("_us") > (F.col("_cell") + 1) * cell_width - width
    cells = F.when(near_end, F.array(F.col("_cell"), F.col("_cell") + 1)).otherwise(F.array(F.col("_cell")))
    copies = placed.select("*", F.explode(cells).alias("_in"))
    trailing = Window.partitionBy(*keys, "_in").orderBy("_us").rangeBetween(-(width - 1), Window.currentRow)
    return copies.withColumn("in_window", F.count("*").over(trailing)).where(
        F.col("_in") == F.col("_cell")).drop("_us", "_cell", "_in")


# --- rate limit -------------------------------------------------------------------------
class SlidingLog:
    """Admitted times of one client: the state of the limiter, never longer than the limit."""

    def __init__(self, limit: int, width: int, admitted: Sequence[int] = (), logged: int | None = None):
        self.limit, self.width = limit, width
        self.admitted = deque(admitted)
        self.logged = logged

    def offer(self, now: int) -> tuple[bool, bool]:
        """(blocked, log line due). Refused requests do not count towards the window."""
        while self.admitted and now - self.admitted[0] >= self.width:
            self.admitted.popleft()
        if len(self.admitted) < self.limit:
            self.admitted.append(now)
            return False, False
        due = self.logged is None or now - self.logged >= self.width
        if due:
            self.logged = now
        return True, due


def replayed(times: DataFrame, limit: int, width: int) -> DataFrame:
    """(_key, _us, passed, lines) of runs of one stretch, each replayed in time order.

    Rows (_key, _run, _us, n, context) stream by; no more than ``limit`` times are held.
    """
    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, log = None, SlidingLog(limit, width)
        for frame in frames:
            passed, lines = [], []
            for key, run, now, n in frame[["_key", "_run", "_us", "n"]].itertuples(index=False, name=None):
                if (key, run) != current:
                    current, log = (key, run), SlidingLog(limit, width)
                verdicts = [log.offer(now) for _ in range(n)]
                passed.append(sum(not blocked for blocked, _ in verdicts))
                lines.append(sum(due for _, due in verdicts))
            own = ~frame["context"].to_numpy(bool)
            yield frame[["_key", "_us"]].assign(passed=passed, lines=lines)[own]

    return times.repartition("_key", "_run").sortWithinPartitions("_key", "_run", "_us").mapInPandas(
        replay, "_key string, _us long, passed long, lines long")


def rate_limit(
    requests: DataFrame, limit: int, window_s: int, keys: Sequence[str] = KEYS,
    time: str = "ts", tie: str = "event_id", stretch_times: int = 100_000,
) -> DataFrame:
    """Add ``blocked`` and ``logged`` per request under a sliding-log limit.

    While the trailing volume of a whole window-long cell stays within the limit, all its
    requests pass. Only runs of busy cells depend on order. A run is cut into stretches of
    about ``stretch_times`` distinct times (at least one window); stretches are summarised
    apart and their summaries combined in log rounds (``limiting``), so an uninterrupted
    flood of one client is spread like other rows; runs of one stretch are replayed. Log lines are a limit of one per
    window on the blocked requests, settled in the same way.

    Null keys are a client of their own. Rows without a time pass and are not counted.
    """
    width = window_s * 1_000_000
    keys, columns = list(keys), requests.columns
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    keyed = requests.where(F.col(time).isNotNull()).withColumn("_key", F.to_json(F.struct(*keys)))
    # Cells, calm rows, busy rows and their context all read the counted rows.
    counted = written(trailing_volume(keyed, window_s, ["_key"], time).withColumn("_us", micros).withColumn(
        "_cell", F.floor(F.col("_us") / F.lit(width))), "request-volume")
    busy_cells = counted.groupBy("_key", "_cell").agg(
        F.max("in_window").alias("_peak"), F.approx_count_distinct("_us").alias("times")).where(F.col("_peak") > limit)
    # Cells are windows of time, so a client has at most (time span / window) of them here.
    in_order = Window.partitionBy("_key").orderBy("_cell")
    cells = written(stretches(busy_cells.select(
        "_key", "_cell", "times", (F.col("_cell") - F.row_number().over(in_order)).alias("_run")), stretch_times), "busy-cells")
    before = cells.groupBy("_key", "_run").agg((F.min("_cell") - 1).alias("_cell"), F.first("alone").alias("alone"))
    most = cells.agg(F.max("_stretch")).first()[0]
    calm = counted.join(cells, ["_key", "_cell"], "left_anti").select(*columns).unionByName(
        requests.where(F.col(time).isNull())).select(
        "*", F.lit(False).alias("blocked"), F.lit(False).alias("logged"))
    if most is None:
        return calm

    per_time = counted.groupBy("_key", "_cell", "_us").agg(F.count("*").alias("n"))
    here = F.struct("_stretch", F.lit(False).alias("context"))
    after = F.struct((F.col("_stretch") + 1).alias("_stretch"), F.lit(True).alias("context"))
    placed = per_time.join(cells, ["_key", "_cell"]).select(
        "_key", "_run", "alone", "_us", "n", (F.col("last_cell") * width).alias("last"),
        F.explode(F.when(F.col("_cell") == F.col("last_cell"), F.array(here, after)).otherwise(F.array(here))).alias("s"))
    quiet = per_time.join(before, ["_key", "_cell"]).select(
        "_key", "_run", "alone", "_us", "n", F.lit(0).cast("long").alias("last"),
        F.struct(F.lit(0).cast("long").alias("_stretch"), F.lit(True).alias("context")).alias("s"))
    times = written(placed.unionByName(quiet).select("_key", "_run", "alone", "s._stretch", "_us", "n", "last", "s.context"), "busy-times")
    verdicts = replayed(times.where("alone AND _stretch = 0"), limit, width)
    if most:
        rounds, flood = int(most).bit_length(), times.where("NOT alone").drop("alone")
        passed = written(passed_counts(flood, limit, width, rounds).drop("_stretch"), "passed")
        # No request was blocked in the quiet window before a run.
        left = flood.where("NOT (context AND _stretch = 0)").join(passed, ["_key", "_run", "_us"]).withColumn(
            "n", F.col("n") - F.col("passed")).drop("passed")
        lines = passed_counts(left, 1, width, rounds).select("_key", "_us", F.col("passed").alias("lines"))
        verdicts = verdicts.unionByName(passed.select("_key", "_us", "passed").join(lines, ["_key", "_us"]))
    # Only requests of one client in one microsecond share a window here.
    place = F.row_number().over(Window.partitionBy("_key", "_us").orderBy(tie))
    decided = counted.join(verdicts, ["_key", "_us"]).withColumn("_place", place).select(
        *columns, (F.col("_place") > F.col("passed")).alias("blocked"),
        ((F.col("_place") == F.col("passed") + 1) & (F.col("lines") > 0)).alias("logged"))
    return calm.unionByName(decided)
