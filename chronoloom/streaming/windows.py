"""Streaming forms of phrases and pages: event-time windows with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """The files under ``path`` as a stream of events with an event-time column ``at``."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return raw.withColumn("at", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, gap: str = "8 hours", late: str = "1 hour") -> DataFrame:
    """Phrases as session windows: a silence of ``gap`` or more ends one."""
    w = F.session_window("at", gap)
    return events.withWatermark("at", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def pages(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Fixed-period pages as tumbling (or sliding) windows."""
    w = F.window("at", size, slide) if slide else F.window("at", size)
    return events.withWatermark("at", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_merge(events: DataFrame, gap_seconds: float, late: str = "1 hour") -> DataFrame:
    """A custom state per user: islands of events, each emitted once the watermark has passed its end by the gap.

    An event exactly ``gap_seconds`` after the last one still belongs to the island, unlike in a
    session window. Events wait in the state until the watermark reaches them and are then taken in
    order, so that those of different batches may arrive in any order within ``late``; older ones are
    dropped. A user whose islands are all emitted has no state.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, n, waiting = state.get if state.exists else (None, None, 0, [])
        mark = state.getCurrentWatermarkMs() / 1000
        times = sorted([*(waiting or []), *(t.timestamp() for f in frames for t in f["at"])])
        done = []
        for t in [t for t in times if t <= mark]:
            if start is not None and t - last > gap_seconds:
                done.append((key[0], start, last, n))
                start, n = None, 0
            start, last, n = (t if start is None else start), t, n + 1
        waiting = [t for t in times if t > mark]
        if start is not None and mark - last > gap_seconds:
            done.append((key[0], start, last, n))
            start, last, n = None, None, 0
        if start is None and not waiting:
            if state.exists:
                state.remove()
        else:
            state.update((start, last, n, waiting))
            due = min([*waiting[:1], *([last + gap_seconds] if start is not None else [])])
            state.setTimeoutTimestamp(max(int(due * 1000), int(mark * 1000)) + 1)
        yield pd.DataFrame(done, columns=["user_id", "start", "end", "n"])

    schema = "start double, last double, n long, waiting array<double>"
    return events.withWatermark("at", late).groupBy("user_id").applyInPandasWithState(step, "user_id long, start double, end double, n long", schema, "append", GroupStateTimeout.EventTimeTimeout)
