"""Structured Streaming forms of the batch windows: bucketed and session aggregates with watermarks, and stable
runs as a stateful operator. An extra: the batch operators are the reference semantics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import sequences  # noqa: F401  (the batch forms)


def timed(stream: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a zone."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def bucket_stream(stream: DataFrame, *, key: list[str], ts: str = "ts", value: str = "value", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Tumbling buckets with mean, maximum and count; rows later than ``late`` are dropped. Append mode."""
    grouped = timed(stream, ts).withWatermark(ts, late).groupBy(*key, F.window(ts, width))
    return grouped.agg(F.avg(value).alias("mean"), F.max(value).alias("largest"), F.count("*").alias("n")).select(*key, F.col("window.start").alias("start"), "mean", "largest", "n")


def session_stream(stream: DataFrame, *, key: list[str], ts: str = "ts", gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Gap sessions: bounds and size. A session ends ``gap`` after its last row. Append mode."""
    grouped = timed(stream, ts).withWatermark(ts, late).groupBy(*key, F.session_window(ts, gap).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.min(ts).alias("t_start"), F.max(ts).alias("t_end")).drop("w")


RUN_OUT, RUN_STATE = "user_id long, n long, first_value double, last_value double", "last double, n long, first double"


def run_stream(stream: DataFrame, *, threshold: float = 20.0, least: int = 3) -> DataFrame:
    """Stable runs of ``value`` per user in order of arrival: a run is put out when a large step ends it. State
    is three numbers per user."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, first = state.get if state.exists else (None, 0, None)
        out = []
        for rows in batches:
            for v in rows.sort_values(["ts", "event_id"])["value"]:
                if last is not None and abs(v - last) <= threshold:
                    n += 1
                else:
                    if n >= least:
                        out.append((key[0], n, first, last))
                    n, first = 1, v
                last = v
        state.update((last, n, first))
        yield pd.DataFrame(out, columns=["user_id", "n", "first_value", "last_value"])

    return stream.groupBy("user_id").applyInPandasWithState(step, RUN_OUT, RUN_STATE, "append", GroupStateTimeout.NoTimeout)
