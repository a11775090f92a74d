"""Structured Streaming forms: windowed counts with late data, first sight of keys, upserts per micro-batch, stateful slots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plinth.operators.keyed import merge


def windowed_counts(events: DataFrame, at: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, end, key, n, total) per tumbling window; rows later than the watermark are dropped, as in any streaming job."""
    out = events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) per session."""
    out = events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(links: DataFrame, at: str, key: str, late: str = "1 day") -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return links.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def upsert_sink(path: str, keys: list[str], keep: list[str] = ()):
    """foreachBatch function: a keyed upsert into versions of a Parquet table, each made from the newest one before it, so numbers
    may be skipped; replaying a batch writes the same version. A version is the whole table: for tables that are small
    beside their stream."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        before = [n for n in (int(x[1:]) for x in names if x[1:].isdigit()) if n < number and fs.exists(folder.suffix(f"/v{n}/_SUCCESS"))]
        old = spark.read.parquet(f"{path}/v{max(before)}") if before else batch.limit(0)
        merge(old, batch, keys, list(keep)).write.mode("overwrite").parquet(f"{path}/v{number}")

    return run


SLOT_STATE = "unit string, since timestamp, number int"
SLOT_ROWS = "party long, number int, unit string, active_from timestamp, active_to timestamp"


def stream_slots(events: DataFrame, party: str = "user_id", unit: str = "event_type", at: str = "ts") -> DataFrame:
    """Closed slots of a stream: a party's slot ends when an event of another unit arrives. State is one open slot per party."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else None
        closed = []
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        for u, t in zip(rows[unit], rows[at]):
            if now is None:
                now = (u, t, 0)
            elif u != now[0]:
                closed.append((key[0], now[2], now[0], now[1], t))
                now = (u, t, now[2] + 1)
        state.update(now)
        yield pd.DataFrame(closed, columns=["party", "number", "unit", "active_from", "active_to"])

    return events.select(party, unit, at).groupBy(party).applyInPandasWithState(step, SLOT_ROWS, SLOT_STATE, "append", GroupStateTimeout.NoTimeout)
