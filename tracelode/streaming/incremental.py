"""Books and windowed counts kept up to date from a stream of calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelode.operators import book as B
from tracelode.sources import writers

PAIR_SCHEMA = "trace string, src string, dst string"


def timed(events: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """A watermark needs a TIMESTAMP; timestamps without zone are cast."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def windowed_counts(events: DataFrame, op: str = "event_type", ts: str = "ts", size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(start, op, n): calls per tumbling or sliding window; rows later than delay are left out."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return timed(events, ts, delay).groupBy(w.alias("w"), op).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), op, "n")


def session_lengths(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """(user, start, calls): sessions that end after a gap without calls."""
    return timed(events, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("calls")).select(user, F.col("w.start").alias("start"), "calls")


def _follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Pairs of one trace in one trigger, its batches sorted as a whole. Calls older than the last one known continue from it
    among themselves in the order of time, as what was given out can't be taken back."""
    last = state.get[0] if state.exists else "NONE"
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    ops = list(pd.concat(parts).sort_values(["ts", "event_id"], kind="stable")["op"])
    state.update((ops[-1],))
    yield pd.DataFrame({"trace": [str(key[0])] * len(ops), "src": [last, *ops[:-1]], "dst": ops})


def transitions(events: DataFrame, trace: str = "user_id", op: str = "event_type") -> DataFrame:
    """(trace, src, dst) for each call as it arrives; the state of a trace is its last operation."""
    need = events.select(F.col(trace).alias("trace"), F.col(op).alias("op"), "ts", "event_id")
    return need.groupBy("trace").applyInPandasWithState(_follow, PAIR_SCHEMA, "last string", "append", GroupStateTimeout.NoTimeout)


def keep_book(pairs: DataFrame, folder: str, checkpoint: str, accepted: Callable[[DataFrame], bool] = lambda batch: True):
    """Starts a query that merges the pairs (trace, src, dst) of every trigger into the book versions in folder; a batch is adopted
    only if accepted says so. A batch that is run again after a failure finds its own version and changes nothing."""

    def merge(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        old, done = writers.latest_version(spark, folder)
        if done is not None and int(done.rpartition("-")[2]) >= no:
            return
        new = batch.select("src", "dst")
        base = old if old is not None else spark.createDataFrame([], B.BOOK)
        if accepted(batch):
            writers.version(B.record(base, new), folder, f"batch-{no}")

    return pairs.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(merge).start()
