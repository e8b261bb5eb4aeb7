"""Counters whose window opens at a key's first hit.

The window is neither clock-aligned nor sliding: it opens with the first hit,
counts until its time is over, and the next hit opens a new one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hits allowed in a minute and in an hour, and the path that is never counted.
PER_MINUTE, PER_HOUR, EXEMPT = 600, 10_000, "/healthcheck"
HEALTH = (EXEMPT, "/health")


def batch_counts(hits: DataFrame, key: str, time: str, order: str, seconds: int) -> DataFrame:
    """Add ``hits``: the count in the key's window after each row.

    Rows are dealt by key, sorted, and folded in one pass that holds one row of
    state, so a hot key is streamed and never held.
    """
    schema = hits.schema
    columns = hits.columns
    limit = seconds * 1_000_000

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, opened, count = object(), 0, 0
        k, t = columns.index(key), columns.index(time)
        for batch in batches:
            at = batch.column(t).cast(pa.timestamp("us", batch.column(t).type.tz)).cast(pa.int64()).to_numpy(zero_copy_only=False)
            out = np.empty(batch.num_rows, np.int64)
            for n, (who, when) in enumerate(zip(batch.column(k).to_pylist(), at.tolist(), strict=True)):
                if who != last_key or when - opened >= limit:
                    last_key, opened, count = who, when, 0
                count += 1
                out[n] = count
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*columns, "hits"])

    dealt = hits.repartition(key).sortWithinPartitions(key, time, order)
    return dealt.mapInArrow(fold, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, hits long")


def decide(minute: Column, hour: Column, path: Column, per_minute: int = PER_MINUTE, per_hour: int = PER_HOUR) -> Column:
    """Status, and what is left of the minute and the hour; both counters go on counting."""
    over = (minute > per_minute) | (hour > per_hour)
    status = F.when(path.isin(*HEALTH), 200).when(over, 429).otherwise(200)
    return F.struct(status.alias("status"), F.greatest(F.lit(0), per_minute - minute).alias("left_minute"), F.greatest(F.lit(0), per_hour - hour).alias("left_hour"))


def limited(hits: DataFrame, key: str, time: str, order: str, path: Column, *, per_minute: int = PER_MINUTE, per_hour: int = PER_HOUR, seconds: tuple[int, int] = (60, 3600)) -> DataFrame:
    """Every request with its status and what is left, by both counters; exempt paths are not counted."""
    asked = hits.withColumn("__exempt", path.isin(*HEALTH))
    short = batch_counts(asked.where("not __exempt"), key, time, order, seconds[0]).withColumnRenamed("hits", "__minute")
    both = batch_counts(short, key, time, order, seconds[1]).withColumnRenamed("hits", "__hour")
    free = asked.where("__exempt").withColumns({"__minute": F.lit(0).cast("long"), "__hour": F.lit(0).cast("long")})
    every = both.unionByName(free)
    told = decide(F.col("__minute"), F.col("__hour"), F.when(F.col("__exempt"), EXEMPT).otherwise(""), per_minute, per_hour)
    return every.withColumn("__told", told).select(*hits.columns, "__told.*")


def stream_counts(hits: DataFrame, key: str, time: str, seconds: int, late: str = "1 minute") -> DataFrame:
    """The same on a stream: ``key, time, hits``.

    A key's state has a timer at the end of its window and goes when the
    watermark, ``late`` behind the newest hit, has passed it, so state is that
    of open windows only.  Hits later than that are left out.  Needs the
    RocksDB state store.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Counter(StatefulProcessor):
        def init(self, handle):
            self.state = handle.getValueState("window", "opened double, count long")
            self.handle = handle

        def handleInputRows(self, who, frames, timers):  # noqa: N802
            opened, count = before = self.state.get() if self.state.exists() else (None, 0)
            times = pd.concat(list(frames))["time"].sort_values()
            counts = []
            for when in times.map(pd.Timestamp.timestamp):
                if opened is None or when - opened >= seconds:
                    opened, count = when, 0
                count += 1
                counts.append(count)
            if before[0] != opened:  # another window: its own timer alone is left
                if before[0] is not None:
                    self.handle.deleteTimer(_end(before[0], seconds))
                self.handle.registerTimer(_end(opened, seconds))
            self.state.update((opened, count))
            yield pd.DataFrame({"key": who[0], "time": times.to_numpy(), "hits": counts})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            self.state.clear()
            return iter(())

        def close(self):
            pass

    kind = hits.schema[key].dataType.simpleString()
    chosen = hits.select(F.col(key).alias("key"), F.col(time).alias("time")).withWatermark("time", late)
    return chosen.groupBy("key").transformWithStateInPandas(Counter(), f"key {kind}, time timestamp, hits long", "Append", "EventTime")


def _end(opened: float, seconds: int) -> int:
    """Milliseconds at which a window is over."""
    return round((opened + seconds) * 1000)
