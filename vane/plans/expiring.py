"""Keyed state of streams that ends: by a timer of the state's own, or when its key has been silent for a while."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from vane.plans.ordered import dumped, framed, restored

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_timers(spark: SparkSession) -> None:
    """Timers and state that ends need the RocksDB state store, which ships with Spark; to be called before such a stream starts."""
    spark.conf.set(STORE, ROCKSDB)


def use_source_watermark(spark: SparkSession) -> None:
    """For streams whose branches are parts of one source: the branch that is ahead moves the watermark of all, as the source itself
    would. By default a part without rows (no gauge for a while) would hold back the others. To be called before the stream starts."""
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "max")


class Expiring(StatefulProcessor):
    """The rows of a key in order through step. When the state's timer fires, end gives rows and says whether the state stays."""

    def __init__(self, order: list[str], names: list[str], columns: list[tuple], start: Callable, step: Callable, due: Callable, end: Callable, finish: Callable | None, silence: int | None):
        self.silence = silence
        self.order, self.names, self.columns = order, names, columns
        self.start, self.step, self.due, self.end, self.finish = start, step, due, end, finish

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "state string, latest bigint")

    def read(self) -> tuple[Any, int]:
        if not self.kept.exists():
            return self.start(), -(2**62)
        state, latest = self.kept.get()
        return restored(self.start(), json.loads(state)), latest

    def keep(self, state: Any, latest: int) -> None:
        """Saves the state and sets its one timer, or drops it if it waits for nothing."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        at = self.due(state, latest)
        if at is None:
            self.kept.clear()
        else:
            self.kept.update((json.dumps(dumped(state)), latest))
            self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows, timerValues):
        state, latest = self.read()
        out: list[tuple] = []
        for row in pd.concat(list(rows)).sort_values(self.order, kind="stable")[self.names].itertuples(index=False, name=None):
            row = tuple(None if v is pd.NA or v is pd.NaT or v != v else v for v in row)
            if self.silence is not None and row[-1] - latest > self.silence:  # the timer may not have fired yet
                state = self.start()
            latest = max(latest, int(row[-1]))
            out += self.step(state, row[:-1]) or ()
        if self.finish is not None:
            out += self.finish(state, tuple(key))
        self.keep(state, latest)
        yield framed(out, self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state, latest = self.read()
        out, stays = self.end(state, tuple(key), timerValues.getCurrentWatermarkInMs() * 1000)
        if stays:
            self.keep(state, latest)
        else:
            self.kept.clear()
        yield framed(out, self.columns)

    def close(self) -> None:
        pass


def expiring_scan(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], list[tuple] | None], schema: str, late: str, due: Callable[[Any, int], int | None], end: Callable[[Any, tuple, int], tuple[list[tuple], bool]], finish: Callable | None = None, silence: int | None = None) -> DataFrame:
    """stream_scan with state that ends. The first column of order is the event time, a timestamp or its micros.

    due(state, latest micros of the key) is when the state's timer fires, in micros; null drops the state at once. When the watermark,
    which follows the event time with the given lateness, has passed that, end(state, key, watermark micros) gives rows and
    whether the state stays, to be asked again. silence: micros without a row after which a key's next row finds a fresh state. Rows behind the watermark are left out, as by all stateful operators of Spark.
    """
    names = [*keys, *order, *(c for c in rows.columns if c not in (*keys, *order))]
    columns = [tuple(c.strip().rsplit(" ", 1)) for c in schema.split(",")]
    is_time = rows.schema[order[0]].dataType.typeName() == "timestamp"
    time = F.col(order[0]) if is_time else F.timestamp_micros(order[0])
    marked = rows.select(*names, F.unix_micros(time).alias("event_us"), time.alias("event_time")).withWatermark("event_time", late)
    job = Expiring(order, [*names, "event_us"], columns, start, step, due, end, finish, silence)
    return marked.groupBy(*keys).transformWithStateInPandas(job, schema, "Append", "EventTime")


def silent_after(seconds: int, late: str = "1 minute") -> Callable[..., DataFrame]:
    """A scan for the ordered operators (scan=...): over streams, with the state of a key dropped when it has been silent for so many seconds."""
    due = lambda state, latest: latest + seconds * 1_000_000
    end = lambda state, key, now: ([], False)

    def scan(rows: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, schema: str, finish: Callable | None = None) -> DataFrame:
        return expiring_scan(rows, keys, order, start, step, schema, late, due, end, finish, seconds * 1_000_000)

    return scan
