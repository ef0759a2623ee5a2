"""Keyed state: coalescing, throttling, last hits and primes.

State is one small value per key in the RocksDB store. It ends by event time: a timer at
the moment from which the value can change no answer any more clears it once the watermark
has passed. Gaps between micro-batches, replays and the clock have no part in it, so a
stream gives what the batch form gives, for rows that are not later than the watermark
(those are dropped). With ``delay`` None there is no watermark: nothing is dropped, and
the state of every key stays.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracewell.functions.timing import micros, to_micros
from tracewell.operators.attribution import HIT_WINDOW, PLAYER_KINDS, PRIME_TTL
from tracewell.operators.gate import COALESCE_WINDOW, SPAWN_WINDOW
from tracewell.schema import ENTITY_CHANGE, SPAWN

# The state runner does not look into files added to the context, so processors
# travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB provider; set before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """One key's rows of a micro-batch, which the source bounds."""
    return pd.concat(list(rows), ignore_index=True).sort_values(["at_us", "id"], kind="stable")


def _timed(rows: DataFrame, delay: str | None) -> DataFrame:
    """``rows`` with ``at_us`` and, with a delay, a watermark on their time. Watermarks need
    a zoned column."""
    rows = rows.withColumn("at_us", micros(F.col("ts")))
    return rows if delay is None else rows.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)


class _Ending(StatefulProcessor):
    """A state that ends at an event time."""

    def __init__(self, ends: bool):
        self.ends = ends

    def end_at(self, moment_us: int | None) -> None:
        """Let the state of the key end once the watermark is past ``moment_us``."""
        if not self.ends:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if moment_us is not None:
            self.handle.registerTimer(moment_us // 1_000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


class _LastSeen(_Ending):
    """Keeps the time of a key's last row (or last kept row)."""

    def __init__(self, window: int, extend: bool, ends: bool, columns: list[str]):
        super().__init__(ends)
        self.window, self.extend, self.columns = window, extend, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", T.StructType([T.StructField("at", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows)
        last = self.state.get()[0] if self.state.exists() else None
        kept = []
        for at in pdf["at_us"]:
            fresh = last is None or at - last >= self.window
            kept.append(fresh)
            if fresh or self.extend:
                last = at
        self.state.update((int(last),))
        self.end_at(int(last) + self.window)
        yield pdf[kept][self.columns]


def _last_seen(rows: DataFrame, key, window: timedelta, extend: bool, delay: str | None) -> DataFrame:
    keyed = _timed(rows.withColumn("state_key", key), delay)
    return keyed.groupBy("state_key").transformWithStateInPandas(
        statefulProcessor=_LastSeen(to_micros(window), extend, delay is not None, rows.columns),
        outputStructType=rows.schema,
        outputMode="Append",
        timeMode="None" if delay is None else "EventTime",
    )


def coalesce_stream(events: DataFrame, window: timedelta = COALESCE_WINDOW, delay: str | None = "10 minutes") -> DataFrame:
    """Entity changes without those that follow a change of the same actor and
    cell by less than ``window``."""
    rows = events.filter(F.col("type") == ENTITY_CHANGE)
    actor = F.coalesce("actor_uuid", "actor_name", F.lit(""))
    key = F.concat_ws("\u0001", actor, "world_key", *[F.col(c).cast("string") for c in "xyz"])
    return _last_seen(rows, key, window, extend=True, delay=delay)


def throttle_stream(events: DataFrame, window: timedelta = SPAWN_WINDOW, delay: str | None = "10 minutes") -> DataFrame:
    """Spawns, at most one per entity kind and ``window``."""
    rows = events.filter(F.col("type") == SPAWN)
    return _last_seen(rows, F.col("target"), window, extend=False, delay=delay)


class _LastRecord(_Ending):
    """Remembers a key's newest record; probes read or take it."""

    def __init__(self, ttl: int, take: bool, accept: tuple[str, ...], ends: bool):
        super().__init__(ends)
        self.ttl, self.take, self.accept = ttl, take, accept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "record",
            T.StructType([
                T.StructField("at", T.LongType()), T.StructField("actor", T.StringType()), T.StructField("kind", T.StringType()),
            ]),
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows)
        held = tuple(self.state.get()) if self.state.exists() else None
        out = []
        for row in pdf.itertuples(index=False):
            if row.is_record:
                # Without an actor it forgets what was there, which is what no record does.
                held = None if row.actor is None else (int(row.at_us), row.actor, row.kind)
                continue
            actor = kind = None
            if held is not None and row.at_us - held[0] <= self.ttl:
                if not self.accept or held[2] in self.accept:
                    actor, kind = held[1], held[2]
            out.append((row.id, actor, kind))
            if self.take:
                held = None
        if held is None:
            self.state.clear()
        else:
            self.state.update(held)
        self.end_at(None if held is None else held[0] + self.ttl)
        yield pd.DataFrame(out, columns=["id", "actor", "kind"])


_FOUND = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("actor", T.StringType()), T.StructField("kind", T.StringType()),
])


def _last_record(events: DataFrame, ttl: timedelta, take: bool, delay: str | None, accept=()) -> DataFrame:
    rows = _timed(events.select("key", "id", "ts", "is_record", "actor", "kind"), delay)
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_LastRecord(to_micros(ttl), take, tuple(accept), delay is not None),
        outputStructType=_FOUND, outputMode="Append", timeMode="None" if delay is None else "EventTime",
    )


def last_hit_stream(events: DataFrame, window: timedelta = HIT_WINDOW, delay: str | None = "10 minutes") -> DataFrame:
    """``events``: key (the victim), ts, id, is_record, actor, kind; hits are
    records (a null actor forgets), deaths are probes. Result: id, actor, kind
    per probe."""
    return _last_record(events, window, take=False, delay=delay)


def prime_stream(events: DataFrame, ttl: timedelta = PRIME_TTL, delay: str | None = "10 minutes") -> DataFrame:
    """As above with key = cell; a probe uses the record up."""
    return _last_record(events, ttl, take=True, delay=delay, accept=PLAYER_KINDS)
