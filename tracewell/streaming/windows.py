"""Windowed rates and container sessions on streams."""

from __future__ import annotations

import math
import pickle
import sys
from datetime import timedelta

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracewell.functions.timing import micros, to_micros
from tracewell.operators.diffs import CONTAINER_EXPIRY, slot_changes
from tracewell.operators.lookups import RATE_SECONDS

# As in ``keyed``: processors travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rate_stream(
    events: DataFrame, window: timedelta = timedelta(seconds=RATE_SECONDS), slide: timedelta = timedelta(seconds=1),
    delay: str = "10 seconds",
) -> DataFrame:
    """Rows per second by type over a sliding window, once it is closed.

    Rows are counted once per pane (the longest span that both window and slide are
    multiples of); the windows add up panes, so no row is multiplied by the windows it
    falls into. A row whose pane the watermark has closed counts nowhere; null types
    are a type, null times count nowhere.
    """
    seconds = window.total_seconds()
    pane = math.gcd(to_micros(window), to_micros(slide))
    span, step = f"{seconds} seconds", f"{slide.total_seconds()} seconds"
    panes = (
        events.withColumn("at", F.col("ts").cast("timestamp"))
        .withWatermark("at", delay)
        .groupBy(F.window("at", f"{pane} microseconds").alias("pane"), "type")
        .agg(F.count("*").alias("in_pane"))
    )
    return (
        panes.groupBy(F.window("pane", span, step).alias("w"), "type")
        .agg(F.sum("in_pane").alias("n"))
        .select(
            F.col("w.start").alias("start"), F.col("w.end").alias("end"), "type", "n",
            (F.col("n") / F.lit(seconds)).alias("per_second"),
        )
    )


class _OpenSession(StatefulProcessor):
    """Keeps a session's newest open until a close takes it or it is too old."""

    def __init__(self, expiry: int, slots: T.DataType):
        self.expiry, self.slots = expiry, slots

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [T.StructField("at", T.LongType()), T.StructField("slots", T.BinaryType())]
        self.open = handle.getValueState("open", T.StructType(fields))

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["at_us", "closing"], kind="stable")
        held = self.open.get() if self.open.exists() else None
        pairs = []
        for at, closing, slots, ts in zip(pdf["at_us"], pdf["closing"], pdf["slots"], pdf["ts"], strict=True):
            if not closing:
                held = (int(at), pickle.dumps(slots))
            elif held is not None:
                if 0 <= at - held[0] <= self.expiry:
                    pairs.append((key[0], ts, pickle.loads(held[1]), slots))
                held = None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held is None:
            self.open.clear()
        else:
            self.open.update(held)
            # Once the watermark is past the expiry no close can take it.
            self.handle.registerTimer((held[0] + self.expiry) // 1_000 + 1)
        yield pd.DataFrame(pairs, columns=["session", "closed", "before", "after"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.open.clear()
        return iter([])

    def close(self) -> None:
        pass


def container_stream(
    opens: DataFrame, closes: DataFrame, expiry: timedelta = CONTAINER_EXPIRY, delay: str = "1 minute",
    max_slots: int | None = None,
) -> DataFrame:
    """Deposits and withdrawals of sessions whose close follows the open within
    ``expiry``; the newest open counts and a close takes it, as in the batch form.

    One row per snapshot: session, ts and ``slots``, an array of (slot, item,
    count). State is one snapshot per open session, dropped in event time.
    """
    columns = ["session", "ts", "slots"]
    events = opens.select(*columns, F.lit(False).alias("closing")).unionByName(
        closes.select(*columns, F.lit(True).alias("closing"))
    )
    timed = (
        events.withColumn("at_us", micros(F.col("ts"))).withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
    )
    slots = timed.schema["slots"].dataType
    session = timed.schema["session"].dataType
    out = T.StructType([
        T.StructField("session", session), T.StructField("closed", T.TimestampType()),
        T.StructField("before", slots), T.StructField("after", slots),
    ])
    pairs = timed.groupBy("session").transformWithStateInPandas(
        statefulProcessor=_OpenSession(to_micros(expiry), slots), outputStructType=out, outputMode="Append",
        timeMode="EventTime",
    )
    return slot_changes(pairs, ["session", "closed"], max_slots)
