"""Time arithmetic on zone-less timestamps.

Facts carry ``timestamp_ntz``. Nothing here depends on the session time zone:
converting to a zoned timestamp would shift rows at daylight-saving changes.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000


def ts_lit(value: datetime) -> Column:
    """A zone-less literal, so comparisons with ``ts`` still reach the scan."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 as a long."""
    minutes = (F.unix_date(ts.cast("date")).cast("long") * 24 + F.hour(ts)) * 60 + F.minute(ts)
    seconds = F.date_part(F.lit("SECOND"), ts)
    return minutes * (60 * MICROS_PER_SECOND) + (seconds * MICROS_PER_SECOND).cast("long")


def to_micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def interval(span: timedelta) -> Column:
    """A day-time interval literal."""
    return F.make_dt_interval(secs=F.lit(to_micros(span) / MICROS_PER_SECOND).cast("decimal(18,6)"))


def segment_of(ts: Column, span: timedelta) -> Column:
    """Number of the time segment of length ``span`` that holds ``ts``."""
    return F.floor(micros(ts) / F.lit(to_micros(span)))
