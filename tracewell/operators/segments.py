"""Windows over keys that may be hot.

A window partitioned by a key alone puts all rows of that key in one task. The
helpers here partition by (key, time segment) instead and carry what earlier
segments leave behind, so the largest task holds one key's rows of one segment.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.timing import micros, segment_of, to_micros

# A segment this many reach-back windows long repeats 1/16 of the rows.
REACH_PER_SEGMENT = 16


def segment_span(reach: timedelta) -> timedelta:
    return reach * REACH_PER_SEGMENT


def with_reach_back(
    df: DataFrame, ts: str, reach: timedelta, span: timedelta | None = None, context: Column | None = None
) -> DataFrame:
    """Add ``seg`` and ``own``: each row once in its own segment and, if it is
    within ``reach`` of the segment's end, once more in the next as context.

    A window over (key, seg) then sees everything up to ``reach`` back from any
    ``own`` row. Only rows matching ``context`` are repeated.
    """
    span = span or segment_span(reach)
    if span < reach:
        raise ValueError("a segment must be at least as long as the reach")
    late = F.pmod(micros(F.col(ts)), F.lit(to_micros(span))) >= F.lit(to_micros(span - reach))
    if context is not None:
        late = late & context
    home = segment_of(F.col(ts), span)
    return (
        df.withColumn("_home", home)
        .withColumn("seg", F.explode(F.when(late, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))))
        .withColumn("own", F.col("seg") == F.col("_home"))
        .drop("_home")
    )


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], values: list[str], span: timedelta, ts: str = "ts"
) -> DataFrame:
    """``prev_<value>`` of the key's preceding row, however far back, plus
    ``has_prev``.

    First pass: ``lag`` inside (key, segment). The first row of every segment
    is left open; it takes its values from the last row of the key's previous
    segment. The second pass sees only segment edges (at most two rows per key
    and segment).
    """
    inside = Window.partitionBy(*keys, "_seg").orderBy(*order)
    marked = df.withColumn("_seg", segment_of(F.col(ts), span))
    marked = marked.withColumn("_first", F.lag(F.lit(1)).over(inside).isNull())
    marked = marked.withColumn("_last", F.lead(F.lit(1)).over(inside).isNull())
    for v in values:
        marked = marked.withColumn(f"prev_{v}", F.lag(v).over(inside))

    settled = marked.filter(~F.col("_first")).withColumn("has_prev", F.lit(True))
    across = Window.partitionBy(*keys).orderBy("_seg", *order)
    edges = marked.filter(F.col("_first") | F.col("_last"))
    edges = edges.withColumn("has_prev", F.lag(F.lit(True), 1, False).over(across))
    for v in values:
        edges = edges.withColumn(f"prev_{v}", F.lag(v).over(across))
    opened = edges.filter(F.col("_first"))
    return settled.unionByName(opened).drop("_seg", "_first", "_last")
