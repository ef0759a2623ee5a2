"""Neighbourhood attribution on streams.

Records and probes interact across cells, so no key keeps them together short
of the world. Instead each micro-batch is joined, with the batch operators,
with the records the batches before it left behind. That remainder is a table
in the checkpoint folder, one version per batch id, bounded by the time to
live; a batch run again reads the same version and writes the same rows.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tracewell.functions.timing import ts_lit
from tracewell.operators.attribution import (
    FIRE_RADIUS,
    FIRE_TTL,
    FLUID_RADIUS,
    FLUID_TTL,
    attribute_fire,
    attribute_fluid,
)
from tracewell.sources.folders import drop
from tracewell.sources.tables import read_table

CAUSERS = T.StructType([
    T.StructField("rid", T.LongType()), T.StructField("world_key", T.StringType()),
    T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("z", T.IntegerType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("actor_uuid", T.StringType()),
    T.StructField("actor_name", T.StringType()), T.StructField("mob", T.StringType()), T.StructField("allowed", T.BooleanType()),
])
SOURCES = T.StructType([f for f in CAUSERS.fields if f.name not in ("mob", "allowed")])
CELL = ["world_key", "x", "y", "z"]


def _newest_per_cell(records: DataFrame, now: DataFrame, ttl: timedelta) -> DataFrame:
    """What can still matter: the last record of each cell, if fresh."""
    columns = records.columns
    last = records.groupBy(*CELL).agg(F.max_by(F.struct(*columns), F.struct("ts", "rid")).alias("_r")).select("_r.*")
    newest = now.agg(F.max("ts")).first()[0]
    return last if newest is None else last.filter(F.col("ts") >= ts_lit(newest - ttl))


def _run(events, split, match, sink, checkpoint, schema, ttl, trigger) -> StreamingQuery:
    state = f"{checkpoint}/carried"

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch, found = batch.persist(), None
        try:
            records, probes = split(batch)
            held = read_table(spark, f"{state}/v={batch_id - 1}", schema, may_be_new=batch_id == 0).unionByName(records)
            found, left = match(probes, held)
            sink(found, batch_id)
            _newest_per_cell(left, batch, ttl).write.mode("overwrite").parquet(f"{state}/v={batch_id}")
            drop(spark, f"{state}/v={batch_id - 2}")
        finally:
            batch.unpersist()
            if found is not None:
                found.unpersist()

    return (
        events.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{checkpoint}/query")
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


def fire_stream(
    events: DataFrame, split, sink, checkpoint: str,
    radius: int = FIRE_RADIUS, ttl: timedelta = FIRE_TTL, trigger: dict | None = None,
) -> StreamingQuery:
    """One-shot fire attribution. ``split(batch)`` gives (causer records, fire
    probes); ``sink(found, batch_id)`` stores fires with their verdict and must
    replace what the same batch id wrote before."""

    def match(probes: DataFrame, held: DataFrame):
        found = attribute_fire(probes, held, radius, ttl).persist()
        used = found.filter(F.col("rid").isNotNull()).select("rid").withColumn("_used", F.lit(True))
        # A used record leaves its cell empty rather than revealing an older one.
        last = held.groupBy(*CELL).agg(F.max_by("rid", F.struct("ts", "rid")).alias("rid"))
        left = held.join(last.select("rid"), "rid", "left_semi").join(used.select("rid"), "rid", "left_anti")
        return found, left.select(*CAUSERS.fieldNames())

    return _run(events, split, match, sink, checkpoint, CAUSERS, ttl, trigger)


def fluid_stream(
    events: DataFrame, split, sink, checkpoint: str,
    radius: int = FLUID_RADIUS, ttl: timedelta = FLUID_TTL, trigger: dict | None = None,
) -> StreamingQuery:
    """Nearest-source attribution; sources are not used up."""

    def match(probes: DataFrame, held: DataFrame):
        return attribute_fluid(probes, held, radius, ttl), held.select(*SOURCES.fieldNames())

    return _run(events, split, match, sink, checkpoint, SOURCES, ttl, trigger)
