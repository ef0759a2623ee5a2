"""Ingest: redact, pseudonymise, gate, validate, store; quarantine what cannot be.

One chain for streams and for replays. Redaction comes first of all: what is refused
later is kept in its redacted form.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tracewell.functions.actions import pseudonymize_join, redact_command
from tracewell.functions.timing import ts_lit
from tracewell.operators.gate import GateConfig, coalesce_actor, gate, quarantine_reason
from tracewell.schema import ENTITY_CHANGE, EVENTS
from tracewell.session import checkpointed
from tracewell.sources.commits import Log, commit_key, drop_retired, is_published, live, publish, repeated
from tracewell.sources.facts import write_actions, write_partitions
from tracewell.sources.folders import drop
from tracewell.sources.tables import read_table

QUARANTINE = T.StructType(
    [
        *EVENTS.fields, T.StructField("quarantine_reason", T.StringType()), T.StructField("tries", T.IntegerType()),
        T.StructField("batch", T.StringType()),
    ]
)


def read_events(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 1_000) -> DataFrame:
    """A folder of event files as a stream, bounded per trigger."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def deduplicated(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop repeated deliveries of an event id while the watermark holds it.

    Watermarks need a zoned column; one is derived and dropped again.
    """
    return (
        events.withColumn("_at", F.col("ts").cast("timestamp"))
        .withWatermark("_at", delay)
        .dropDuplicatesWithinWatermark(["id"])
        .drop("_at")
    )


def quarantined(spark: SparkSession, root: str, log: Log | None = None) -> DataFrame:
    """Rows that wait, with the number of times that they were tried again."""
    rows = live(read_table(spark, f"{root}/quarantine", QUARANTINE), spark, root, "quarantine", log)
    return rows.withColumn("tries", F.coalesce("tries", F.lit(0)))


def chain(
    events: DataFrame,
    cfg: GateConfig = GateConfig(),
    rules: DataFrame | None = None,
    predicates=(),
    salt: str | None = None,
    before=None,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """``events`` with gate_reason and, for accepted rows, quarantine_reason. ``earlier``
    has the last changes of the batches before (see ``gate``)."""
    rows = events.withColumn("target", redact_command(F.col("type"), F.col("target")))
    if salt is not None:
        rows = rows.withColumn("target", pseudonymize_join(F.col("type"), F.col("target"), salt))
    gated = gate(rows, cfg, rules, list(predicates), before, earlier)
    # Without a type or a world no gate can judge a row: it waits in the quarantine.
    unknown = F.col("type").isNull() | F.col("world_key").isNull()
    gated = gated.withColumn("gate_reason", F.when(~unknown, F.col("gate_reason")))
    return gated.withColumn("quarantine_reason", F.when(F.col("gate_reason").isNull(), quarantine_reason()))


def _store(rows: DataFrame, root: str, commit: str, any_bad: bool) -> None:
    """Refused rows first: once the facts of a commit count, all of it is stored."""
    accepted = rows.filter(F.col("gate_reason").isNull()).drop("gate_reason")
    if any_bad:
        bad = accepted.filter(F.col("quarantine_reason").isNotNull())
        bad = bad.withColumn("tries", F.lit(0)).withColumn("batch", F.lit(commit))
        write_partitions(bad.select(*QUARANTINE.fieldNames()), f"{root}/quarantine", "batch")
    write_actions(accepted.filter(F.col("quarantine_reason").isNull()).drop("quarantine_reason"), root, commit)
    publish(rows.sparkSession, root, commit, "append")


_LAST = "_actor string, world_key string, x int, y int, z int, ts timestamp_ntz"


def _carried(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    """What the batch before left; only the very first batch has none."""
    return read_table(spark, f"{folder}/v={batch - 1}", T.StructType.fromDDL(_LAST), may_be_new=batch <= 0)


def process_batch(
    events: DataFrame, root: str, batch: int, cfg: GateConfig = GateConfig(), writer: str = "main",
    state: str | None = None, **chain_args
) -> None:
    """One micro-batch, as one commit of ``writer``: a batch that is run again after it
    was stored is left as it is, one that failed before is written whole. A batch without
    events stores nothing.

    With a ``state`` folder the last change of every actor and cell is handed from batch
    to batch, so a run of changes is coalesced across batches as it is within one.
    """
    spark, commit = events.sparkSession, commit_key(writer, batch)
    if is_published(spark, root, commit):
        return
    earlier = _carried(spark, state, batch) if state and cfg.strict else None
    # The gate takes changes and other rows apart: without this the batch is read, and the
    # deduplication of the stream run, once for each.
    events = events.persist()
    rows = chain(events, cfg, earlier=earlier, **chain_args).persist()
    try:
        # The one pass over the batch itself; all else reads what it left.
        bad = F.col("gate_reason").isNull() & F.col("quarantine_reason").isNotNull()
        newest, any_bad, total = rows.agg(F.max("ts"), F.max(bad), F.count("*")).first()
        if earlier is not None:
            changes = rows.filter(F.col("type") == ENTITY_CHANGE).filter(
                F.col("gate_reason").isNull() | (F.col("gate_reason") != "entity")
            )
            last = changes.select(coalesce_actor().alias("_actor"), "world_key", "x", "y", "z", "ts").unionByName(earlier)
            last = last.groupBy("_actor", "world_key", "x", "y", "z").agg(F.max("ts").alias("ts"))
            if newest is not None:
                last = last.filter(F.col("ts") > ts_lit(newest - cfg.coalesce_window))
            last.write.mode("overwrite").parquet(f"{state}/v={batch}")
            drop(spark, f"{state}/v={batch - 2}")
        if total:
            _store(rows, root, commit, bool(any_bad))
    finally:
        rows.unpersist()
        events.unpersist()


def _writer_of(spark: SparkSession, checkpoint: str) -> str:
    """The name of the stream that a checkpoint belongs to, made up when it is new: a
    fresh checkpoint starts its batches at 0 again and must not be taken for a retry."""
    folder = f"{checkpoint}/writer"
    known = read_table(spark, folder, T.StructType.fromDDL("writer string")).first()
    if known is None:
        name = f"stream-{uuid.uuid4().hex[:12]}"
        spark.range(1).select(F.lit(name).alias("writer")).coalesce(1).write.mode("overwrite").parquet(folder)
        return name
    return known.writer


def ingest_stream(
    events: DataFrame, root: str, checkpoint: str, trigger: dict | None = None, delay: str | None = "10 minutes", **gate_args
) -> StreamingQuery:
    """Start the ingest. Without a trigger it runs every five seconds. Repeated
    deliveries of an id are dropped within ``delay``; None leaves them."""
    writer = _writer_of(events.sparkSession, checkpoint)
    rows = events if delay is None else deduplicated(events, delay)

    def run(batch_df: DataFrame, batch_id: int) -> None:
        process_batch(batch_df, root, batch_id, writer=writer, state=f"{checkpoint}/coalescing", **gate_args)

    return (
        rows.writeStream.foreachBatch(run)
        .option("checkpointLocation", f"{checkpoint}/query")
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


def quarantine_replay(spark: SparkSession, root: str, repair=None, again: bool = False, **chain_args) -> DataFrame:
    """Try the quarantined rows once more, after an optional repair.

    Rows go through the chain of the ingest, with the same settings. In one commit those
    that now pass are stored, those that the gate refuses go, those that still fail stay
    quarantined as tried, and the partitions they all came from are retired: each row is
    at one place, whatever other rows share its id, and a call that is repeated finds
    nothing to do. Rows tried before are left alone unless ``again``; all that is still
    quarantined is returned. May run beside ingests and other replays.
    """

    def work(log: Log) -> None:
        waiting = quarantined(spark, root, log)
        wanted = waiting if again else waiting.filter(F.col("tries") == 0)
        wanted = checkpointed(wanted)
        if wanted.isEmpty():
            return
        commit = commit_key("replay")
        rows = wanted.drop("quarantine_reason", "batch")
        rows = chain(repair(rows) if repair is not None else rows, **chain_args).filter(F.col("gate_reason").isNull())
        rows = checkpointed(rows.drop("gate_reason"))
        bad = rows.filter(F.col("quarantine_reason").isNotNull()).withColumn("tries", F.col("tries") + 1)
        from_ = wanted.select("batch").distinct()
        # Rows tried before stand in the same partitions as others that are tried now.
        others = waiting.join(from_, "batch", "left_semi").filter(F.col("tries") > 0) if not again else waiting.limit(0)
        kept = others.drop("batch").unionByName(bad).withColumn("batch", F.lit(commit))
        write_partitions(kept.select(*QUARANTINE.fieldNames()), f"{root}/quarantine", "batch")
        fit = rows.filter(F.col("quarantine_reason").isNull()).drop("quarantine_reason", "tries")
        write_actions(fit, root, commit)
        retired = from_.select(F.lit("quarantine").alias("tab"), F.lit(None).cast("date").alias("dt"), "batch")
        publish(spark, root, commit, "replay", retired, log)
        drop_retired(spark, root, commit)

    repeated(spark, root, work)
    return quarantined(spark, root).drop("batch")
