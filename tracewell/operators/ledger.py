"""Rollback batches as an append-only ledger.

Facts are never updated in place. Applied steps are rows of a bridge table, and
a row's effective flag is decided by the newest batch that touched it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions.affected import parse_affected
from tracewell.functions.predicates import ActionFilter, filter_from_json
from tracewell.functions.timing import ts_lit
from tracewell.operators.lookups import newest_first
from tracewell.operators.rollback import RESTORE, ROLLBACK, is_rollbackable, newest_per_position
from tracewell.schema import BATCH_ACTIONS, BATCHES, CONSOLE_ACTOR, EXPLOSION, KILL
from tracewell.sources.tables import read_table

# Fixed value: operations kept per actor.
UNDO_DEPTH = 20

OPENED, CLOSED = "opened", "closed"
PLANNED, APPLIED = "planned", "applied"


def effective_flags(actions: DataFrame, batches: DataFrame, bridge: DataFrame) -> DataFrame:
    """``rolled_back`` after every applied batch: the last batch per row wins,
    rows no batch touched keep their own flag.

    ``batches`` has batch_id, mode; ``bridge`` batch_id, action_id. The bridge
    is reduced to one row per action before it meets the facts.
    """
    return _with_flags(actions, _applied_flags(batches, bridge))


def _applied_flags(batches: DataFrame, bridge: DataFrame) -> DataFrame:
    modes = batches.select("batch_id", "mode").distinct()
    return (
        bridge.join(modes, "batch_id")
        .groupBy(F.col("action_id").alias("id"))
        .agg(F.max_by((F.col("mode") == ROLLBACK).cast("int"), "batch_id").alias("_flag"))
    )


def _with_flags(actions: DataFrame, flags: DataFrame) -> DataFrame:
    return (
        actions.join(flags, "id", "left")
        .withColumn("rolled_back", F.coalesce("_flag", "rolled_back"))
        .drop("_flag")
    )


def incomplete_batches(batches: DataFrame) -> DataFrame:
    """Opened and never closed, oldest first. ``status`` rows are append-only."""
    closed = batches.filter(F.col("status") == CLOSED).select("batch_id").distinct()
    return batches.filter(F.col("status") == OPENED).join(closed, "batch_id", "left_anti").orderBy("batch_id")


def incomplete_actions(batches: DataFrame, bridge: DataFrame) -> DataFrame:
    """(batch, action) rows of incomplete batches, in batch and action order."""
    pending = incomplete_batches(batches).select("batch_id")
    return bridge.join(pending, "batch_id", "left_semi").select("batch_id", "action_id").orderBy("batch_id", "action_id")


def batch_rows(actions: DataFrame, bridge: DataFrame, batch_id: int) -> DataFrame:
    ids = bridge.filter(F.col("batch_id") == batch_id).select(F.col("action_id").alias("id")).distinct()
    return actions.join(ids, "id", "left_semi")


def _actor() -> F.Column:
    return F.coalesce(F.col("actor_uuid"), F.lit(CONSOLE_ACTOR))


def undo_history(batches: DataFrame, depth: int = UNDO_DEPTH) -> DataFrame:
    """Last operations of every actor; the console counts as one actor."""
    ranked = Window.partitionBy("actor").orderBy(F.col("batch_id").desc())
    return (
        batches.withColumn("actor", _actor())
        .withColumn("rn", F.row_number().over(ranked))
        .filter(F.col("rn") <= depth)
    )


def undoable(batches: DataFrame, actor: str | None) -> DataFrame:
    """The actor's batches that an undo may still revert: an undo takes the batch it
    reverts off the stack and is not put on it."""
    mine = batches.filter(_actor() == (actor or CONSOLE_ACTOR))
    if "undoes" not in batches.columns:
        return mine
    done = mine.filter(F.col("undoes").isNotNull()).select(F.col("undoes").alias("batch_id")).distinct()
    return mine.filter(F.col("undoes").isNull()).join(done, "batch_id", "left_anti")


def undo_plan(
    actions: DataFrame, batches: DataFrame, bridge: DataFrame, actor: str | None, flt: ActionFilter = ActionFilter()
) -> DataFrame:
    """Plan that reverts the actor's newest batch that is not undone yet: exactly its
    rows, in the other mode, still under the filter the batch was made with.

    ``actions`` carries effective flags. The newest batch is an aggregate, and
    the mode it implies is compared with each row's flag inside the join, so
    nothing is fetched to the driver.
    """
    newest = (
        undoable(batches, actor)
        .groupBy()
        .agg(F.max("batch_id").alias("batch_id"), F.max_by("mode", "batch_id").alias("mode"))
    )
    ids = bridge.join(newest, "batch_id").select(F.col("action_id").alias("id"), "mode").distinct()
    wanted = F.when(F.col("mode") == ROLLBACK, 1).otherwise(0)  # a rollback is undone by restoring
    rows = flt.but(rolled_back=None).apply(actions).join(ids, "id")
    rows = rows.filter((F.col("rolled_back") == wanted) & is_rollbackable())
    inverse = F.when(F.col("mode") == ROLLBACK, F.lit(RESTORE)).otherwise(F.lit(ROLLBACK))
    return newest_per_position(rows.withColumn("mode", inverse)).orderBy(*newest_first())


class Ledger:
    """The batch tables under one folder.

    Every write replaces the partition of its own batch and step, so a retried
    job leaves the same rows. The bridge is written before the batch row: a
    batch that can be seen has all its actions.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.batches_path = f"{root}/rollback_batches"
        self.bridge_path = f"{root}/rollback_batch_actions"

    def batches(self) -> DataFrame:
        return read_table(self.spark, self.batches_path, BATCHES)

    def bridge(self, step: str | None = None) -> DataFrame:
        rows = read_table(self.spark, self.bridge_path, BATCH_ACTIONS)
        return rows if step is None else rows.filter(F.col("step") == step)

    def _write_bridge(self, ids: DataFrame, batch_id: int, step: str) -> None:
        (
            ids.select(F.col("id").alias("action_id"))
            .distinct()
            .withColumn("batch_id", F.lit(batch_id).cast("long"))
            .withColumn("step", F.lit(step))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id", "step")
            .parquet(self.bridge_path)
        )

    def _write_batch(self, batch_id, ts, actor, mode, affected, filter_json, status, undoes) -> None:
        row = self.spark.range(1).select(
            ts_lit(ts).alias("ts"),
            F.lit(actor).cast("string").alias("actor_uuid"),
            F.lit(mode).alias("mode"),
            F.lit(affected).cast("long").alias("affected"),
            F.lit(filter_json).cast("string").alias("filter_json"),
            F.lit(undoes).cast("long").alias("undoes"),
            F.lit(status).alias("status"),
            F.lit(batch_id).cast("long").alias("batch_id"),
        )
        (
            row.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("status", "batch_id")
            .parquet(self.batches_path)
        )

    def next_id(self) -> int:
        return (self.batches().agg(F.max("batch_id")).first()[0] or 0) + 1

    def open_batch(
        self, plan_rows: DataFrame, mode: int, actor: str | None, ts: datetime, flt: ActionFilter, batch_id: int,
        undoes: int | None = None,
    ) -> int:
        """Record a plan before anything is applied; returns its size. ``undoes`` names the
        batch that an undo reverts."""
        self._write_bridge(plan_rows, batch_id, PLANNED)
        planned = self.bridge(PLANNED).filter(F.col("batch_id") == batch_id).count()
        self._write_batch(batch_id, ts, actor, mode, planned, flt.to_json(), OPENED, undoes)
        return planned

    def close_batch(self, results: DataFrame, batch_id: int, ts: datetime) -> bool:
        """Record the outcome of every step: ``results`` has id, ok. Applied
        rows are flagged in any case; the batch is closed only if every planned
        row was applied, else it stays open for recovery."""
        self._write_bridge(results.filter("ok").select("id"), batch_id, APPLIED)
        mine = self.bridge().filter(F.col("batch_id") == batch_id)
        applied = mine.filter(F.col("step") == APPLIED).select("action_id")
        missing = mine.filter(F.col("step") == PLANNED).join(applied, "action_id", "left_anti")
        if missing.limit(1).count():
            return False
        opened = self.batches().filter((F.col("batch_id") == batch_id) & (F.col("status") == OPENED)).first()
        self._write_batch(batch_id, ts, opened.actor_uuid, opened.mode, applied.count(), opened.filter_json, CLOSED, opened.undoes)
        return True

    def plan_undo(self, actions: DataFrame, actor: str | None) -> tuple[int, ActionFilter, DataFrame] | None:
        """(batch, its filter, plan) of the actor's next undo, or None: the newest closed
        batch not undone yet, under the filter stored with it. One row comes to the driver."""
        closed = self.batches().filter(F.col("status") == CLOSED)
        newest = undoable(closed, actor).orderBy(F.col("batch_id").desc()).first()
        if newest is None:
            return None
        flt = filter_from_json(newest.filter_json)
        return newest.batch_id, flt, undo_plan(actions, closed, self.bridge(APPLIED), actor, flt)

    def effective(self, actions: DataFrame) -> DataFrame:
        """Facts under all applied steps so far; how the flags are joined is left to their
        size at run time."""
        return _with_flags(actions, _applied_flags(self.batches(), self.bridge(APPLIED)))


def step_results(plan_rows: DataFrame, mode: int, failed_ids: DataFrame | None = None) -> DataFrame:
    """Outcome per planned row. Explosions without a readable block list and
    restored kills cannot be carried out, nor can rows listed as failed."""
    skipped = (F.col("type") == EXPLOSION) & (F.size(parse_affected(F.col("target"))) == 0)
    if mode == RESTORE:
        skipped = skipped | (F.col("type") == KILL)
    rows = plan_rows.select("id", (~skipped).alias("ok"))
    if failed_ids is None:
        return rows
    bad = failed_ids.select("id").distinct().withColumn("_bad", F.lit(True))
    return rows.join(bad, "id", "left").select("id", (F.col("ok") & F.col("_bad").isNull()).alias("ok"))
