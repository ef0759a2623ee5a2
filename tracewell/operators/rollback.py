"""Rollback, restore and undo plans, and the mutations they turn into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.actions import has_payload
from tracewell.functions.affected import parse_affected
from tracewell.functions.predicates import ActionFilter, guard_time, all_of
from tracewell.functions.timing import micros
from tracewell.operators.lookups import CELL, newest_first
from tracewell.schema import AIR, ENTITY_CHANGE, EXPLOSION, KILL, MUTATION_COLUMNS, NEWEST_WINS, ROLLBACKABLE, type_is

ROLLBACK, RESTORE = 0, 1

# How far an explosion reaches, and the reference limits of a plan.
EXPLOSION_REACH = 16
MAX_SCANNED, MAX_PLANNED = 100_000, 50_000

# What undoing or redoing a type does to the world.
CLEARED_ON_ROLLBACK = (1, 16, 23, 36, 37, 40)
REBUILT_ON_ROLLBACK = (2, 15, 17, 24, 25)
DEPOSITS = (3, 29)
WITHDRAWALS = (4, 30)
HANGING_PLACED, HANGING_BROKEN = 34, 35


def is_rollbackable() -> Column:
    return type_is(ROLLBACKABLE)


def split_rollbackable(actions: DataFrame) -> DataFrame:
    """Mark rows a plan can act on; the rest counts as skipped."""
    return actions.withColumn("rollbackable", is_rollbackable())


def newest_per_position(actions: DataFrame) -> DataFrame:
    """Keep the newest block-state row per cell and every other row.

    Only rows that can be superseded are shuffled and sorted; the others go past.
    The ``rank <= 1`` filter is applied per task before the shuffle (window group
    limit): a cell with a third of all rows sends one row per task.
    """
    contest = F.coalesce(type_is(NEWEST_WINS), F.lit(False))
    ranked = Window.partitionBy(*CELL).orderBy(*newest_first())
    newest = actions.filter(contest).withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= 1)
    return newest.drop("_rank").unionByName(actions.filter(~contest))


def _candidates(actions: DataFrame, flt: ActionFilter, mode: int) -> DataFrame:
    wanted = flt.but(rolled_back=(mode == RESTORE))
    return guard_time(wanted).apply(actions)


def scanned_rows(actions: DataFrame, flt: ActionFilter, mode: int) -> DataFrame:
    """Rows that a plan looks at: those in scope whose flag the plan would turn. Rows that
    are in the wanted state already are never read and count towards no limit."""
    return _candidates(actions, flt, mode)


def plan(actions: DataFrame, flt: ActionFilter, mode: int) -> DataFrame:
    """Rows to act on, newest first in both directions."""
    rows = _candidates(actions, flt, mode).filter(is_rollbackable())
    return newest_per_position(rows).orderBy(*newest_first())


def plan_rollback(actions: DataFrame, flt: ActionFilter) -> DataFrame:
    return plan(actions, flt, ROLLBACK)


def plan_restore(actions: DataFrame, flt: ActionFilter) -> DataFrame:
    return plan(actions, flt, RESTORE)


def plan_with_explosions(actions: DataFrame, flt: ActionFilter, mode: int, reach: int = EXPLOSION_REACH) -> DataFrame:
    """A plan that also takes explosions centred outside the box whose affected
    blocks reach into it. They follow the primary rows (``plan_part`` 1).

    Both parts come from one scan of the widened box.
    """
    if not (flt.has_finite_radius and flt.admits(EXPLOSION)):
        return plan(actions, flt, mode).withColumn("plan_part", F.lit(0))
    flt = guard_time(flt.but(rolled_back=(mode == RESTORE)))
    primary = flt.spatial()
    if flt.types:
        primary.append(type_is(flt.type_ids()))
    outside = flt.widened_explosions(reach)
    scan = flt.but(radius=flt.radius + reach, box=None, types=()).apply(actions)
    rows = (
        scan.filter(is_rollbackable())
        .filter(all_of(primary) | outside)
        .withColumn("plan_part", F.when(outside, 1).otherwise(0))
    )
    return newest_per_position(rows).orderBy(*newest_first(F.col("plan_part").asc()))


class PlanTooLarge(ValueError):
    pass


def check_limits(
    scanned: DataFrame, planned: DataFrame, max_scanned: int | None = None, max_planned: int | None = None
) -> None:
    """Refuse plans over a limit. Off by default. Rows are counted by partial aggregates, for
    which a plan is not sorted: a limit would move up to its rows from every task to one."""
    for what, df, cap in (("scanned", scanned, max_scanned), ("planned", planned, max_planned)):
        if cap is not None and df.count() > cap:
            raise PlanTooLarge(f"more than {cap} rows {what}")


def preview(actions: DataFrame, flt: ActionFilter, mode: int) -> DataFrame:
    """One row: how many rows would be planned, skipped and superseded."""
    rows = split_rollbackable(_candidates(actions, flt, mode))
    kept = newest_per_position(rows.select("id", "ts", "type", *CELL, "rollbackable").filter("rollbackable"))
    counted = rows.select("rollbackable", F.lit(False).alias("planned")).unionByName(
        kept.select(F.lit(True).alias("rollbackable"), F.lit(True).alias("planned"))
    )
    return counted.agg(
        F.count_if("planned").alias("planned"),
        F.count_if(~F.col("planned") & ~F.col("rollbackable")).alias("skipped"),
        F.count_if(~F.col("planned")).alias("scanned"),
    )


def _step_key() -> Column:
    """Execution order of plan rows as a sortable value, no global numbering."""
    return F.struct(F.col("plan_part").alias("part"), (-micros(F.col("ts"))).alias("age"), (-F.col("id")).alias("rid"))


def _with_part(rows: DataFrame) -> DataFrame:
    return rows if "plan_part" in rows.columns else rows.withColumn("plan_part", F.lit(0))


def _with_payload_columns(rows: DataFrame) -> DataFrame:
    """Plans over display columns simply carry no payload."""
    for name in ("old_block_state", "new_block_state"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    for name in ("block_entity_nbt", "item_nbt", "entity_nbt"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("binary"))
    return rows


def _mutations(rows: DataFrame, verb, obj, meta, state, payload, amount) -> DataFrame:
    return rows.select(
        F.col("id").alias("action_id"),
        "step",
        verb.alias("verb"),
        "world_key", "x", "y", "z",
        obj.alias("object"),
        amount.alias("amount"),
        meta.alias("meta"),
        state.alias("state"),
        payload.alias("payload"),
    )


def _exploded_mutations(rows: DataFrame, rebuild: bool, sidecar: DataFrame | None) -> DataFrame:
    blocks = rows.filter(F.col("type") == EXPLOSION).select(
        "id", "step", "world_key", F.posexplode(parse_affected(F.col("target"))).alias("pos", "e")
    )
    blocks = blocks.select(
        "id",
        F.struct("step.part", "step.age", "step.rid", F.col("pos")).alias("step"),
        "world_key",
        F.col("e.x").alias("x"), F.col("e.y").alias("y"), F.col("e.z").alias("z"),
        F.col("e.block").alias("block"), F.col("e.meta").alias("meta"),
    )
    none = F.lit(None)
    if not rebuild:
        return _mutations(
            blocks, F.lit("set"), F.lit(AIR), none.cast("string"), none.cast("string"), none.cast("binary"),
            none.cast("int"),
        )
    if sidecar is None:
        return _mutations(
            blocks, F.lit("set"), F.col("block"), F.col("meta"), none.cast("string"), none.cast("binary"),
            none.cast("int"),
        )
    extra = sidecar.select(
        "id", "x", "y", "z", F.col("meta").alias("_state"), F.col("payload").alias("_payload"), F.lit(True).alias("_rich")
    )
    merged = blocks.join(extra, ["id", "x", "y", "z"], "left")
    return _mutations(
        merged, F.lit("set"), F.col("block"), F.when(F.col("_rich").isNull(), F.col("meta")),
        F.coalesce("_state", F.when(F.col("_rich"), F.col("meta"))), F.col("_payload"), none.cast("int"),
    )


def _plain_rows(plan_rows: DataFrame) -> DataFrame:
    rows = _with_payload_columns(_with_part(plan_rows)).withColumn("step", _step_key())
    return rows.withColumn("step", F.struct("step.part", "step.age", "step.rid", F.lit(0).alias("pos")))


def inverse_mutations(plan_rows: DataFrame, sidecar: DataFrame | None = None) -> DataFrame:
    """What undoes each planned row, one row per world change.

    ``step`` sorts in execution order. ``sidecar`` (id, x, y, z, meta, payload)
    adds state to the blocks of an explosion.
    """
    t, none = F.col("type"), F.lit(None)
    rows = _plain_rows(plan_rows)
    plain = rows.filter(is_rollbackable() & (t != EXPLOSION))
    cleared, rebuilt = type_is(CLEARED_ON_ROLLBACK), type_is((*REBUILT_ON_ROLLBACK, ENTITY_CHANGE))
    moved = type_is((*DEPOSITS, *WITHDRAWALS))
    respawned = t.isin(KILL, HANGING_BROKEN)
    verb = (
        F.when(cleared | rebuilt, "set")
        .when(t.isin(*DEPOSITS), "remove_item")
        .when(t.isin(*WITHDRAWALS), "give_item")
        .when(respawned, "respawn")
        .when(t == HANGING_PLACED, "remove_entity")
    )
    keeps_meta = t.isin(*REBUILT_ON_ROLLBACK, *WITHDRAWALS) | respawned
    payload = (
        F.when(rebuilt, F.col("block_entity_nbt"))
        .when(t.isin(*WITHDRAWALS), F.col("item_nbt"))
        .when(respawned, F.col("entity_nbt"))
    )
    single = _mutations(
        plain,
        verb,
        F.when(cleared, F.lit(AIR)).otherwise(F.col("target")),
        F.when(keeps_meta, F.col("meta")),
        F.when(rebuilt & has_payload(), F.col("old_block_state")),
        payload,
        F.when(moved, F.greatest(F.lit(1), F.col("amount"))).otherwise(none.cast("int")),
    )
    return single.unionByName(_exploded_mutations(rows, True, sidecar))


def forward_mutations(plan_rows: DataFrame) -> DataFrame:
    """What redoes each planned row. A kill cannot be redone: its row does nothing, and
    ``step_results`` reports it as not carried out."""
    t, none = F.col("type"), F.lit(None)
    rows = _plain_rows(plan_rows)
    plain = rows.filter(is_rollbackable() & (t != EXPLOSION))
    replaced, removed = type_is(CLEARED_ON_ROLLBACK), type_is(REBUILT_ON_ROLLBACK)
    changed = t == ENTITY_CHANGE
    moved = type_is((*DEPOSITS, *WITHDRAWALS))
    verb = (
        F.when(replaced | removed | changed, "set")
        .when(t.isin(*DEPOSITS), "give_item")
        .when(t.isin(*WITHDRAWALS), "remove_item")
        .when(t == KILL, "none")
        .when(t == HANGING_PLACED, "respawn")
        .when(t == HANGING_BROKEN, "remove_entity")
    )
    obj = (
        F.when(removed, F.lit(AIR))
        .when(changed, F.coalesce(F.col("meta"), F.lit(AIR)))
        .otherwise(F.col("target"))
    )
    keeps_meta = replaced | t.isin(*DEPOSITS, HANGING_PLACED)
    payload = (
        F.when(replaced | changed, F.col("block_entity_nbt"))
        .when(t.isin(*DEPOSITS), F.col("item_nbt"))
        .when(t == HANGING_PLACED, F.col("entity_nbt"))
    )
    single = _mutations(
        plain,
        verb,
        obj,
        F.when(keeps_meta, F.col("meta")),
        F.when((replaced | changed) & has_payload(), F.col("new_block_state")),
        payload,
        F.when(moved, F.greatest(F.lit(1), F.col("amount"))).otherwise(none.cast("int")),
    )
    return single.unionByName(_exploded_mutations(rows, False, None))


def apply_mutations(state: DataFrame, mutations: DataFrame) -> DataFrame:
    """World state (cell -> block) after the set-verbs of a mutation set; the
    last executed change of a cell wins. Both sides are reduced to one row per
    cell before the join."""
    last = (
        mutations.filter(F.col("verb") == "set")
        .groupBy(*CELL)
        .agg(F.max_by("object", "step").alias("_new"))
    )
    return (
        state.select(*CELL, "block")
        .join(last, CELL, "full_outer")
        .select(*CELL, F.coalesce("_new", "block").alias("block"))
    )


def foreach_mutation(mutations: DataFrame, apply_rows) -> None:
    """Hand each task's mutation rows to a callback, in execution order within
    a cell. Rows of one cell stay together."""
    columns = list(MUTATION_COLUMNS)
    ordered = mutations.select(*columns).repartition(*CELL).sortWithinPartitions("step")
    ordered.foreachPartition(apply_rows)


def mutation_outcomes(mutations: DataFrame, apply_batches, schema) -> DataFrame:
    """What a callback reports for the mutations: it gets a task's rows as an iterator
    of pandas frames, cell after cell and in execution order within a cell, and yields
    frames of ``schema``. A cell is never split over tasks, however many rows it has;
    it may go on in the next frame.
    """
    ordered = mutations.repartition(*CELL).sortWithinPartitions(*CELL, "step")
    return ordered.select(*(c for c in MUTATION_COLUMNS if c != "step")).mapInPandas(apply_batches, schema)
