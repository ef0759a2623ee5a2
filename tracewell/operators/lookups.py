"""Paging, counting, existence and the typed lookups.

All take facts with names resolved (``actor_name``, ``world_key``) and stay
narrow: they select the display columns, so payloads are never read.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.actions import history_line, previous_name
from tracewell.functions.predicates import ActionFilter
from tracewell.functions.timing import ts_lit
from tracewell.operators.spatial import facts_in_boxes
from tracewell.schema import (
    CHAT,
    COMMAND,
    JOIN,
    LEAVE,
    PAYLOAD_COLUMNS,
    RENAME,
    SIGN,
    type_attribute,
    types_in,
)

# Page size when none is asked for, cap of ``page_capped``, and seconds
# of the rate window.
DEFAULT_PAGE = 7
MAX_ROWS = 100_000
RATE_SECONDS = 30


def newest_first(*before: Column) -> list[Column]:
    return [*before, F.col("ts").desc(), F.col("id").desc()]


def display(actions: DataFrame) -> DataFrame:
    """Everything but the payload columns."""
    return actions.drop(*PAYLOAD_COLUMNS)


def page_newest(actions: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """One page, newest first: a bounded top-k per task, no full sort. Without a limit
    (None) all rows, in no order; 0 is the default page."""
    if limit is None:
        return actions
    limit = limit if limit > 0 else DEFAULT_PAGE
    return actions.orderBy(*newest_first()).offset(offset).limit(limit)


def page_capped(actions: DataFrame, limit: int, cap: int = MAX_ROWS, offset: int = 0) -> DataFrame:
    """A page of at most ``cap`` rows. ``truncated`` is set only if more than
    the cap was asked for and the cap was filled."""
    page = page_newest(actions, min(limit, cap), offset)
    if limit <= cap:
        return page.withColumn("truncated", F.lit(False))
    whole_page = Window.partitionBy(F.lit(0))  # the page is already one task of at most cap rows
    return page.withColumn("truncated", F.count("*").over(whole_page) == cap)


def page_summary(actions: DataFrame, page: int, page_size: int) -> DataFrame:
    size = max(1, page_size)
    return actions.agg(F.count("*").alias("total")).select(
        "total",
        F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long").alias("pages"),
        F.lit(max(1, page)).cast("int").alias("page"),
    )


def count_matching(actions: DataFrame) -> DataFrame:
    return actions.agg(F.count("*").alias("n"))


CELL = ["world_key", "x", "y", "z"]


def probes_with_actions(
    probes: DataFrame,
    actions: DataFrame,
    types: list[int] | None = None,
    window: timedelta | None = None,
    now: datetime | None = None,
    negate: bool = False,
) -> DataFrame:
    """Probes (actor_uuid and cell) that did, or did not, act at their cell.

    Facts are reduced to distinct keys before the join, so a cell with many
    rows arrives once. No window, or one of zero, is unbounded.
    """
    rows = actions
    if types:
        rows = rows.filter(F.col("type").isin(list(types)))
    if window is not None and window > timedelta(0):
        rows = rows.filter((F.col("ts") >= ts_lit(now - window)) & (F.col("ts") <= ts_lit(now)))
    keys = rows.select("actor_uuid", *CELL).distinct()
    return probes.join(keys, ["actor_uuid", *CELL], "left_anti" if negate else "left_semi")


def has_placed(probes, actions, window=None, now=None, negate=False) -> DataFrame:
    return probes_with_actions(probes, actions, [1], window, now, negate)


def has_removed(probes, actions, window=None, now=None, negate=False) -> DataFrame:
    return probes_with_actions(probes, actions, [2], window, now, negate)


def count_by_type(actions: DataFrame) -> DataFrame:
    return actions.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def user_last_n(actions: DataFrame, n: int) -> DataFrame:
    """Last ``n`` rows of every actor. Spark limits each group before the
    shuffle (a window group limit), so a busy actor sends n rows per task."""
    ranked = Window.partitionBy("user_id").orderBy(*newest_first())
    return actions.withColumn("rn", F.row_number().over(ranked)).filter(F.col("rn") <= n)


def region_unrolled(actions: DataFrame, world: str, x: int, z: int, radius: int, limit: int) -> DataFrame:
    flt = ActionFilter(world=world, x=x, z=z, radius=radius, rolled_back=False)
    return page_newest(flt.apply(actions), limit)


def event_rate(actions: DataFrame, now: datetime, seconds: int = RATE_SECONDS) -> DataFrame:
    """Rows per second by type, and over all (type null), in the last
    ``seconds`` whole seconds including the current one."""
    start = now.replace(microsecond=0) - timedelta(seconds=seconds - 1)
    end = now.replace(microsecond=0) + timedelta(seconds=1)
    recent = actions.filter((F.col("ts") >= ts_lit(start)) & (F.col("ts") < ts_lit(end)))
    counts = recent.groupBy("type").agg(F.count("*").alias("n"))
    total = counts.agg(F.lit(None).cast("int").alias("type"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    rate = (F.col("n") / F.lit(float(seconds))).alias("per_second")
    return counts.unionByName(total).select("type", F.col("n"), rate)


def _since(now: datetime, window: timedelta | None) -> datetime | None:
    return now - window if window is not None and window > timedelta(0) else None


def at_cell(actions: DataFrame, world: str, x: int, y: int, z: int, types, now, window) -> DataFrame:
    flt = ActionFilter(
        world=world, x=x, y=y, z=z, radius=0, types=tuple(types), since=_since(now, window)
    )
    return flt.apply(actions)


def block_lookup(actions, world, x, y, z, now, window=None, limit=None) -> DataFrame:
    rows = page_newest(at_cell(actions, world, x, y, z, types_in("BLOCK"), now, window), limit)
    return rows.select(
        "id", "ts", "actor_uuid", "actor_name", *CELL, "target", "meta",
        F.ltrim(type_attribute("token"), F.lit("+-")).alias("action"),
        "rolled_back", "source_tag", "old_block_state", "new_block_state",
    )


def signed_amount() -> Column:
    return F.when(type_attribute("direction") == "-", -F.col("amount")).otherwise(F.col("amount"))


def container_lookup(actions, world, x, y, z, now, window=None, limit=None) -> DataFrame:
    rows = page_newest(at_cell(actions, world, x, y, z, types_in("CONTAINER"), now, window), limit)
    return rows.select(
        "id", "ts", "actor_uuid", "actor_name", *CELL, "target", "meta",
        signed_amount().alias("delta"), "rolled_back", "source_tag",
    )


def _by_user(actions, uuid, types, now, window, limit) -> DataFrame:
    flt = ActionFilter(uuids=(uuid,), types=tuple(types), since=_since(now, window))
    return page_newest(flt.apply(actions), limit)


def message_lookup(actions, uuid, kind, now, window=None, limit=0) -> DataFrame:
    type_id = {"chat": CHAT, "command": COMMAND}[kind]
    return _by_user(actions, uuid, [type_id], now, window, limit).select(
        "id", "ts", "actor_uuid", "actor_name", F.col("target").alias("message"), F.lit(kind).alias("kind")
    )


def chat_lookup(actions, uuid, now, window=None, limit=0) -> DataFrame:
    return message_lookup(actions, uuid, "chat", now, window, limit)


def command_lookup(actions, uuid, now, window=None, limit=0) -> DataFrame:
    return message_lookup(actions, uuid, "command", now, window, limit)


def _item_rows(actions, uuid, types, now, window, limit) -> DataFrame:
    return _by_user(actions, uuid, types, now, window, limit).select(
        "id", "ts", "actor_uuid", "actor_name", *CELL, "target", "meta", "amount",
        F.ltrim(type_attribute("token"), F.lit("+-")).alias("action"), "source_tag",
    )


def item_lookup(actions, uuid, now, window=None, limit=0) -> DataFrame:
    return _item_rows(actions, uuid, types_in("ITEM"), now, window, limit)


def inventory_lookup(actions, uuid, now, window=None, limit=0) -> DataFrame:
    return _item_rows(actions, uuid, [27, 28], now, window, limit)


def session_lookup(actions, uuid, now, window=None, limit=0) -> DataFrame:
    return _by_user(actions, uuid, [JOIN, LEAVE], now, window, limit).select(
        "id", "ts", "actor_uuid", "actor_name", "world_key",
        F.when(F.col("type") == JOIN, "join").otherwise("leave").alias("direction"),
        "target",
    )


def username_lookup(actions, uuid, now, window=None, limit=0) -> DataFrame:
    return _by_user(actions, uuid, [RENAME], now, window, limit).select(
        "id", "ts", "actor_uuid", F.col("actor_name").alias("name"), previous_name(F.col("target")).alias("previous")
    )


def sign_lookup(actions, world, x, y, z, now, window=None, limit=None) -> DataFrame:
    rows = page_newest(at_cell(actions, world, x, y, z, [SIGN], now, window), limit)
    return rows.select(
        "id", "ts", "actor_uuid", "actor_name", *CELL, F.col("target").alias("line"), "source_tag",
        "sign_side", "sign_dye_color", "sign_waxed",
    )


# Reach of a "near" lookup and of an inspected cell.
NEAR_RADIUS, NEAR_AGE = 5, timedelta(hours=1)
INSPECT_RADIUS, INSPECT_AGE = 2, timedelta(days=30)


def near(actions, world, x, y, z, now, radius=NEAR_RADIUS, age=NEAR_AGE, limit=DEFAULT_PAGE) -> DataFrame:
    flt = ActionFilter(world=world, x=x, y=y, z=z, radius=radius, since=now - age)
    return page_newest(flt.apply(actions), limit)


def newest_of_each(found: DataFrame, key: str, limit: int | None) -> DataFrame:
    """The ``limit`` newest rows of each key. Every task keeps that many of a key before
    they leave it, so a crowded place costs ``limit`` rows a key and task."""
    if limit is None:
        return found
    order = Window.partitionBy(key).orderBy(*newest_first())
    return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n")


def newest_in_boxes(facts: DataFrame, boxes: DataFrame, key: str, limit: int | None, same_world: bool = True) -> DataFrame:
    """(box, fact) pairs as ``facts_in_boxes`` gives them, or the ``limit`` newest of each
    ``key``.

    A box that holds one row of a cell holds all of them, so no box takes more than the
    ``limit`` newest of a cell; and equal boxes have one answer. Cells are cut to ``limit``
    rows and boxes made distinct before they meet, so the pairs follow the occupied cells
    around distinct places and not the rows there.
    """
    if limit is None:
        return facts_in_boxes(facts, boxes, [key], same_world)
    world = ["world_key"] if same_world else []
    bounds = ["min_x", "max_x", "min_y", "max_y", "min_z", "max_z"]
    # Structs are equal if their fields are, nulls included: a box may have no bounds on y.
    boxes = boxes.withColumn("_place", F.struct(*world, *bounds))
    places = boxes.select("_place").distinct().select("_place", "_place.*")
    of_cells = Window.partitionBy(*world, "x", "y", "z").orderBy(*newest_first())
    newest = facts.withColumn("_n", F.row_number().over(of_cells)).filter(F.col("_n") <= limit).drop("_n")
    found = newest_of_each(facts_in_boxes(newest, places, ["_place"], same_world), "_place", limit)
    return newest_of_each(found.join(boxes.select("_place", key), "_place").drop("_place"), key, limit)


def near_points(actions, points, now, radius=NEAR_RADIUS, age=NEAR_AGE, limit: int | None = None) -> DataFrame:
    """Bulk form: every recent row around every point (``point_id``, world_key,
    x, y, z), or the ``limit`` newest around each."""
    boxes = points.select(
        "point_id", "world_key",
        *[(F.col(c) - radius).alias(f"min_{c}") for c in "xyz"],
        *[(F.col(c) + radius).alias(f"max_{c}") for c in "xyz"],
    )
    recent = actions.filter(F.col("ts") >= ts_lit(now - age))
    return newest_in_boxes(recent, boxes, "point_id", limit)


def within_regions(actions: DataFrame, boxes: DataFrame, viewer: str) -> DataFrame:
    """Rows inside the viewer's saved box, in any world; none saved, no rows.

    The one saved box is known when the query is planned, so it becomes a
    predicate that reaches the scan.
    """
    saved = boxes.filter(F.col("viewer") == viewer).select(
        "min_x", "min_y", "min_z", "max_x", "max_y", "max_z"
    ).limit(2).collect()
    if len(saved) > 1:
        raise ValueError(f"more than one box saved for {viewer}")
    if not saved:
        return actions.filter(F.lit(False))
    return ActionFilter(box=tuple(saved[0])).apply(actions)


def within_any_region(actions: DataFrame, boxes: DataFrame, limit: int | None = None) -> DataFrame:
    """Bulk form: (viewer, row) for every viewer with a saved box, or the ``limit``
    newest rows of each viewer."""
    return newest_in_boxes(actions, boxes, "viewer", limit, same_world=False)


def inspect_cell(actions, world, x, y, z, now, limit=DEFAULT_PAGE, radius=0, age=None) -> DataFrame:
    """History lines of one cell, newest first; the command form looks at
    radius 2 and thirty days."""
    flt = ActionFilter(world=world, x=x, y=y, z=z, radius=radius, since=_since(now, age))
    return page_newest(flt.apply(actions), max(1, limit)).select("id", "ts", history_line(now).alias("line"))


def history_lines(actions: DataFrame, now: datetime) -> DataFrame:
    return actions.select("id", "ts", history_line(now).alias("line"))


def pending_lookup(landing: DataFrame, stored: DataFrame, world, x, y, z) -> DataFrame:
    """Rows of a cell that have landed but are not in the main table yet."""
    cell = ActionFilter(world=world, x=x, y=y, z=z, radius=0)
    waiting = cell.apply(landing)
    done = cell.apply(stored).select("id").distinct()
    return waiting.join(done, "id", "left_anti")


def pending_and_stored(landing: DataFrame, stored: DataFrame, world, x, y, z) -> DataFrame:
    cell = ActionFilter(world=world, x=x, y=y, z=z, radius=0)
    waiting = pending_lookup(landing, stored, world, x, y, z).withColumn("pending", F.lit(True))
    return waiting.unionByName(cell.apply(stored).withColumn("pending", F.lit(False)))
