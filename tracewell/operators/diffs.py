"""Actions from observed states: what changed between two looks."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.blocks import block_category, is_hot_category, natural_change
from tracewell.functions.timing import interval, segment_of
from tracewell.operators.attribution import _last_record
from tracewell.operators.segments import with_previous
from tracewell.schema import AIR

# Limits of the watchers.
CONTAINER_EXPIRY, MAX_SLOTS = timedelta(minutes=5), 216
CLICK_WINDOW = timedelta(milliseconds=500)
MAX_REGION_CELLS = 32_768
HOPPER_SLOTS = 5

CELL = ["world_key", "x", "y", "z"]
DAY = timedelta(days=1)


def pair_sessions(
    opens: DataFrame, closes: DataFrame, session: list[str], expiry: timedelta | None = CONTAINER_EXPIRY,
    span: timedelta = DAY,
) -> DataFrame:
    """session columns, opened, closed, before, after: which open each close ends.

    Both sides have the session columns, ts, id and ``slots``. The newest open of a
    session counts, a close takes it, and it must follow within ``expiry``: so a close
    pairs with the event right before it if that is an open. At one instant opens come
    before closes. A long session key is cut into stretches of ``span``.
    """
    columns = [*session, "ts", "id", "slots"]
    events = opens.select(*columns, F.lit(0).alias("closing")).unionByName(
        closes.select(*columns, F.lit(1).alias("closing"))
    )
    pairs = with_previous(events, session, ["ts", "closing", "id"], ["closing", "ts", "slots"], span)
    pairs = pairs.filter((F.col("closing") == 1) & F.col("has_prev") & (F.col("prev_closing") == 0))
    if expiry is not None:
        pairs = pairs.filter(F.col("ts") - F.col("prev_ts") <= interval(expiry))
    return pairs.select(
        *session, F.col("prev_ts").alias("opened"), F.col("ts").alias("closed"),
        F.col("prev_slots").alias("before"), F.col("slots").alias("after"),
    )


def slot_changes(pairs: DataFrame, keys: list[str], max_slots: int | None = None) -> DataFrame:
    """keys, slot, item, type, amount of ``pairs`` (keys, before, after: arrays of slot,
    item, count): deposits (3) and withdrawals (4). A slot that swapped its item nets
    under the old one. Slots from ``max_slots`` on are left out if it is given."""

    def full(s: Column) -> Column:
        held = s["item"].isNotNull() & (s["count"] > 0)
        return held if max_slots is None else held & (s["slot"] < max_slots)

    def as_map(c: str) -> Column:
        filled = F.transform(F.filter(c, full), lambda s: F.struct(s["slot"], F.struct(s["item"], s["count"])))
        return F.map_from_entries(filled)

    rows = pairs.select(*keys, as_map("before").alias("b"), as_map("after").alias("a"))
    slots = rows.select(*keys, "a", "b", F.explode(F.array_union(F.map_keys("a"), F.map_keys("b"))).alias("slot"))
    was, now = F.try_element_at("b", F.col("slot")), F.try_element_at("a", F.col("slot"))
    delta = F.coalesce(now["count"], F.lit(0)) - F.coalesce(was["count"], F.lit(0))
    return (
        slots.select(*keys, "slot", F.coalesce(was["item"], now["item"]).alias("item"), delta.alias("delta"))
        .filter(F.col("delta") != 0)
        .select(
            *keys, "slot", "item", F.when(F.col("delta") > 0, 3).otherwise(4).alias("type"),
            F.abs("delta").cast("int").alias("amount"),
        )
    )


def container_sessions(
    opens: DataFrame, closes: DataFrame, session: list[str], expiry: timedelta | None = CONTAINER_EXPIRY,
    max_slots: int | None = None,
) -> DataFrame:
    """Changes of each session from its open to its close: snapshots are one row each
    (see ``pair_sessions``), with all slots."""
    return slot_changes(pair_sessions(opens, closes, session, expiry), [*session, "closed"], max_slots)


def diff_containers(
    opens: DataFrame, closes: DataFrame, session: list[str], expiry: timedelta | None = CONTAINER_EXPIRY,
    max_slots: int | None = None,
) -> DataFrame:
    """Deposits (3) and withdrawals (4) per session and slot, for sessions of one open and
    one close that are given slot by slot.

    Both sides have the session columns, slot, item, count (no item: null or
    0) and ``at``, the time of the look. A slot that swapped its item nets
    under the old one. Only sessions with both looks, the close after the open and
    at most ``expiry`` later, are compared. Sessions that open several times are for
    ``container_sessions``.
    """
    def side(df: DataFrame, prefix: str) -> DataFrame:
        filled = F.col("item").isNotNull() & (F.coalesce("count", F.lit(0)) > 0)
        seen = df if max_slots is None else df.filter(F.col("slot") < max_slots)
        return seen.select(
            *session, "slot",
            F.when(filled, F.col("item")).alias(f"{prefix}_item"),
            F.when(filled, F.col("count")).otherwise(0).alias(f"{prefix}_count"),
        )

    def sessions(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*session).agg(F.max("at").alias(name))

    paired = sessions(opens, "opened").join(sessions(closes, "closed"), session)
    paired = paired.filter(F.col("closed") >= F.col("opened"))
    if expiry is not None:
        paired = paired.filter(F.col("closed") - F.col("opened") <= interval(expiry))
    delta = F.coalesce("after_count", F.lit(0)) - F.coalesce("before_count", F.lit(0))
    return (
        side(opens, "before")
        .join(side(closes, "after"), [*session, "slot"], "full_outer")
        .join(paired, session, "left_semi")
        .select(*session, "slot", F.coalesce("before_item", "after_item").alias("item"), delta.alias("delta"))
        .filter(F.col("item").isNotNull() & (F.col("delta") != 0))
        .select(
            *session, "slot", "item",
            F.when(F.col("delta") > 0, 3).otherwise(4).alias("type"),
            F.abs("delta").cast("int").alias("amount"),
        )
    )


def _slot_item(slot: Column) -> Column:
    return F.substring_index(slot, "|", 1)


def _slot_count(slot: Column) -> Column:
    return F.coalesce(F.substring_index(slot, "|", -1).try_cast("int"), F.lit(0))


def diff_hopper_samples(samples: DataFrame, span: timedelta = DAY) -> DataFrame:
    """Pushes (29) and pulls (30) between consecutive samples of a hopper.

    ``samples``: cell, ts, id, slots (array of ``item|count`` or null). Silent
    while the sample before is missing or had only empty slots. An exchanged
    item is a pull of the old and a push of the new one.
    """
    pairs = with_previous(samples, CELL, ["ts", "id"], ["slots"], span)
    seen = F.coalesce(F.exists("prev_slots", lambda s: s.isNotNull()), F.lit(False))
    slots = pairs.filter(F.col("has_prev") & seen).select(
        "id", "ts", *CELL, F.posexplode(F.arrays_zip("prev_slots", "slots")).alias("slot", "s")
    )
    prev, cur = F.col("s.prev_slots"), F.col("s.slots")
    delta = F.when(cur.isNull(), 0).otherwise(_slot_count(cur)) - F.when(prev.isNull(), 0).otherwise(_slot_count(prev))
    item = _slot_item(F.coalesce(cur, prev))

    def move(type_id: int, what: Column, amount: Column) -> Column:
        return F.struct(F.lit(type_id).alias("type"), what.alias("item"), amount.cast("int").alias("amount"))

    swapped = prev.isNotNull() & cur.isNotNull() & (_slot_item(prev) != _slot_item(cur))
    moves = (
        F.when(swapped, F.array(
            move(30, _slot_item(prev), _slot_count(prev)), move(29, _slot_item(cur), _slot_count(cur)),
        ))
        .when(delta > 0, F.array(move(29, item, delta)))
        .when(delta < 0, F.array(move(30, item, -delta)))
    )
    return (
        slots.filter(~prev.eqNullSafe(cur))
        .select("id", "ts", *CELL, "slot", F.explode(moves).alias("m"))
        .select("id", "ts", *CELL, "slot", "m.*")
    )


def small_regions(regions: DataFrame, most: int = MAX_REGION_CELLS) -> DataFrame:
    """Regions of at most ``most`` cells (min_x .. max_z): a filter for callers that want
    one, ``diff_regions`` itself has no limit."""
    volume = F.lit(1).cast("long")
    for c in "xyz":
        volume = volume * (F.col(f"max_{c}") - F.col(f"min_{c}") + 1).cast("long")
    return regions.filter((volume > 0) & (volume <= most))


def diff_regions(before: DataFrame, after: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Breaks (2) and places (1) between two states (keys, cell, block); an
    absent cell is air."""
    cell = [*keys, *CELL]
    both = (
        before.select(*cell, F.col("block").alias("was"))
        .join(after.select(*cell, F.col("block").alias("now")), cell, "full_outer")
        .select(*cell, F.coalesce("was", F.lit(AIR)).alias("was"), F.coalesce("now", F.lit(AIR)).alias("now"))
        .filter(F.col("was") != F.col("now"))
    )
    change = lambda t, b: F.struct(F.lit(t).alias("type"), F.col(b).alias("block"))
    rows = F.filter(F.array(change(2, "was"), change(1, "now")), lambda c: c["block"] != AIR)
    return both.select(*cell, F.explode(rows).alias("c")).select(*cell, "c.type", "c.block")


def _remembered(rows: DataFrame, keys: list[str], order: list[str], always: str, category: str) -> DataFrame:
    """Which rows the watcher remembers, within ``keys``.

    An ``always`` row is remembered; any other row only if what is remembered
    has a category. So from the last always row on, rows are remembered up to
    and including the first without a category. Adds ``_rn``, ``_hot`` (row
    number of the last always row), ``_null`` (of the last row before this one
    without a category) and ``_kept``.
    """
    timeline = Window.partitionBy(*keys).orderBy(*order)
    until_here = timeline.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = timeline.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_rn", F.row_number().over(timeline))
    blank = F.when(F.col(category).isNull(), F.col("_rn"))
    rows = rows.withColumns({
        "_hot": F.max(F.when(F.col(always), F.col("_rn"))).over(until_here), "_null": F.max(blank).over(earlier),
    })
    lasting = F.col("_hot").isNotNull() & (F.coalesce("_null", F.lit(0)) < F.col("_hot"))
    return rows.withColumn("_kept", F.col(always) | lasting)


def classify_block_changes(observations: DataFrame, span: timedelta = DAY) -> DataFrame:
    """Natural changes (burn, ignite, fade, form, spread, decay) of watched
    cells. ``observations``: cell, ts, id, block.

    A cell is watched from its first "hot" block on. What a cell remembers can
    be arbitrarily old, so the window runs per (cell, segment) and each
    segment is told what its cell remembered when it began; that comes from a
    second window over one summary row per cell and segment.
    """
    part, order = [*CELL, "_seg"], ["ts", "id"]
    category = block_category(F.col("block"))
    rows = observations.withColumns({"_seg": segment_of(F.col("ts"), span), "_cat": category})
    rows = _remembered(rows.withColumn("_always", is_hot_category(F.col("_cat"))), part, order, "_always", "_cat")
    timeline = Window.partitionBy(*part).orderBy(*order)
    earlier = timeline.rowsBetween(Window.unboundedPreceding, -1)
    # Before the segment's first hot row it depends on what came in: if that has
    # a category, rows are kept up to and including the first without one.
    opening = F.col("_hot").isNull()
    if_open = F.when(opening & F.col("_null").isNull(), F.col("block"))
    rows = rows.withColumns({"_if_open": if_open, "_settled": F.when(F.col("_kept"), F.col("block"))})
    rows = rows.withColumns({
        "_prev_open": F.last("_if_open", ignorenulls=True).over(earlier),
        "_prev": F.last("_settled", ignorenulls=True).over(earlier),
    })

    at = F.struct("ts", "id")
    summary = rows.groupBy(*part).agg(
        F.max_by("_settled", F.when(F.col("_settled").isNotNull(), at)).alias("_out"),
        F.max_by("_if_open", F.when(F.col("_if_open").isNotNull(), at)).alias("_out_open"),
    )
    left = F.coalesce("_out", "_out_open")
    summary = summary.withColumns({"_always": F.col("_out").isNotNull(), "_block": left, "_cat": block_category(left)})
    summary = _remembered(summary, CELL, ["_seg"], "_always", "_cat")
    before = Window.partitionBy(*CELL).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *part, F.last(F.when(F.col("_kept"), F.col("_block")), ignorenulls=True).over(before).alias("_in")
    )

    rows = rows.select(*part, "ts", "id", "block", "_prev", "_prev_open").join(carried, part, "left")
    open_in = block_category(F.col("_in")).isNotNull()
    prev = F.coalesce(F.col("_prev"), F.when(open_in, F.col("_prev_open")), F.col("_in"))
    rows = rows.withColumn("prev_block", prev)
    return (
        rows.withColumn("change", natural_change(F.col("prev_block"), F.col("block")))
        .filter(F.col("change").isNotNull())
        .select("id", "ts", *CELL, "prev_block", "block", "change")
    )


def pair_click_open(
    opens: DataFrame, clicks: DataFrame, window: timedelta = CLICK_WINDOW, span: timedelta | None = None
) -> DataFrame:
    """Container opens with the position of the player's last click, if that
    is at most ``window`` old; other opens start no session.

    ``opens``: player, ts, id; ``clicks``: player, ts, id and the cell.
    """
    found = _last_record(opens, clicks, ["player"], CELL, window, span)
    return found.filter(F.col("rec").isNotNull()).select(
        *opens.columns, *[F.col(f"rec.{c}").alias(c) for c in CELL], F.col("rec.at").alias("click_ts")
    )
