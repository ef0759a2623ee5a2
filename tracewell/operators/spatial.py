"""Range and neighbourhood joins as equi joins on grid cells."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.timing import interval
from tracewell.operators.segments import segment_span, with_reach_back

# Cells of the coarsest-to-finest grids that boxes are filed under.
FINEST_GRID = 6  # 2**6 = 64 blocks


def facts_in_boxes(facts: DataFrame, boxes: DataFrame, keys: list[str], same_world: bool = True) -> DataFrame:
    """Every (box, fact) pair with the fact's x, z (and y, where the box has
    bounds on it) inside the box. ``boxes`` has min_x..max_z and ``keys``.

    A box is filed under the power-of-two grid that cuts it into at most four
    cells, so neither a tiny nor a world-sized box multiplies: facts carry one
    grid cell per grid size in use (a handful), and the join is on equality.
    """
    side = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_z") - F.col("min_z"), F.lit(1))
    level = F.greatest(F.ceil(F.log2(side.cast("double"))).cast("int"), F.lit(FINEST_GRID))
    boxes = boxes.withColumn("_level", level)
    levels = sorted(r[0] for r in boxes.select("_level").distinct().collect())  # at most 32 rows

    def cells(lo: str, hi: str) -> F.Column:
        return F.sequence(F.expr(f"shiftright({lo}, _level)"), F.expr(f"shiftright({hi}, _level)"))

    filed = boxes.withColumn("_gx", F.explode(cells("min_x", "max_x")))
    filed = filed.withColumn("_gz", F.explode(cells("min_z", "max_z")))
    filed = filed.select(
        *[F.col(k) for k in keys],
        *([F.col("world_key").alias("_world")] if same_world else []),
        "_level", "_gx", "_gz",
        "min_x", "max_x", "min_y", "max_y", "min_z", "max_z",
    )
    placed = facts.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels] or [F.lit(0)])))
    placed = placed.withColumn("_gx", F.expr("shiftright(x, _level)")).withColumn("_gz", F.expr("shiftright(z, _level)"))
    joined = placed.join(filed, ["_level", "_gx", "_gz"])
    inside = (
        F.col("x").between(F.col("min_x"), F.col("max_x"))
        & F.col("z").between(F.col("min_z"), F.col("max_z"))
        & (F.col("min_y").isNull() | F.col("y").between(F.col("min_y"), F.col("max_y")))
    )
    if same_world:
        inside = inside & (F.col("world_key") == F.col("_world"))
    drop = ["_level", "_gx", "_gz", "min_x", "max_x", "min_y", "max_y", "min_z", "max_z"]
    return joined.filter(inside).drop(*drop, *(["_world"] if same_world else []))


def live_neighbours(
    probes: DataFrame,
    records: DataFrame,
    payload: list[str],
    radius: int,
    ttl: timedelta,
    metric: str,
    span: timedelta | None = None,
) -> DataFrame:
    """For each probe and each cell near it: the newest record that stood in
    that cell when the probe happened, if not older than ``ttl``.

    ``probes`` has ``pid, world_key, x, y, z, ts``; ``records`` has ``rid``,
    the same position columns and ``payload``. Result: ``pid``, ``p_ts``,
    ``dist``, ``rid``, ``r_ts``, ``rx, ry, rz`` and the payload. Events happen
    in (ts, id) order.

    A record is replaced by the next one in its cell, so a probe has at most
    one candidate per cell of the neighbourhood. Probes are therefore joined
    with *distinct* record cells, never with the records, and each (probe,
    cell) pair then looks up the record as of its time in a window over
    (cell, time segment). Work grows with the number of probes, also where one
    place holds most of the rows.
    """
    span = span or segment_span(ttl)
    # A cell is filed under two grid cells an axis at most.
    grid = 2 * radius + 1
    recs = with_reach_back(
        records.select("rid", "world_key", "x", "y", "z", F.col("ts"), *payload), "ts", ttl, span
    )
    homes = probes.select("pid", "world_key", "x", "y", "z", "ts")
    homes = with_reach_back(homes, "ts", ttl, span, context=F.lit(False))

    def near(c: str) -> F.Column:
        lo, hi = F.floor((F.col(c) - radius) / grid), F.floor((F.col(c) + radius) / grid)
        return F.explode(F.sequence(lo, hi))

    cells = recs.select("world_key", "seg", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("z").alias("rz"))
    cells = cells.distinct()
    for axis in ("rx", "ry", "rz"):
        cells = cells.withColumn(f"_b{axis[1]}", near(axis))
    for axis in ("x", "y", "z"):
        homes = homes.withColumn(f"_b{axis}", F.floor(F.col(axis) / grid))

    gaps = [F.abs(F.col(a) - F.col(f"r{a}")) for a in ("x", "y", "z")]
    dist = gaps[0] + gaps[1] + gaps[2] if metric == "manhattan" else F.greatest(*gaps)
    pairs = (
        homes.join(cells, ["world_key", "seg", "_bx", "_by", "_bz"])
        .withColumn("dist", dist)
        .filter(F.col("dist") <= radius)
        .select("world_key", "seg", "rx", "ry", "rz", "ts", "pid", "dist")
    )
    stored = recs.select(
        "world_key", "seg", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("z").alias("rz"), "ts",
        F.struct("rid", F.col("ts").alias("r_ts"), *payload).alias("rec"),
    )
    events = pairs.withColumn("rec", F.lit(None).cast(stored.schema["rec"].dataType)).unionByName(
        stored.withColumn("pid", F.lit(None).cast("long")).withColumn("dist", F.lit(None).cast("int"))
    )
    timeline = (
        Window.partitionBy("world_key", "rx", "ry", "rz", "seg")
        .orderBy("ts", F.coalesce("pid", "rec.rid"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        events.withColumn("rec", F.last("rec", ignorenulls=True).over(timeline))
        .filter(F.col("pid").isNotNull() & F.col("rec").isNotNull())
        .filter(F.col("ts") - F.col("rec.r_ts") <= interval(ttl))
        .select("pid", F.col("ts").alias("p_ts"), "dist", "rx", "ry", "rz", "rec.*")
    )
