"""Who is behind it: as-of, interval and nearest-neighbour joins.

Every lookup here reaches back a limited time, so all windows run over (key,
time segment) with the reach repeated across segment borders: exact, and no
task holds a key's whole history.
"""

from __future__ import annotations

from datetime import timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.timing import interval, micros, to_micros
from tracewell.operators.gate import acting_mob, allow_listed
from tracewell.operators.groups import connected_groups
from tracewell.operators.segments import with_reach_back
from tracewell.operators.spatial import live_neighbours
from tracewell.schema import ENTITY_CHANGE
from tracewell.session import checkpointed

# How long and how far each cause is remembered.
HIT_WINDOW = timedelta(seconds=20)
PRIME_TTL = timedelta(minutes=5)
FIRE_TTL, FIRE_RADIUS = timedelta(seconds=2), 2
FLUID_TTL, FLUID_RADIUS = timedelta(minutes=2), 8
MAX_OWNER_CHAIN = 4

# Kinds that name a player.
PLAYER_KINDS = (
    "PLAYER_DIRECT", "PLAYER_RIDER", "PLAYER_OWNER", "PLAYER_TAMER", "PLAYER_PROJECTILE", "PLAYER_INDIRECT",
)
CELL = ["world_key", "x", "y", "z"]


def _timeline(keys: list[str]) -> Window:
    return Window.partitionBy(*keys, "seg").orderBy("ts", "_seq")


def _merged(probes: DataFrame, records: DataFrame, keys: list[str], record: Column, reach, span, repeat_probes):
    """Probes and records on one timeline per key: ``probe`` or ``rec`` is set."""
    left = probes.select(*keys, "ts", F.col("id").alias("_seq"), F.struct(*probes.columns).alias("probe"))
    right = records.select(*keys, "ts", F.col("id").alias("_seq"), record.alias("rec"))
    both = left.withColumn("rec", F.lit(None).cast(right.schema["rec"].dataType)).unionByName(
        right.withColumn("probe", F.lit(None).cast(left.schema["probe"].dataType))
    )
    context = None if repeat_probes else F.col("rec").isNotNull()
    return with_reach_back(both, "ts", reach, span, context)


def _last_record(probes, records, keys, payload, reach, span) -> DataFrame:
    """Probes with ``rec``, the key's last record before them (a struct of the
    payload and ``at``), or null if it is older than ``reach``."""
    record = F.struct(*payload, F.col("ts").alias("at"))
    events = _merged(probes, records, keys, record, reach, span, repeat_probes=False)
    so_far = _timeline(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last("rec", ignorenulls=True).over(so_far)
    return (
        events.withColumn("rec", last)
        .filter(F.col("probe").isNotNull() & F.col("own"))
        .withColumn("rec", F.when(F.col("ts") - F.col("rec.at") <= interval(reach), F.col("rec")))
        .select("probe.*", "rec")
    )


def attribute_last_hit(
    probes: DataFrame,
    hits: DataFrame,
    window: timedelta = HIT_WINDOW,
    forgets: DataFrame | None = None,
    span: timedelta | None = None,
) -> DataFrame:
    """The victim's last attacker, if that hit is within ``window`` of the
    probe; older hits are not consulted and a forget row clears the slate.

    ``hits`` has victim, attacker, ts, id; ``probes`` victim, ts, id.
    """
    rows = hits.select("victim", "attacker", "ts", "id")
    if forgets is not None:
        cleared = F.lit(None).cast(rows.schema["attacker"].dataType).alias("attacker")
        rows = rows.unionByName(forgets.select("victim", cleared, "ts", "id"))
    found = _last_record(probes, rows, ["victim"], ["attacker"], window, span)
    return found.select(
        *probes.columns,
        F.col("rec.attacker").alias("attacker"),
        F.when(F.col("rec.attacker").isNotNull(), F.col("rec.at")).alias("hit_ts"),
    )


def attribute_prime(
    probes: DataFrame, primes: DataFrame, ttl: timedelta = PRIME_TTL, span: timedelta | None = None
) -> DataFrame:
    """The record a detonation consumes: one-shot, exact cell.

    A detonation takes whatever stands in its cell, so it is matched exactly if
    the row before it in the cell is a record. That record counts if it is
    fresh, names an actor and is of a player kind; otherwise it is used up for
    nothing. ``distance`` is 0 for a direct actor, else 1.

    ``primes`` has the cell, ts, id, actor_uuid, actor_name, kind.
    """
    record = F.struct("actor_uuid", "actor_name", "kind", F.col("ts").alias("at"))
    events = _merged(probes, primes, CELL, record, ttl, span, repeat_probes=True)
    before = F.lag("rec").over(_timeline(CELL))
    rows = events.withColumn("rec", before).filter(F.col("probe").isNotNull() & F.col("own"))
    good = (
        (F.col("ts") - F.col("rec.at") <= interval(ttl))
        & F.col("rec.actor_uuid").isNotNull()
        & F.col("rec.kind").isin(*PLAYER_KINDS)
    )
    rows = rows.withColumn("rec", F.when(good, F.col("rec")))
    return rows.select(
        "probe.*",
        F.col("rec.actor_uuid").alias("prime_uuid"),
        F.col("rec.actor_name").alias("prime_name"),
        F.col("rec.kind").alias("prime_kind"),
        F.when(F.col("rec").isNotNull(), F.when(F.col("rec.kind") == "PLAYER_DIRECT", 0).otherwise(1)).alias("distance"),
    )


def peek_prime(
    probes: DataFrame, primes: DataFrame, ttl: timedelta = PRIME_TTL, span: timedelta | None = None
) -> DataFrame:
    """Last fresh record of the cell, left in place."""
    found = _last_record(probes, primes, CELL, ["actor_uuid", "actor_name", "kind"], ttl, span)
    return found.select(
        *probes.columns,
        F.col("rec.actor_uuid").alias("prime_uuid"),
        F.col("rec.actor_name").alias("prime_name"),
        F.col("rec.kind").alias("prime_kind"),
    )


def couple_entity_changes(changes: DataFrame, allow_list: tuple[str, ...], log_all: bool = False) -> DataFrame:
    """Fire-cause records from entity block changes: allow-listed mobs can be
    held responsible, all others silence the fire they cause."""
    mob = acting_mob()
    return changes.filter((F.col("type") == ENTITY_CHANGE) & mob.isNotNull()).select(
        F.col("id").alias("rid"), *CELL, "ts", "actor_uuid", "actor_name",
        mob.alias("mob"), allow_listed(mob, allow_list, log_all).alias("allowed"),
    )


_CAUSER = ["actor_uuid", "actor_name", "mob", "allowed"]


def _fire_candidates(fires, causers, radius, ttl, span) -> DataFrame:
    probes = fires.select(F.col("id").alias("pid"), *CELL, "ts")
    return live_neighbours(probes, causers, _CAUSER, radius, ttl, "chebyshev", span)


def _freshness() -> Column:
    """Newest first; among equals the lowest cell."""
    return F.struct(micros(F.col("r_ts")).alias("t"), (-F.col("rx")).alias("a"), (-F.col("ry")).alias("b"), (-F.col("rz")).alias("c"))


def peek_fire_causer(
    fires: DataFrame,
    causers: DataFrame,
    radius: int = FIRE_RADIUS,
    ttl: timedelta = FIRE_TTL,
    span: timedelta | None = None,
) -> DataFrame:
    """Each fire with the newest fresh causer around it, left in place."""
    best = (
        _fire_candidates(fires, causers, radius, ttl, span)
        .groupBy(F.col("pid").alias("id"))
        .agg(F.max_by(F.struct("rid", *[F.col(c).alias(f"causer_{c}") for c in _CAUSER]), _freshness()).alias("_b"))
        .select("id", "_b.*")
    )
    return fires.join(best, "id", "left")


def _taken(ttl: int):
    """Streams candidates sorted by group, fire and freshness, freshest first; each fire
    takes the first that is left."""

    def run(batches):
        group = fire = None
        taken: dict[int, int] = {}  # causer -> its time, oldest taken first
        done = False
        for batch in batches:
            out = []
            for root, turn, pid, t, rid in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if root != group:
                    group, fire, taken = root, None, {}
                if pid != fire:
                    fire, done = pid, False
                    if len(taken) > 4096:  # too old for this fire and all after it
                        taken = {r: at for r, at in taken.items() if turn - at <= ttl}
                if not done and rid not in taken:
                    taken[rid] = t
                    out.append((pid, rid))
                    done = True
            columns = [pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "rid"])

    return run


def attribute_fire(
    fires: DataFrame,
    causers: DataFrame,
    radius: int = FIRE_RADIUS,
    ttl: timedelta = FIRE_TTL,
    span: timedelta | None = None,
) -> DataFrame:
    """Each fire with the causer it uses up, and a verdict: PAIR, SUPPRESS (the
    causer is not allow-listed) or PASSTHROUGH (none).

    In time order every fire takes the newest causer left around it. A fire whose
    candidates no other fire could take is settled by itself. The others form groups,
    connected by shared candidates, which are fires near each other in place and within
    the time to live; each group is gone through once, in time order. A task streams the
    sorted candidates of its groups and holds the causers taken within the time to live.
    A fire has at most one candidate per neighbouring cell, so the candidate table is
    linear in the fires.
    """
    fresh = _freshness()
    left = checkpointed(_fire_candidates(fires, causers, radius, ttl, span).select(
        "pid", micros(F.col("p_ts")).alias("turn"), "rid", fresh.alias("fresh")
    ))
    shared = left.groupBy("rid").agg(F.min("pid").alias("a"), F.max("pid").alias("z")).filter("a < z")
    groups = connected_groups(left.join(shared, "rid").select("a", F.col("pid").alias("b")).distinct())
    alone = left.join(groups, left["pid"] == groups["node"], "left_anti")
    settled = alone.groupBy(F.col("pid").alias("id")).agg(F.max_by("rid", "fresh").alias("rid"))
    contested = left.join(groups, left["pid"] == groups["node"]).select("root", "turn", "pid", "fresh", "rid")
    folded = (
        contested.repartition("root").sortWithinPartitions("root", "turn", "pid", F.col("fresh").desc())
        .select("root", "turn", "pid", F.col("fresh.t").alias("t"), "rid")
        .mapInArrow(_taken(to_micros(ttl)), "id long, rid long")
    )
    match = settled.unionByName(folded)
    named = match.join(causers.select("rid", *[F.col(c).alias(f"causer_{c}") for c in _CAUSER]), "rid")
    verdict = (
        F.when(F.col("rid").isNull(), "PASSTHROUGH").when(F.col("causer_allowed"), "PAIR").otherwise("SUPPRESS")
    )
    return fires.join(named, "id", "left").withColumn("verdict", verdict)


def attribute_fluid(
    flows: DataFrame,
    sources: DataFrame,
    radius: int = FLUID_RADIUS,
    ttl: timedelta = FLUID_TTL,
    span: timedelta | None = None,
) -> DataFrame:
    """Each flow with the nearest fresh source (Manhattan distance, the newer
    one on a tie), left in place; without one the actor is ``#fluid``.

    ``sources`` has rid, the cell, ts, actor_uuid, actor_name.
    """
    probes = flows.select(F.col("id").alias("pid"), *CELL, "ts")
    near = live_neighbours(probes, sources, ["actor_uuid", "actor_name"], radius, ttl, "manhattan", span)
    order = F.struct("dist", (-micros(F.col("r_ts"))).alias("age"), (-F.col("rid")).alias("r"))
    best = (
        near.groupBy(F.col("pid").alias("id"))
        .agg(F.min_by(F.struct("rid", "dist", F.col("actor_uuid").alias("u"), F.col("actor_name").alias("n")), order).alias("_b"))
        .select("id", "_b.*")
    )
    return (
        flows.join(best, "id", "left")
        .withColumn("source_uuid", F.col("u"))
        .withColumn("source_name", F.when(F.col("u").isNotNull(), F.coalesce("n", F.lit("#fluid"))).otherwise("#fluid"))
        .drop("u", "n")
    )


def _settled_kind() -> Column:
    """Rules that need no time: player, rider, owner."""
    return (
        F.when(F.col("is_player"), "PLAYER_DIRECT")
        .when(F.col("rider").isNotNull(), "PLAYER_RIDER")
        .when(F.col("owner").isNotNull(), "PLAYER_OWNER")
    )


def responsible_entities(entities: DataFrame) -> DataFrame:
    """Each entity with the entity that answers for it: follow the shooter of
    a projectile until a rule settles, at most four deep.

    ``entities``: entity, is_player, rider, owner, shooter, stored_owner,
    in_raid. Works on the entity table, not on facts: the chain does not depend
    on time.
    """
    settled = F.coalesce(F.col("is_player"), F.lit(False)) | F.col("rider").isNotNull() | F.col("owner").isNotNull()
    links = entities.select(F.col("entity").alias("_from"), F.when(~settled, F.col("shooter")).alias("_to"))
    out = entities.select("entity", F.col("entity").alias("answers"), F.lit(0).alias("depth"))
    for _ in range(MAX_OWNER_CHAIN):
        step = out.join(links, out["answers"] == links["_from"], "left")
        out = step.select(
            "entity",
            F.coalesce("_to", "answers").alias("answers"),
            (F.col("depth") + F.col("_to").isNotNull().cast("int")).alias("depth"),
        )
    return out


def attribute_entity(
    probes: DataFrame,
    entities: DataFrame,
    hits: DataFrame,
    window: timedelta = HIT_WINDOW,
    span: timedelta | None = None,
) -> DataFrame:
    """Who answers for what an entity did: player, controlling rider, owner,
    shooter (recursively), recent attacker, stored owner, nature; first match
    wins. ``probes`` has entity, ts, id."""
    who = responsible_entities(entities)
    facts = entities.select(
        F.col("entity").alias("answers"), "is_player", "rider", "owner", "stored_owner", "in_raid"
    )
    known = who.join(facts, "answers", "left")
    rows = probes.join(known, "entity", "left").withColumn("victim", F.coalesce("answers", "entity"))
    rows = attribute_last_hit(rows, hits, window, span=span)
    endless = F.coalesce(F.col("depth") >= MAX_OWNER_CHAIN, F.lit(False))
    natural = F.when(F.coalesce(F.col("in_raid"), F.lit(False)), "NATURAL_RAID").otherwise("NATURAL_SPAWN")
    kind = F.when(endless, "UNKNOWN").otherwise(
        F.coalesce(
            _settled_kind(),
            F.when(F.col("attacker").isNotNull(), "PLAYER_INDIRECT"),
            F.when(F.col("stored_owner").isNotNull(), "PLAYER_TAMER"),
            natural,
        )
    )
    actor = F.when(~endless, F.coalesce(
        F.when(F.col("is_player"), F.col("victim")), F.col("rider"), F.col("owner"), F.col("attacker"), F.col("stored_owner"),
    ))
    rows = rows.withColumn("_kind", kind).withColumn("responsible", actor)
    shot = (F.coalesce(F.col("depth"), F.lit(0)) > 0) & F.col("_kind").isin(*PLAYER_KINDS)
    return rows.withColumn("kind", F.when(shot, "PLAYER_PROJECTILE").otherwise(F.col("_kind"))).select(
        *probes.columns, "responsible", "kind"
    )
