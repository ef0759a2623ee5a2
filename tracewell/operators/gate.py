"""Ingest gate: toggles, lists, overrides, block rules, coalescing, throttling.

Configuration is held as plain values (as a config file gives them) and turns
into literals inside one projection. Rule tables of any size are supported: up
to :data:`MAX_LITERAL_RULES` they are literals, beyond that joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import timedelta

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.actions import is_hot_source, mob_key, redact_command
from tracewell.functions.predicates import any_of
from tracewell.functions.timing import micros, interval, to_micros
from tracewell.operators.chains import greedy_chain
from tracewell.operators.segments import with_reach_back
from tracewell.schema import (
    ACTION_TYPES,
    CHAT,
    COMMAND,
    ENTITY_CHANGE,
    EXPLOSION,
    FLUID,
    SIGN,
    SPAWN,
    type_is,
    types_in,
)

MAX_LITERAL_RULES = 2_000

# Windows of the coalescer and the spawn throttle.
COALESCE_WINDOW = timedelta(milliseconds=500)
SPAWN_WINDOW = timedelta(seconds=1)

# Column widths of a store.
MAX_TARGET, MAX_NAME, MAX_WORLD, MAX_TAG, MAX_SIDE, MAX_DYE = 4096, 64, 96, 64, 8, 16


@dataclass(frozen=True)
class Toggles:
    """What is logged, and the lists that go with it."""

    blocks: bool = True
    containers: bool = True
    items: bool = True
    entities: bool = True
    explosions: bool = True
    world_events: bool = True
    chat: bool = True
    commands: bool = True
    signs: bool = True
    sessions: bool = True
    interactions: bool = True
    lava_flow: bool = True
    water_flow: bool = True
    worlds: tuple[str, ...] = ()
    block_ids: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()


@dataclass(frozen=True)
class GateConfig:
    toggles: Toggles = Toggles()
    hot_sources: bool = True
    per_world: dict[str, Toggles] = field(default_factory=dict)
    entity_allow_list: tuple[str, ...] = ()
    log_all_entities: bool = False
    coalesce_window: timedelta = COALESCE_WINDOW
    strict: bool = True


# Which toggle a category or a single type obeys.
CATEGORY_TOGGLES = {
    "BLOCK": "blocks", "CONTAINER": "containers", "ITEM": "items", "ENTITY": "entities", "WORLD": "world_events",
    "SESSION": "sessions", "INTERACT": "interactions",
}
TYPE_TOGGLES = {EXPLOSION: "explosions", CHAT: "chat", COMMAND: "commands", SIGN: "signs"}


def type_enabled(toggles: Toggles) -> Column:
    """One toggle per category, with finer ones for explosions, messages and
    fluids (by whether the target is lava)."""
    on = [
        t.id for t in ACTION_TYPES
        if t.id != FLUID and getattr(toggles, TYPE_TOGGLES.get(t.id) or CATEGORY_TOGGLES[t.category])
    ]
    lava = F.coalesce(F.lower("target").contains("lava"), F.lit(False))
    fluid = F.when(lava, F.lit(toggles.lava_flow)).otherwise(F.lit(toggles.water_flow))
    return F.coalesce(F.when(F.col("type") == FLUID, fluid).otherwise(type_is(on)), F.lit(False))


def _in(column: Column, values) -> Column:
    return F.coalesce(column.isin(*values), F.lit(False)) if values else F.lit(False)


def list_reason(toggles: Toggles) -> Column:
    """Why the lists drop a row; null if they do not."""
    return (
        F.when(_in(F.col("world_key"), toggles.worlds), "world")
        .when(type_is(types_in("BLOCK")) & _in(F.col("target"), toggles.block_ids), "block")
        .when(_in(F.col("source_tag"), toggles.tags), "source")
    )


def type_reason(toggles: Toggles) -> Column:
    return F.when(~type_enabled(toggles), "type")


def hot_reason(enabled: bool) -> Column:
    return F.when(F.lit(not enabled) & is_hot_source(F.col("source_tag")), "hot_source")


def per_world_reason(per_world: dict[str, Toggles]) -> Column:
    """Deny on toggles or lists of the row's world; no override passes."""
    expr = F.lit(None).cast("string")
    for world, toggles in per_world.items():
        denied = F.coalesce(type_reason(toggles), list_reason(toggles)).isNotNull()
        expr = F.when((F.col("world_key") == world) & denied, "per_world").otherwise(expr)
    return expr


def decide(predicates: list[Column]) -> Column:
    """Accept / deny / pass predicates: the first that is not null decides,
    and a row nobody has an opinion on is accepted."""
    return F.coalesce(*predicates, F.lit(True)) if predicates else F.lit(True)


# --- block rules -----------------------------------------------------------

RULE_KINDS = ("user", "user_uuid", "command", "block", "entity", "composite")


def _rule_keys() -> dict[str, Column]:
    """The key each kind of rule is matched on; null where it cannot apply."""
    t = F.col("type")
    name, target = F.lower("actor_name"), F.lower("target")
    message = F.regexp_replace(F.trim(target), "^/", "")
    return {
        "user": name,
        "user_uuid": F.lower("actor_uuid"),
        "command": F.when(t == COMMAND, F.regexp_extract(message, "^([^ ]*)", 1)),
        "block": F.when(t.isin(1, 2), target),
        "entity": F.when(t.isin(7, SPAWN), target),
        "composite": F.concat(target, F.lit("@"), name),
    }


def mark_blacklisted(actions: DataFrame, rules: DataFrame, flag: str = "blacklisted") -> DataFrame:
    """Add a flag: the row matches a rule (``kind``, ``value``; see
    ``sources.rules``).

    Few rules become literal sets inside the projection, so no row moves. With more
    rules than that, the distinct combinations of keys that rows have (a narrow table,
    combined before it moves) are exploded and met with all rules of all kinds at once;
    the rows themselves move once, to the combinations that were hit. Rows that no kind
    applies to get a combination of their own so they do not pile up on one.
    """
    wanted = rules.select("kind", F.lower("value").alias("value"))
    few = wanted.limit(MAX_LITERAL_RULES + 1).collect()
    keys = _rule_keys()
    if len(few) <= MAX_LITERAL_RULES:
        hits = [
            _in(keys[kind], sorted({r["value"] for r in few if r["kind"] == kind}))
            for kind in RULE_KINDS
        ]
        return actions.withColumn(flag, any_of(hits))
    marked = [F.concat(F.lit(f"{kind}\0"), keys[kind]) for kind in RULE_KINDS]
    combination = F.array_compact(F.array(*marked))
    lone = F.array(F.concat(F.lit("\0"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    out = actions.withColumn("_keys", F.when(F.size(combination) > 0, combination).otherwise(lone))
    values = wanted.select(F.concat_ws("\0", "kind", "value").alias("_key")).distinct()
    held = actions.select(combination.alias("_keys")).filter(F.size("_keys") > 0).distinct()
    hit = held.withColumn("_key", F.explode("_keys")).join(values, "_key", "left_semi").select("_keys").distinct()
    return out.join(hit.withColumn(flag, F.lit(True)), "_keys", "left").drop("_keys").withColumn(
        flag, F.coalesce(F.col(flag), F.lit(False))
    )


def gate_blacklist(actions: DataFrame, rules: DataFrame) -> DataFrame:
    return mark_blacklisted(actions, rules, "_hit").filter(~F.col("_hit")).drop("_hit")


# --- entity changes --------------------------------------------------------

def allow_listed(key: Column, allow_list: tuple[str, ...], log_all: bool = False) -> Column:
    """Exact id, ``ns:*`` or bare ``ns``. Nothing is allowed by default."""
    if log_all:
        return F.lit(True)
    entries = [e.strip() for e in allow_list if e and e.strip()]
    exact = [e for e in entries if not e.endswith(":*")]
    spaces = [e[:-2] for e in entries if e.endswith(":*") and len(e) > 2] + [e for e in entries if ":" not in e]
    namespace = F.substring_index(key, ":", 1)
    return _in(key, exact) | _in(namespace, spaces)


def acting_mob() -> Column:
    return F.coalesce(mob_key(F.col("actor_name")), mob_key(F.col("source_tag")))


def entity_reason(cfg: GateConfig) -> Column:
    mob = acting_mob()
    allowed = allow_listed(mob, cfg.entity_allow_list, cfg.log_all_entities)
    return F.when((F.col("type") == ENTITY_CHANGE) & mob.isNotNull() & ~allowed, "entity")


def gate_entity_changes(actions: DataFrame, allow_list: tuple[str, ...], log_all: bool = False) -> DataFrame:
    cfg = GateConfig(entity_allow_list=allow_list, log_all_entities=log_all)
    return actions.filter(entity_reason(cfg).isNull())


COALESCE_KEY = ["_actor", "world_key", "x", "y", "z"]


def coalesce_actor() -> Column:
    return F.coalesce("actor_uuid", "actor_name", F.lit(""))


def mark_coalesced(
    rows: DataFrame, window: timedelta = COALESCE_WINDOW, span: timedelta | None = None, flag: str = "coalesced"
) -> DataFrame:
    """Flag rows that follow a row of the same actor and cell by less than
    ``window``. A flagged row extends the window too, so it is the gap to the
    row before that counts; a gap of exactly the window starts anew."""
    spread = rows if "_actor" in rows.columns else rows.withColumn("_actor", coalesce_actor())
    spread = with_reach_back(spread, "ts", window, span)
    before = F.lag("ts").over(Window.partitionBy(*COALESCE_KEY, "seg").orderBy("ts", "id"))
    close = F.coalesce(F.col("ts") - before < interval(window), F.lit(False))
    return spread.withColumn(flag, close).filter("own").drop("_actor", "seg", "own")


def coalesce_entity_changes(actions: DataFrame, window: timedelta = COALESCE_WINDOW, span=None) -> DataFrame:
    rows = actions.filter(F.col("type") == ENTITY_CHANGE)
    return mark_coalesced(rows, window, span).filter(~F.col("coalesced")).drop("coalesced")


# --- the whole gate --------------------------------------------------------

def gate(
    events: DataFrame,
    cfg: GateConfig = GateConfig(),
    rules: DataFrame | None = None,
    predicates: list[Column] = (),
    before=None,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """Add ``gate_reason``: null if the row is accepted.

    Entity rules and coalescing come first and only in the strict variant; then
    redaction, the hot switch, toggles and lists; rows of hot sources skip the
    rest (per-world, block rules, predicates). ``before`` is a callback
    DataFrame -> DataFrame that runs ahead of everything (cancel by filtering,
    annotate by replacing columns). ``earlier`` (_actor, world_key, x, y, z, ts) are last
    changes from before the events: coalescing counts gaps from them as well.
    """
    rows = before(events) if before is not None else events
    if cfg.strict:
        rows = rows.withColumn("_entity", entity_reason(cfg))
        changes = rows.filter((F.col("type") == ENTITY_CHANGE) & F.col("_entity").isNull())
        others = rows.filter(~((F.col("type") == ENTITY_CHANGE) & F.col("_entity").isNull()) | F.col("type").isNull())
        if earlier is not None:
            changes = changes.withColumn("_actor", coalesce_actor()).withColumn("_earlier", F.lit(False)).unionByName(
                earlier.withColumn("_earlier", F.lit(True)), allowMissingColumns=True
            )
            marked = mark_coalesced(changes, cfg.coalesce_window).filter(~F.col("_earlier")).drop("_earlier")
        else:
            marked = mark_coalesced(changes, cfg.coalesce_window)
        rows = marked.unionByName(others.withColumn("coalesced", F.lit(False)))
    else:
        rows = rows.withColumn("_entity", F.lit(None).cast("string")).withColumn("coalesced", F.lit(False))
    rows = rows.withColumn("target", redact_command(F.col("type"), F.col("target")))
    if rules is not None:
        rows = mark_blacklisted(rows, rules, "_listed")
    else:
        rows = rows.withColumn("_listed", F.lit(False))
    hot = is_hot_source(F.col("source_tag"))
    reason = F.coalesce(
        F.col("_entity"),
        F.when(F.col("coalesced"), "coalesced"),
        hot_reason(cfg.hot_sources),
        type_reason(cfg.toggles),
        list_reason(cfg.toggles),
        F.when(~hot, per_world_reason(cfg.per_world)),
        F.when(~hot & F.col("_listed"), "blacklist"),
        F.when(~hot & ~decide(list(predicates)), "predicate"),
    )
    return rows.withColumn("gate_reason", reason).drop("_entity", "coalesced", "_listed")


def ingest_report(gated: DataFrame) -> DataFrame:
    """Rows by outcome; coalesced rows count as suppressed, not as gated."""
    outcome = F.coalesce("gate_reason", F.lit("accepted"))
    return gated.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def quarantine_reason() -> Column:
    """Why a store would refuse a row; null if it would not."""

    def longer(name: str, width: int) -> Column:
        return F.coalesce(F.length(name) > width, F.lit(False))

    return (
        F.when(F.col("type").isNull(), "type")
        .when(F.col("world_key").isNull(), "world")
        .when(longer("target", MAX_TARGET), "target")
        .when(longer("actor_name", MAX_NAME), "name")
        .when(longer("world_key", MAX_WORLD), "world")
        .when(longer("source_tag", MAX_TAG), "source_tag")
        .when(longer("sign_side", MAX_SIDE), "sign_side")
        .when(longer("sign_dye_color", MAX_DYE), "sign_dye_color")
    )


def validate_rows(events: DataFrame) -> DataFrame:
    return events.withColumn("quarantine_reason", quarantine_reason())


# --- spawn throttle --------------------------------------------------------

# Time per task and entity kind when throttling.
THROTTLE_SEGMENT = timedelta(hours=1)


def throttle_spawns(
    actions: DataFrame, window: timedelta = SPAWN_WINDOW, segment: timedelta = THROTTLE_SEGMENT
) -> DataFrame:
    """Spawn rows kept when each entity kind is logged at most once per
    ``window``, counted from the last *kept* row, over all worlds.

    Rows at the same instant are reduced to their first before anything is
    grouped, so a segment's size depends on the clock, not on the traffic.
    """
    width = to_micros(window)
    spawns = actions.filter(F.col("type") == SPAWN)
    if "from_disk" in actions.columns:
        spawns = spawns.filter(~F.coalesce("from_disk", F.lit(False)))
    firsts = spawns.groupBy("target", micros(F.col("ts")).alias("at")).agg(F.min("id").alias("id"))
    marked = greedy_chain(
        firsts.select("target", "at"),
        ["target"], "at",
        lambda pdf: pdf["at"].to_numpy(np.int64) + width,
        segment=max(to_micros(segment), width), reach=width,
    )
    kept = marked.filter(F.col("start") == F.col("at")).select("target", "at")
    ids = firsts.join(kept, ["target", "at"]).select("id")
    return spawns.join(ids, "id", "left_semi")
