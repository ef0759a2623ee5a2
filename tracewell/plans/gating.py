"""Ingest gate (I) and user predicates (U)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tracewell.operators import gate as g
from tracewell.plans.binding import DISPLAY, facts, oracle, shown
from tracewell.plans.lookups import TYPES_SQL
from tracewell.plans.registry import query

COLS = ", ".join(DISPLAY)

TOGGLES = g.Toggles(
    items=False, chat=False, explosions=False, water_flow=False,
    worlds=("minecraft:the_end",), block_ids=("minecraft:red_sand",), tags=("#hopper",),
)
OVERRIDES = {"minecraft:the_nether": g.Toggles(sessions=False, block_ids=("minecraft:dirt",))}
ALLOW = ("dragons:*", "minecraft:ravager")
HOURS_6 = timedelta(hours=6)

JOINED = f"FROM a JOIN {TYPES_SQL} ON a.type = d.type"
TYPE_ON = """CASE WHEN a.type = 40 THEN contains(a.target, 'lava') WHEN a.type = 8 THEN false WHEN a.type = 9 THEN false
  WHEN d.category = 'ITEM' THEN false ELSE true END"""
LIST_REASON = """CASE WHEN a.world_key = 'minecraft:the_end' THEN 'world' WHEN d.category = 'BLOCK' AND a.target = 'minecraft:red_sand' THEN 'block'
  WHEN a.source_tag = '#hopper' THEN 'source' END"""
HOT = "coalesce(regexp_matches(a.source_tag, '^(#fire|#natural|#dispenser|#fluid)'), false)"
NETHER = """a.world_key = 'minecraft:the_nether' AND (d.category = 'SESSION' OR (d.category = 'BLOCK' AND a.target = 'minecraft:dirt'))"""

RULES = (
    ("user", "User_12"), ("user_uuid", "00000000-0000-4000-8000-000000000007"), ("command", "tp"),
    ("block", "minecraft:STONE"), ("entity", "minecraft:dirt"), ("composite", "minecraft:water@user_3"),
)
LISTED = """(lower(a.actor_name) IN ('user_12') OR coalesce(a.actor_uuid = '00000000-0000-4000-8000-000000000007', false)
  OR (a.type = 10 AND regexp_extract(a.target, '^/?([^ ]*)', 1) = 'tp') OR (a.type IN (1, 2) AND a.target = 'minecraft:stone')
  OR (a.type IN (7, 32) AND a.target = 'minecraft:dirt') OR (a.target = 'minecraft:water' AND lower(a.actor_name) = 'user_3'))"""
MOB = "CASE WHEN a.source_tag LIKE '#mob:%' THEN substr(a.source_tag, 6) END"
ENTITY_DENIED = f"(a.type = 26 AND {MOB} IS NOT NULL AND NOT (split_part({MOB}, ':', 1) = 'dragons' OR {MOB} = 'minecraft:ravager'))"


def rules(spark):
    return spark.createDataFrame(list(RULES), "kind string, value string")


@query("gate_types", oracle(f"SELECT a.id, {TYPE_ON} AS enabled {JOINED}"))
def gate_types(spark, sf):
    return facts(spark, sf).select("id", g.type_enabled(TOGGLES).alias("enabled"))


@query("gate_lists", oracle(f"SELECT a.id, {LIST_REASON} AS reason {JOINED}"))
def gate_lists(spark, sf):
    return facts(spark, sf).select("id", g.list_reason(TOGGLES).alias("reason"))


@query("gate_hot_sources", oracle(f"SELECT a.id, CASE WHEN {HOT} THEN 'hot_source' END AS reason FROM a"))
def gate_hot_sources(spark, sf):
    return facts(spark, sf).select("id", g.hot_reason(False).alias("reason"))


@query("gate_per_world", oracle(f"SELECT a.id, CASE WHEN {NETHER} THEN 'per_world' END AS reason {JOINED}"))
def gate_per_world(spark, sf):
    return facts(spark, sf).select("id", g.per_world_reason(OVERRIDES).alias("reason"))


@query("gate_blacklist", oracle(f"SELECT {COLS} FROM a WHERE NOT coalesce({LISTED}, false)"))
def gate_blacklist(spark, sf):
    return g.gate_blacklist(shown(facts(spark, sf)), rules(spark))


@query("gate_blacklist_large", oracle("""
SELECT a.id FROM a WHERE NOT (lower(a.actor_name) IN (SELECT concat('user_', CAST(c_custkey AS varchar)) FROM customer WHERE c_nationkey < 12)
  OR (a.type IN (1, 2) AND a.target = 'minecraft:stone'))"""))
def gate_blacklist_large(spark, sf):
    """Rules from a table of any size: beyond the literal limit they are joined."""
    people = spark.read.parquet(f"{sf}/customer.parquet").filter("c_nationkey < 12").select(
        F.lit("user").alias("kind"), F.concat(F.lit("User_"), F.col("c_custkey").cast("string")).alias("value")
    )
    block = spark.createDataFrame([("block", "minecraft:stone")], "kind string, value string")
    return g.gate_blacklist(facts(spark, sf), people.unionByName(block)).select("id")


@query("gate_entity_changes", oracle(f"SELECT {COLS} FROM a WHERE NOT coalesce({ENTITY_DENIED}, false)"))
def gate_entity_changes(spark, sf):
    return g.gate_entity_changes(shown(facts(spark, sf)), ALLOW)


GAP = "INTERVAL 72 HOUR"


def coalesced_sql(source: str, gap: str) -> str:
    return f"""SELECT id, ts - lag(ts) OVER (PARTITION BY coalesce(actor_uuid, actor_name), world_key, x, y, z ORDER BY ts, id) < {gap} AS close FROM {source}"""


@query("coalesce_entity_changes", oracle(f"""
, m AS (SELECT * FROM a WHERE type IN (26)), l AS ({coalesced_sql('m', GAP)})
SELECT {COLS} FROM m WHERE id IN (SELECT id FROM l WHERE NOT coalesce(close, false))"""))
def coalesce_entity_changes(spark, sf):
    return g.coalesce_entity_changes(shown(facts(spark, sf)), timedelta(hours=72))


@query("coalesce_cells", oracle(f"""
, m AS (SELECT * REPLACE ('#mob' AS actor_name, NULL AS actor_uuid) FROM a), l AS ({coalesced_sql('m', 'INTERVAL 6 HOUR')})
SELECT id, coalesce(close, false) AS coalesced FROM l"""))
def coalesce_cells(spark, sf):
    """Coalescing of all rows under one actor: long runs per cell."""
    rows = shown(facts(spark, sf)).withColumn("actor_name", F.lit("#mob")).withColumn("actor_uuid", F.lit(None).cast("string"))
    return g.mark_coalesced(rows, HOURS_6).select("id", "coalesced")


# A predicate list: accept item frames, deny the lowest layer, no opinion else.
GATE_REASON = f"""CASE
  WHEN coalesce({ENTITY_DENIED}, false) THEN 'entity'
  WHEN a.id IN (SELECT id FROM l WHERE close) THEN 'coalesced'
  WHEN NOT ({TYPE_ON}) THEN 'type'
  WHEN {LIST_REASON} IS NOT NULL THEN {LIST_REASON}
  WHEN {HOT} THEN NULL
  WHEN {NETHER} THEN 'per_world'
  WHEN coalesce({LISTED}, false) THEN 'blacklist'
  WHEN NOT coalesce(CASE WHEN a.type IN (34, 35) THEN true END, CASE WHEN a.y = 60 THEN false END, true) THEN 'predicate' END"""
GATE_SQL = f"""
, m AS (SELECT * FROM a WHERE type = 26 AND NOT coalesce({ENTITY_DENIED}, false)), l AS ({coalesced_sql('m', GAP)}),
gated AS (SELECT a.id, CASE WHEN a.type = 10 THEN concat('/', regexp_extract(a.target, '^/*([^ ]+)', 1)) ELSE a.target END AS target,
          {GATE_REASON} AS gate_reason {JOINED})"""


def gated(spark, sf):
    cfg = g.GateConfig(TOGGLES, True, OVERRIDES, ALLOW, coalesce_window=timedelta(hours=72))
    preds = [F.when(F.col("type").isin(34, 35), F.lit(True)), F.when(F.col("y") == 60, F.lit(False))]
    return g.gate(shown(facts(spark, sf)), cfg, rules(spark), preds)


@query("gate", oracle(f"{GATE_SQL} SELECT * FROM gated"))
def gate(spark, sf):
    return gated(spark, sf).select("id", "target", "gate_reason")


@query("ingest_report", oracle(f"{GATE_SQL} SELECT coalesce(gate_reason, 'accepted') AS outcome, count(*) AS n FROM gated GROUP BY 1"))
def ingest_report(spark, sf):
    return g.ingest_report(gated(spark, sf))


@query("user_predicates", oracle("""
SELECT id, coalesce(CASE WHEN type IN (34, 35) THEN true END, CASE WHEN y = 60 THEN false END, true) AS accepted FROM a"""))
def user_predicates(spark, sf):
    first = F.when(F.col("type").isin(34, 35), F.lit(True))
    second = F.when(F.col("y") == 60, F.lit(False))
    return facts(spark, sf).select("id", g.decide([first, second]).alias("accepted"))


@query("pre_log_hook", oracle("""
SELECT id, target, CASE WHEN type IN (5, 6, 31) THEN 'type' END AS gate_reason
FROM (SELECT id, type, CASE WHEN type = 9 THEN upper(target) WHEN type = 10 THEN concat('/', regexp_extract(target, '^/*([^ ]+)', 1)) ELSE target END AS target
      FROM a WHERE y <> 63)"""))
def pre_log_hook(spark, sf):
    """A callback cancels rows of the top layer and annotates chat."""
    def hook(df):
        shout = F.when(F.col("type") == 9, F.upper("target")).otherwise(F.col("target"))
        return df.filter(F.col("y") != 63).withColumn("target", shout)

    cfg = g.GateConfig(g.Toggles(items=False), strict=False)
    return g.gate(shown(facts(spark, sf)), cfg, before=hook).select("id", "target", "gate_reason")


@query("validate_rows", oracle("""
, r AS (SELECT id, CASE WHEN id % 17 = 1 THEN NULL ELSE type END AS type, CASE WHEN id % 19 = 2 THEN NULL ELSE world_key END AS world_key,
               CASE WHEN id % 23 = 3 THEN repeat(target, 500) ELSE target END AS target,
               CASE WHEN id % 29 = 4 THEN repeat(actor_name, 20) ELSE actor_name END AS actor_name, repeat(source_tag, 1 + id % 9) AS source_tag
        FROM a)
SELECT id, CASE WHEN type IS NULL THEN 'type' WHEN world_key IS NULL THEN 'world' WHEN length(target) > 4096 THEN 'target'
  WHEN length(actor_name) > 64 THEN 'name' WHEN length(world_key) > 96 THEN 'world' WHEN length(source_tag) > 64 THEN 'source_tag' END AS quarantine_reason FROM r"""))
def validate_rows(spark, sf):
    i = F.col("id")
    raw = facts(spark, sf).select(
        "id",
        F.when(i % 17 != 1, F.col("type")).alias("type"),
        F.when(i % 19 != 2, F.col("world_key")).alias("world_key"),
        F.when(i % 23 == 3, F.repeat("target", F.lit(500))).otherwise(F.col("target")).alias("target"),
        F.when(i % 29 == 4, F.repeat("actor_name", F.lit(20))).otherwise(F.col("actor_name")).alias("actor_name"),
        F.expr("repeat(source_tag, cast(1 + id % 9 as int))").alias("source_tag"),
        "sign_side", "sign_dye_color",
    )
    return g.validate_rows(raw).select("id", "quarantine_reason")


@query("throttle_spawns", oracle("""
, s AS (SELECT target, ts, min(id) AS id FROM (SELECT target, ts, id FROM a WHERE type = 32) GROUP BY target, ts),
nx AS (SELECT p.target, p.ts, min(q.ts) AS nxt FROM s p LEFT JOIN s q ON q.target = p.target AND q.ts >= p.ts + INTERVAL 6 HOUR GROUP BY p.target, p.ts),
k AS (WITH RECURSIVE r(target, ts) AS (
        SELECT target, min(ts) FROM s GROUP BY target
        UNION ALL SELECT r.target, nx.nxt FROM r JOIN nx ON nx.target = r.target AND nx.ts = r.ts WHERE nx.nxt IS NOT NULL)
      SELECT * FROM r)
SELECT s.id, s.target, s.ts FROM s JOIN k ON k.target = s.target AND k.ts = s.ts"""))
def throttle_spawns(spark, sf):
    return g.throttle_spawns(facts(spark, sf), HOURS_6, timedelta(hours=48)).select("id", "target", "ts")
