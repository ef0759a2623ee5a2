"""Sources, projections, filters, paging and typed lookups (A, B, C, D, E)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracewell.functions import actions as act
from tracewell.functions import predicates as pred
from tracewell.operators import dimensions, lookups, visibility
from tracewell.plans.binding import DISPLAY, NOW, facts, oracle, shown
from tracewell.plans.registry import query
from tracewell.schema import ACTION_TYPES, action_type_table

COLS = ", ".join(DISPLAY)
NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
UUID_7 = "00000000-0000-4000-8000-000000000007"

# The action-type dimension for checking queries.
TYPES_SQL = "(VALUES " + ", ".join(
    f"({t.id}, '{t.name}', '{t.token}', '{t.category}', '{t.direction}', '{t.verb}')" for t in ACTION_TYPES
) + ") AS d(type, name, token, category, direction, verb)"


# --- A: scan, dimensions ----------------------------------------------------

@query("scan_actions", oracle(f"SELECT {COLS} FROM a"))
def scan_actions(spark, sf):
    return shown(facts(spark, sf))


@query("resolve_users", oracle("""
SELECT coalesce(actor_uuid, actor_name) AS user_key, max(actor_uuid) AS uuid,
       arg_min(actor_name, id) AS name, min(ts) AS first_seen, max(ts) AS last_seen
FROM a GROUP BY 1"""))
def resolve_users(spark, sf):
    return dimensions.resolve_users(facts(spark, sf))


@query("resolve_users_new", oracle("""
SELECT coalesce(actor_uuid, actor_name) AS user_key, max(actor_uuid) AS uuid,
       arg_min(actor_name, id) AS name, min(ts) AS first_seen, max(ts) AS last_seen
FROM a WHERE coalesce(actor_uuid, actor_name) NOT IN
  (SELECT coalesce(actor_uuid, actor_name) FROM a WHERE ts < TIMESTAMP '2024-01-03 00:00:00')
GROUP BY 1"""))
def resolve_users_new(spark, sf):
    rows = facts(spark, sf)
    known = dimensions.resolve_users(rows.filter(F.col("ts") < pred.ts_lit(datetime(2024, 1, 3))))
    return dimensions.resolve_users(rows, known)


@query("resolve_worlds", oracle("SELECT DISTINCT world_key FROM a"))
def resolve_worlds(spark, sf):
    return dimensions.resolve_worlds(facts(spark, sf))


@query("with_dimensions", oracle("""
, u AS (SELECT user_id, max(actor_uuid) AS uuid, max(concat('user_', CAST(user_id AS varchar))) AS name FROM a GROUP BY user_id),
w AS (SELECT DISTINCT user_id % 3 AS world_id, world_key FROM a)
SELECT a.id, a.type, u.uuid AS actor_uuid, u.name AS actor_name, w.world_key
FROM a JOIN u ON a.user_id = u.user_id JOIN w ON a.user_id % 3 = w.world_id"""))
def with_dimensions(spark, sf):
    rows = facts(spark, sf).withColumn("world_id", F.col("user_id") % 3)
    users = rows.groupBy("user_id").agg(
        F.max("actor_uuid").alias("uuid"),
        F.max(F.concat(F.lit("user_"), F.col("user_id").cast("string"))).alias("name"),
    )
    worlds = rows.select("world_id", "world_key").distinct()
    bare = rows.select("id", "type", "user_id", "world_id")
    return dimensions.with_dimensions(bare, users, worlds).select("id", "type", "actor_uuid", "actor_name", "world_key")


@query("decode_type", oracle(f"""
SELECT a.id, a.type, ltrim(d.token, '+-') AS action, d.category, d.direction
FROM a JOIN {TYPES_SQL} ON a.type = d.type"""))
def decode_type(spark, sf):
    return dimensions.decode_type(facts(spark, sf)).select("id", "type", "action", "category", "direction")


@query("action_types", oracle(f"""
SELECT d.type, d.name, d.token, d.category, d.direction, count(a.id) AS n
FROM {TYPES_SQL} LEFT JOIN a ON a.type = d.type GROUP BY ALL"""))
def action_types(spark, sf):
    counts = facts(spark, sf).groupBy("type").agg(F.count("*").alias("c"))
    rows = action_type_table(spark).join(counts, "type", "left")
    return rows.select("type", "name", "token", "category", "direction", F.coalesce("c", F.lit(0)).alias("n"))


# --- B: projections ---------------------------------------------------------

@query("normalize_actions", oracle("""
, raw AS (
  SELECT id, CASE WHEN id % 10 <> 3 THEN type END AS type, CASE WHEN id % 3 = 0 THEN NULL ELSE actor_uuid END AS actor_uuid,
         CASE WHEN id % 4 = 0 THEN NULL ELSE actor_name END AS actor_name,
         CASE WHEN id % 11 <> 5 THEN world_key END AS world_key,
         CASE WHEN id % 5 = 1 THEN NULL ELSE target END AS target, CASE WHEN id % 6 = 2 THEN NULL ELSE amount END AS amount
  FROM a)
SELECT id, type, actor_uuid,
       CASE WHEN actor_uuid IS NULL AND actor_name IS NULL THEN '#unknown' ELSE coalesce(actor_name, '') END AS actor_name,
       world_key, coalesce(target, '') AS target, coalesce(amount, 1) AS amount
FROM raw WHERE type IS NOT NULL AND world_key IS NOT NULL"""))
def normalize_actions(spark, sf):
    i = F.col("id")
    raw = facts(spark, sf).select(
        "id",
        F.when(i % 10 != 3, F.col("type")).alias("type"),
        F.when(i % 3 != 0, F.col("actor_uuid")).alias("actor_uuid"),
        F.when(i % 4 != 0, F.col("actor_name")).alias("actor_name"),
        F.when(i % 11 != 5, F.col("world_key")).alias("world_key"),
        F.when(i % 5 != 1, F.col("target")).alias("target"),
        F.when(i % 6 != 2, F.col("amount")).alias("amount"),
    )
    return dimensions.normalize_actions(raw)


@query("redact_commands", oracle("""
SELECT id, type, CASE WHEN type = 10 THEN concat('/', regexp_extract(target, '^/*([^ ]+)', 1)) ELSE target END AS target FROM a"""))
def redact_commands(spark, sf):
    return facts(spark, sf).select("id", "type", act.redact_command(F.col("type"), F.col("target")).alias("target"))


@query("pseudonymize_ips", oracle("""
SELECT id, type, CASE WHEN type = 12 THEN CASE WHEN target = '' THEN '' ELSE concat('sha256:', substr(sha256(concat('pepper', target)), 1, 16)) END
            ELSE target END AS target FROM a"""))
def pseudonymize_ips(spark, sf):
    return facts(spark, sf).select(
        "id", "type", act.pseudonymize_join(F.col("type"), F.col("target"), "pepper").alias("target")
    )


@query("history_lines", oracle(f"""
, h AS (SELECT a.*, d.verb, CAST(epoch_us({NOW_SQL}) - epoch_us(a.ts) AS bigint) // 1000000 AS s
        FROM a JOIN {TYPES_SQL} ON a.type = d.type)
SELECT id, ts, concat(
  CASE WHEN s < 60 THEN concat(s, 's') WHEN s < 3600 THEN concat(s // 60, 'm') WHEN s < 86400 THEN concat(s // 3600, 'h')
       WHEN s < 1209600 THEN concat(s // 86400, 'd') ELSE concat(s // 604800, 'w') END,
  ' ago - ', actor_name, ' ', verb, ' ', target, ' (', x, ',', y, ',', z, ')',
  CASE WHEN rolled_back = 1 THEN ' [rolled back]' ELSE '' END) AS line FROM h"""))
def history_lines(spark, sf):
    return lookups.history_lines(facts(spark, sf), NOW)


@query("split_username_change", oracle("""
SELECT id, actor_name AS name, CASE WHEN contains(target, ' -> ') THEN split_part(target, ' -> ', 1) ELSE '?' END AS previous
FROM a WHERE type IN (9, 14)"""))
def split_username_change(spark, sf):
    rows = facts(spark, sf).filter(F.col("type").isin(9, 14))
    return rows.select("id", F.col("actor_name").alias("name"), act.previous_name(F.col("target")).alias("previous"))


CAUSES = ("fall", "inFire", "explosion.player", "starve", "inWall", "cactus")
ENTITIES = ("minecraft:creeper", "minecraft:zombie", "minecraft:arrow", "isle:fury")


@query("source_tag_of", oracle("""
, s AS (SELECT id, CASE amount % 6 WHEN 0 THEN 'fall' WHEN 1 THEN 'inFire' WHEN 2 THEN 'explosion.player' WHEN 3 THEN 'starve'
                       WHEN 4 THEN 'inWall' ELSE 'cactus' END AS cause,
               CASE WHEN id % 3 <> 0 THEN CASE amount % 4 WHEN 0 THEN 'minecraft:creeper' WHEN 1 THEN 'minecraft:zombie'
                       WHEN 2 THEN 'minecraft:arrow' ELSE 'isle:fury' END END AS direct,
               CASE WHEN id % 2 = 0 THEN 'minecraft:skeleton' END AS causing, block
        FROM a),
m AS (SELECT * FROM (VALUES ('minecraft:creeper', '#creeper'), ('minecraft:arrow', '#arrow')) AS v(e, tag)),
c AS (SELECT * FROM (VALUES ('fall', '#fall'), ('inFire', '#fire'), ('explosion.player', '#explosion'), ('inWall', '#suffocate')) AS v(e, tag))
SELECT s.id, coalesce(c.tag, m.tag, '#mob:' || s.direct, '#mob:' || s.causing) AS source_tag,
       CASE s.block WHEN 'minecraft:water' THEN '#fluid:water' ELSE '#block:' || s.block END AS block_tag
FROM s LEFT JOIN c ON s.cause = c.e LEFT JOIN m ON s.direct = m.e"""))
def source_tag_of(spark, sf):
    i = F.col("id")
    cause = F.get(F.array(*[F.lit(c) for c in CAUSES]), F.col("amount") % 6)
    direct = F.when(i % 3 != 0, F.get(F.array(*[F.lit(e) for e in ENTITIES]), F.col("amount") % 4))
    causing = F.when(i % 2 == 0, F.lit("minecraft:skeleton"))
    return facts(spark, sf).select(
        "id", act.source_tag_of(cause, direct, causing).alias("source_tag"), act.block_tag(F.col("block")).alias("block_tag")
    )


SENTINEL_SQL = ", ".join(f"'{s}'" for s in act.SENTINELS)


@query("classify_source", oracle(f"""
SELECT id, actor_name IN ({SENTINEL_SQL}) AS sentinel,
       coalesce(regexp_matches(source_tag, '^(#fire|#natural|#dispenser|#fluid)'), false) AS hot,
       CASE WHEN source_tag LIKE '#mob:%' THEN substr(source_tag, 6) END AS mob FROM a"""))
def classify_source(spark, sf):
    return facts(spark, sf).select(
        "id",
        act.is_sentinel(F.col("actor_name")).alias("sentinel"),
        act.is_hot_source(F.col("source_tag")).alias("hot"),
        act.mob_key(F.col("source_tag")).alias("mob"),
    )


@query("is_positional", oracle("""
SELECT id, type NOT IN (9, 10, 12, 13, 14) AS positional,
       old_block_state IS NOT NULL OR new_block_state IS NOT NULL AS payload FROM a"""))
def is_positional(spark, sf):
    rows = facts(spark, sf)
    for name in ("block_entity_nbt", "item_nbt", "entity_nbt"):
        rows = rows.withColumn(name, F.lit(None).cast("binary"))
    return rows.select("id", act.is_positional(F.col("type")).alias("positional"), act.has_payload().alias("payload"))


# --- C: filters --------------------------------------------------------------

def _filter(name, where, build):
    @query(name, oracle(f"SELECT {COLS} FROM a WHERE {where}"))
    def run(spark, sf):
        return shown(build(facts(spark, sf)))

    return run


_filter("by_ids", "id IN (3, 14, 159, 265, 358)", lambda df: pred.with_ids(df, [3, 14, 159, 265, 358]))
_filter(
    "by_ids_large",
    "id IN (SELECT o_orderkey FROM orders)",
    lambda df: pred.with_ids(
        df,
        df.sparkSession.read.parquet(df.inputFiles()[0].rsplit("/", 1)[0] + "/orders.parquet").select(
            F.col("o_orderkey").alias("id")
        ),
    ),
)
_filter(
    "by_users",
    f"(actor_uuid IN ('{UUID_7}') OR actor_name IN ('user_12', '#creeper'))",
    lambda df: df.filter(pred.by_users(["user_12", "#Creeper"], [UUID_7])),
)
_filter(
    "since",
    "ts >= TIMESTAMP '2024-01-20 00:00:00' AND ts <= TIMESTAMP '2024-01-25 12:00:00'",
    lambda df: pred.ActionFilter(since=NOW - timedelta(days=11), until=NOW - timedelta(days=5, hours=12)).apply(df),
)


def _ages(df):
    lo, hi = pred.age_bounds(NOW, timedelta(days=3), timedelta(days=10))
    return pred.ActionFilter(since=lo, until=hi).apply(df)


_filter("age_range", f"ts >= {NOW_SQL} - INTERVAL 10 DAY AND ts <= {NOW_SQL} - INTERVAL 3 DAY", _ages)
_filter("in_world", "world_key = 'minecraft:the_nether'", lambda df: df.filter(pred.in_world("Nether")))
_filter(
    "within_radius",
    "x BETWEEN -2 AND 4 AND z BETWEEN -3 AND 3 AND y BETWEEN 58 AND 64",
    lambda df: df.filter(pred.within_radius(1, 0, 3, 61)),
)
_filter(
    "within_radius_no_height",
    "x BETWEEN -2 AND 4 AND z BETWEEN -3 AND 3",
    lambda df: df.filter(pred.within_radius(1, 0, 3)),
)
_filter("by_types", "type IN (1, 2, 27, 28, 12)", lambda df: df.filter(pred.by_types(["+block", 2, "inventory", "login"])))
_filter(
    "by_family",
    "type IN (3, 4, 27, 28, 29, 30)",
    lambda df: df.filter(pred.by_family("container")),
)
INCLUDED = "('minecraft:red_sand', 'minecraft:fire')"
LIKES = " OR ".join(
    f"target LIKE '%={i}{tail}'" for i in ("minecraft:red_sand", "minecraft:fire") for tail in (",%", "|%", "")
)
IDS = [pred.qualify_id("red_sand"), "minecraft:fire"]
_filter(
    "include_targets",
    f"(target IN {INCLUDED} OR (type = 26 AND meta IN {INCLUDED}) OR (type = 8 AND ({LIKES})))",
    lambda df: df.filter(pred.include_targets(IDS)),
)
_filter(
    "exclude_targets",
    f"target NOT IN {INCLUDED} AND NOT (type = 26 AND meta IN {INCLUDED}) AND NOT (type = 8 AND ({LIKES}))",
    lambda df: df.filter(pred.exclude_targets(IDS)),
)
_filter("rolled_back_state", "rolled_back = 1", lambda df: df.filter(pred.rolled_back_state(True)))
_filter(
    "include_exploded",
    "type = 8 AND regexp_matches(target, '=minecraft:fire(,|\\||$)')",
    lambda df: df.filter(pred.include_exploded(["minecraft:fire"])),
)

BOXES = (("ann", -3, 60, -3, 2, 62, 5), ("bob", 0, 60, 0, 7, 63, 7), ("cho", -8, 0, -8, 300, 70, 300))
BOXES_SQL = "(VALUES " + ", ".join(str(b) for b in BOXES) + ") AS b(viewer, min_x, min_y, min_z, max_x, max_y, max_z)"


def boxes(spark):
    return spark.createDataFrame(
        list(BOXES), "viewer string, min_x int, min_y int, min_z int, max_x int, max_y int, max_z int"
    )


_filter(
    "within_regions",
    "x BETWEEN -3 AND 2 AND y BETWEEN 60 AND 62 AND z BETWEEN -3 AND 5",
    lambda df: lookups.within_regions(df, boxes(df.sparkSession), "ann"),
)


@query("within_any_region", oracle(f"""
SELECT b.viewer, a.id FROM a JOIN {BOXES_SQL} ON a.x BETWEEN b.min_x AND b.max_x AND a.y BETWEEN b.min_y AND b.max_y AND a.z BETWEEN b.min_z AND b.max_z"""))
def within_any_region(spark, sf):
    return lookups.within_any_region(facts(spark, sf), boxes(spark)).select("viewer", "id")


@query("within_any_region_newest", oracle(f"""
SELECT b.viewer, a.id FROM a JOIN {BOXES_SQL} ON a.x BETWEEN b.min_x AND b.max_x AND a.y BETWEEN b.min_y AND b.max_y AND a.z BETWEEN b.min_z AND b.max_z
QUALIFY row_number() OVER (PARTITION BY b.viewer ORDER BY a.ts DESC, a.id DESC) <= 20"""))
def within_any_region_newest(spark, sf):
    return lookups.within_any_region(facts(spark, sf), boxes(spark), 20).select("viewer", "id")


# --- D: paging and aggregation ----------------------------------------------

PAGE_WHERE = """ts >= TIMESTAMP '2024-01-10 00:00:00' AND world_key = 'minecraft:overworld' AND x BETWEEN -5 AND 5 AND z BETWEEN -5 AND 5
 AND type IN (1, 2, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 40) AND (target IN ('minecraft:stone', 'minecraft:dirt') OR (type = 26 AND meta IN ('minecraft:stone', 'minecraft:dirt')))"""


def recent_changes(spark, sf):
    """Who changed blocks around here in the last weeks."""
    flt = pred.ActionFilter(
        since=NOW - timedelta(days=21), world="overworld", x=0, z=0, radius=5, types=("block",),
        include=("minecraft:stone", "minecraft:dirt"),
    )
    return shown(flt.apply(facts(spark, sf)))


@query("lookup_page", oracle(f"SELECT {COLS} FROM a WHERE {PAGE_WHERE} ORDER BY ts DESC, id DESC LIMIT 50"))
def lookup_page(spark, sf):
    return lookups.page_newest(recent_changes(spark, sf), 50)


@query("page_newest", oracle(f"SELECT {COLS} FROM a ORDER BY ts DESC, id DESC LIMIT 20 OFFSET 40"))
def page_newest(spark, sf):
    return lookups.page_newest(shown(facts(spark, sf)), 20, 40)


@query("page_capped", oracle(f"""
, p AS (SELECT {COLS} FROM a ORDER BY ts DESC, id DESC LIMIT 100)
SELECT *, (SELECT count(*) FROM p) = 100 AS truncated FROM p"""))
def page_capped(spark, sf):
    return lookups.page_capped(shown(facts(spark, sf)), 500, 100)


@query("page_summary", oracle("""
SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 7.0) AS bigint)) AS pages, CAST(3 AS int) AS page
FROM a WHERE type IN (1, 2)"""))
def page_summary(spark, sf):
    return lookups.page_summary(facts(spark, sf).filter(pred.by_types([1, 2])), 3, 7)


@query("count_matching", oracle("SELECT count(*) AS n FROM a WHERE rolled_back = 0 AND type IN (3, 4, 27, 28, 29, 30)"))
def count_matching(spark, sf):
    flt = pred.ActionFilter(types=("container",), rolled_back=False)
    return lookups.count_matching(flt.apply(facts(spark, sf)))


PROBE_SQL = ", p AS (SELECT id AS probe_id, actor_uuid, world_key, x, y, z FROM a WHERE type IN (1, 2, 39) AND actor_uuid IS NOT NULL)"


def _probes(rows):
    return rows.filter(F.col("type").isin(1, 2, 39) & F.col("actor_uuid").isNotNull()).select(
        F.col("id").alias("probe_id"), "actor_uuid", "world_key", "x", "y", "z"
    )


def _probe_query(name, type_id, days, negate):
    window = f"AND a.ts >= {NOW_SQL} - INTERVAL {days} DAY AND a.ts <= {NOW_SQL}" if days else ""
    kind = "NOT EXISTS" if negate else "EXISTS"

    @query(name, oracle(f"""{PROBE_SQL}
SELECT p.* FROM p WHERE {kind} (SELECT 1 FROM a WHERE a.type = {type_id} AND a.actor_uuid = p.actor_uuid AND a.world_key = p.world_key
   AND a.x = p.x AND a.y = p.y AND a.z = p.z {window})"""))
    def run(spark, sf):
        rows = facts(spark, sf)
        fn = lookups.has_placed if type_id == 1 else lookups.has_removed
        span = timedelta(days=days) if days else None
        return fn(_probes(rows), rows, span, NOW, negate).select("probe_id", "actor_uuid", "world_key", "x", "y", "z")

    return run


_probe_query("has_placed", 1, 0, False)
_probe_query("has_removed", 2, 20, False)
_probe_query("has_not_placed", 1, 20, True)


@query("count_by_type", oracle("SELECT type, count(*) AS n FROM a WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY type"))
def count_by_type(spark, sf):
    return lookups.count_by_type(facts(spark, sf).filter(pred.since(NOW - timedelta(days=7))))


@query("user_last_n", oracle(f"""
SELECT {COLS}, CAST(rn AS int) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS rn FROM a) WHERE rn <= 5"""))
def user_last_n(spark, sf):
    return lookups.user_last_n(shown(facts(spark, sf)), 5)


@query("region_unrolled", oracle(f"""
SELECT {COLS} FROM a WHERE world_key = 'minecraft:the_end' AND x BETWEEN -2 AND 4 AND z BETWEEN -2 AND 4 AND rolled_back = 0
ORDER BY ts DESC, id DESC LIMIT 100"""))
def region_unrolled(spark, sf):
    return lookups.region_unrolled(shown(facts(spark, sf)), "end", 1, 1, 3, 100)


RATE_SPAN = 86_400


@query("event_rate", oracle(f"""
, r AS (SELECT type, count(*) AS n FROM a WHERE ts >= {NOW_SQL} - INTERVAL {RATE_SPAN * 5 - 1} SECOND AND ts < {NOW_SQL} + INTERVAL 1 SECOND GROUP BY type)
SELECT type, n, CAST(n AS double) / CAST({RATE_SPAN * 5} AS double) AS per_second FROM r
UNION ALL SELECT CAST(NULL AS int), CAST(coalesce(sum(n), 0) AS bigint), CAST(coalesce(sum(n), 0) AS double) / CAST({RATE_SPAN * 5} AS double) FROM r"""))
def event_rate(spark, sf):
    return lookups.event_rate(facts(spark, sf), NOW, RATE_SPAN * 5)


VIEWERS = (("ann", 2), ("bob", 4), ("cho", 0), ("dee", 3))
GRANTS = (("ann", "lookup.chat", True), ("ann", "lookup.block", False), ("cho", "lookup.item", True), ("cho", "lookup", True), ("dee", "lookup.session", False))
NODE_SQL = "(VALUES " + ", ".join(
    f"({t.id}, '{visibility.node_of('lookup', t.name, t.category)}', "
    f"{visibility.NODE_LEVELS[visibility.node_of('lookup', t.name, t.category)]})" for t in ACTION_TYPES
) + ") AS n(type, node, need)"
VISIBLE_SQL = f""", vis AS (
  SELECT v.viewer, n.type FROM (VALUES {", ".join(str(v) for v in VIEWERS)}) AS v(viewer, op_level)
  JOIN {NODE_SQL} ON true
  LEFT JOIN (VALUES {", ".join(f"('{a}', '{b}', {str(c).lower()})" for a, b, c in GRANTS)}) AS g(viewer, node, granted)
    ON g.viewer = v.viewer AND g.node = n.node
  WHERE coalesce(g.granted, v.op_level >= n.need))"""


def _visible(spark):
    viewers = spark.createDataFrame(list(VIEWERS), "viewer string, op_level int")
    grants = spark.createDataFrame(list(GRANTS), "viewer string, node string, granted boolean")
    return visibility.visible_types(viewers, grants, visibility.type_nodes(spark))


@query("visible_types", oracle(f"{VISIBLE_SQL} SELECT vis.viewer, a.type, count(*) AS n FROM a JOIN vis ON vis.type = a.type GROUP BY ALL"))
def visible_types(spark, sf):
    counts = facts(spark, sf).groupBy("type").agg(F.count("*").alias("n"))
    return _visible(spark).join(counts, "type").select("viewer", "type", "n")


@query("page_visible", oracle(f"""{VISIBLE_SQL}
SELECT {COLS} FROM a WHERE type IN (SELECT type FROM vis WHERE viewer = 'ann') ORDER BY ts DESC, id DESC LIMIT 25 OFFSET 50"""))
def page_visible(spark, sf):
    return visibility.page_visible(shown(facts(spark, sf)), _visible(spark), "ann", 3, 25)


@query("count_visible", oracle(f"""{VISIBLE_SQL}
SELECT vis.viewer, count(*) AS n FROM a JOIN vis ON vis.type = a.type GROUP BY vis.viewer"""))
def count_visible(spark, sf):
    rows = visibility.count_visible(facts(spark, sf), _visible(spark))
    return rows.select("viewer", "n")


# --- E: typed lookups ---------------------------------------------------------

CELL_SQL = "world_key = 'minecraft:overworld' AND x = 3 AND y = 63 AND z = -6"
HERE = ("overworld", 3, 63, -6)
WHO = "id, ts, actor_uuid, actor_name"


def _cell(spark, sf):
    """A cell that holds rows of every family at the sizes used."""
    return facts(spark, sf)


@query("block_lookup", oracle(f"""
SELECT {WHO}, world_key, x, y, z, target, meta, ltrim(d.token, '+-') AS action, rolled_back, source_tag, old_block_state, new_block_state
FROM a JOIN {TYPES_SQL} ON a.type = d.type WHERE {CELL_SQL} AND d.category = 'BLOCK'"""))
def block_lookup(spark, sf):
    return lookups.block_lookup(_cell(spark, sf), *HERE, NOW)


@query("container_lookup", oracle(f"""
SELECT {WHO}, world_key, x, y, z, target, meta, CASE WHEN d.direction = '-' THEN -amount ELSE amount END AS delta, rolled_back, source_tag
FROM a JOIN {TYPES_SQL} ON a.type = d.type WHERE {CELL_SQL} AND d.category = 'CONTAINER' AND ts >= {NOW_SQL} - INTERVAL 28 DAY"""))
def container_lookup(spark, sf):
    return lookups.container_lookup(_cell(spark, sf), *HERE, NOW, timedelta(days=28))


def _message(name, type_id, kind):
    @query(name, oracle(f"""
SELECT {WHO}, target AS message, '{kind}' AS kind FROM a WHERE actor_uuid = '{UUID_7}' AND type = {type_id} ORDER BY ts DESC, id DESC LIMIT 7"""))
    def run(spark, sf):
        return getattr(lookups, name)(facts(spark, sf), UUID_7, NOW)

    return run


_message("chat_lookup", 9, "chat")
_message("command_lookup", 10, "command")


def _items(name, types):
    @query(name, oracle(f"""
SELECT {WHO}, world_key, x, y, z, target, meta, amount, ltrim(d.token, '+-') AS action, source_tag
FROM a JOIN {TYPES_SQL} ON a.type = d.type WHERE actor_uuid = '{UUID_7}' AND a.type IN {types} AND ts >= {NOW_SQL} - INTERVAL 25 DAY
ORDER BY ts DESC, id DESC LIMIT 30"""))
    def run(spark, sf):
        return getattr(lookups, name)(facts(spark, sf), UUID_7, NOW, timedelta(days=25), 30)

    return run


_items("item_lookup", "(5, 6, 31)")
_items("inventory_lookup", "(27, 28)")


@query("session_lookup", oracle(f"""
SELECT {WHO}, world_key, CASE WHEN type = 12 THEN 'join' ELSE 'leave' END AS direction, target
FROM a WHERE actor_uuid = '{UUID_7}' AND type IN (12, 13) ORDER BY ts DESC, id DESC LIMIT 40"""))
def session_lookup(spark, sf):
    return lookups.session_lookup(facts(spark, sf), UUID_7, NOW, None, 40)


@query("username_lookup", oracle(f"""
SELECT id, ts, actor_uuid, actor_name AS name, split_part(target, ' -> ', 1) AS previous
FROM a WHERE actor_uuid = '{UUID_7}' AND type = 14 ORDER BY ts DESC, id DESC LIMIT 40"""))
def username_lookup(spark, sf):
    return lookups.username_lookup(facts(spark, sf), UUID_7, NOW, None, 40)


@query("sign_lookup", oracle(f"""
SELECT {WHO}, world_key, x, y, z, target AS line, source_tag, sign_side, sign_dye_color, sign_waxed
FROM a WHERE type = 11 AND world_key = 'minecraft:the_end' AND x = -1 AND y = 63 AND z = -6"""))
def sign_lookup(spark, sf):
    return lookups.sign_lookup(facts(spark, sf), "end", -1, 63, -6, NOW)


@query("near", oracle(f"""
SELECT {COLS} FROM a WHERE world_key = 'minecraft:the_nether' AND x BETWEEN -5 AND 5 AND z BETWEEN -5 AND 5 AND y BETWEEN 56 AND 66
 AND ts >= {NOW_SQL} - INTERVAL 5 DAY ORDER BY ts DESC, id DESC LIMIT 7"""))
def near(spark, sf):
    return lookups.near(shown(facts(spark, sf)), "nether", 0, 61, 0, NOW, age=timedelta(days=5))


@query("near_points", oracle(f"""
, p AS (SELECT id AS point_id, world_key, x, y, z FROM a WHERE type = 37 AND ts >= {NOW_SQL} - INTERVAL 5 DAY)
SELECT p.point_id, a.id FROM p JOIN a ON a.world_key = p.world_key AND a.x BETWEEN p.x - 2 AND p.x + 2 AND a.y BETWEEN p.y - 2 AND p.y + 2
  AND a.z BETWEEN p.z - 2 AND p.z + 2 AND a.ts >= {NOW_SQL} - INTERVAL 5 DAY"""))
def near_points(spark, sf):
    rows = facts(spark, sf)
    recent = rows.filter((F.col("type") == 37) & pred.since(NOW - timedelta(days=5)))
    points = recent.select(F.col("id").alias("point_id"), "world_key", "x", "y", "z")
    return lookups.near_points(rows, points, NOW, 2, timedelta(days=5)).select("point_id", "id")


@query("near_points_newest", oracle(f"""
, p AS (SELECT id AS point_id, world_key, x, y, z FROM a WHERE type = 37 AND ts >= {NOW_SQL} - INTERVAL 5 DAY)
SELECT p.point_id, a.id FROM p JOIN a ON a.world_key = p.world_key AND a.x BETWEEN p.x - 5 AND p.x + 5 AND a.y BETWEEN p.y - 5 AND p.y + 5
  AND a.z BETWEEN p.z - 5 AND p.z + 5 AND a.ts >= {NOW_SQL} - INTERVAL 5 DAY
QUALIFY row_number() OVER (PARTITION BY p.point_id ORDER BY a.ts DESC, a.id DESC) <= 3"""))
def near_points_newest(spark, sf):
    """The three newest rows around every portal."""
    rows = facts(spark, sf)
    recent = rows.filter((F.col("type") == 37) & pred.since(NOW - timedelta(days=5)))
    points = recent.select(F.col("id").alias("point_id"), "world_key", "x", "y", "z")
    return lookups.near_points(rows, points, NOW, 5, timedelta(days=5), limit=3).select("point_id", "id")


@query("inspect_cell", oracle(f"""
, h AS (SELECT a.*, d.verb, CAST(epoch_us({NOW_SQL}) - epoch_us(a.ts) AS bigint) // 1000000 AS s
        FROM a JOIN {TYPES_SQL} ON a.type = d.type WHERE {CELL_SQL} ORDER BY ts DESC, id DESC LIMIT 10)
SELECT id, ts, concat(
  CASE WHEN s < 60 THEN concat(s, 's') WHEN s < 3600 THEN concat(s // 60, 'm') WHEN s < 86400 THEN concat(s // 3600, 'h')
       WHEN s < 1209600 THEN concat(s // 86400, 'd') ELSE concat(s // 604800, 'w') END,
  ' ago - ', actor_name, ' ', verb, ' ', target, ' (', x, ',', y, ',', z, ')',
  CASE WHEN rolled_back = 1 THEN ' [rolled back]' ELSE '' END) AS line FROM h"""))
def inspect_cell(spark, sf):
    return lookups.inspect_cell(facts(spark, sf), *HERE, NOW, 10)


@query("pending_lookup", oracle(f"""
SELECT {COLS} FROM a WHERE world_key = 'minecraft:overworld' AND x = 3 AND y = 63 AND z = -6 AND ts > TIMESTAMP '2024-01-16 00:00:00'"""))
def pending_lookup(spark, sf):
    rows = shown(facts(spark, sf))
    stored = rows.filter(F.col("ts") <= pred.ts_lit(NOW - timedelta(days=15)))
    return lookups.pending_lookup(rows, stored, *HERE)


@query("pending_and_stored", oracle(f"""
SELECT {COLS}, ts > TIMESTAMP '2024-01-16 00:00:00' AS pending FROM a WHERE {CELL_SQL}"""))
def pending_and_stored(spark, sf):
    rows = shown(facts(spark, sf))
    stored = rows.filter(F.col("ts") <= pred.ts_lit(NOW - timedelta(days=15)))
    return lookups.pending_and_stored(rows, stored, *HERE)
