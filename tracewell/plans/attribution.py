"""Attribution joins (H)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tracewell.operators import attribution as att
from tracewell.plans.binding import facts, oracle
from tracewell.plans.registry import query

HOURS_6 = timedelta(hours=6)
DAY = timedelta(days=1)
CELL = "world_key, x, y, z"
SAME_CELL = "r.world_key = p.world_key AND r.x = p.x AND r.y = p.y AND r.z = p.z"
EARLIER = "(r.ts < p.ts OR (r.ts = p.ts AND r.id < p.id))"


def _victim():
    return F.concat_ws(":", "world_key", F.col("x").cast("string"))


HITS_SQL = """
, h AS (SELECT id, ts, concat(world_key, ':', x) AS victim, user_id AS attacker FROM a WHERE type = 33),
p AS (SELECT id, ts, concat(world_key, ':', x) AS victim FROM a WHERE type = 7)"""


def _hits(rows):
    hits = rows.filter(F.col("type") == 33).select("id", "ts", _victim().alias("victim"), F.col("user_id").alias("attacker"))
    deaths = rows.filter(F.col("type") == 7).select("id", "ts", _victim().alias("victim"))
    return hits, deaths


@query("attribute_last_hit", oracle(f"""{HITS_SQL},
j AS (SELECT p.id, p.ts, p.victim, arg_max(r.attacker, r.ts) AS attacker, max(r.ts) AS hit_ts
      FROM p LEFT JOIN h r ON r.victim = p.victim AND {EARLIER} GROUP BY p.id, p.ts, p.victim)
SELECT id, ts, victim, CASE WHEN ts - hit_ts <= INTERVAL 24 HOUR THEN attacker END AS attacker,
       CASE WHEN ts - hit_ts <= INTERVAL 24 HOUR THEN hit_ts END AS hit_ts FROM j"""))
def attribute_last_hit(spark, sf):
    hits, deaths = _hits(facts(spark, sf))
    return att.attribute_last_hit(deaths, hits, DAY)


@query("attribute_last_hit_forget", oracle(f"""{HITS_SQL},
f AS (SELECT id, ts, concat(world_key, ':', x) AS victim, CAST(NULL AS bigint) AS attacker FROM a WHERE type = 13),
ev AS (SELECT * FROM h UNION ALL SELECT id, ts, victim, attacker FROM f),
j AS (SELECT p.id, p.ts, p.victim, max(struct_pack(t := r.ts, a := r.attacker)) AS m FROM p LEFT JOIN ev r ON r.victim = p.victim AND {EARLIER} GROUP BY p.id, p.ts, p.victim)
SELECT id, ts, victim, CASE WHEN ts - m.t <= INTERVAL 24 HOUR THEN m.a END AS attacker,
       CASE WHEN ts - m.t <= INTERVAL 24 HOUR AND m.a IS NOT NULL THEN m.t END AS hit_ts FROM j"""))
def attribute_last_hit_forget(spark, sf):
    rows = facts(spark, sf)
    hits, deaths = _hits(rows)
    forgets = rows.filter(F.col("type") == 13).select("id", "ts", _victim().alias("victim"))
    return att.attribute_last_hit(deaths, hits, DAY, forgets)


PRIME_SQL = """
, s AS (SELECT id, ts, world_key, x, z - (z % 2) AS z, 0 AS y, actor_uuid, actor_name,
               CASE WHEN type = 16 THEN CASE amount % 3 WHEN 0 THEN 'PLAYER_DIRECT' WHEN 1 THEN 'PLAYER_INDIRECT' ELSE 'NATURAL_SPAWN' END END AS kind,
               type = 16 AS is_record FROM a WHERE type IN (8, 16))"""


def _primes(rows):
    cell = [F.col("world_key"), F.col("x"), F.lit(0).alias("y"), (F.col("z") - F.col("z") % 2).alias("z")]
    kind = F.get(F.array(F.lit("PLAYER_DIRECT"), F.lit("PLAYER_INDIRECT"), F.lit("NATURAL_SPAWN")), F.col("amount") % 3)
    primes = rows.filter(F.col("type") == 16).select("id", "ts", *cell, "actor_uuid", "actor_name", kind.alias("kind"))
    blasts = rows.filter(F.col("type") == 8).select("id", "ts", *cell)
    return primes, blasts


@query("attribute_prime", oracle(f"""{PRIME_SQL},
l AS (SELECT *, lag(struct_pack(r := is_record, u := actor_uuid, n := actor_name, k := kind, t := ts)) OVER (PARTITION BY world_key, x, z ORDER BY ts, id) AS b FROM s),
g AS (SELECT *, coalesce(b.r AND b.u IS NOT NULL AND b.k LIKE 'PLAYER%' AND ts - b.t <= INTERVAL 240 HOUR, false) AS ok FROM l WHERE NOT is_record)
SELECT id, ts, {CELL}, CASE WHEN ok THEN b.u END AS prime_uuid, CASE WHEN ok THEN b.n END AS prime_name, CASE WHEN ok THEN b.k END AS prime_kind,
       CASE WHEN ok THEN CASE WHEN b.k = 'PLAYER_DIRECT' THEN 0 ELSE 1 END END AS distance FROM g"""))
def attribute_prime(spark, sf):
    primes, blasts = _primes(facts(spark, sf))
    return att.attribute_prime(blasts, primes, timedelta(hours=240), span=timedelta(hours=240))


@query("peek_prime", oracle(f"""{PRIME_SQL},
j AS (SELECT p.id, p.ts, p.world_key, p.x, p.y, p.z, max(struct_pack(t := r.ts, u := r.actor_uuid, n := r.actor_name, k := r.kind)) AS m
      FROM (SELECT * FROM s WHERE NOT is_record) p LEFT JOIN (SELECT * FROM s WHERE is_record) r ON {SAME_CELL} AND {EARLIER} GROUP BY ALL)
SELECT id, ts, {CELL}, CASE WHEN ts - m.t <= INTERVAL 240 HOUR THEN m.u END AS prime_uuid, CASE WHEN ts - m.t <= INTERVAL 240 HOUR THEN m.n END AS prime_name,
       CASE WHEN ts - m.t <= INTERVAL 240 HOUR THEN m.k END AS prime_kind FROM j"""))
def peek_prime(spark, sf):
    primes, blasts = _primes(facts(spark, sf))
    return att.peek_prime(blasts, primes, timedelta(hours=240), span=timedelta(hours=240))


ALLOW = ("dragons", "minecraft:ravager")
CAUSERS_SQL = """
, c AS (SELECT id AS rid, world_key, x, y, z, ts, actor_uuid, actor_name, substr(source_tag, 6) AS mob,
               source_tag IN ('#mob:dragons:fire', '#mob:minecraft:ravager') AS allowed
        FROM a WHERE type = 26 AND source_tag LIKE '#mob:%'),
f AS (SELECT id, ts, world_key, x, y, z FROM a WHERE type IN (15, 16))"""


def _fires(rows):
    fires = rows.filter(F.col("type").isin(15, 16)).select("id", "ts", "world_key", "x", "y", "z")
    return fires, att.couple_entity_changes(rows, ALLOW)


@query("couple_entity_changes", oracle(f"{CAUSERS_SQL} SELECT * FROM c"))
def couple_entity_changes(spark, sf):
    return att.couple_entity_changes(facts(spark, sf), ALLOW)


@query("peek_fire_causer", oracle(f"""{CAUSERS_SQL},
j AS (SELECT f.id, c.*, row_number() OVER (PARTITION BY f.id ORDER BY c.ts DESC, c.x, c.y, c.z) AS n
      FROM f JOIN c ON c.world_key = f.world_key AND abs(c.x - f.x) <= 2 AND abs(c.y - f.y) <= 2 AND abs(c.z - f.z) <= 2
        AND (c.ts < f.ts OR (c.ts = f.ts AND c.rid < f.id)) AND f.ts - c.ts <= INTERVAL 6 HOUR)
SELECT f.*, j.rid, j.actor_uuid AS causer_actor_uuid, j.actor_name AS causer_actor_name, j.mob AS causer_mob, j.allowed AS causer_allowed
FROM f LEFT JOIN j ON j.id = f.id AND j.n = 1"""))
def peek_fire_causer(spark, sf):
    return att.peek_fire_causer(*_fires(facts(spark, sf)), ttl=HOURS_6)


# Fires in their order, one after the other: each takes the first candidate that none before it took.
FIRE_SQL = oracle(f"""{CAUSERS_SQL},
k AS (SELECT f.id, c.rid, row_number() OVER (PARTITION BY f.id, c.x, c.y, c.z ORDER BY c.ts DESC, c.rid DESC) AS n, c.ts AS cts, c.x, c.y, c.z, f.ts
      FROM f JOIN c ON c.world_key = f.world_key AND abs(c.x - f.x) <= 2 AND abs(c.y - f.y) <= 2 AND abs(c.z - f.z) <= 2
        AND (c.ts < f.ts OR (c.ts = f.ts AND c.rid < f.id))),
o AS (SELECT f.id, row_number() OVER (ORDER BY f.ts, f.id) AS turn, coalesce(l.rids, []) AS rids
      FROM f LEFT JOIN (SELECT id, list(rid ORDER BY cts DESC, x, y, z) AS rids FROM k WHERE n = 1 AND ts - cts <= INTERVAL 6 HOUR GROUP BY id) l ON l.id = f.id),
r(turn, id, rid, used) AS (
  SELECT CAST(0 AS bigint), CAST(NULL AS bigint), CAST(NULL AS bigint), CAST([] AS bigint[]) UNION ALL
  SELECT o.turn, o.id, t.rid, CASE WHEN t.rid IS NULL THEN r.used ELSE list_append(r.used, t.rid) END
  FROM r JOIN o ON o.turn = r.turn + 1, LATERAL (SELECT list_filter(o.rids, lambda v: NOT list_contains(r.used, v))[1] AS rid) t)
SELECT r.id, r.rid, c.mob AS causer_mob, CASE WHEN r.rid IS NULL THEN 'PASSTHROUGH' WHEN c.allowed THEN 'PAIR' ELSE 'SUPPRESS' END AS verdict
FROM r LEFT JOIN c ON c.rid = r.rid WHERE r.turn > 0""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("attribute_fire", FIRE_SQL)
def attribute_fire(spark, sf):
    return att.attribute_fire(*_fires(facts(spark, sf)), ttl=HOURS_6).select("id", "rid", "causer_mob", "verdict")


@query("attribute_fluid", oracle("""
, s AS (SELECT id AS rid, world_key, x, y, z, ts, actor_uuid, actor_name FROM a WHERE type = 23),
f AS (SELECT id, ts, world_key, x, y, z FROM a WHERE type = 40),
j AS (SELECT f.id, s.rid, s.actor_uuid, s.actor_name, abs(s.x - f.x) + abs(s.y - f.y) + abs(s.z - f.z) AS dist,
             row_number() OVER (PARTITION BY f.id ORDER BY abs(s.x - f.x) + abs(s.y - f.y) + abs(s.z - f.z), s.ts DESC, s.rid DESC) AS n
      FROM f JOIN s ON s.world_key = f.world_key AND abs(s.x - f.x) + abs(s.y - f.y) + abs(s.z - f.z) <= 8
        AND (s.ts < f.ts OR (s.ts = f.ts AND s.rid < f.id)) AND f.ts - s.ts <= INTERVAL 6 HOUR)
SELECT f.id, j.rid, CAST(j.dist AS int) AS dist, j.actor_uuid AS source_uuid,
       CASE WHEN j.actor_uuid IS NULL THEN '#fluid' ELSE j.actor_name END AS source_name FROM f LEFT JOIN j ON j.id = f.id AND j.n = 1"""))
def attribute_fluid(spark, sf):
    rows = facts(spark, sf)
    sources = rows.filter(F.col("type") == 23).select(
        F.col("id").alias("rid"), "world_key", "x", "y", "z", "ts", "actor_uuid", "actor_name"
    )
    flows = rows.filter(F.col("type") == 40).select("id", "ts", "world_key", "x", "y", "z")
    found = att.attribute_fluid(flows, sources, ttl=HOURS_6)
    return found.select("id", "rid", "dist", "source_uuid", "source_name")


# Entities are the users of the facts; their ties come from their own rows.
ENTITY_SQL = """
, ent AS (SELECT user_id AS entity, user_id % 11 = 0 AS is_player,
                 CASE WHEN sum(amount) % 5 = 0 THEN user_id + 1000 END AS rider, CASE WHEN sum(amount) % 7 = 1 THEN user_id + 2000 END AS owner,
                 CASE WHEN count(*) % 3 <> 0 THEN CAST(user_id + 1 + count(*) % 4 AS bigint) END AS shooter,
                 CASE WHEN max(id) % 2 = 0 THEN user_id + 3000 END AS stored_owner, user_id % 4 = 0 AS in_raid FROM a GROUP BY user_id),
r0 AS (SELECT *, coalesce(is_player, false) OR rider IS NOT NULL OR owner IS NOT NULL AS settled FROM ent),
k AS (SELECT entity AS src, CASE WHEN NOT settled THEN shooter END AS dst FROM r0),
w1 AS (SELECT k.src AS entity, coalesce(k.dst, k.src) AS e1, CASE WHEN k.dst IS NULL THEN 0 ELSE 1 END AS d1 FROM k),
w2 AS (SELECT w1.entity, coalesce(k.dst, e1) AS e2, d1 + CASE WHEN k.dst IS NULL THEN 0 ELSE 1 END AS d2 FROM w1 LEFT JOIN k ON k.src = e1),
w3 AS (SELECT w2.entity, coalesce(k.dst, e2) AS e3, d2 + CASE WHEN k.dst IS NULL THEN 0 ELSE 1 END AS d3 FROM w2 LEFT JOIN k ON k.src = e2),
w4 AS (SELECT w3.entity, coalesce(k.dst, e3) AS answers, d3 + CASE WHEN k.dst IS NULL THEN 0 ELSE 1 END AS depth FROM w3 LEFT JOIN k ON k.src = e3),
hit AS (SELECT id, ts, user_id AS attacker, amount AS victim FROM a WHERE type = 33),
p AS (SELECT a.id, a.ts, a.user_id AS entity, w4.answers, w4.depth, r0.* EXCLUDE (entity) FROM a JOIN w4 ON w4.entity = a.user_id LEFT JOIN r0 ON r0.entity = w4.answers WHERE a.type = 26),
j AS (SELECT p.id, max(struct_pack(t := r.ts, a := r.attacker)) AS m FROM p LEFT JOIN hit r ON r.victim = p.answers AND (r.ts < p.ts OR (r.ts = p.ts AND r.id < p.id)) GROUP BY p.id),
q AS (SELECT p.*, CASE WHEN p.ts - j.m.t <= INTERVAL 240 HOUR THEN j.m.a END AS attacker FROM p JOIN j ON j.id = p.id),
v AS (SELECT *, CASE WHEN depth >= 4 THEN 'UNKNOWN' WHEN is_player THEN 'PLAYER_DIRECT' WHEN rider IS NOT NULL THEN 'PLAYER_RIDER' WHEN owner IS NOT NULL THEN 'PLAYER_OWNER'
        WHEN attacker IS NOT NULL THEN 'PLAYER_INDIRECT' WHEN stored_owner IS NOT NULL THEN 'PLAYER_TAMER'
        WHEN in_raid THEN 'NATURAL_RAID' ELSE 'NATURAL_SPAWN' END AS k FROM q)
SELECT id, ts, entity, CASE WHEN depth < 4 THEN coalesce(CASE WHEN is_player THEN answers END, rider, owner, attacker, stored_owner) END AS responsible,
       CASE WHEN depth > 0 AND k LIKE 'PLAYER%' THEN 'PLAYER_PROJECTILE' ELSE k END AS kind FROM v"""


@query("attribute_entity", oracle(ENTITY_SQL))
def attribute_entity(spark, sf):
    rows = facts(spark, sf)
    u, n, total = F.col("user_id"), F.count("*"), F.sum("amount")
    entities = rows.groupBy("user_id").agg(
        (u % 11 == 0).alias("is_player"),
        F.when(total % 5 == 0, u + 1000).alias("rider"),
        F.when(total % 7 == 1, u + 2000).alias("owner"),
        F.when(n % 3 != 0, u + 1 + n % 4).alias("shooter"),
        F.when(F.max("id") % 2 == 0, u + 3000).alias("stored_owner"),
        (u % 4 == 0).alias("in_raid"),
    ).withColumnRenamed("user_id", "entity")
    hits = rows.filter(F.col("type") == 33).select(
        "id", "ts", F.col("amount").cast("long").alias("victim"), F.col("user_id").alias("attacker")
    )
    probes = rows.filter(F.col("type") == 26).select("id", "ts", F.col("user_id").alias("entity"))
    return att.attribute_entity(probes, entities, hits, timedelta(hours=240))
