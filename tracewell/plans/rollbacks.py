"""Rollback plans, mutations, ledger, affected-block lists (F, G)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tracewell.functions.predicates import ActionFilter
from tracewell.operators import explosions, ledger, rollback
from tracewell.plans.binding import DISPLAY, NOW, facts, oracle, shown
from tracewell.plans.registry import query
from tracewell.schema import NEWEST_WINS, ROLLBACKABLE

COLS = ", ".join(DISPLAY)
ROLL = str(ROLLBACKABLE)
WINS = str(NEWEST_WINS)
CELL = "world_key, x, y, z"


def planned_sql(where: str, source: str = "a") -> str:
    """CTEs ``c`` (candidates) and ``plan`` for checking queries."""
    return f"""
, c AS (SELECT * FROM {source} WHERE {where} AND type IN {ROLL}),
plan AS (
  SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY {CELL} ORDER BY ts DESC, id DESC) AS r FROM c WHERE type IN {WINS}) WHERE r = 1
  UNION ALL SELECT * FROM c WHERE type NOT IN {WINS})"""


SINCE = NOW - timedelta(days=25)
SINCE_SQL = "ts >= TIMESTAMP '2024-01-06 00:00:00'"
NEARBY = ActionFilter(since=SINCE, world="overworld", x=0, z=0, radius=4)
NEARBY_SQL = f"{SINCE_SQL} AND world_key = 'minecraft:overworld' AND x BETWEEN -4 AND 4 AND z BETWEEN -4 AND 4"
ALL_SINCE = ActionFilter(since=SINCE)


@query("split_rollbackable", oracle(f"SELECT id, type, type IN {ROLL} AS rollbackable FROM a"))
def split_rollbackable(spark, sf):
    return rollback.split_rollbackable(facts(spark, sf)).select("id", "type", "rollbackable")


@query("newest_per_position", oracle(f"{planned_sql('rolled_back = 0')} SELECT {COLS} FROM plan"))
def newest_per_position(spark, sf):
    rows = shown(facts(spark, sf)).filter((F.col("rolled_back") == 0) & rollback.is_rollbackable())
    return rollback.newest_per_position(rows)


@query("plan_rollback", oracle(f"{planned_sql(f'{NEARBY_SQL} AND rolled_back = 0')} SELECT {COLS} FROM plan"))
def plan_rollback(spark, sf):
    return rollback.plan_rollback(shown(facts(spark, sf)), NEARBY)


@query("plan_restore", oracle(f"{planned_sql(f'{SINCE_SQL} AND rolled_back = 1')} SELECT {COLS} FROM plan"))
def plan_restore(spark, sf):
    return rollback.plan_restore(shown(facts(spark, sf)), ALL_SINCE)


AFFECTED_SQL = """
, lists AS (SELECT id, ts, world_key, x AS cx, y AS cy, z AS cz, rolled_back, type,
                   unnest(string_split(target, ',')) AS piece, generate_subscripts(string_split(target, ','), 1) - 1 AS pos FROM a WHERE type = 8),
blocks AS (SELECT id, ts, world_key, cx, cy, cz, rolled_back, CAST(pos AS int) AS pos,
             CAST(split_part(split_part(piece, '=', 1), ':', 1) AS int) AS x, CAST(split_part(split_part(piece, '=', 1), ':', 2) AS int) AS y,
             CAST(split_part(split_part(piece, '=', 1), ':', 3) AS int) AS z, split_part(substr(piece, strpos(piece, '=') + 1), '|', 1) AS block,
             nullif(split_part(substr(piece, strpos(piece, '=') + 1), '|', 2), '') AS meta FROM lists)"""


@query("plan_with_explosions", oracle(f"""{AFFECTED_SQL}{planned_sql(f'{NEARBY_SQL} AND rolled_back = 0')},
far AS (SELECT DISTINCT id FROM blocks WHERE {SINCE_SQL} AND world_key = 'minecraft:overworld' AND rolled_back = 0
   AND cx BETWEEN -20 AND 20 AND cz BETWEEN -20 AND 20 AND NOT (cx BETWEEN -4 AND 4 AND cz BETWEEN -4 AND 4)
   AND x BETWEEN -4 AND 4 AND z BETWEEN -4 AND 4)
SELECT {COLS}, CAST(0 AS int) AS plan_part FROM plan
UNION ALL SELECT {COLS}, CAST(1 AS int) FROM a WHERE id IN (SELECT id FROM far)"""))
def plan_with_explosions(spark, sf):
    return rollback.plan_with_explosions(shown(facts(spark, sf)), NEARBY, rollback.ROLLBACK)


@query("preview_rollback", oracle(f"""{planned_sql(f'{SINCE_SQL} AND rolled_back = 0')}
SELECT (SELECT count(*) FROM plan) AS planned,
       (SELECT count(*) FROM a WHERE {SINCE_SQL} AND rolled_back = 0 AND type NOT IN {ROLL}) AS skipped,
       (SELECT count(*) FROM a WHERE {SINCE_SQL} AND rolled_back = 0) AS scanned"""))
def preview_rollback(spark, sf):
    return rollback.preview(facts(spark, sf), ALL_SINCE, rollback.ROLLBACK)


WIDE_COLS = (*DISPLAY, "old_block_state", "new_block_state")


def planned(spark, sf, mode):
    rows = facts(spark, sf).select(*WIDE_COLS)
    return rollback.plan(rows, ALL_SINCE, mode)


MUTATION_OUT = ("action_id", "verb", "world_key", "x", "y", "z", "object", "amount", "meta", "state")
LAST_SQL = "old_block_state IS NOT NULL OR new_block_state IS NOT NULL"


@query("inverse_mutations", oracle(f"""{AFFECTED_SQL}{planned_sql(f'{SINCE_SQL} AND rolled_back = 0')}
SELECT id AS action_id,
  CASE WHEN type IN (1, 16, 23, 36, 37, 40, 2, 15, 17, 25, 24, 26) THEN 'set' WHEN type IN (3, 29) THEN 'remove_item'
       WHEN type IN (4, 30) THEN 'give_item' WHEN type IN (7, 35) THEN 'respawn' ELSE 'remove_entity' END AS verb,
  {CELL}, CASE WHEN type IN (1, 16, 23, 36, 37, 40) THEN 'minecraft:air' ELSE target END AS object,
  CASE WHEN type IN (3, 4, 29, 30) THEN greatest(1, amount) END AS amount,
  CASE WHEN type IN (2, 15, 17, 25, 24, 4, 30, 7, 35) THEN meta END AS meta,
  CASE WHEN type IN (2, 15, 17, 25, 24, 26) AND ({LAST_SQL}) THEN old_block_state END AS state
FROM plan WHERE type <> 8
UNION ALL SELECT b.id, 'set', b.world_key, b.x, b.y, b.z, b.block, NULL, b.meta, NULL FROM blocks b JOIN plan ON plan.id = b.id"""))
def inverse_mutations(spark, sf):
    return rollback.inverse_mutations(planned(spark, sf, rollback.ROLLBACK)).select(*MUTATION_OUT)


@query("forward_mutations", oracle(f"""{AFFECTED_SQL}{planned_sql(f'{SINCE_SQL} AND rolled_back = 1')}
SELECT id AS action_id,
  CASE WHEN type IN (1, 16, 23, 36, 37, 40, 2, 15, 17, 25, 24, 26) THEN 'set' WHEN type IN (3, 29) THEN 'give_item'
       WHEN type IN (4, 30) THEN 'remove_item' WHEN type = 7 THEN 'none' WHEN type = 34 THEN 'respawn' ELSE 'remove_entity' END AS verb,
  {CELL}, CASE WHEN type IN (2, 15, 17, 25, 24) THEN 'minecraft:air' WHEN type = 26 THEN coalesce(meta, 'minecraft:air') ELSE target END AS object,
  CASE WHEN type IN (3, 4, 29, 30) THEN greatest(1, amount) END AS amount,
  CASE WHEN type IN (1, 16, 23, 36, 37, 40, 3, 29, 34) THEN meta END AS meta,
  CASE WHEN type IN (1, 16, 23, 36, 37, 40, 26) AND ({LAST_SQL}) THEN new_block_state END AS state
FROM plan WHERE type <> 8
UNION ALL SELECT b.id, 'set', b.world_key, b.x, b.y, b.z, 'minecraft:air', NULL, NULL, NULL FROM blocks b JOIN plan ON plan.id = b.id"""))
def forward_mutations(spark, sf):
    return rollback.forward_mutations(planned(spark, sf, rollback.RESTORE)).select(*MUTATION_OUT)


@query("apply_mutations", oracle(f"""{AFFECTED_SQL}{planned_sql(f'{SINCE_SQL} AND rolled_back = 0')},
sets AS (
  SELECT {CELL}, CASE WHEN type IN (1, 16, 23, 36, 37, 40) THEN 'minecraft:air' ELSE target END AS object, ts, id, 0 AS pos
  FROM plan WHERE type IN (1, 16, 23, 36, 37, 40, 2, 15, 17, 25, 24, 26)
  UNION ALL SELECT b.world_key, b.x, b.y, b.z, b.block, b.ts, b.id, b.pos FROM blocks b JOIN plan ON plan.id = b.id),
last_set AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {CELL} ORDER BY ts, id, pos DESC) AS r FROM sets) WHERE r = 1),
state AS (SELECT * FROM (SELECT {CELL}, block, row_number() OVER (PARTITION BY {CELL} ORDER BY ts DESC, id DESC) AS r FROM a WHERE type IN (1, 2)) WHERE r = 1)
SELECT coalesce(s.world_key, m.world_key) AS world_key, coalesce(s.x, m.x) AS x, coalesce(s.y, m.y) AS y, coalesce(s.z, m.z) AS z,
       coalesce(m.object, s.block) AS block
FROM state s FULL JOIN last_set m ON s.world_key = m.world_key AND s.x = m.x AND s.y = m.y AND s.z = m.z"""))
def apply_mutations(spark, sf):
    state = (
        facts(spark, sf).filter(F.col("type").isin(1, 2)).groupBy("world_key", "x", "y", "z")
        .agg(F.max_by("block", F.struct("ts", "id")).alias("block"))
    )
    return rollback.apply_mutations(state, rollback.inverse_mutations(planned(spark, sf, rollback.ROLLBACK)))


SETS_SQL = f"""{AFFECTED_SQL}{planned_sql(f'{SINCE_SQL} AND rolled_back = 0')},
sets AS (
  SELECT id AS action_id, {CELL}, CASE WHEN type IN (1, 16, 23, 36, 37, 40) THEN 'minecraft:air' ELSE target END AS object, ts, 0 AS pos
  FROM plan WHERE type IN (1, 16, 23, 36, 37, 40, 2, 15, 17, 25, 24, 26)
  UNION ALL SELECT b.id, b.world_key, b.x, b.y, b.z, b.block, b.ts, b.pos FROM blocks b JOIN plan ON plan.id = b.id)"""


def _replaced(frames):
    """Callback: what each change replaces among the changes of its cell."""
    at, left = None, None
    for pdf in frames:
        before = []
        for cell, new in zip(pdf[CELL.split(", ")].itertuples(index=False, name=None), pdf["object"], strict=True):
            before.append(left if cell == at else None)
            at, left = cell, new
        yield pdf[["action_id", *CELL.split(", "), "object"]].assign(before=before)


@query("mutation_outcomes", oracle(f"""{SETS_SQL}
SELECT action_id, {CELL}, object, lag(object) OVER (PARTITION BY {CELL} ORDER BY ts DESC, action_id DESC, pos) AS before FROM sets"""))
def mutation_outcomes(spark, sf):
    """A callback applied to all block changes of a rollback, in order within each cell."""
    changes = rollback.inverse_mutations(planned(spark, sf, rollback.ROLLBACK)).filter(F.col("verb") == "set")
    schema = "action_id long, world_key string, x int, y int, z int, object string, before string"
    return rollback.mutation_outcomes(changes, _replaced, schema)


# Limits on the rows scanned and planned.
LIMITS = ((100, None), (None, 50), (10**9, 10**9))


@query("plan_limits", oracle(f"""{planned_sql(f'{SINCE_SQL} AND rolled_back = 0')},
sizes AS (SELECT (SELECT count(*) FROM a WHERE {SINCE_SQL} AND rolled_back = 0) AS scanned, (SELECT count(*) FROM plan) AS planned),
limits(max_scanned, max_planned) AS (VALUES (100::bigint, NULL::bigint), (NULL, 50), (1000000000, 1000000000))
SELECT max_scanned, max_planned, CASE WHEN scanned > max_scanned THEN concat('more than ', max_scanned, ' rows scanned')
  WHEN planned > max_planned THEN concat('more than ', max_planned, ' rows planned') END AS refusal FROM limits, sizes"""))
def plan_limits(spark, sf):
    """The refusal of a rollback of all rows since a day, under several limits."""
    rows = facts(spark, sf)
    scanned = ALL_SINCE.but(rolled_back=False).apply(rows)
    wanted = rollback.plan_rollback(rows, ALL_SINCE)
    answers = []
    for limits in LIMITS:
        try:
            rollback.check_limits(scanned, wanted, *limits)
            answers.append((*limits, None))
        except rollback.PlanTooLarge as refusal:
            answers.append((*limits, str(refusal)))
    return spark.createDataFrame(answers, "max_scanned long, max_planned long, refusal string")


# --- ledger: batches derived from the facts -----------------------------------
# One batch per actor and ten-day slice; rollbacks and restores alternate, and
# one batch in four was never closed.

LEDGER_SQL = """
, b AS (SELECT *, user_id * 10 + (day(ts) - 1) // 10 AS batch_id FROM a WHERE type IN (1, 2, 3, 4, 7, 8, 15, 16, 26)),
batches AS (SELECT batch_id, max(ts) AS ts, max(actor_uuid) AS actor_uuid, CAST(batch_id % 2 AS int) AS mode, count(*) AS affected,
                   batch_id % 4 <> 3 AS completed FROM b GROUP BY batch_id),
bridge AS (SELECT batch_id, id AS action_id FROM b WHERE id % 3 <> 0)"""


def _ledger(rows):
    keyed = rows.filter(F.col("type").isin(1, 2, 3, 4, 7, 8, 15, 16, 26)).withColumn(
        "batch_id", F.col("user_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 10)
    )
    batches = keyed.groupBy("batch_id").agg(
        F.max("ts").alias("ts"),
        F.max("actor_uuid").alias("actor_uuid"),
        (F.col("batch_id") % 2).cast("int").alias("mode"),
        F.count("*").alias("affected"),
    )
    bridge = keyed.filter(F.col("id") % 3 != 0).select("batch_id", F.col("id").alias("action_id"))
    return batches, bridge


def _statuses(batches):
    status = F.when(F.col("batch_id") % 4 != 3, F.array(F.lit("opened"), F.lit("closed"))).otherwise(F.array(F.lit("opened")))
    return batches.withColumn("status", F.explode(status))


FLAGS_SQL = """
flags AS (SELECT action_id, arg_max(CASE WHEN mode = 0 THEN 1 ELSE 0 END, batches.batch_id) AS flag
          FROM bridge JOIN batches ON bridge.batch_id = batches.batch_id GROUP BY action_id)"""


@query("effective_flags", oracle(f"""{LEDGER_SQL},{FLAGS_SQL}
SELECT a.id, coalesce(CAST(flags.flag AS int), a.rolled_back) AS rolled_back FROM a LEFT JOIN flags ON flags.action_id = a.id"""))
def effective_flags(spark, sf):
    rows = facts(spark, sf)
    return ledger.effective_flags(rows, *_ledger(rows)).select("id", "rolled_back")


@query("incomplete_batches", oracle(f"{LEDGER_SQL} SELECT batch_id, ts, actor_uuid, mode, affected FROM batches WHERE NOT completed"))
def incomplete_batches(spark, sf):
    batches, _ = _ledger(facts(spark, sf))
    return ledger.incomplete_batches(_statuses(batches)).select("batch_id", "ts", "actor_uuid", "mode", "affected")


@query("incomplete_actions", oracle(f"""{LEDGER_SQL}
SELECT bridge.batch_id, action_id FROM bridge JOIN batches ON bridge.batch_id = batches.batch_id WHERE NOT completed"""))
def incomplete_actions(spark, sf):
    batches, bridge = _ledger(facts(spark, sf))
    return ledger.incomplete_actions(_statuses(batches), bridge)


@query("batch_rows", oracle(f"{LEDGER_SQL} SELECT {COLS} FROM a WHERE id IN (SELECT action_id FROM bridge WHERE batch_id = 71)"))
def batch_rows(spark, sf):
    rows = facts(spark, sf)
    return shown(ledger.batch_rows(rows, _ledger(rows)[1], 71))


@query("undo_history", oracle(f"""{LEDGER_SQL}
SELECT batch_id, actor, mode, CAST(rn AS int) AS rn FROM (
  SELECT *, coalesce(actor_uuid, '00000000-0000-0000-0000-000000000000') AS actor,
         row_number() OVER (PARTITION BY coalesce(actor_uuid, '00000000-0000-0000-0000-000000000000') ORDER BY batch_id DESC) AS rn FROM batches)
WHERE rn <= 2"""))
def undo_history(spark, sf):
    batches, _ = _ledger(facts(spark, sf))
    return ledger.undo_history(batches, 2).select("batch_id", "actor", "mode", "rn")


ACTOR = "00000000-0000-4000-8000-000000000007"


@query("undo_plan", oracle(f"""{LEDGER_SQL},{FLAGS_SQL},
f AS (SELECT a.* EXCLUDE (rolled_back), coalesce(CAST(flags.flag AS int), a.rolled_back) AS rolled_back FROM a LEFT JOIN flags ON flags.action_id = a.id),
newest AS (SELECT batch_id, mode FROM batches WHERE actor_uuid = '{ACTOR}' ORDER BY batch_id DESC LIMIT 1),
mine AS (SELECT f.* FROM f JOIN bridge ON bridge.action_id = f.id JOIN newest ON newest.batch_id = bridge.batch_id
         WHERE f.rolled_back = CASE WHEN newest.mode = 0 THEN 1 ELSE 0 END){planned_sql('true', 'mine')}
SELECT {COLS}, (SELECT CAST(1 - mode AS int) FROM newest) AS mode FROM plan"""))
def undo_plan(spark, sf):
    rows = facts(spark, sf)
    batches, bridge = _ledger(rows)
    flagged = ledger.effective_flags(shown(rows), batches, bridge)
    return ledger.undo_plan(flagged, batches, bridge, ACTOR).select(*DISPLAY, "mode")


# --- G: affected-block lists ---------------------------------------------------

@query("parse_affected", oracle(f"{AFFECTED_SQL} SELECT id, CAST(count(*) AS int) AS n, min(block) AS least, max(meta) AS meta FROM blocks GROUP BY id"))
def parse_affected(spark, sf):
    from tracewell.functions.affected import parse_affected as parse

    p = parse(F.col("target"))
    return explosions.explosions(facts(spark, sf)).select(
        "id", F.size(p).alias("n"), F.array_min(F.transform(p, lambda e: e["block"])).alias("least"),
        F.array_max(F.transform(p, lambda e: e["meta"])).alias("meta"),
    )


@query("explode_affected", oracle(f"{AFFECTED_SQL} SELECT id, ts, world_key, pos, x, y, z, block, meta FROM blocks"))
def explode_affected(spark, sf):
    return explosions.explode_affected(facts(spark, sf)).drop("payload")


@query("serialize_affected", oracle("SELECT id, target FROM a WHERE type = 8"))
def serialize_affected(spark, sf):
    return explosions.normalise_affected(facts(spark, sf))


@query("merge_sidecar", oracle(f"""{AFFECTED_SQL},
side AS (SELECT id, x, y, z, CASE WHEN pos = 0 THEN 'axis=y' END AS meta, CASE WHEN pos = 1 THEN 'AAEC' END AS payload FROM blocks WHERE id % 2 = 0)
SELECT b.id, b.pos, b.x, b.y, b.z, b.block, coalesce(side.meta, b.meta) AS meta, side.payload
FROM blocks b LEFT JOIN side ON side.id = b.id AND side.x = b.x AND side.y = b.y AND side.z = b.z"""))
def merge_sidecar(spark, sf):
    blocks = explosions.explode_affected(facts(spark, sf))
    side = blocks.filter(F.col("id") % 2 == 0).select(
        "id", "x", "y", "z",
        F.when(F.col("pos") == 0, "axis=y").alias("meta"), F.when(F.col("pos") == 1, "AAEC").alias("payload"),
    )
    return explosions.merge_sidecar(blocks, side).select("id", "pos", "x", "y", "z", "block", "meta", "payload")


@query("explosions_touching", oracle(f"""{AFFECTED_SQL}
SELECT {COLS} FROM a WHERE id IN (SELECT id FROM blocks WHERE world_key = 'minecraft:overworld' AND x BETWEEN -1 AND 5 AND z BETWEEN -3 AND 3 AND y BETWEEN 58 AND 64)"""))
def explosions_touching(spark, sf):
    return shown(explosions.explosions_touching(facts(spark, sf), "minecraft:overworld", 2, 0, 3, 61))


@query("pack_affected", oracle("""
, n AS (SELECT id // 512 AS blast, id % 512 AS seq, CASE WHEN amount % 13 <> 0 THEN concat(x, ':', y, ':', z, '=', repeat(block, 1 + amount % 5)) END AS text FROM a),
s AS (SELECT *, CASE WHEN text IS NULL THEN 0 ELSE length(text) + 1 END AS size,
             sum(CASE WHEN text IS NULL THEN 0 ELSE length(text) + 1 END) OVER (PARTITION BY blast ORDER BY seq) AS total FROM n),
nx AS (SELECT p.blast, p.seq, least(p.seq + 96, coalesce(min(q.seq), p.seq + 96)) AS nxt FROM s p
       LEFT JOIN s q ON q.blast = p.blast AND q.seq > p.seq AND q.seq < p.seq + 96 AND q.size > 0 AND q.total - (p.total - p.size) > 3801
       GROUP BY p.blast, p.seq),
c AS (WITH RECURSIVE r(blast, chunk) AS (
        SELECT blast, min(seq) FROM s GROUP BY blast UNION ALL SELECT r.blast, nx.nxt FROM r JOIN nx ON nx.blast = r.blast AND nx.seq = r.chunk)
      SELECT blast, chunk, lead(chunk, 1, 512) OVER (PARTITION BY blast ORDER BY chunk) AS upto FROM r)
SELECT c.blast, c.chunk, string_agg(s.text, ',' ORDER BY s.seq) AS target FROM c JOIN s ON s.blast = c.blast AND s.seq >= c.chunk AND s.seq < c.upto
WHERE s.text IS NOT NULL GROUP BY c.blast, c.chunk"""))
def pack_affected(spark, sf):
    """All facts as the blocks of blasts of up to 512 blocks."""
    named = F.when(F.col("amount") % 13 != 0, F.expr("repeat(block, 1 + amount % 5)"))
    blocks = facts(spark, sf).select(
        F.floor(F.col("id") / 512).alias("blast"), (F.col("id") % 512).alias("seq"), "x", "y", "z", named.alias("block")
    )
    return explosions.pack_affected(blocks, ["blast"])
