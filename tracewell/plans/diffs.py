"""Actions derived from observed states (K)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tracewell.functions.blocks import CATEGORY_ENDINGS, CATEGORY_IDS, FLUID_PRODUCTS, HOT_CATEGORIES
from tracewell.functions.timing import ts_lit
from tracewell.operators import diffs
from tracewell.plans.binding import MID, facts, oracle
from tracewell.plans.registry import query

CELL = "world_key, x, y, z"
MID_SQL = "TIMESTAMP '2024-01-16 00:00:00'"


@query("diff_containers", oracle("""
, o AS (SELECT user_id, CAST(ts AS date) AS day, amount % 5 AS slot, arg_max(block, ts) AS item, arg_max(amount % 9, ts) AS n, max(ts) AS seen FROM a WHERE type IN (3, 27, 29) GROUP BY ALL),
c AS (SELECT user_id, CAST(ts AS date) AS day, amount % 5 AS slot, arg_max(block, ts) AS item, arg_max(amount % 9, ts) AS n, max(ts) AS seen FROM a WHERE type IN (4, 28, 30) GROUP BY ALL),
ok AS (SELECT x.user_id, x.day FROM (SELECT user_id, day, max(seen) AS seen FROM o GROUP BY ALL) x JOIN (SELECT user_id, day, max(seen) AS seen FROM c GROUP BY ALL) y
       ON x.user_id = y.user_id AND x.day = y.day WHERE y.seen >= x.seen AND y.seen - x.seen <= INTERVAL 6 HOUR),
d AS (SELECT coalesce(o.user_id, c.user_id) AS user_id, coalesce(o.day, c.day) AS day, coalesce(o.slot, c.slot) AS slot,
             coalesce(CASE WHEN o.n > 0 THEN o.item END, CASE WHEN c.n > 0 THEN c.item END) AS item, coalesce(c.n, 0) - coalesce(o.n, 0) AS delta
      FROM o FULL JOIN c ON o.user_id = c.user_id AND o.day = c.day AND o.slot = c.slot)
SELECT d.user_id, d.day, d.slot, d.item, CASE WHEN delta > 0 THEN 3 ELSE 4 END AS type, CAST(abs(delta) AS int) AS amount
FROM d JOIN ok ON ok.user_id = d.user_id AND ok.day = d.day WHERE item IS NOT NULL AND delta <> 0"""))
def diff_containers(spark, sf):
    rows = facts(spark, sf).withColumn("day", F.col("ts").cast("date"))

    def snapshot(types):
        return rows.filter(F.col("type").isin(*types)).groupBy("user_id", "day", (F.col("amount") % 5).alias("slot")).agg(
            F.max_by("block", "ts").alias("item"), F.max_by(F.col("amount") % 9, "ts").alias("count"), F.max("ts").alias("at")
        )

    return diffs.diff_containers(snapshot((3, 27, 29)), snapshot((4, 28, 30)), ["user_id", "day"], timedelta(hours=6))


# Every change of a container is a snapshot of one slot; opens and closes of a user
# follow each other in any order. A close ends the event right before it, if that is
# an open (the newest open counts, a close takes it) at most a day old.
SESSIONS_SQL = """
, s AS (SELECT user_id AS session, ts, id, type IN (4, 28, 30) AS closing, amount % 5 AS slot, block AS item, amount % 9 AS n FROM a WHERE type IN (3, 4, 27, 28, 29, 30)),
w AS (SELECT *, lag(closing) OVER e AS pclosing, lag(ts) OVER e AS pts, lag(slot) OVER e AS oslot, lag(item) OVER e AS oitem, lag(n) OVER e AS on_
      FROM s WINDOW e AS (PARTITION BY session ORDER BY ts, closing, id)),
p AS (SELECT session, ts AS closed, oslot, oitem, on_, slot AS cslot, item AS citem, n AS cn FROM w
      WHERE closing AND NOT pclosing AND ts - pts <= INTERVAL 24 HOUR),
d AS (SELECT session, closed, oslot AS slot, CASE WHEN on_ > 0 THEN oitem ELSE citem END AS item, cn - on_ AS delta FROM p WHERE oslot = cslot
      UNION ALL SELECT session, closed, oslot, oitem, -on_ FROM p WHERE oslot <> cslot
      UNION ALL SELECT session, closed, cslot, citem, cn FROM p WHERE oslot <> cslot)
SELECT session, closed, slot, item, CASE WHEN delta > 0 THEN 3 ELSE 4 END AS type, CAST(abs(delta) AS int) AS amount FROM d WHERE delta <> 0"""


def snapshots(rows, types):
    slot = F.struct((F.col("amount") % 5).alias("slot"), F.col("block").alias("item"), (F.col("amount") % 9).alias("count"))
    return rows.filter(F.col("type").isin(*types)).select(
        F.col("user_id").alias("session"), "ts", "id", F.array(slot).alias("slots")
    )


@query("container_sessions", oracle(SESSIONS_SQL))
def container_sessions(spark, sf):
    rows = facts(spark, sf)
    return diffs.container_sessions(
        snapshots(rows, (3, 27, 29)), snapshots(rows, (4, 28, 30)), ["session"], timedelta(hours=24)
    )


def _slot(i: int) -> str:
    return f"CASE WHEN (amount + {i}) % 3 <> 0 THEN concat(block, '|', (amount + {i}) % 7) END"


@query("diff_hopper_samples", oracle(f"""
, s AS (SELECT id, ts, {CELL}, [{", ".join(_slot(i) for i in range(4))}, NULL] AS slots FROM a WHERE type IN (3, 4, 27, 28, 29, 30)),
l AS (SELECT *, lag(slots) OVER (PARTITION BY {CELL} ORDER BY ts, id) AS before FROM s),
p AS (SELECT id, ts, {CELL}, CAST(unnest(range(5)) AS int) AS slot, unnest(before) AS was, unnest(slots) AS now FROM l
      WHERE before IS NOT NULL AND list_aggregate(before, 'count') > 0),
q AS (SELECT *, split_part(was, '|', 1) AS wi, split_part(now, '|', 1) AS ni, coalesce(CAST(split_part(was, '|', 2) AS int), 0) AS wc,
             coalesce(CAST(split_part(now, '|', 2) AS int), 0) AS nc FROM p WHERE was IS DISTINCT FROM now)
SELECT id, ts, {CELL}, slot, 30 AS type, wi AS item, wc AS amount FROM q WHERE was IS NOT NULL AND now IS NOT NULL AND wi <> ni
UNION ALL SELECT id, ts, {CELL}, slot, 29, ni, nc FROM q WHERE was IS NOT NULL AND now IS NOT NULL AND wi <> ni
UNION ALL SELECT id, ts, {CELL}, slot, CASE WHEN nc > wc THEN 29 ELSE 30 END, coalesce(ni, wi), abs(nc - wc) FROM q
  WHERE NOT coalesce(was IS NOT NULL AND now IS NOT NULL AND wi <> ni, false) AND nc <> wc"""))
def diff_hopper_samples(spark, sf):
    slots = F.expr(f"array({', '.join(_slot(i) for i in range(4))}, NULL)")
    samples = facts(spark, sf).filter(F.col("type").isin(3, 4, 27, 28, 29, 30)).select(
        "id", "ts", "world_key", "x", "y", "z", slots.alias("slots")
    )
    return diffs.diff_hopper_samples(samples)


@query("diff_regions", oracle(f"""
, b AS (SELECT {CELL}, arg_max(block, ts) AS block FROM a WHERE type IN (1, 2, 18) AND ts < {MID_SQL} GROUP BY ALL),
n AS (SELECT {CELL}, arg_max(new_block, ts) AS block FROM a WHERE type IN (1, 2, 18) GROUP BY ALL),
d AS (SELECT coalesce(b.world_key, n.world_key) AS world_key, coalesce(b.x, n.x) AS x, coalesce(b.y, n.y) AS y, coalesce(b.z, n.z) AS z,
             coalesce(b.block, 'minecraft:air') AS was, coalesce(n.block, 'minecraft:air') AS now
      FROM b FULL JOIN n ON b.world_key = n.world_key AND b.x = n.x AND b.y = n.y AND b.z = n.z)
SELECT {CELL}, 2 AS type, was AS block FROM d WHERE was <> now AND was <> 'minecraft:air'
UNION ALL SELECT {CELL}, 1, now FROM d WHERE was <> now AND now <> 'minecraft:air'"""))
def diff_regions(spark, sf):
    rows = facts(spark, sf).filter(F.col("type").isin(1, 2, 18))
    cell = ["world_key", "x", "y", "z"]
    before = rows.filter(F.col("ts") < ts_lit(MID)).groupBy(*cell).agg(F.max_by("block", "ts").alias("block"))
    after = rows.groupBy(*cell).agg(F.max_by("new_block", "ts").alias("block"))
    return diffs.diff_regions(before, after)


@query("small_regions", oracle("""
SELECT id, 1 + amount % 40 AS side FROM a WHERE CAST(1 + amount % 40 AS bigint) * (1 + amount % 40) * (1 + amount % 40) <= 32768"""))
def small_regions(spark, sf):
    side = 1 + F.col("amount") % 40
    rows = facts(spark, sf).select(
        "id", side.alias("side"),
        *[F.col(c).alias(f"min_{c}") for c in "xyz"], *[(F.col(c) + side - 1).alias(f"max_{c}") for c in "xyz"],
    )
    return diffs.small_regions(rows).select("id", "side")


def category_sql(block: str) -> str:
    parts = [f"WHEN {block} LIKE '%{end.replace('_', '#_')}' ESCAPE '#' THEN '{c}'" for c, end in CATEGORY_ENDINGS.items()]
    parts += [f"WHEN {block} IN ({', '.join(repr(i) for i in ids)}) THEN '{c}'" for c, ids in CATEGORY_IDS.items()]
    return f"CASE {' '.join(parts)} END"


HOT = ", ".join(f"'{c}'" for c in HOT_CATEGORIES)
PRODUCTS = ", ".join(f"'{c}'" for c in FLUID_PRODUCTS)


@query("classify_block_changes", oracle(f"""
, o AS (SELECT id, ts, {CELL}, CASE WHEN id % 2 = 0 THEN new_block ELSE block END AS block FROM a WHERE type IN (1, 2, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 40)),
c AS (SELECT *, {category_sql('block')} AS cat, row_number() OVER (PARTITION BY {CELL} ORDER BY ts, id) AS rn FROM o),
s AS (SELECT *, max(CASE WHEN cat IN ({HOT}) THEN rn END) OVER (PARTITION BY {CELL} ORDER BY rn) AS last_hot,
             max(CASE WHEN cat IS NULL THEN rn END) OVER (PARTITION BY {CELL} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_null FROM c),
m AS (SELECT *, coalesce(cat IN ({HOT}), false) OR (last_hot IS NOT NULL AND coalesce(last_null, 0) < last_hot) AS kept FROM s),
w AS (SELECT *, last_value(CASE WHEN kept THEN block END IGNORE NULLS) OVER (PARTITION BY {CELL} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_block FROM m),
v AS (SELECT *, {category_sql('prev_block')} AS pc FROM w),
r AS (SELECT *, CASE WHEN prev_block IS NOT NULL AND prev_block <> block THEN
    CASE WHEN pc = 'fire' AND cat IS DISTINCT FROM 'fire' THEN 'BURN' WHEN pc IS DISTINCT FROM 'fire' AND cat = 'fire' THEN 'IGNITE'
         WHEN pc = 'ice' AND cat IS DISTINCT FROM 'ice' THEN 'FADE' WHEN pc = 'powder' AND cat = 'concrete' THEN 'FORM'
         WHEN pc IN ('water', 'lava') AND cat IN ({PRODUCTS}) THEN 'FORM' WHEN (pc = 'water' OR pc IS NULL) AND cat = 'ice' THEN 'FORM'
         WHEN pc = 'dirt' AND cat = 'grass' THEN 'SPREAD' WHEN pc = 'leaves' AND cat IS DISTINCT FROM 'leaves' THEN 'LEAVES_DECAY' END
    WHEN prev_block IS NULL AND cat = 'fire' THEN 'IGNITE' END AS change FROM v)
SELECT id, ts, {CELL}, prev_block, block, change FROM r WHERE change IS NOT NULL"""))
def classify_block_changes(spark, sf):
    kinds = (1, 2, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 40)
    seen = F.when(F.col("id") % 2 == 0, F.col("new_block")).otherwise(F.col("block"))
    rows = facts(spark, sf).filter(F.col("type").isin(*kinds)).select("id", "ts", "world_key", "x", "y", "z", seen.alias("block"))
    return diffs.classify_block_changes(rows)


@query("pair_click_open", oracle(f"""
, c AS (SELECT id, ts, user_id AS player, {CELL} FROM a WHERE type IN (39, 33)),
o AS (SELECT id, ts, user_id AS player FROM a WHERE type IN (3, 27)),
j AS (SELECT o.id, o.ts, o.player, max(struct_pack(t := c.ts, w := c.world_key, x := c.x, y := c.y, z := c.z)) AS m
      FROM o JOIN c ON c.player = o.player AND (c.ts < o.ts OR (c.ts = o.ts AND c.id < o.id)) GROUP BY ALL)
SELECT id, ts, player, m.w AS world_key, m.x AS x, m.y AS y, m.z AS z, m.t AS click_ts FROM j WHERE ts - m.t <= INTERVAL 24 HOUR"""))
def pair_click_open(spark, sf):
    rows = facts(spark, sf).withColumn("player", F.col("user_id"))
    clicks = rows.filter(F.col("type").isin(39, 33)).select("id", "ts", "player", "world_key", "x", "y", "z")
    opens = rows.filter(F.col("type").isin(3, 27)).select("id", "ts", "player")
    return diffs.pair_click_open(opens, clicks, timedelta(hours=24), span=timedelta(hours=48))
