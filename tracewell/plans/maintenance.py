"""Retention, export, rules and schema (A7, A8, J)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tracewell.functions.predicates import ActionFilter
from tracewell.plans.binding import DISPLAY, NOW, facts, oracle, shown
from tracewell.plans.lookups import TYPES_SQL
from tracewell.plans.registry import query
from tracewell.sources import exports, maintenance, rules

COLS = ", ".join(DISPLAY)
OLD = ActionFilter(since=NOW - timedelta(days=20), types=("block",), exclude=("minecraft:stone",))
OLD_SQL = """ts <= TIMESTAMP '2024-01-11 00:00:00' AND type IN (1, 2, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 40)
  AND target <> 'minecraft:stone' AND NOT (type = 26 AND meta = 'minecraft:stone') AND NOT (type = 8 AND target LIKE '%=minecraft:stone%')"""


@query("purge", oracle(f"SELECT {COLS} FROM a WHERE id NOT IN (SELECT id FROM a WHERE {OLD_SQL})"))
def purge(spark, sf):
    return maintenance.purge_survivors(shown(facts(spark, sf)), OLD, NOW)


@query("purge_count", oracle(f"SELECT count(*) AS n FROM a WHERE {OLD_SQL}"))
def purge_count(spark, sf):
    return maintenance.purge_victims(facts(spark, sf), OLD, NOW).agg(F.count("*").alias("n"))


@query("auto_purge", oracle(f"SELECT {COLS} FROM a WHERE ts >= TIMESTAMP '2024-01-20 12:00:00'"))
def auto_purge(spark, sf):
    return maintenance.auto_purge_survivors(shown(facts(spark, sf)), NOW, timedelta(days=10, hours=12))


@query("export_jsonl", oracle(f"""
SELECT concat('{{"ts":', CAST(floor(epoch_us(ts) / 1000) AS bigint), ',"type":"', d.name, '","actor":{{"uuid":', coalesce('"' || actor_uuid || '"', 'null'),
  ',"name":"', actor_name, '"}},"world":"', world_key, '","pos":[', x, ',', y, ',', z, '],"target":"', target, '","amount":', amount,
  ',"source":', coalesce('"' || source_tag || '"', 'null'), ',"meta":', coalesce('"' || meta || '"', 'null'), '}}') AS value, CAST(ts AS date) AS dt
FROM a JOIN {TYPES_SQL} ON a.type = d.type"""))
def export_jsonl(spark, sf):
    return exports.export_lines(facts(spark, sf))


@query("read_rules", oracle("""
, l AS (SELECT DISTINCT CASE amount % 7 WHEN 0 THEN concat(' USER: ', actor_name) WHEN 1 THEN concat('block:', upper(block)) WHEN 2 THEN '# note'
     WHEN 3 THEN concat(block, '@', actor_name) WHEN 4 THEN 'nonsense' WHEN 5 THEN 'entity: ' ELSE concat('command:', 'Tp') END AS v FROM a)
SELECT DISTINCT CASE WHEN contains(v, '@') THEN 'composite' ELSE lower(trim(split_part(v, ':', 1))) END AS kind,
  CASE WHEN v LIKE ' USER%' THEN trim(substr(v, 7)) WHEN contains(v, '@') THEN concat(lower(split_part(v, '@', 1)), '@', split_part(v, '@', 2))
       ELSE lower(substr(v, strpos(v, ':') + 1)) END AS value
FROM l WHERE v NOT IN ('# note', 'nonsense', 'entity: ')"""))
def read_rules(spark, sf):
    name, block = F.col("actor_name"), F.col("block")
    lines = [
        F.concat(F.lit(" USER: "), name), F.concat(F.lit("block:"), F.upper(block)), F.lit("# note"),
        F.concat(block, F.lit("@"), name), F.lit("nonsense"), F.lit("entity: "), F.lit("command:Tp"),
    ]
    one = F.get(F.array(*lines), F.col("amount") % 7)
    return rules.parse_rules(facts(spark, sf).select(F.explode(F.array(one)).alias("value")))


@query("upgrade_schema", oracle("""
SELECT id, target, CAST(NULL AS varchar) AS sign_side, CAST(NULL AS varchar) AS sign_dye_color, CAST(NULL AS boolean) AS sign_waxed,
       CAST(NULL AS varchar) AS old_block_state, CAST(NULL AS varchar) AS new_block_state FROM a"""))
def upgrade_schema(spark, sf):
    old = facts(spark, sf).select("id", "target")
    return maintenance.upgrade_schema(old, 2).drop("block_entity_nbt", "item_nbt", "entity_nbt")
