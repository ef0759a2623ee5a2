"""Audit facts derived from the ``events`` table.

The binding is one SQL text that Spark and the checking engine both run, so a
comparison exercises the operators and not two derivations of the input.
"""

from __future__ import annotations

import functools
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.schema import EVENTS as PRODUCED

# The clock of every registered query.
NOW = datetime(2024, 1, 31)
MID = datetime(2024, 1, 16)

# The number inside ``props``, once per row. Spark gets it as the output of a
# generator: filters are pushed through plain projections by substitution, and
# would otherwise run the pattern again in every branch that mentions it.
NUMBER = "CAST(regexp_extract(props, '[0-9]+', 0) AS int)"

BINDING = """
e AS (
  SELECT event_id, ts, user_id, value, k FROM {numbered}
), t AS (
  SELECT event_id AS id, ts, CAST(1 + (event_id * 7 + k) % 40 AS int) AS type, user_id, k,
         CASE WHEN k % 11 = 0 THEN '#creeper'
              ELSE concat('user_', CAST(user_id AS varchar(20))) END AS actor_name,
         CASE user_id % 3 WHEN 0 THEN 'minecraft:overworld'
                          WHEN 1 THEN 'minecraft:the_nether'
                          ELSE 'minecraft:the_end' END AS world_key,
         CAST((event_id * 31) % 16 - 8 AS int) AS x,
         CAST(60 + k % 4 AS int) AS y,
         CAST((event_id * 17 + k * 3) % 16 - 8 AS int) AS z,
         CASE k % 5 WHEN 0 THEN 'minecraft:stone' WHEN 1 THEN 'minecraft:dirt'
                    WHEN 2 THEN 'minecraft:red_sand' WHEN 3 THEN 'minecraft:oak_leaves'
                    ELSE 'minecraft:water' END AS block,
         CASE (k + 1) % 3 WHEN 0 THEN 'minecraft:air' WHEN 1 THEN 'minecraft:stone'
                    ELSE 'minecraft:fire' END AS new_block,
         CAST(1 + floor(value) AS int) AS amount,
         CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS rolled_back,
         CASE k % 7 WHEN 0 THEN '#fire:ignite' WHEN 1 THEN '#natural:form'
                    WHEN 2 THEN '#hopper' ELSE NULL END AS plain_tag
  FROM e
), a AS (
  SELECT id, ts, type, user_id,
         CASE WHEN k % 11 = 0 THEN NULL
              ELSE concat('00000000-0000-4000-8000-', lpad(CAST(user_id AS varchar(20)), 12, '0')) END AS actor_uuid,
         actor_name, world_key, x, y, z,
         CASE WHEN type = 8 THEN
                concat(CAST(x AS varchar(9)), ':', CAST(y AS varchar(9)), ':', CAST(z + 1 AS varchar(9)), '=', block, ',',
                       CAST(x + 9 AS varchar(9)), ':', CAST(y AS varchar(9)), ':', CAST(z AS varchar(9)), '=', new_block, '|facing=north')
              WHEN type = 9 THEN concat('hello ', block)
              WHEN type = 10 THEN concat('/tp user_', CAST(amount AS varchar(9)), ' ', block)
              WHEN type = 14 THEN concat('old_', CAST(user_id AS varchar(20)), ' -> ', actor_name)
              ELSE block END AS target,
         CASE WHEN type = 26 THEN new_block ELSE NULL END AS meta,
         amount, rolled_back,
         CASE WHEN type <> 26 THEN plain_tag
              ELSE CASE k % 4 WHEN 0 THEN '#mob:minecraft:ravager' WHEN 1 THEN '#mob:dragons:fire'
                              WHEN 2 THEN '#mob:isle:fury' ELSE NULL END END AS source_tag,
         CASE WHEN type = 11 THEN CASE WHEN amount % 2 = 0 THEN 'front' ELSE 'back' END END AS sign_side,
         CASE WHEN type = 11 THEN CASE amount % 3 WHEN 0 THEN 'black' WHEN 1 THEN 'red' ELSE 'blue' END END AS sign_dye_color,
         CASE WHEN type = 11 THEN amount % 2 = 1 END AS sign_waxed,
         CASE WHEN type IN (2, 26) AND k % 3 = 0 THEN 'facing=east' END AS old_block_state,
         CASE WHEN type IN (1, 26) AND k % 3 = 1 THEN 'facing=west' END AS new_block_state,
         block, new_block
  FROM t
)
"""

DISPLAY = (
    "id", "ts", "type", "user_id", "actor_uuid", "actor_name", "world_key", "x", "y", "z",
    "target", "meta", "amount", "rolled_back", "source_tag",
)


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def bind(events: DataFrame) -> DataFrame:
    numbered = events.select("event_id", "ts", "user_id", "value", F.explode(F.array(F.expr(NUMBER))).alias("k"))
    return events.sparkSession.sql("WITH " + BINDING + "SELECT * FROM a", numbered=numbered)


@functools.lru_cache(maxsize=4)
def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All derived columns, as a plan (no data is kept); callers select what
    they need and the scan prunes."""
    return bind(events_of(spark, sf_dir))


def fact_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same facts as a stream over the event files."""
    return bind(spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/event*.parquet"))


def as_events(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """What a producer would hand in: columns the facts lack are null. Columns of ``keep``
    go along."""
    return rows.select(
        *[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in PRODUCED.fields],
        *keep,
    )


def shown(df: DataFrame) -> DataFrame:
    return df.select(*DISPLAY)


def oracle(body: str) -> str:
    """A checking query over the same facts; ``body`` starts with SELECT or
    with further CTEs introduced by a comma."""
    text = body.strip()
    joint = "" if text.startswith(",") else " "
    return "WITH " + BINDING.replace("{numbered}", f"(SELECT *, {NUMBER} AS k FROM events)").strip() + joint + text
