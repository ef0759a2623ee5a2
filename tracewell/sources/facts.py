"""The fact table and its dimensions: scan and append.

Layout under one root::

    actions/dt=2024-01-31/batch=main-17/…   facts, by day and commit
    users/batch=main-17/…                   sightings of actors
    worlds/batch=main-17/…                  sightings of worlds
    log/…  changes/…  snapshots/…           what counts (see ``commits``)

Every append is a commit of its own, so appends never touch each other's rows.
Dimension tables hold sightings; readers fold them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.actions import default_world
from tracewell.functions.predicates import ActionFilter, all_of
from tracewell.operators.dimensions import normalize_actions, user_id, user_key, with_dimensions, world_id
from tracewell.operators.ledger import Ledger
from tracewell.schema import ACTIONS, PAYLOAD_COLUMNS, USERS, WORLDS
from tracewell.sources.commits import Log, commit_key, is_published, live, publish, read_log
from tracewell.sources.tables import read_table

BATCHED_USERS = T.StructType([*USERS.fields, T.StructField("user_key", T.StringType()), T.StructField("batch", T.StringType())])
BATCHED_WORLDS = T.StructType([*WORLDS.fields, T.StructField("batch", T.StringType())])


def sightings(spark: SparkSession, root: str, tab: str, log: Log | None = None) -> DataFrame:
    """Stored rows of ``users`` or ``worlds`` that count, by the ``log`` if one is given."""
    schema = BATCHED_USERS if tab == "users" else BATCHED_WORLDS
    return live(read_table(spark, f"{root}/{tab}", schema), spark, root, tab, log)


def users(spark: SparkSession, root: str, log: Log | None = None) -> DataFrame:
    """One row per actor: first-seen name, first and last sighting."""
    return (
        sightings(spark, root, "users", log)
        .groupBy("user_id")
        .agg(
            F.max("user_key").alias("user_key"),
            F.max("uuid").alias("uuid"),
            F.min_by("name", "first_seen").alias("name"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
        )
    )


def worlds(spark: SparkSession, root: str, log: Log | None = None) -> DataFrame:
    return sightings(spark, root, "worlds", log).select("world_id", "world_key").distinct()


def id_collisions(spark: SparkSession, root: str) -> DataFrame:
    """Surrogates shared by two natural keys (none is expected)."""
    return (
        sightings(spark, root, "users")
        .groupBy("user_id")
        .agg(F.min("user_key").alias("one"), F.max("user_key").alias("other"))
        .filter(F.col("one") != F.col("other"))
    )


def facts(spark: SparkSession, root: str, log: Log | None = None) -> DataFrame:
    return live(read_table(spark, f"{root}/actions", ACTIONS), spark, root, "actions", log)


def scan_actions(
    spark: SparkSession,
    root: str,
    payload: bool = False,
    names: bool = True,
    since: datetime | None = None,
    until: datetime | None = None,
    flt: ActionFilter | None = None,
    log: Log | None = None,
) -> DataFrame:
    """Facts with effective rolled-back flags and, by default, names.

    Without ``payload`` the five payload columns are never read. Time bounds
    given here prune day partitions before the ledger join. Of a filter ``flt`` that the
    caller applies, the part that stored columns express is applied to the scan already.
    """
    log = log or read_log(spark, root)
    rows = facts(spark, root, log)
    if not payload:
        rows = rows.drop(*PAYLOAD_COLUMNS)
    if since is not None:
        rows = rows.filter(F.col("dt") >= F.lit(since.date()))
    if until is not None:
        rows = rows.filter(F.col("dt") <= F.lit(until.date()))
    if flt is not None and (bounds := flt.stored_bounds()):
        rows = rows.filter(all_of(bounds))
    rows = Ledger(spark, root).effective(rows)
    return with_dimensions(rows, users(spark, root, log), worlds(spark, root, log)) if names else rows


def named(spark: SparkSession, root: str, rows: DataFrame, log: Log) -> DataFrame:
    """Stored facts with effective flags and names, as ``scan_actions`` gives them, and
    all their columns."""
    return with_dimensions(Ledger(spark, root).effective(rows), users(spark, root, log), worlds(spark, root, log))


def write_partitions(rows: DataFrame, path: str, *partition: str) -> None:
    """Write, replacing what the same commit may have left unpublished."""
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition)
        .parquet(path)
    )


def append_actions(events: DataFrame, root: str, batch: int | str | None = None, writer: str = "main") -> str:
    """Store events: defaults, dimension sightings, then facts; returns the commit.

    ``writer`` and ``batch`` name the commit. A commit that is stored already is left
    as it is, so a retry stores nothing twice; two writers must have two names. Without
    a batch every call is a commit of its own. Nothing is visible before everything
    is written.
    """
    spark, commit = events.sparkSession, commit_key(writer, batch)
    if is_published(spark, root, commit):
        return commit
    write_actions(events, root, commit)
    publish(spark, root, commit, "append")
    return commit


def write_actions(events: DataFrame, root: str, commit: str) -> None:
    """Write events as partitions of a commit, which does not count yet."""
    rows = (
        normalize_actions(events)
        .withColumn("user_key", user_key())
        .withColumn("user_id", user_id())
        .withColumn("world_key", default_world(F.col("world_key")))
        .withColumn("world_id", world_id())
        .withColumn("batch", F.lit(commit))
    )
    seen = rows.groupBy("user_id", "user_key", "batch").agg(
        F.max("actor_uuid").alias("uuid"),
        F.min_by("actor_name", F.struct("ts", "id")).alias("name"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )
    write_partitions(seen, f"{root}/users", "batch")
    write_partitions(rows.select("world_id", "world_key", "batch").distinct(), f"{root}/worlds", "batch")
    stored = rows.withColumn("rolled_back", F.coalesce("rolled_back", F.lit(0))).withColumn("dt", F.col("ts").cast("date"))
    # Rebalancing splits a heavy day over several tasks and joins light ones.
    stored = stored.select(*ACTIONS.fieldNames()).hint("rebalance", "dt")
    write_partitions(stored, f"{root}/actions", "dt", "batch")
