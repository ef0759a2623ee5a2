"""Retention, compaction, schema steps and dataset copies."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.predicates import ActionFilter, all_of
from tracewell.functions.timing import ts_lit
from tracewell.schema import ACTIONS, SCHEMA_VERSION
from tracewell.session import checkpointed
from tracewell.sources import facts as store
from tracewell.sources.commits import RETIRED, Log, commit_key, drop_retired, has_log, publish, read_log, repeated

# Least age a purge may name, from a console and in game.
CONSOLE_MIN_AGE, GAME_MIN_AGE = timedelta(hours=24), timedelta(days=30)


# --- deleting --------------------------------------------------------------

def purge_filter(flt: ActionFilter, now: datetime, min_age: timedelta = CONSOLE_MIN_AGE) -> ActionFilter:
    """The lower bound of the request becomes the upper bound of what goes
    (inclusive); an upper bound in the request is ignored."""
    if flt.since is None or flt.since > now - min_age:
        raise ValueError(f"a purge needs a time at least {min_age} ago")
    return flt.but(since=None, until=flt.since)


def purge_victims(actions: DataFrame, flt: ActionFilter, now: datetime, min_age=CONSOLE_MIN_AGE) -> DataFrame:
    return purge_filter(flt, now, min_age).apply(actions)


def purge_survivors(actions: DataFrame, flt: ActionFilter, now: datetime, min_age=CONSOLE_MIN_AGE) -> DataFrame:
    """What the purge leaves: rows that the filter does not select. A row goes by itself,
    not by its id, which others may share."""
    return actions.filter(~selected(purge_filter(flt, now, min_age)))


def selected(flt: ActionFilter) -> Column:
    """Whether a row is selected; where the filter is unknown (null), it is not."""
    return F.coalesce(flt.condition(), F.lit(False))


def auto_purge_survivors(actions: DataFrame, now: datetime, retention: timedelta) -> DataFrame:
    """Strictly older rows go; no join needed."""
    return actions.filter(F.col("ts") >= ts_lit(now - retention))


def delete_rows(
    spark: SparkSession, root: str, victim: Column, bounds: list[Column], log: Log, named: bool = True,
    rewritten: Column | None = None, delete: bool = True,
) -> int:
    """Remove the facts for which ``victim`` holds; returns how many went. ``bounds`` are
    predicates on stored columns that all victims meet; ``victim`` may also use the
    effective flag and the names, unless ``named`` is off.

    The survivors of every partition that loses rows are written under a new commit,
    which retires those partitions; others are not read. Days for which ``rewritten`` does
    not hold have no survivors and are retired as they are. Readers see the facts before
    or after, and a run that failed before its commit left nothing that counts. Without
    ``delete`` the retired folders stay for readers at work until ``vacuum``.
    """

    def scanned(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("stored_flag", F.col("rolled_back"))
        return store.named(spark, root, rows, log) if named else rows

    stored = store.facts(spark, root, log)
    lost = scanned(stored.filter(all_of(bounds))).filter(victim).groupBy("dt", "batch").agg(F.count("*").alias("n"))
    lost = checkpointed(lost)
    total = lost.agg(F.sum("n")).first()[0] or 0
    if not total:
        return 0
    commit = commit_key("purge")
    touched = (lost if rewritten is None else lost.filter(rewritten)).select("dt", "batch")
    kept = scanned(stored.join(touched, ["dt", "batch"], "left_semi")).filter(~victim)
    kept = kept.withColumn("rolled_back", F.col("stored_flag")).withColumn("batch", F.lit(commit))
    store.write_partitions(kept.select(*ACTIONS.fieldNames()).hint("rebalance", "dt"), f"{root}/actions", "dt", "batch")
    publish(spark, root, commit, "purge", lost.withColumn("tab", F.lit("actions")), log)
    if delete:
        drop_retired(spark, root, commit)
    return total


def purge(
    spark: SparkSession, root: str, flt: ActionFilter, now: datetime, min_age=CONSOLE_MIN_AGE, compact_after: bool = False,
    delete: bool = True,
) -> int:
    """Delete what a filter selects; optionally reclaim space afterwards. May run beside
    appends, compactions and other purges: what they changed meanwhile is looked at again."""
    wanted = purge_filter(flt.but(day_column="dt"), now, min_age)
    bounds = wanted.stored_bounds()
    removed = repeated(spark, root, lambda log: delete_rows(spark, root, selected(wanted), bounds, log, delete=delete))
    if compact_after and removed:
        compact(spark, root, delete=delete)
    return removed


def auto_purge(spark: SparkSession, root: str, now: datetime, retention: timedelta, delete: bool = True) -> int:
    """Delete facts older than the retention: whole days are retired as they are, only
    the boundary day is rewritten."""
    cutoff = now - retention
    edge, old = F.lit(cutoff.date()), F.col("ts") < ts_lit(cutoff)
    bounds, boundary = [F.col("dt") <= edge], F.col("dt") == edge
    return repeated(
        spark, root, lambda log: delete_rows(spark, root, old, bounds, log, named=False, rewritten=boundary, delete=delete)
    )


def vacuum(spark: SparkSession, root: str) -> None:
    """Delete the folders of all retired partitions. Run it when no reader is left that
    started before the jobs that retired them."""
    drop_retired(spark, root)


def compact(spark: SparkSession, root: str, before: datetime | None = None, delete: bool = True) -> list[str]:
    """Merge the commits of every day (optionally only of days before a time) into one
    partition, ordered by place so that min/max statistics skip files, and fold the
    sightings of actors and worlds. Days of one commit are left alone.

    Facts stored twice with all columns equal (one event delivered to two commits) become
    one; facts that only share an id all stay. The new commit retires what it merged, in
    one step, and the merged commits stay known, so that a batch retried afterwards is
    not stored again. Batches that arrive meanwhile are not touched; what a purge or
    another compaction retired meanwhile is not brought back: the work is done again.
    """
    return repeated(spark, root, lambda log: _compact(spark, root, before, log, delete))


def _compact(spark: SparkSession, root: str, before: datetime | None, log: Log, delete: bool) -> list[str]:
    pairs = store.facts(spark, root, log).select("dt", "batch").distinct()
    if before is not None:
        pairs = pairs.filter(F.col("dt") < F.lit(before.date()))
    several = pairs.groupBy("dt").count().filter("count > 1").select("dt")
    merged_pairs = checkpointed(pairs.join(several, "dt"))
    seen = {
        tab: checkpointed(store.sightings(spark, root, tab, log).select("batch").distinct()) for tab in ("users", "worlds")
    }
    days = sorted(r.dt.isoformat() for r in merged_pairs.select("dt").distinct().collect())
    foldable = {tab: table for tab, table in seen.items() if table.count() > 1}
    if not days and not foldable:
        return []
    commit = commit_key("compact")
    retired = merged_pairs.select(F.lit("actions").alias("tab"), "dt", "batch")
    if days:
        rows = store.facts(spark, root, log).join(merged_pairs, ["dt", "batch"], "left_semi")
        stored = [c for c in ACTIONS.fieldNames() if c != "batch"]
        rows = rows.select(*stored).distinct().withColumn("batch", F.lit(commit)).select(*ACTIONS.fieldNames())
        rows = rows.hint("rebalance", "dt").sortWithinPartitions("dt", "batch", "world_id", "x", "z", "y", "ts")
        store.write_partitions(rows, f"{root}/actions", "dt", "batch")
    for tab, old in foldable.items():
        kept = store.sightings(spark, root, tab, log).join(old, "batch", "left_semi")
        if tab == "users":
            kept = kept.groupBy("user_id", "user_key").agg(
                F.max("uuid").alias("uuid"), F.min_by("name", "first_seen").alias("name"),
                F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
            )
        else:
            kept = kept.select("world_id", "world_key").distinct()
        store.write_partitions(kept.withColumn("batch", F.lit(commit)), f"{root}/{tab}", "batch")
        retired = retired.unionByName(old.select(F.lit(tab).alias("tab"), F.lit(None).cast("date").alias("dt"), "batch"))
    publish(spark, root, commit, "compact", retired, log)
    if delete:
        drop_retired(spark, root, commit)
    return days


# --- schema steps ------------------------------------------------------------

def _with_nulls(df: DataFrame, **columns: str) -> DataFrame:
    for name, kind in columns.items():
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


# Step from the version before; the keys are never renumbered.
UPGRADES: dict[int, Callable[[DataFrame], DataFrame]] = {
    3: lambda df: df.withColumn("target", F.col("target").cast("string")),
    4: lambda df: _with_nulls(df, sign_side="string", sign_dye_color="string", sign_waxed="boolean"),
    5: lambda df: _with_nulls(
        df, old_block_state="string", new_block_state="string",
        block_entity_nbt="binary", item_nbt="binary", entity_nbt="binary",
    ),
}
OLDEST_VERSION = 2


def upgrade_schema(actions: DataFrame, version: int, target: int = SCHEMA_VERSION) -> DataFrame:
    """Columns of an older fact table brought to ``target``, one step at a
    time; newer or unknown versions are refused."""
    if not OLDEST_VERSION <= version <= target <= SCHEMA_VERSION:
        raise ValueError(f"cannot go from version {version} to {target}")
    for step in range(version + 1, target + 1):
        actions = UPGRADES[step](actions)
    return actions


def read_version(spark: SparkSession, root: str) -> int | None:
    from tracewell.sources.tables import read_table
    from pyspark.sql import types as T

    table = read_table(spark, f"{root}/schema_version", T.StructType([T.StructField("version", T.IntegerType())]))
    return table.agg(F.max("version")).first()[0]


def write_version(spark: SparkSession, root: str, version: int = SCHEMA_VERSION) -> None:
    row = spark.range(1).select(F.lit(version).alias("version"))
    row.write.mode("overwrite").parquet(f"{root}/schema_version")


def upgrade_dataset(spark: SparkSession, old_root: str, new_root: str) -> int:
    """Rewrite an older dataset, with its ledger and quarantine, under a new root, which
    gets its version last. Facts of a dataset without commits all count."""
    version = read_version(spark, old_root)
    if version is None or version >= SCHEMA_VERSION:
        raise ValueError(f"nothing to upgrade at version {version}")
    old = spark.read.parquet(f"{old_root}/actions")
    rows = upgrade_schema(old, version)
    rows.select(*[F.col(f.name).cast(f.dataType) for f in ACTIONS.fields]).write.mode("overwrite").partitionBy(
        "dt", "batch"
    ).parquet(f"{new_root}/actions")
    for name in CARRIED:
        source = Backend(spark, old_root).read(name)
        if source is not None:
            Backend(spark, new_root).write(name, source)
    if Backend(spark, old_root).read("commits") is None:
        keys = old.select(F.col("batch").cast("string").alias("commit")).distinct()
        target = Backend(spark, new_root)
        target.write("commits", keys.withColumn("kind", F.lit("append")))
        target.write("retired", spark.createDataFrame([], RETIRED))
    write_version(spark, new_root)
    return version


# --- copies --------------------------------------------------------------------

# Parents before children.
TABLES = {
    "users": ("batch",),
    "worlds": ("batch",),
    "actions": ("dt", "batch"),
    "rollback_batches": ("status", "batch_id"),
    "rollback_batch_actions": ("batch_id", "step"),
}


# What an upgrade takes over as it is.
CARRIED = {**{t: p for t, p in TABLES.items() if t != "actions"}, "quarantine": ("batch",), "commits": (), "retired": ()}
# The log of a folder goes as a first snapshot, its last table last.
_SNAPSHOT = {"commits": "snapshots/n=1/keys", "retired": "snapshots/n=1/retired"}


class CopyRefused(ValueError):
    pass


class Backend:
    """Where a dataset lives: a folder in a file format, or a database.

    For ``jdbc`` the options hold url, driver and credentials, and reads are
    split on ``id`` when bounds are given (partitionColumn, lowerBound,
    upperBound, numPartitions).
    """

    def __init__(self, spark: SparkSession, location: str = "", fmt: str = "parquet", **options: str):
        self.spark, self.location, self.fmt, self.options = spark, location, fmt, options

    def read(self, table: str) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        reader = self.spark.read.format(self.fmt).options(**self.options)
        try:
            if self.fmt == "jdbc":
                return reader.option("dbtable", table).load()
            if table in _SNAPSHOT and self.fmt == "parquet":
                if not has_log(self.spark, self.location):
                    return None
                log = read_log(self.spark, self.location)
                return log.keys() if table == "commits" else log.retired()
            return reader.load(f"{self.location}/{table}")
        except AnalysisException as failure:
            if failure.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def write(self, table: str, rows: DataFrame) -> None:
        writer = rows.write.format(self.fmt).options(**self.options).mode("overwrite")
        if self.fmt == "jdbc":
            writer.option("dbtable", table).option("truncate", "true").save()
        else:
            parts = TABLES.get(table) or CARRIED.get(table)
            if parts:
                writer = writer.option("partitionOverwriteMode", "static").partitionBy(*parts)
            writer.save(f"{self.location}/{_SNAPSHOT.get(table, table)}")

    def version(self) -> int | None:
        table = self.read("schema_version")
        return None if table is None else table.agg(F.max("version")).first()[0]


def copy_dataset(source: Backend, target: Backend, force: bool = False) -> dict[str, int]:
    """Copy all tables; returns rows per table.

    Both sides must have the current schema version (an empty target has none
    yet), a target with rows is refused unless forced, and every table's count
    is compared afterwards. The version is written last.
    """
    if source.version() != SCHEMA_VERSION:
        raise CopyRefused(f"source is at version {source.version()}, not {SCHEMA_VERSION}")
    if target.version() not in (None, SCHEMA_VERSION):
        raise CopyRefused(f"target is at version {target.version()}, not {SCHEMA_VERSION}")
    if not force:
        for table in TABLES:
            there = target.read(table)
            if there is not None and there.limit(1).count():
                raise CopyRefused(f"target table {table} is not empty")
    copied = {}
    for table in TABLES:
        rows = source.read(table)
        if rows is None:
            copied[table] = 0
            continue
        expected = rows.count()
        target.write(table, rows)
        arrived = target.read(table).count()
        if arrived != expected:
            raise CopyRefused(f"{table}: {arrived} rows arrived of {expected}")
        copied[table] = arrived
    for table in ("quarantine", "commits", "retired"):
        rows = source.read(table)
        if rows is not None:
            target.write(table, rows)
    target.write("schema_version", source.read("schema_version"))
    return copied
