"""Jobs that write: facts are stored under the shared folder, worked on and
read back (A2, A7, F10, J1, J2, J4, J5, J6)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta

from pyspark.sql import functions as F

from tracewell.functions.predicates import ActionFilter, default_rollback_scope, guard_radius, guard_time
from tracewell.operators import ledger, rollback
from tracewell.plans.binding import NOW, as_events, facts, oracle
from tracewell.plans.maintenance import OLD, OLD_SQL
from tracewell.plans.registry import ORACLES, query
from tracewell.plans.rollbacks import NEARBY, NEARBY_SQL, SINCE_SQL, planned_sql
from tracewell.session import checkpointed, scratch_folder
from tracewell.sources import commits, exports, maintenance
from tracewell.sources import facts as store

STORED = ("id", "ts", "type", "actor_uuid", "actor_name", "world_key", "x", "y", "z", "target", "amount", "rolled_back", "sign_side")
STORED_SQL = ", ".join(STORED)


def stored(spark, sf, name):
    root = scratch_folder(spark, name)
    store.append_actions(as_events(facts(spark, sf)), root)
    return root


def scanned(spark, root):
    return store.scan_actions(spark, root).select(*STORED)


@query("append_actions", oracle(f"SELECT {STORED_SQL} FROM a"))
def append_actions(spark, sf):
    """Written twice as one batch: the second is recognised as a retry."""
    root = scratch_folder(spark, "append")
    for _ in range(2):
        store.append_actions(as_events(facts(spark, sf)), root, 0)
    return scanned(spark, root)


@query("stored_users", ORACLES["resolve_users"])
def stored_users(spark, sf):
    users = store.users(spark, stored(spark, sf, "users"))
    return users.select("user_key", "uuid", "name", "first_seen", "last_seen")


@query("open_close_batch", oracle(f"""{planned_sql(f'{NEARBY_SQL} AND rolled_back = 0')}
SELECT id, CASE WHEN id IN (SELECT id FROM plan) THEN 1 ELSE rolled_back END AS rolled_back FROM a"""))
def open_close_batch(spark, sf):
    root = stored(spark, sf, "ledger")
    book = ledger.Ledger(spark, root)
    plan = rollback.plan_rollback(store.scan_actions(spark, root), NEARBY)
    book.open_batch(plan, rollback.ROLLBACK, None, NOW, NEARBY, 1)
    book.close_batch(ledger.step_results(plan, rollback.ROLLBACK), 1, NOW)
    return store.scan_actions(spark, root).select("id", "rolled_back")


def _rest(sql: str) -> str:
    return f"SELECT {STORED_SQL.replace(', sign_side', '')} FROM ({sql})"


@query("purge_dataset", _rest(ORACLES["purge"]))
def purge_dataset(spark, sf):
    root = stored(spark, sf, "purge")
    maintenance.purge(spark, root, OLD, NOW)
    return scanned(spark, root).drop("sign_side")


@query("auto_purge_dataset", _rest(ORACLES["auto_purge"]))
def auto_purge_dataset(spark, sf):
    root = stored(spark, sf, "auto-purge")
    maintenance.auto_purge(spark, root, NOW, timedelta(days=10, hours=12))
    return scanned(spark, root).drop("sign_side")


@query("compact", oracle(f"SELECT {STORED_SQL} FROM a"))
def compact(spark, sf):
    """Two overlapping batches become one partition per day."""
    root = stored(spark, sf, "compact")
    late = facts(spark, sf).filter(F.col("type").isin(1, 2))
    store.append_actions(as_events(late), root, 1)
    maintenance.compact(spark, root)
    return scanned(spark, root)


@query("two_appends", oracle(f"SELECT {STORED_SQL} FROM a"))
def two_appends(spark, sf):
    """Different events of the same days, in two appends that name no batch."""
    root = scratch_folder(spark, "two-appends")
    for i in range(2):
        store.append_actions(as_events(facts(spark, sf).filter(F.col("id") % 2 == i)), root)
    return scanned(spark, root)


@query("append_after_compact", oracle(f"SELECT {STORED_SQL} FROM a"))
def append_after_compact(spark, sf):
    """Two commits are merged; the first is then tried again, and a third one comes."""
    root = scratch_folder(spark, "after-compact")
    thirds = [as_events(facts(spark, sf).filter(F.col("id") % 3 == i)) for i in range(3)]
    for i in (0, 1):
        store.append_actions(thirds[i], root, i)
    maintenance.compact(spark, root)
    for i in (0, 2):
        store.append_actions(thirds[i], root, i)
    return scanned(spark, root)


@query("compact_shared_ids", oracle("SELECT id, ts, amount FROM a UNION ALL SELECT id, ts, amount + 1 FROM a"))
def compact_shared_ids(spark, sf):
    """Different facts that share an id all stay."""
    root = stored(spark, sf, "shared-ids")
    store.append_actions(as_events(facts(spark, sf).withColumn("amount", F.col("amount") + 1)), root)
    maintenance.compact(spark, root)
    return store.facts(spark, root).select("id", "ts", "amount")


def _side_by_side(*jobs):
    with ThreadPoolExecutor(len(jobs)) as pool:
        for job in [pool.submit(job) for job in jobs]:
            job.result()


def _two_commits(spark, sf, name):
    root = scratch_folder(spark, name)
    for i in range(2):
        store.append_actions(as_events(facts(spark, sf).filter(F.col("id") % 3 == i)), root, i)
    return root, as_events(facts(spark, sf).filter(F.col("id") % 3 == 2))


@query("purge_beside_compact", _rest(ORACLES["purge"]))
def purge_beside_compact(spark, sf):
    """A purge, a compaction and an append at the same time: each fact once, none back."""
    root, late = _two_commits(spark, sf, "purge-compact")
    _side_by_side(
        lambda: maintenance.purge(spark, root, OLD, NOW),
        lambda: maintenance.compact(spark, root),
        # What arrives late is not purged by a purge that ran before.
        lambda: store.append_actions(late.filter(~maintenance.selected(maintenance.purge_filter(OLD, NOW))), root, 2),
    )
    return scanned(spark, root).drop("sign_side")


@query("two_compactions", oracle(f"SELECT {STORED_SQL} FROM a"))
def two_compactions(spark, sf):
    root, late = _two_commits(spark, sf, "two-compactions")
    _side_by_side(
        lambda: maintenance.compact(spark, root), lambda: maintenance.compact(spark, root),
        lambda: store.append_actions(late, root, 2),
    )
    return scanned(spark, root)


@query("two_purges", oracle(f"""SELECT {STORED_SQL} FROM a
WHERE id NOT IN (SELECT id FROM a WHERE {OLD_SQL}) AND ts >= TIMESTAMP '2024-01-08 12:00:00'"""))
def two_purges(spark, sf):
    """A purge by filter and one by age, which meet in the same partitions."""
    root = stored(spark, sf, "two-purges")
    _side_by_side(
        lambda: maintenance.purge(spark, root, OLD, NOW),
        lambda: maintenance.auto_purge(spark, root, NOW, timedelta(days=22, hours=12)),
    )
    return scanned(spark, root)


@query("scan_from_snapshot", oracle(f"SELECT {STORED_SQL} FROM a"))
def scan_from_snapshot(spark, sf):
    """The log is read from a snapshot and the entries after it; retries are known from it."""
    root, late = _two_commits(spark, sf, "snapshot")
    maintenance.compact(spark, root)
    commits.snapshot(spark, root)
    store.append_actions(as_events(facts(spark, sf).filter(F.col("id") % 3 == 0)), root, 0)
    store.append_actions(late, root, 2)
    return scanned(spark, root)


@query("upgrade_keeps_flags", oracle(f"""{planned_sql(f'{NEARBY_SQL} AND rolled_back = 0')}
SELECT id, CASE WHEN id IN (SELECT id FROM plan) THEN 1 ELSE rolled_back END AS rolled_back FROM a"""))
def upgrade_keeps_flags(spark, sf):
    root, new = stored(spark, sf, "upgrade"), scratch_folder(spark, "upgraded")
    book = ledger.Ledger(spark, root)
    plan = rollback.plan_rollback(store.scan_actions(spark, root), NEARBY)
    book.open_batch(plan, rollback.ROLLBACK, None, NOW, NEARBY, 1)
    book.close_batch(ledger.step_results(plan, rollback.ROLLBACK), 1, NOW)
    maintenance.write_version(spark, root, 4)
    maintenance.upgrade_dataset(spark, root, new)
    return store.scan_actions(spark, new).select("id", "rolled_back")


NETHER = ActionFilter(since=NEARBY.since, world="the_nether", x=0, z=0, radius=4)
NETHER_SQL = NEARBY_SQL.replace("overworld", "the_nether")


BOTH_SQL = f"(({NEARBY_SQL}) OR ({NETHER_SQL})) AND rolled_back = 0"


@query("undo_twice", oracle(f"""{planned_sql(BOTH_SQL)}
SELECT CASE WHEN world_key = 'minecraft:overworld' THEN 2 ELSE 1 END AS batch_id, id FROM plan"""))
def undo_twice(spark, sf):
    """Two rollbacks; the first undo reverts the second of them, the next one goes one
    further back and is not led astray by the undo itself."""
    root = stored(spark, sf, "undo-twice")
    book = ledger.Ledger(spark, root)
    for number, flt in ((1, NETHER), (2, NEARBY)):
        plan = rollback.plan_rollback(store.scan_actions(spark, root), flt)
        book.open_batch(plan, rollback.ROLLBACK, None, NOW, flt, number)
        book.close_batch(ledger.step_results(plan, rollback.ROLLBACK), number, NOW)
    found = []
    for number in (3, 4):
        undone, flt, plan = book.plan_undo(store.scan_actions(spark, root), None)
        plan = checkpointed(plan)
        found.append(plan.select(F.lit(undone).cast("int").alias("batch_id"), "id"))
        book.open_batch(plan, rollback.RESTORE, None, NOW, flt, number, undoes=undone)
        # Restored kills cannot be carried out; the batch counts as done all the same.
        book.close_batch(plan.select("id", F.lit(True).alias("ok")), number, NOW)
    return found[0].unionByName(found[1])


@query("stored_lookup", oracle(f"SELECT {STORED_SQL} FROM a WHERE {NEARBY_SQL} AND type IN (1, 2) AND user_id = 7 AND actor_uuid IS NOT NULL"))
def stored_lookup(spark, sf):
    """World, user, type and place of a filter reach the stored facts."""
    root = stored(spark, sf, "lookup")
    flt = NEARBY.but(types=(1, 2), uuids=("00000000-0000-4000-8000-000000000007",))
    return flt.apply(store.scan_actions(spark, root, flt=flt)).select(*STORED)


@query("scoped_rollback", oracle(f"""{planned_sql(f'{SINCE_SQL} AND x BETWEEN -10 AND 10 AND z BETWEEN -10 AND 10 AND y BETWEEN 52 AND 72 AND rolled_back = 0')}
SELECT id FROM plan"""))
def scoped_rollback(spark, sf):
    """A rollback that names no place: ten blocks around the caller, within the limits."""
    rows = facts(spark, sf)
    flt = guard_time(guard_radius(default_rollback_scope(ActionFilter(since=NEARBY.since), (0, 62, 0)), 100))
    plan = rollback.plan_rollback(rows, flt)
    rollback.check_limits(rollback.scanned_rows(rows, flt, rollback.ROLLBACK), plan, 1_000_000, 1_000_000)
    return plan.select("id")


@query("copy_dataset", oracle("""
SELECT 'users' AS tab, count(DISTINCT coalesce(actor_uuid, actor_name)) AS n FROM a UNION ALL SELECT 'worlds', count(DISTINCT world_key) FROM a
UNION ALL SELECT 'actions', count(*) FROM a UNION ALL SELECT 'rollback_batches', 0 UNION ALL SELECT 'rollback_batch_actions', 0"""))
def copy_dataset(spark, sf):
    root, target = stored(spark, sf, "copy"), scratch_folder(spark, "copied")
    maintenance.write_version(spark, root)
    counts = maintenance.copy_dataset(maintenance.Backend(spark, root), maintenance.Backend(spark, target, "orc"))
    return spark.createDataFrame(list(counts.items()), "tab string, n long")


@query("export_files", ORACLES["export_jsonl"])
def export_files(spark, sf):
    path = scratch_folder(spark, "export")
    exports.export_jsonl(facts(spark, sf), path)
    return spark.read.text(path).select("value", F.col("dt").cast("date").alias("dt"))


@query("prune_exports", f"SELECT value, dt FROM ({ORACLES['export_jsonl']}) WHERE dt >= DATE '2024-01-16'")
def prune_exports(spark, sf):
    path = scratch_folder(spark, "prune")
    exports.export_jsonl(facts(spark, sf), path)
    exports.prune_exports(spark, path, (NOW + timedelta(days=15)).date())
    return spark.read.text(path).select("value", F.col("dt").cast("date").alias("dt"))
