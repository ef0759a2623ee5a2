"""Append, scan, retention, compaction, copies, exports."""

import gzip
import json
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import START, action, actions, at, ids
from tracewell.functions.predicates import ActionFilter
from tracewell.operators import ledger as led
from tracewell.operators import rollback as rb
from tracewell.operators.lookups import pending_lookup
from tracewell.schema import ACTIONS, EVENTS, SCHEMA_VERSION
from tracewell.sources import commits, exports, facts, maintenance

DAY = 86_400


def events(spark, *rows):
    df = actions(spark, *rows)
    for f in EVENTS.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.select(*EVENTS.fieldNames())


def test_append_and_scan(spark, tmp_path):
    root = str(tmp_path)
    first = events(spark, action(1, 0, 1, uuid="u", name="old"), action(2, DAY, 2, name=None, target=None, amount=None, meta="m"),
                   action(3, 0, None), action(4, 0, 1, world=None))
    facts.append_actions(first, root, 0)
    facts.append_actions(events(spark, action(5, 2 * DAY, 1, uuid="u", name="new", world="w")), root, 1)
    facts.append_actions(first, root, 0)  # the same batch again
    got = {r.id: r for r in facts.scan_actions(spark, root).collect()}
    assert sorted(got) == [1, 2, 5]
    assert got[5].actor_name == "old" and got[5].actor_uuid == "u" and got[5].world_key == "w"
    assert (got[2].actor_name, got[2].target, got[2].amount, got[2].rolled_back) == ("#unknown", "", 1, 0)
    assert "entity_nbt" not in got[1].__fields__
    assert "entity_nbt" in facts.scan_actions(spark, root, payload=True).columns
    assert facts.facts(spark, root).schema.fieldNames() == ACTIONS.fieldNames()
    assert facts.id_collisions(spark, root).count() == 0
    user = facts.users(spark, root).filter("uuid = 'u'").first()
    assert (user.first_seen, user.last_seen) == (at(0), at(2 * DAY))
    plan = facts.scan_actions(spark, root, since=at(DAY))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan


def test_day_bound_prunes_partitions(spark, tmp_path):
    root = str(tmp_path)
    facts.append_actions(events(spark, *[action(i, i * DAY, 1) for i in range(5)]), root)
    flt = ActionFilter(since=at(2 * DAY), until=at(3 * DAY), day_column="dt")
    rows = flt.apply(facts.scan_actions(spark, root))
    assert sorted(ids(rows)) == [2, 3]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "dt#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_keys_reach_the_stored_facts(spark, tmp_path):
    root = str(tmp_path)
    facts.append_actions(events(spark, *[action(i, i, 1 + i % 2, x=i, uuid=f"u{i % 3}") for i in range(9)]), root)
    flt = ActionFilter(since=START, world="overworld", x=0, z=0, radius=4, types=(1,), uuids=("u0",))
    rows = flt.apply(facts.scan_actions(spark, root, flt=flt))
    assert sorted(ids(rows)) == [0]
    pushed = [p.split("]")[0] for p in rows._jdf.queryExecution().executedPlan().toString().split("PushedFilters: [")[1:]]
    scan = max(pushed, key=len)
    assert all(f"({c}," in scan or f"({c})" in scan for c in ("world_id", "user_id", "type", "x", "z", "ts"))


def test_commits(spark, tmp_path):
    root = str(tmp_path)
    first, second = events(spark, action(1, 0, 1)), events(spark, action(2, 1, 1), action(1, 1, 2))
    facts.append_actions(first, root)
    facts.append_actions(second, root)  # no batch named: never the same commit
    assert sorted(ids(facts.facts(spark, root))) == [1, 1, 2]
    key = facts.append_actions(events(spark, action(3, 2, 1)), root, 0, "w")
    maintenance.compact(spark, root)
    assert facts.append_actions(events(spark, action(3, 2, 1)), root, 0, "w") == key  # a retry
    facts.append_actions(events(spark, action(4, 3, 1)), root, 1, "w")
    assert sorted(ids(facts.facts(spark, root))) == [1, 1, 2, 3, 4]
    # What was written without a commit does not count.
    extra = facts.facts(spark, root).limit(1).withColumn("batch", F.lit("lost")).select(*ACTIONS.fieldNames())
    facts.write_partitions(extra, f"{root}/actions", "dt", "batch")
    assert facts.facts(spark, root).count() == 5
    with pytest.raises(ValueError):
        facts.append_actions(first, root, "a/b")


def test_scan_applies_the_ledger(spark, tmp_path):
    root = str(tmp_path)
    facts.append_actions(events(spark, action(1, 0, 1, x=1), action(2, 1, 1, x=2)), root)
    book = led.Ledger(spark, root)
    plan = rb.plan_rollback(facts.scan_actions(spark, root), ActionFilter(since=START, x=1, z=0, radius=0))
    book.open_batch(plan, rb.ROLLBACK, None, at(5), ActionFilter(since=START), 1)
    book.close_batch(led.step_results(plan, rb.ROLLBACK), 1, at(6))
    assert {r.id: r.rolled_back for r in facts.scan_actions(spark, root).collect()} == {1: 1, 2: 0}
    assert ids(rb.plan_rollback(facts.scan_actions(spark, root), ActionFilter(since=START))) == [2]


def days(spark, root, n=4, batches=2):
    for b in range(batches):
        rows = [action(b * 100 + i, i * DAY + 10 * (b + 1), 1 + i % 2, x=i, name=f"p{i % 2}") for i in range(n)]
        facts.append_actions(events(spark, *rows), root, b)


def test_purge(spark, tmp_path):
    root = str(tmp_path)
    days(spark, root)
    now = at(10 * DAY)
    with pytest.raises(ValueError):
        maintenance.purge(spark, root, ActionFilter(), now)
    with pytest.raises(ValueError):
        maintenance.purge(spark, root, ActionFilter(since=now - timedelta(hours=1)), now)
    assert maintenance.purge(spark, root, ActionFilter(since=at(2 * DAY + 10), until=at(0), names=("p0",)), now) == 3
    assert sorted(ids(facts.facts(spark, root))) == [1, 3, 101, 102, 103]
    assert maintenance.purge(spark, root, ActionFilter(since=at(2 * DAY + 10), names=("p0",)), now) == 0
    assert maintenance.purge(spark, root, ActionFilter(since=at(3 * DAY + 10)), now, compact_after=True) == 4
    assert ids(facts.facts(spark, root)) == [103]


def test_auto_purge_is_strict(spark, tmp_path):
    root = str(tmp_path)
    days(spark, root)
    assert maintenance.auto_purge(spark, root, at(10 * DAY), timedelta(seconds=8 * DAY - 20)) == 5
    assert sorted(ids(facts.facts(spark, root))) == [3, 102, 103]


def test_compact(spark, tmp_path):
    root = str(tmp_path)
    days(spark, root)
    before = sorted(ids(facts.facts(spark, root)))
    assert len(maintenance.compact(spark, root, before=at(3 * DAY))) == 3
    assert sorted(ids(facts.facts(spark, root))) == before
    (merged,) = [p.name for p in (tmp_path / "actions" / "dt=2024-01-01").iterdir() if p.is_dir()]
    assert merged.startswith("batch=compact-")
    assert sorted(p.name for p in (tmp_path / "actions" / "dt=2024-01-04").iterdir() if p.is_dir()) == ["batch=main-0", "batch=main-1"]
    maintenance.compact(spark, root)
    assert sorted(ids(facts.facts(spark, root))) == before


def test_schema_steps(spark, tmp_path):
    old = actions(spark, action(1, 0, 1)).select("id", "target")
    assert maintenance.upgrade_schema(old, 2).columns[-5:] == ["old_block_state", "new_block_state", "block_entity_nbt", "item_nbt", "entity_nbt"]
    assert maintenance.upgrade_schema(old, 3, 4).columns == ["id", "target", "sign_side", "sign_dye_color", "sign_waxed"]
    for version, target in ((1, 5), (5, 6), (4, 3)):
        with pytest.raises(ValueError):
            maintenance.upgrade_schema(old, version, target)
    src, dst = str(tmp_path / "old"), str(tmp_path / "new")
    days(spark, src)
    dropped = ["sign_side", "sign_dye_color", "sign_waxed", "old_block_state", "new_block_state", "block_entity_nbt", "item_nbt", "entity_nbt"]
    v3 = str(tmp_path / "v3")
    facts.facts(spark, src).drop(*dropped).write.partitionBy("dt", "batch").parquet(f"{v3}/actions")
    for name in ("users", "worlds"):
        spark.read.parquet(f"{src}/{name}").write.partitionBy("batch").parquet(f"{v3}/{name}")
    maintenance.write_version(spark, v3, 3)
    assert maintenance.upgrade_dataset(spark, v3, dst) == 3
    assert maintenance.read_version(spark, dst) == SCHEMA_VERSION
    assert facts.scan_actions(spark, dst, payload=True).count() == 8
    with pytest.raises(ValueError):
        maintenance.upgrade_dataset(spark, dst, v3)


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_copy(spark, tmp_path, fmt):
    src = str(tmp_path / "src")
    days(spark, src)
    source, target = maintenance.Backend(spark, src), maintenance.Backend(spark, str(tmp_path / "dst"), fmt)
    with pytest.raises(maintenance.CopyRefused):
        maintenance.copy_dataset(source, target)
    maintenance.write_version(spark, src)
    counts = maintenance.copy_dataset(source, target)
    assert counts == {"users": 4, "worlds": 2, "actions": 8, "rollback_batches": 0, "rollback_batch_actions": 0}
    with pytest.raises(maintenance.CopyRefused):
        maintenance.copy_dataset(source, target)
    assert maintenance.copy_dataset(source, target, force=True) == counts
    assert sorted(ids(target.read("actions"))) == sorted(ids(source.read("actions")))


def test_exports(spark, tmp_path):
    path = str(tmp_path)
    rows = actions(
        spark, action(1, 1.5, 2, target="minecraft:diamond_ore", name="Notch", uuid="u"), action(2, DAY, 9, target='say "hi"'),
        action(3, 40 * DAY, 1),
    )
    for _ in range(2):
        exports.export_jsonl(rows, path)
    files = list((tmp_path / "dt=2024-01-01").glob("*.gz"))
    lines = [line for f in files for line in gzip.open(f, "rt").read().splitlines()]
    assert lines == [
        '{"ts":1704067201500,"type":"BLOCK_BREAK","actor":{"uuid":"u","name":"Notch"},"world":"minecraft:overworld",'
        '"pos":[0,64,0],"target":"minecraft:diamond_ore","amount":1,"source":null,"meta":null}'
    ]
    chat = [json.loads(line) for f in (tmp_path / "dt=2024-01-02").glob("*.gz") for line in gzip.open(f, "rt")]
    assert chat[0]["target"] == 'say "hi"' and chat[0]["actor"]["uuid"] is None
    assert [r.dt for r in exports.expired_exports(spark, path, date(2024, 2, 1)).collect()] == ["2024-01-01"]
    assert exports.prune_exports(spark, path, date(2024, 2, 1)) == 1
    assert exports.prune_exports(spark, path, date(2024, 2, 1)) == 0
    assert sorted(p.name for p in tmp_path.iterdir() if p.is_dir()) == ["dt=2024-01-02", "dt=2024-02-10"]


def test_pending(spark):
    landing = actions(spark, action(1, 0, 1), action(2, 0, 1), action(3, 0, 1, x=1))
    stored = landing.filter("id = 1")
    assert ids(pending_lookup(landing, stored, "overworld", 0, 64, 0)) == [2]


def beside(monkeypatch, module, other):
    """Run ``other`` once, between the work of a job and its commit."""
    real, done = module.publish, []

    def publish(*args, **kwargs):
        if not done:
            done.append(True)
            other()
        return real(*args, **kwargs)

    monkeypatch.setattr(module, "publish", publish)


def test_purge_during_compact(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    days(spark, root)
    beside(monkeypatch, maintenance, lambda: maintenance.purge(spark, root, ActionFilter(since=at(DAY), types=(1,)), at(10 * DAY)))
    maintenance.compact(spark, root)
    assert sorted(ids(facts.facts(spark, root))) == [1, 2, 3, 101, 102, 103]
    assert facts.scan_actions(spark, root).count() == 6


def test_two_compactions_and_two_purges(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    days(spark, root)
    beside(monkeypatch, maintenance, lambda: maintenance.compact(spark, root))
    maintenance.compact(spark, root)
    assert sorted(ids(facts.facts(spark, root))) == [0, 1, 2, 3, 100, 101, 102, 103]
    old = at(10 * DAY)
    beside(monkeypatch, maintenance, lambda: maintenance.purge(spark, root, ActionFilter(since=at(2 * DAY), names=("p0",)), old))
    assert maintenance.purge(spark, root, ActionFilter(since=at(DAY + 30), names=("p1",)), old) == 2
    assert sorted(ids(facts.facts(spark, root))) == [2, 3, 102, 103]


def test_compact_during_purge_and_append(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    days(spark, root)

    def others():
        facts.append_actions(events(spark, action(500, 5, 2)), root, 7)
        maintenance.compact(spark, root)

    beside(monkeypatch, maintenance, others)
    assert maintenance.auto_purge(spark, root, at(10 * DAY), timedelta(days=8)) == 5
    assert sorted(ids(facts.facts(spark, root))) == [2, 3, 102, 103]


def test_purge_goes_by_row_not_by_id(spark, tmp_path):
    root = str(tmp_path)
    facts.append_actions(events(spark, action(1, 0, 1), action(1, 0, 2), action(2, 0, 2)), root)
    assert maintenance.purge(spark, root, ActionFilter(since=at(5), types=(1,)), at(10 * DAY)) == 1
    assert sorted((r.id, r.type) for r in facts.facts(spark, root).collect()) == [(1, 2), (2, 2)]


def test_snapshots_bound_what_a_scan_opens(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    monkeypatch.setattr(commits, "SNAPSHOT", 4)
    keys = [facts.append_actions(events(spark, action(i, i, 1)), root, i) for i in range(10)]
    log = commits.read_log(spark, root)
    assert (log.base, log.head, len(log.tail)) == (8, 10, 2)
    assert all(commits.is_published(spark, root, k) for k in keys) and not commits.is_published(spark, root, "main-99")
    facts.append_actions(events(spark, action(0, 0, 1)), root, 0)  # a retry, known from the snapshot
    maintenance.compact(spark, root)
    assert commits.read_log(spark, root).head == 11
    facts.append_actions(events(spark, action(11, 11, 1)), root, 11)
    assert commits.read_log(spark, root).tail == ()  # 12: all in a snapshot, with what was retired
    assert sorted(ids(facts.scan_actions(spark, root))) == [*range(10), 11]
    # A snapshot that was not finished does not count.
    (tmp_path / "snapshots" / "n=12" / "retired" / "_SUCCESS").unlink()
    assert commits.read_log(spark, root).base == 8
    assert sorted(ids(facts.scan_actions(spark, root))) == [*range(10), 11]


def test_entries_are_created_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from tracewell.sources import folders

    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: folders.create_new(spark, f"{tmp_path}/log/1", str(i)), range(8)))
    assert sum(won) == 1 and folders.read_text(spark, f"{tmp_path}/log/1") == str(won.index(True))
    assert folders.names(spark, f"{tmp_path}/log") == ["1"]
    # The form for other file systems.
    (tmp_path / "a").write_text("a"), (tmp_path / "b").write_text("b")
    path = spark._jvm.org.apache.hadoop.fs.Path
    for name, moved in (("a", True), ("b", False)):
        assert folders._moved(spark, path(f"file:{tmp_path}/{name}"), path(f"file:{tmp_path}/c")) == moved
    assert (tmp_path / "c").read_text() == "a"


def test_appends_side_by_side(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: facts.append_actions(events(spark, action(i, i, 1)), root, i % 6), range(6)))
    assert sorted(ids(facts.facts(spark, root))) == list(range(6))
    assert commits.read_log(spark, root).head == 6


def test_retired_folders_can_stay_for_readers(spark, tmp_path):
    root = str(tmp_path)
    days(spark, root)
    reader = facts.scan_actions(spark, root)
    assert maintenance.purge(spark, root, ActionFilter(since=at(DAY)), at(10 * DAY), compact_after=True, delete=False) == 2
    assert reader.count() == 8 and facts.facts(spark, root).count() == 6
    maintenance.vacuum(spark, root)
    assert facts.scan_actions(spark, root).count() == 6
    left = [p.parent.name + "/" + p.name for p in tmp_path.glob("actions/*/*") if p.is_dir()]
    assert not any("batch=main" in p for p in left if "dt=2024-01-02" in p), left
