"""Plans, mutations and the ledger."""

import pytest
from pyspark.sql import functions as F

from helpers import START, action, actions, at, ids
from tracewell.functions.predicates import ActionFilter
from tracewell.operators import ledger as led
from tracewell.operators import rollback as rb
from tracewell.operators.explosions import merge_sidecar, explode_affected
from tracewell.plans import registry
from tracewell.schema import ACTION_TYPES, ROLLBACKABLE

SINCE = ActionFilter(since=START)


def test_every_type_is_planned_or_skipped(spark):
    rows = actions(spark, *[action(t.id, t.id, t.id, x=t.id) for t in ACTION_TYPES])
    assert sorted(ids(rb.plan_rollback(rows, SINCE))) == sorted(ROLLBACKABLE)
    counts = rb.preview(rows, SINCE, rb.ROLLBACK).first()
    assert (counts.planned, counts.skipped, counts.scanned) == (20, 20, 40)
    for fn in (rb.inverse_mutations, rb.forward_mutations):
        done = {r.action_id for r in fn(rb.plan_rollback(rows, SINCE)).filter("verb is not null").collect()}
        assert done == set(ROLLBACKABLE) - {8}  # the explosion here has no readable list


def test_newest_wins_across_types(spark):
    rows = actions(
        spark, action(1, 1, 1), action(2, 2, 2), action(3, 2, 40), action(4, 3, 3), action(5, 4, 3), action(6, 5, 8),
        action(7, 6, 8), action(8, 1, 1, world="w"), action(9, 7, 18),
    )
    assert ids(rb.plan_rollback(rows, SINCE)) == [7, 6, 5, 4, 3, 8]


def test_modes_pick_by_flag_and_need_time(spark):
    rows = actions(spark, action(1, 1, 1, x=1), action(2, 2, 1, x=2, rolled_back=1))
    assert ids(rb.plan_rollback(rows, SINCE)) == [1]
    assert ids(rb.plan_restore(rows, SINCE)) == [2]
    with pytest.raises(ValueError):
        rb.plan_rollback(rows, ActionFilter())


def test_explosions_reaching_in(spark):
    rows = actions(
        spark,
        action(1, 1, 8, x=10, target="3:64:0=a:b"), action(2, 2, 8, x=10, target="9:64:0=a:b"), action(3, 3, 8, x=2, target="50:64:0=a:b"),
        action(4, 4, 8, x=40, target="1:64:0=a:b"), action(5, 5, 1, x=1), action(6, 6, 8, x=10, target="bad"),
        action(7, 7, 8, x=10, target="3:64:0=a:b", rolled_back=1), action(8, 8, 8, x=10, target="3:99:0=a:b"),
    )
    near = ActionFilter(since=START, x=0, z=0, radius=3)
    got = [(r.id, r.plan_part) for r in rb.plan_with_explosions(rows, near, rb.ROLLBACK).collect()]
    assert got == [(5, 0), (3, 0), (8, 1), (1, 1)]
    assert ids(rb.plan_with_explosions(rows, near.but(y=64), rb.ROLLBACK)) == [5, 3, 1]
    assert ids(rb.plan_with_explosions(rows, near.but(types=("block",)), rb.ROLLBACK)) == [5]
    assert ids(rb.plan_with_explosions(rows, near.but(types=("explosion",)), rb.ROLLBACK)) == [3, 8, 1]
    assert 4 in ids(rb.plan_with_explosions(rows, near, rb.ROLLBACK, reach=40))
    assert ids(rb.plan_with_explosions(rows, near, rb.RESTORE)) == [7]
    boxed = near.but(box=(-3, 0, -3, 3, 99, 3))
    assert ids(rb.plan_with_explosions(rows, boxed, rb.ROLLBACK)) == [5, 3, 8, 1]


def test_limits(spark):
    rows = actions(spark, *[action(i, i, 1, x=i) for i in range(10)])
    rb.check_limits(rows, rows, 10, 10)
    rb.check_limits(rows, rows)
    with pytest.raises(rb.PlanTooLarge):
        rb.check_limits(rows, rows, 9)


def verbs(df):
    return {r.action_id: (r.verb, r.object, r.amount, r.meta, r.state) for r in df.collect()}


def test_mutations(spark):
    rows = actions(
        spark, action(1, 1, 1, x=1, meta="m"), action(2, 1, 2, x=2, meta="m"), action(3, 1, 3, amount=0), action(4, 1, 4, amount=5, meta="m"),
        action(7, 1, 7, meta="m"), action(26, 1, 26, x=3, meta="new"), action(27, 1, 26, x=4), action(34, 1, 34, meta="m"), action(35, 1, 35, meta="m"),
    ).withColumn("old_block_state", F.lit("old")).withColumn("new_block_state", F.when(F.col("id") != 2, F.lit("new")))
    plan = rb.plan_rollback(rows, SINCE)
    back, forth = verbs(rb.inverse_mutations(plan)), verbs(rb.forward_mutations(plan))
    stone, air = "minecraft:stone", "minecraft:air"
    assert back == {
        1: ("set", air, None, None, None), 2: ("set", stone, None, "m", "old"), 3: ("remove_item", stone, 1, None, None),
        4: ("give_item", stone, 5, "m", None), 7: ("respawn", stone, None, "m", None), 26: ("set", stone, None, None, "old"),
        27: ("set", stone, None, None, "old"), 34: ("remove_entity", stone, None, None, None), 35: ("respawn", stone, None, "m", None),
    }
    assert forth == {
        1: ("set", stone, None, "m", "new"), 2: ("set", air, None, None, None), 3: ("give_item", stone, 1, None, None),
        4: ("remove_item", stone, 5, None, None), 7: ("none", stone, None, None, None), 26: ("set", "new", None, None, "new"),
        27: ("set", air, None, None, "new"), 34: ("respawn", stone, None, "m", None), 35: ("remove_entity", stone, None, None, None),
    }


def test_explosion_mutations_and_sidecar(spark):
    rows = actions(spark, action(1, 1, 8, target="1:2:3=a:b|old,4:5:6=c:d"))
    side = spark.createDataFrame([(1, 1, 2, 3, "axis=y", bytearray(b"x"))], "id long, x int, y int, z int, meta string, payload binary")
    plain = {(r.x, r.object, r.meta, r.state) for r in rb.inverse_mutations(rows).collect()}
    assert plain == {(1, "a:b", "old", None), (4, "c:d", None, None)}
    rich = {(r.x, r.object, r.meta, r.state, r.payload and bytes(r.payload)) for r in rb.inverse_mutations(rows, side).collect()}
    assert rich == {(1, "a:b", None, "axis=y", b"x"), (4, "c:d", None, None, None)}
    assert {(r.x, r.object, r.meta) for r in rb.forward_mutations(rows).collect()} == {(1, "minecraft:air", None), (4, "minecraft:air", None)}
    blocks = merge_sidecar(explode_affected(rows), side.withColumn("payload", F.lit(None).cast("string")))
    assert {(r.x, r.meta) for r in blocks.collect()} == {(1, "axis=y"), (4, None)}


def test_last_executed_change_wins(spark):
    state = spark.createDataFrame([("w", 0, 0, 0, "was"), ("w", 9, 0, 0, "kept")], "world_key string, x int, y int, z int, block string")
    rows = actions(
        spark, action(1, 1, 8, world="w", target="0:0:0=old:est,0:0:0=old:er"), action(2, 2, 8, world="w", target="0:0:0=new:er,1:0:0=n:w"),
        action(3, 3, 3, world="w", y=0),
    )
    got = {r.x: r.block for r in rb.apply_mutations(state, rb.inverse_mutations(rb.plan_rollback(rows, SINCE))).collect()}
    assert got == {0: "old:er", 1: "n:w", 9: "kept"}


def test_callback_sees_every_mutation(spark, tmp_path):
    rows = actions(spark, *[action(i, i, 1, x=i) for i in range(50)])
    folder = str(tmp_path)

    def apply_rows(part):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
            for row in part:
                out.write(f"{row.action_id}\n")

    rb.foreach_mutation(rb.inverse_mutations(rb.plan_rollback(rows, SINCE)), apply_rows)
    seen = sorted(int(line) for f in tmp_path.iterdir() for line in f.read_text().split())
    assert seen == list(range(50))


def test_ledger_round_trip(spark, tmp_path):
    book = led.Ledger(spark, str(tmp_path))
    rows = actions(spark, action(1, 1, 1, x=1), action(2, 2, 1, x=2), action(3, 3, 8, x=3, target="broken"), action(4, 4, 7, x=4))
    assert book.next_id() == 1
    flt = ActionFilter(since=START, types=(1, 7))
    plan = rb.plan_rollback(book.effective(rows), flt)
    assert book.open_batch(plan, rb.ROLLBACK, "ann", at(9), flt, 1) == 3
    assert [r.batch_id for r in led.incomplete_batches(book.batches()).collect()] == [1]
    assert [r.action_id for r in led.incomplete_actions(book.batches(), book.bridge(led.PLANNED)).collect()] == [1, 2, 4]
    assert {r.id: r.rolled_back for r in book.effective(rows).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert book.close_batch(led.step_results(plan, rb.ROLLBACK), 1, at(10))
    assert {r.id: r.rolled_back for r in book.effective(rows).collect()} == {1: 1, 2: 1, 3: 0, 4: 1}
    assert led.incomplete_batches(book.batches()).count() == 0
    # The same batch again changes nothing.
    assert book.open_batch(plan, rb.ROLLBACK, "ann", at(9), flt, 1) == 3
    assert book.batches().count() == 2 and book.bridge().count() == 6

    undo = led.undo_plan(book.effective(rows), book.batches().filter("status = 'closed'"), book.bridge(led.APPLIED), "ann", flt)
    assert [(r.id, r.mode) for r in undo.collect()] == [(4, rb.RESTORE), (2, rb.RESTORE), (1, rb.RESTORE)]
    # A restored kill cannot be carried out, so the undo stays open; what was applied is flagged.
    assert book.next_id() == 2
    book.open_batch(undo, rb.RESTORE, None, at(20), flt, 2)
    assert not book.close_batch(led.step_results(undo, rb.RESTORE), 2, at(21))
    assert {r.id: r.rolled_back for r in book.effective(rows).collect()} == {1: 0, 2: 0, 3: 0, 4: 1}
    assert [r.batch_id for r in led.incomplete_batches(book.batches()).collect()] == [2]
    history = led.undo_history(book.batches().filter("status = 'opened'"))
    assert {(r.actor, r.batch_id) for r in history.collect()} == {("ann", 1), ("00000000-0000-0000-0000-000000000000", 2)}


def test_failed_and_unreadable_steps(spark, tmp_path):
    book = led.Ledger(spark, str(tmp_path))
    rows = actions(spark, action(1, 1, 1, x=1), action(2, 2, 1, x=2), action(3, 3, 8, x=3, target="broken"))
    plan = rb.plan_rollback(rows, SINCE)
    book.open_batch(plan, rb.ROLLBACK, "ann", at(9), SINCE, 1)
    failed = spark.createDataFrame([(2,)], "id long")
    assert not book.close_batch(led.step_results(plan, rb.ROLLBACK, failed), 1, at(10))
    assert {r.id: r.rolled_back for r in book.effective(rows).collect()} == {1: 1, 2: 0, 3: 0}
    assert ids(led.batch_rows(rows, book.bridge(led.APPLIED), 1)) == [1]


def test_undo_depth(spark):
    rows = [(i, at(i), None if i % 2 else "ann", 0) for i in range(60)]
    batches = spark.createDataFrame(rows, "batch_id long, ts timestamp_ntz, actor_uuid string, mode int")
    kept = led.undo_history(batches).collect()
    assert len(kept) == 40 and min(r.batch_id for r in kept) == 20


def test_limits_count_without_sorting(spark):
    rows = actions(spark, *[action(i, i, 1, x=i % 3) for i in range(30)])
    wanted = rb.plan_rollback(rows, SINCE)
    rb.check_limits(rows, wanted, 30, 3)
    rb.check_limits(rows, wanted, 10**12, 10**12)
    for caps, what in (((29, 3), "more than 29 rows scanned"), ((30, 2), "more than 2 rows planned")):
        with pytest.raises(rb.PlanTooLarge, match=what):
            rb.check_limits(rows, wanted, *caps)


def test_rows_in_the_wanted_state_count_towards_no_limit(spark, monkeypatch):
    """A rollback scans rows that are not rolled back; so does the registered query."""
    rows = actions(spark, *(action(i, i, 1, x=i, rolled_back=i % 2) for i in range(10)))
    flt = ActionFilter(since=START)
    assert sorted(ids(rb.scanned_rows(rows, flt, rb.ROLLBACK))) == [0, 2, 4, 6, 8]
    assert sorted(ids(rb.scanned_rows(rows, flt, rb.RESTORE))) == [1, 3, 5, 7, 9]
    counted = []
    monkeypatch.setattr(rb, "check_limits", lambda scanned, *_: counted.append({r[0] for r in scanned.select("rolled_back").distinct().collect()}))
    registry.load_all()
    registry.QUERIES["scoped_rollback"](spark, "/root/testdata/sf0.001")
    assert counted == [{0}]


def test_rows_without_a_contest_are_not_shuffled(spark):
    rows = actions(spark, action(1, 0, 1), action(2, 1, 2), action(3, 2, 3), action(3, 2, 3), action(4, 3, None))
    kept = rb.newest_per_position(rows)
    assert sorted(ids(kept)) == [2, 3, 3, 4]


def test_callback_sees_the_changes_of_a_cell_in_order(spark):
    rows = actions(spark, *[action(i, i, 2, x=i % 2, target=f"b{i}") for i in range(8)])
    changes = rb.inverse_mutations(rows)

    def seen(frames):
        for pdf in frames:
            yield pdf[["action_id", "x"]]

    got = rb.mutation_outcomes(changes, seen, "action_id long, x int").withColumn("task", F.spark_partition_id())
    for x, order in ((0, [6, 4, 2, 0]), (1, [7, 5, 3, 1])):
        assert [r.action_id for r in got.filter(F.col("x") == x).collect()] == order
    assert {r.n for r in got.groupBy("x").agg(F.countDistinct("task").alias("n")).collect()} == {1}
