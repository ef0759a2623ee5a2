"""State observations turned into actions."""

import random
from datetime import timedelta

import pytest

from helpers import make
from tracewell.functions.blocks import CATEGORY_IDS, HOT_CATEGORIES, NO_CATEGORY, change_between
from tracewell.operators import diffs
from tracewell.operators.segments import with_previous

SNAP = "session string, slot int, item string, count int, at timestamp_ntz"
OBSERVED = "id long, ts timestamp_ntz, world_key string, x int, y int, z int, block string"
SAMPLE = "id long, ts timestamp_ntz, world_key string, x int, y int, z int, slots array<string>"


def snapshots(spark, rows):
    from helpers import at

    return spark.createDataFrame([(*r[:4], at(r[4])) for r in rows], SNAP)


def test_containers(spark):
    opens = snapshots(spark, [("a", 0, "diamond", 5, 0), ("a", 2, "dirt", 1, 0), ("a", 3, "coal", 9, 0), ("a", 216, "far", 1, 0),
                              ("b", 0, "x", 1, 0), ("c", 0, "x", 1, 0)])
    closes = snapshots(spark, [("a", 0, "diamond", 2, 60), ("a", 1, "gold", 4, 60), ("a", 2, "dirt", 1, 60), ("a", 3, "iron", 4, 60),
                               ("a", 216, "far", 9, 60), ("c", 0, "x", 9, 301)])
    limited = diffs.diff_containers(opens, closes, ["session"], max_slots=216)
    got = {(r.session, r.slot): (r.item, r.type, r.amount) for r in limited.collect()}
    assert got == {("a", 0): ("diamond", 4, 3), ("a", 1): ("gold", 3, 4), ("a", 3): ("coal", 4, 5)}
    # Without a limit, which is the default, slots of any number count.
    assert ("far", 3, 8) in {(r.item, r.type, r.amount) for r in diffs.diff_containers(opens, closes, ["session"]).collect()}
    late = diffs.diff_containers(opens, closes, ["session"], None).filter("session = 'c'").collect()
    assert [(r.type, r.amount) for r in late] == [(3, 8)]


@pytest.mark.parametrize("span", [timedelta(days=1), timedelta(seconds=2)])
def test_hoppers(spark, span):
    def sample(i, t, *slots, x=0):
        return (i, t, "w", x, 0, 0, list(slots))

    samples = make(
        spark,
        [sample(1, 0, None, None), sample(2, 1, "a|3", None), sample(3, 2, "a|6", None), sample(4, 9, "a|1", "b|2"),
         sample(5, 10, "c|4", "b|2"), sample(6, 20, None, None), sample(7, 21, "d|1", None), sample(8, 3, "a|9", None, x=1)],
        SAMPLE,
    )
    got = sorted((r.id, r.slot, r.type, r.item, r.amount) for r in diffs.diff_hopper_samples(samples, span).collect())
    assert got == [
        (3, 0, 29, "a", 3), (4, 0, 30, "a", 5), (4, 1, 29, "b", 2), (5, 0, 29, "c", 4), (5, 0, 30, "a", 1),
        (6, 0, 30, "c", 4), (6, 1, 30, "b", 2),
    ]


def test_previous_row_across_segments(spark):
    rng = random.Random(3)
    rows = [(i, rng.random() * 100, rng.choice("ab"), rng.randrange(100)) for i in range(800)]
    df = make(spark, rows, "id long, ts timestamp_ntz, k string, v int")
    expected, last = {}, {}
    for i, t, k, v in sorted(rows, key=lambda r: (r[1], r[0])):
        expected[i] = (k in last, last.get(k))
        last[k] = v
    got = with_previous(df, ["k"], ["ts", "id"], ["v"], timedelta(seconds=4)).collect()
    assert len(got) == len(rows)
    assert {r.id: (r.has_prev, r.prev_v) for r in got} == expected


def test_regions(spark):
    schema = "world_key string, x int, y int, z int, block string"
    before = spark.createDataFrame([("w", 0, 0, 0, "m:cobble"), ("w", 1, 0, 0, "m:same"), ("w", 2, 0, 0, "m:gone")], schema)
    cube = [("w", 10 + i, j, k, "m:glass") for i in range(3) for j in range(3) for k in range(3)]
    after = spark.createDataFrame([("w", 0, 0, 0, "m:stone"), ("w", 1, 0, 0, "m:same"), *cube], schema)
    rows = diffs.diff_regions(before, after).collect()
    got = {(r.x, r.type, r.block) for r in rows if r.x < 10}
    assert got == {(0, 2, "m:cobble"), (0, 1, "m:stone"), (2, 2, "m:gone")}
    assert sum(1 for r in rows if r.block == "m:glass" and r.type == 1) == 27
    regions = spark.createDataFrame([(1, 0, 0, 0, 31, 31, 31), (2, 0, 0, 0, 32, 31, 31), (3, 0, 0, 0, -5, 1, 1)],
                                    "id int, min_x int, min_y int, min_z int, max_x int, max_y int, max_z int")
    assert [r.id for r in diffs.small_regions(regions).collect()] == [1]


@pytest.mark.parametrize(
    "was,now,change",
    [("fire", NO_CATEGORY, "BURN"), ("fire", "fire", None), ("stone", "fire", "IGNITE"), (NO_CATEGORY, "fire", "IGNITE"),
     ("ice", "water", "FADE"), ("ice", "ice", None), ("powder", "concrete", "FORM"), ("lava", "obsidian", "FORM"),
     ("water", "ice", "FORM"), (NO_CATEGORY, "ice", "FORM"), ("stone", "ice", None), ("dirt", "grass", "SPREAD"),
     ("grass", "dirt", None), ("leaves", NO_CATEGORY, "LEAVES_DECAY"), ("leaves", "fire", "IGNITE"), ("water", "dirt", None)],
)
def test_change_rules(was, now, change):
    assert change_between(was, now) == change


def category(block):
    if block is None:
        return None
    for name, ids in CATEGORY_IDS.items():
        if block in ids:
            return name
    for ending, name in (("_leaves", "leaves"), ("_concrete_powder", "powder"), ("_concrete", "concrete")):
        if block.endswith(ending):
            return name
    return None


BLOCKS = ["minecraft:fire", "minecraft:air", "minecraft:stone", "minecraft:water", "minecraft:ice", "m:oak_leaves", "m:a_concrete",
          "m:a_concrete_powder", "minecraft:dirt", "minecraft:podzol", "m:x", "minecraft:obsidian", "minecraft:snow"]


@pytest.mark.parametrize("seed", range(4))
def test_block_changes_equal_fold(spark, seed):
    rng = random.Random(seed)
    blocks = BLOCKS if seed % 2 else ["minecraft:fire", "minecraft:air", "minecraft:stone", "m:x", "minecraft:obsidian"]
    weights = [1 if category(b) in HOT_CATEGORIES else 3 for b in blocks]
    rows = [(i, i + rng.random() * 3, "w", rng.randrange(2), 0, 0, rng.choices(blocks, weights)[0]) for i in range(1500)]
    cache, expected = {}, {}
    for i, t, w, x, y, z, block in sorted(rows, key=lambda r: (r[1], r[0])):
        prev = cache.get(x)
        cur_cat, prev_cat = category(block), category(prev)
        if prev is not None and prev != block:
            change = change_between(prev_cat or NO_CATEGORY, cur_cat or NO_CATEGORY)
        else:
            change = "IGNITE" if prev is None and cur_cat == "fire" else None
        if change:
            expected[i] = (prev, change)
        if cur_cat in HOT_CATEGORIES or prev_cat is not None:
            cache[x] = block
    got = diffs.classify_block_changes(make(spark, rows, OBSERVED), timedelta(seconds=5)).collect()
    assert {r.id: (r.prev_block, r.change) for r in got} == expected


def test_clicks(spark):
    clicks = make(spark, [(1, 0, "p", "w", 1, 2, 3), (2, 1, "p", "w", 4, 5, 6)],
                  "id long, ts timestamp_ntz, player string, world_key string, x int, y int, z int")
    opens = make(spark, [(3, 0.4, "p"), (4, 1.5, "p"), (5, 1.501, "p"), (6, 1.1, "q")], "id long, ts timestamp_ntz, player string")
    got = {r.id: (r.x, r.y, r.z) for r in diffs.pair_click_open(opens, clicks).collect()}
    assert got == {3: (1, 2, 3), 4: (4, 5, 6)}
