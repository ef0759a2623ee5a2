from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import START, action, actions, at, ids, make
from tracewell.functions import actions as act
from tracewell.functions import predicates as p
from tracewell.functions.affected import parse_affected, serialize_affected
from tracewell.functions.timing import micros
from tracewell.operators import dimensions, lookups, visibility


@pytest.fixture(scope="module")
def thousand(spark):
    worlds = ["w0", "w1", "w2"]
    rows = [
        action(
            i, i, 1 if i % 2 == 0 else 2, x=i % 100, z=(i // 100) % 100, name=f"user{i % 5}", user=i % 5,
            world=worlds[i % 3], target="minecraft:stone" if i % 4 == 0 else "minecraft:dirt",
        )
        for i in range(1000)
    ]
    return actions(spark, *rows).cache()


@pytest.mark.parametrize(
    "flt,expected",
    [
        (p.ActionFilter(), 1000),
        (p.ActionFilter(names=("user2",)), 200),
        (p.ActionFilter(types=(2,)), 500),
        (p.ActionFilter(types=("-block",)), 500),
        (p.ActionFilter(since=at(0), until=at(99)), 100),
        (p.ActionFilter(include=("minecraft:stone",)), 250),
        (p.ActionFilter(exclude=("minecraft:dirt",)), 250),
        (p.ActionFilter(world="w0"), 334),
        (p.ActionFilter(world="#global"), 1000),
        (p.ActionFilter(ids=(1, 2, 3, 5000)), 3),
        (p.ActionFilter(rolled_back=True), 0),
        (p.ActionFilter(x=5, z=5, radius=0), 1),
        (p.ActionFilter(x=5, z=5, radius=1), 9),
        (p.ActionFilter(x=5, z=5, radius=1, y=70), 0),
        (p.ActionFilter(x=5, z=5, radius=-1), 1000),
        (p.ActionFilter(box=(0, 0, 0, 9, 255, 0)), 10),
    ],
)
def test_thousand_actions(thousand, flt, expected):
    assert flt.apply(thousand).count() == expected


def test_many_ids_are_joined(thousand):
    wanted = list(range(0, 4000, 2))
    rows = p.with_ids(thousand, wanted)
    assert rows.count() == 500
    assert "LeftSemi" in rows._jdf.queryExecution().toString()


def test_newest_first_with_ties(spark):
    rows = actions(spark, action(1, 5, 1), action(3, 9, 1), action(2, 9, 1), action(4, 1, 1))
    assert ids(lookups.page_newest(rows, 3)) == [3, 2, 1]
    assert ids(lookups.page_newest(rows, 2, 1)) == [2, 1]
    assert len(ids(lookups.page_newest(rows, 0))) == 4


def test_page_capped_flag(thousand):
    assert {r.truncated for r in lookups.page_capped(thousand, 50, 20).collect()} == {True}
    assert {r.truncated for r in lookups.page_capped(thousand, 20, 20).collect()} == {False}
    assert lookups.page_capped(thousand, 5000, 2000).filter("truncated").count() == 0


def test_page_summary_of_nothing(thousand):
    row = lookups.page_summary(thousand.filter("id < 0"), 0, 7).first()
    assert (row.total, row.pages, row.page) == (0, 1, 1)


def test_ages():
    assert p.age_bounds(START, timedelta(milliseconds=3)) == (START - timedelta(seconds=1), None)
    lo, hi = p.age_bounds(START, timedelta(hours=1), timedelta(hours=2))
    assert (lo, hi) == (START - timedelta(hours=2), START - timedelta(hours=1))
    assert p.age_bounds(START, timedelta(hours=2), timedelta(hours=1)) == (lo, hi)
    assert p.age_bounds(START, timedelta(seconds=5, microseconds=1900))[0] == START - timedelta(seconds=5, milliseconds=1)


def test_arguments():
    assert p.qualify_id("Stone") == "minecraft:stone"
    assert p.qualify_id("mod:Red_Sand") == "mod:red_sand"
    for bad in ("", ":x", "x:", "a b"):
        with pytest.raises(ValueError):
            p.qualify_id(bad)
    with pytest.raises(ValueError):
        p.guard_radius(p.ActionFilter(radius=101), 100)
    with pytest.raises(ValueError):
        p.guard_time(p.ActionFilter())
    with pytest.raises(ValueError):
        p.resolve_types(["nothing"])
    assert p.resolve_types(["inventory", "logout", "+block"]) == [27, 28, 13, 1]
    here = p.default_rollback_scope(p.ActionFilter(since=START), (1, 2, 3))
    assert (here.x, here.y, here.z, here.radius) == (1, 2, 3, 10)
    assert p.default_rollback_scope(p.ActionFilter(world="w"), (1, 2, 3)).radius is None
    assert p.world_key("NETHER") == "minecraft:the_nether"


def test_three_valued_exclusion_and_wildcards(spark):
    rows = actions(
        spark,
        action(1, 0, 26, target="minecraft:dirt", meta=None),
        action(2, 0, 26, target="minecraft:dirt", meta="minecraft:stone"),
        action(3, 0, 26, target="minecraft:dirt", meta="minecraft:air"),
        action(4, 0, 8, target="0:0:0=minecraft:redXsand,1:1:1=minecraft:dirt|x=1"),
        action(5, 0, 8, target="0:0:0=minecraft:red_sandstone"),
    )
    assert sorted(ids(rows.filter(p.exclude_targets(["minecraft:stone"])))) == [3, 4, 5]
    assert ids(rows.filter(p.include_targets(["minecraft:red_sand"]))) == [4]
    assert ids(rows.filter(p.include_exploded(["minecraft:red_sand"]))) == []
    assert ids(rows.filter(p.include_exploded(["minecraft:dirt"]))) == [4]


@pytest.mark.parametrize(
    "raw,head",
    [
        ("/tp a b", "/tp"), ("  //fill  1", "/fill"), ("say hi", "/say"), ("'msg bob' x", "/msg"), ('"op" x', "/op"),
        ("''", ""), ("'open", ""), ("", ""), (None, ""), ("/", ""), (" / / home", "/home"),
    ],
)
def test_command_heads(spark, raw, head):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(act.command_head(F.col("t"))).first()[0] == head


def test_ages_in_words(spark):
    seconds = [0, 59, 60, 3599, 3600, 86399, 86400, 14 * 86400 - 1, 14 * 86400, 21 * 86400]
    rows = make(spark, [(i, -s) for i, s in enumerate(seconds)], "id long, ts timestamp_ntz")
    texts = [r[0] for r in rows.orderBy("id").select(act.age_text(F.col("ts"), START)).collect()]
    assert texts == ["0s", "59s", "1m", "59m", "1h", "23h", "1d", "13d", "2w", "3w"]
    future = make(spark, [(1, 5)], "id long, ts timestamp_ntz")
    assert future.select(act.age_text(F.col("ts"), START)).first()[0] == "0s"


def test_micros_ignore_the_session_zone(spark):
    rows = make(spark, [(1, 70 * 86400 + 2.5 * 3600)], "id long, ts timestamp_ntz")
    expected = (at(70 * 86400 + 2.5 * 3600) - at(0)) // timedelta(microseconds=1)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        base = make(spark, [(1, 0)], "id long, ts timestamp_ntz").select(micros(F.col("ts"))).first()[0]
        assert rows.select(micros(F.col("ts"))).first()[0] - base == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_pseudonyms(spark):
    import hashlib

    df = spark.createDataFrame([("10.0.0.1",), ("",), (None,)], "t string")
    out = [r[0] for r in df.select(act.pseudonym(F.col("t"), "salt")).collect()]
    assert out == ["sha256:" + hashlib.sha256(b"salt10.0.0.1").hexdigest()[:16], "", ""]


@pytest.mark.parametrize(
    "text,parsed",
    [
        ("100:64:0=minecraft:oak_planks", [(100, 64, 0, "minecraft:oak_planks", None, None)]),
        ("-100:-5:-30=minecraft:bedrock", [(-100, -5, -30, "minecraft:bedrock", None, None)]),
        ("1:2:3=a:b|x=1,y,1:2=q,a:b:c=d,=e,4:5:6=,7:8:9=m:n||QUJD", [(1, 2, 3, "a:b", "x=1", None), (7, 8, 9, "m:n", None, "QUJD")]),
        (" 1 : 2 : 3 = a:b ", [(1, 2, 3, "a:b", None, None)]),
        ("", []), ("  ", []), (None, []),
    ],
)
def test_affected_lists(spark, text, parsed):
    df = spark.createDataFrame([(text,)], "t string")
    assert [tuple(e) for e in df.select(parse_affected(F.col("t"))).first()[0]] == parsed


def test_affected_round_trip(spark):
    text = "1:2:3=a:b|x=1|QUJD,4:5:6=c:d,7:8:9=m:n||QUJD,0:0:0=p:q|k"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(serialize_affected(parse_affected(F.col("t")))).first()[0] == text


def test_existence_windows(spark):
    rows = actions(spark, action(1, 100, 1, uuid="u"), action(2, 200, 2, uuid="u", x=5))
    probes = spark.createDataFrame(
        [(1, "u", "minecraft:overworld", 0, 64, 0), (2, "u", "minecraft:overworld", 5, 64, 0), (3, "v", "minecraft:overworld", 0, 64, 0)],
        "id long, actor_uuid string, world_key string, x int, y int, z int",
    )
    assert ids(lookups.has_placed(probes, rows)) == [1]
    assert ids(lookups.has_placed(probes, rows, timedelta(seconds=50), at(150))) == [1]
    assert ids(lookups.has_placed(probes, rows, timedelta(seconds=49), at(150))) == []
    assert ids(lookups.has_placed(probes, rows, timedelta(0), at(9999))) == [1]
    assert sorted(ids(lookups.probes_with_actions(probes, rows))) == [1, 2]
    assert sorted(ids(lookups.has_removed(probes, rows, negate=True))) == [1, 3]


def test_event_rate(spark):
    rows = actions(spark, *[action(i, i, 1 + i % 2) for i in range(100)])
    got = {r.type: (r.n, r.per_second) for r in lookups.event_rate(rows, at(99)).collect()}
    assert got == {1: (15, 0.5), 2: (15, 0.5), None: (30, 1.0)}
    quiet = {r.type: r.n for r in lookups.event_rate(rows, at(9999)).collect()}
    assert quiet == {None: 0}


def test_users_keep_first_name(spark):
    rows = actions(
        spark, action(1, 5, 1, uuid="u", name="new"), action(2, 1, 1, uuid="u", name="old"), action(3, 2, 1, name="#tnt"),
        action(4, 3, 1, name=None), action(5, 4, 1, uuid="v", name="old"),
    )
    got = {r.user_key: (r.uuid, r.name, r.first_seen, r.last_seen) for r in dimensions.resolve_users(rows).collect()}
    assert got["u"] == ("u", "old", at(1), at(5))
    assert got["#tnt"] == (None, "#tnt", at(2), at(2))
    assert got["#unknown"][1] == "#unknown"
    assert got["v"][1] == "old"
    known = dimensions.resolve_users(rows.filter("id = 2"))
    assert {r.user_key for r in dimensions.resolve_users(rows, known).collect()} == {"#tnt", "#unknown", "v"}


def test_visibility(spark, thousand):
    viewers = spark.createDataFrame([("low", 0), ("mid", 2), ("high", 4)], "viewer string, op_level int")
    grants = spark.createDataFrame(
        [("low", "lookup.block", True), ("high", "lookup.block", False)], "viewer string, node string, granted boolean"
    )
    visible = visibility.visible_types(viewers, grants, visibility.type_nodes(spark))
    by_viewer = {}
    for r in visible.collect():
        by_viewer.setdefault(r.viewer, set()).add(r.type)
    assert by_viewer["low"] == {1, 2, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 40}
    assert 9 not in by_viewer["mid"] and 10 not in by_viewer["mid"] and 11 in by_viewer["mid"]
    assert 9 in by_viewer["high"] and 1 not in by_viewer["high"]
    assert ids(visibility.page_visible(thousand, visible, "low", 2, 3)) == [996, 995, 994]
    assert ids(visibility.page_visible(thousand, visible, "high", 1, 3)) == []
    assert len(ids(visibility.page_visible(thousand, visible, None, 1, 3))) == 3
    with pytest.raises(ValueError):
        visibility.page_visible(thousand, visible, "low", 0, 3)
    stricter = visibility.type_nodes(spark, levels={"lookup.sign": 4, "lookup.item": 9})
    needs = {r.type: r.need for r in stricter.collect()}
    assert needs[11] == 4 and needs[5] == 2


def test_regions(spark):
    rows = actions(spark, action(1, 0, 1, x=1, y=1, z=1), action(2, 0, 1, x=500, y=1, z=1), action(3, 0, 1, x=-70, y=9, z=-70, world="w"))
    boxes = spark.createDataFrame(
        [("small", 0, 0, 0, 2, 2, 2), ("huge", -1000000, 0, -1000000, 1000000, 1, 1000000), ("neg", -128, 0, -128, -64, 20, -64)],
        "viewer string, min_x int, min_y int, min_z int, max_x int, max_y int, max_z int",
    )
    assert ids(lookups.within_regions(rows, boxes, "small")) == [1]
    assert ids(lookups.within_regions(rows, boxes, "nobody")) == []
    pairs = {(r.viewer, r.id) for r in lookups.within_any_region(rows, boxes).collect()}
    assert pairs == {("small", 1), ("huge", 1), ("huge", 2), ("neg", 3)}


def test_newest_of_a_crowded_place(spark, monkeypatch):
    """Pairs follow cells and distinct boxes, not the rows and points that stand there."""
    rows = [action(i, i % 50, 1, x=i % 5, y=None if i % 9 == 0 else 64 + i % 2, world="w" if i % 7 else "v") for i in range(600)]
    points = [(i % 150, "w", i % 4, None if i % 50 == 0 else 64, 0) for i in range(300)]
    made = []
    monkeypatch.setattr(lookups, "facts_in_boxes", lambda *a, whole=lookups.facts_in_boxes: made.append(whole(*a)) or made[-1])
    boxes = spark.createDataFrame(points, "point_id long, world_key string, x int, y int, z int")
    got = lookups.near_points(actions(spark, *rows), boxes, at(60), 1, timedelta(seconds=45), 3)
    expected = []
    for point in sorted({p[0] for p in points}):
        near = [
            (r[1], r[0]) for p in points if p[0] == point for r in rows
            if r[6] == "w" and r[1] >= 15 and abs(r[7] - p[2]) <= 1 and (p[3] is None or r[8] is not None and abs(r[8] - p[3]) <= 1)
        ]
        expected += [(point, id) for _, id in sorted(near, reverse=True)[:3]]
    assert sorted((r.point_id, r.id) for r in got.collect()) == sorted(expected)
    # 15 cells of 3 rows at most and 8 distinct boxes; there are 300 points and 360 rows.
    assert made[0].count() <= 8 * 45
