"""Gate rules, coalescing, throttling and packing."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import action, actions, ids
from tracewell.operators import gate as g
from tracewell.operators.explosions import MAX_CHARS, MAX_ENTRIES, pack_affected
from tracewell.schema import ACTION_TYPES
from tracewell.sources.rules import parse_rules

TOGGLE_OF = {
    "BLOCK": "blocks", "CONTAINER": "containers", "ITEM": "items", "ENTITY": "entities", "WORLD": "world_events",
    "SESSION": "sessions", "INTERACT": "interactions",
}
SPECIAL = {8: "explosions", 9: "chat", 10: "commands", 11: "signs", 40: "water_flow"}


@pytest.fixture(scope="module")
def one_of_each(spark):
    return actions(spark, *[action(t.id, t.id, t.id) for t in ACTION_TYPES]).cache()


@pytest.mark.parametrize("toggle", sorted({*TOGGLE_OF.values(), *SPECIAL.values()}))
def test_each_toggle_drops_its_types(one_of_each, toggle):
    off = one_of_each.filter(~g.type_enabled(g.Toggles(**{toggle: False})))
    expected = {t.id for t in ACTION_TYPES if (SPECIAL.get(t.id) or TOGGLE_OF.get(t.category)) == toggle}
    assert set(ids(off)) == expected
    assert one_of_each.filter(g.type_enabled(g.Toggles())).count() == 40


def test_fluid_toggle_looks_at_the_target(spark):
    rows = actions(spark, action(1, 0, 40, target="minecraft:LAVA"), action(2, 0, 40, target="minecraft:water"), action(3, 0, 40, target=None))
    assert sorted(ids(rows.filter(g.type_enabled(g.Toggles(lava_flow=False))))) == [2, 3]
    assert ids(rows.filter(g.type_enabled(g.Toggles(water_flow=False)))) == [1]


RULES = ["user: Notch", "user_uuid:00000000-0000-4000-8000-00000000000a", "command:Login", "block:minecraft:TNT", "entity:minecraft:bat",
         "minecraft:stone@Jeb", "# user:no", "", "user:", "user_uuid:zz", "what:ever", "plain", "@x", "y@"]


def test_rule_lines(spark):
    rules = parse_rules(spark.createDataFrame([(r,) for r in RULES], "value string"))
    assert {(r.kind, r.value) for r in rules.collect()} == {
        ("user", "Notch"), ("user_uuid", "00000000-0000-4000-8000-00000000000a"), ("command", "login"),
        ("block", "minecraft:tnt"), ("entity", "minecraft:bat"), ("composite", "minecraft:stone@Jeb"),
    }


@pytest.mark.parametrize("limit", [2_000, 0])
def test_blacklist(spark, monkeypatch, limit):
    monkeypatch.setattr(g, "MAX_LITERAL_RULES", limit)
    rules = parse_rules(spark.createDataFrame([(r,) for r in RULES], "value string"))
    rows = actions(
        spark, action(1, 0, 9, name="NOTCH"), action(2, 0, 9, uuid="00000000-0000-4000-8000-00000000000A"), action(3, 0, 10, target="/login x"),
        action(4, 0, 10, target="/loginx y"), action(5, 0, 9, target="/login"), action(6, 0, 1, target="minecraft:tnt"),
        action(7, 0, 15, target="minecraft:tnt"), action(8, 0, 7, target="minecraft:bat"), action(9, 0, 33, target="minecraft:bat"),
        action(10, 0, 20, name="jeb"), action(11, 0, 20, name="ann"), action(12, 0, 10, target="LOGIN"), action(13, 0, 10, target=None, name=None),
    )
    assert sorted(ids(g.gate_blacklist(rows, rules))) == [4, 5, 7, 9, 11, 13]


def test_allow_list(spark):
    rows = actions(
        spark, action(1, 0, 26, name="#mob:isle:fury"), action(2, 0, 26, tag="#mob:isle:fury"), action(3, 0, 26, tag="#mob:minecraft:cow"),
        action(4, 0, 26), action(5, 0, 1, tag="#mob:minecraft:cow"), action(6, 0, 26, name="#mob:minecraft:cow", tag="#mob:isle:fury"),
    )
    assert sorted(ids(g.gate_entity_changes(rows, ("isle",)))) == [1, 2, 4, 5]
    assert sorted(ids(g.gate_entity_changes(rows, (" isle:* ",)))) == [1, 2, 4, 5]
    assert sorted(ids(g.gate_entity_changes(rows, ("isle:fury", "minecraft:cow")))) == [1, 2, 3, 4, 5, 6]
    assert sorted(ids(g.gate_entity_changes(rows, (), True))) == [1, 2, 3, 4, 5, 6]
    assert sorted(ids(g.gate_entity_changes(rows, ()))) == [4, 5]


def test_gate_order(spark):
    cfg = g.GateConfig(
        g.Toggles(items=False, worlds=("bad",), block_ids=("minecraft:tnt",), tags=("#x",)),
        per_world={"nether": g.Toggles(chat=False)}, entity_allow_list=("ok",),
    )
    rules = spark.createDataFrame([("user", "jeb")], "kind string, value string")
    deny_low = F.when(F.col("y") < 0, F.lit(False))
    rows = actions(
        spark,
        action(1, 0, 1), action(2, 0, 5), action(3, 0, 1, world="bad"), action(4, 0, 1, target="minecraft:tnt"), action(5, 0, 1, tag="#x"),
        action(6, 0, 9, world="nether"), action(7, 0, 1, name="jeb"), action(8, 0, 1, y=-1), action(9, 0, 9, name="jeb", world="nether", y=-1),
        action(10, 0, 15, name="jeb", y=-1, tag="#fire:x"), action(11, 0, 26, tag="#mob:no:x"), action(12, 1, 26, tag="#mob:ok:x", x=9),
        action(13, 1.4, 26, tag="#mob:ok:x", x=9), action(14, 1.9, 26, tag="#mob:ok:x", x=9), action(15, 2.39, 26, tag="#mob:ok:x", x=9),
        action(16, 3, 10, target="//give me"), action(17, 0, 5, world="bad"),
    )
    got = {r.id: r.gate_reason for r in g.gate(rows, cfg, rules, [deny_low]).collect()}
    assert got == {
        1: None, 2: "type", 3: "world", 4: "block", 5: "source", 6: "per_world", 7: "blacklist", 8: "predicate", 9: "per_world",
        10: None, 11: "entity", 12: None, 13: "coalesced", 14: None, 15: "coalesced", 16: None, 17: "type",
    }
    closed = {r.id: r.gate_reason for r in g.gate(rows, g.GateConfig(hot_sources=False, strict=False)).collect()}
    assert closed[10] == "hot_source" and closed[11] is None and closed[13] is None
    assert g.gate(rows, cfg).filter("id = 16").first().target == "/give"
    report = {r.outcome: r.n for r in g.ingest_report(g.gate(rows, cfg, rules, [deny_low])).collect()}
    assert report["accepted"] == 5 and report["coalesced"] == 2


def test_predicates_first_opinion_wins(spark):
    rows = actions(spark, action(1, 0, 1, x=1), action(2, 0, 1, x=2), action(3, 0, 1, x=3))
    yes, no = F.when(F.col("x") == 1, F.lit(True)), F.when(F.col("x") <= 2, F.lit(False))
    assert sorted(ids(rows.filter(g.decide([yes, no])))) == [1, 3]
    assert rows.filter(g.decide([])).count() == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_coalescing_equals_fold(spark, seed):
    rng = random.Random(seed)
    t, rows = 0.0, []
    for i in range(1500):
        t += rng.choice([0.1, 0.2, 0.25, 0.5, 0.6])
        rows.append(action(i, round(t, 3), 26, x=rng.randrange(2)))
    last, expected = {}, []
    for r in rows:
        now = round(r[1] * 1000)
        if r[7] not in last or now - last[r[7]] >= 500:
            expected.append(r[0])
        last[r[7]] = now
    got = g.coalesce_entity_changes(actions(spark, *rows), span=timedelta(seconds=3))
    assert sorted(ids(got)) == expected


@pytest.mark.parametrize("seed,step,block", [(1, 0.3, 2), (2, 0.001, 1024), (3, 2.0, 3), (4, 0.25, 4)])
def test_throttle_equals_fold(spark, monkeypatch, seed, step, block):
    monkeypatch.setattr("tracewell.operators.chains.BLOCK", block)
    rng = random.Random(seed)
    t, rows = 0.0, []
    for i in range(2000):
        t += rng.choice([0, step, step / 2, step * 3])
        rows.append(action(i, round(t, 3), 32, target=rng.choice(["zombie", "bat"]), world=rng.choice("vw")))
    last, expected = {}, []
    for r in rows:
        now = round(r[1] * 1000)
        if r[10] not in last or now - last[r[10]] >= 1000:
            expected.append(r[0])
            last[r[10]] = now
    got = g.throttle_spawns(actions(spark, *rows), segment=timedelta(seconds=2))
    assert sorted(ids(got)) == expected


def fold_pack(blocks):
    chunks, start = [], 0
    while start < len(blocks):
        parts, i, size = [], start, 0
        while i < min(start + MAX_ENTRIES, len(blocks)):
            x, y, z, block = blocks[i]
            if block:
                text = f"{x}:{y}:{z}={block}"
                if parts and size + 1 + len(text) > MAX_CHARS:
                    break
                size += len(text) + (1 if parts else 0)
                parts.append(text)
            i += 1
        if parts:
            chunks.append((start, ",".join(parts)))
        start = i
    return chunks


@pytest.mark.parametrize("segment", [MAX_ENTRIES, 3 * MAX_ENTRIES])
def test_packing_equals_fold(spark, monkeypatch, segment):
    monkeypatch.setattr("tracewell.operators.explosions.PACK_SEGMENT", segment)
    monkeypatch.setattr("tracewell.operators.chains.BLOCK", 2)
    rng = random.Random(segment)
    groups, rows = {}, []
    for name, n, longest in (("short", 700, 12), ("mixed", 900, 200), ("long", 300, 1500), ("huge", 60, 5000), ("one", 1, 5), ("gaps", 500, 90)):
        blocks = []
        for i in range(n):
            block = "m:" + "b" * rng.randrange(1, longest)
            if name == "gaps" and rng.random() < 0.6:
                block = rng.choice(["", None])
            blocks.append((rng.randrange(-999, 999), 64, i, block))
        groups[name] = blocks
        rows += [(name, i, *b) for i, b in enumerate(blocks)]
    df = spark.createDataFrame(rows, "blast string, seq int, x int, y int, z int, block string").repartition(5)
    got = {}
    for r in pack_affected(df, ["blast"]).collect():
        got.setdefault(r.blast, []).append((r.chunk, r.target))
    assert {k: sorted(v) for k, v in got.items()} == {k: fold_pack(v) for k, v in groups.items()}


def test_quarantine_reasons(spark):
    rows = actions(
        spark, action(1, 0, 1), action(2, 0, None), action(3, 0, 1, world=None), action(4, 0, 1, target="x" * 4097),
        action(5, 0, 1, name="n" * 65), action(6, 0, 1, world="w" * 97), action(7, 0, 1, tag="#" * 65), action(8, 0, 1, target="x" * 4096),
    ).withColumn("sign_side", F.lit("front")).withColumn("sign_dye_color", F.lit("red"))
    got = {r.id: r.quarantine_reason for r in g.validate_rows(rows).collect()}
    assert got == {1: None, 2: "type", 3: "world", 4: "target", 5: "name", 6: "world", 7: "source_tag", 8: None}


def test_many_rules_move_the_rows_once(spark, monkeypatch):
    monkeypatch.setattr(g, "MAX_LITERAL_RULES", 0)
    monkeypatch.setattr(g, "any_of", None)  # the literal form is not taken
    rows = actions(spark, action(1, 0, 1, target="a:b", name="Ann", meta="m"), action(2, 1, 10, target="/Tp x", name="bob", uuid="U"),
                   action(3, 2, 7, target="a:b", name=None), action(4, 3, 9, target="a:b", name="cy"), action(5, 4, 5, target=None, name=None))
    table = [("user", "ANN"), ("user_uuid", "u"), ("command", "tp"), ("entity", "a:b"), ("composite", "a:b@cy"), ("block", "x")]
    marked = g.mark_blacklisted(rows, spark.createDataFrame(table, "kind string, value string"))
    assert {r.id: r.blacklisted for r in marked.collect()} == {1: True, 2: True, 3: True, 4: True, 5: False}
    for kind, hits in (("block", []), ("command", [2]), ("composite", [4]), ("entity", [3])):
        some = spark.createDataFrame([t for t in table if t[0] == kind], "kind string, value string")
        assert sorted(ids(g.mark_blacklisted(rows, some).filter("blacklisted"))) == hits
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = marked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Only the exchange of the rows themselves carries their other columns.
    initial = plan.split("== Initial Plan ==")[-1]
    carrying = [line for line in initial.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("_keys" in line for line in carrying) <= 4 and len(carrying) <= 6
