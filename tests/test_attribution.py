"""Attribution against sequential folds, with segments far smaller than the data."""

import random
from datetime import timedelta

import pytest

from helpers import action, actions, make
from tracewell.operators import attribution as att

HIT = "victim string, attacker string, ts timestamp_ntz, id long"
PROBE = "victim string, ts timestamp_ntz, id long"


def sec(n):
    return timedelta(seconds=n)


def test_last_hit_rules(spark):
    hits = make(spark, [("v", "a", 0, 1), ("v", "b", 15, 2), ("w", "a", 0, 3), ("z", "a", 10, 10)], HIT)
    deaths = make(spark, [("v", 16, 4), ("v", 35, 5), ("v", 35.001, 6), ("w", 20, 7), ("w", 20.001, 8), ("x", 1, 9), ("z", 12, 12)], PROBE)
    forgets = make(spark, [("z", 11, 11)], PROBE)
    got = {r.id: r.attacker for r in att.attribute_last_hit(deaths, hits, forgets=forgets).collect()}
    assert got == {4: "b", 5: "b", 6: None, 7: "a", 8: None, 9: None, 12: None}


@pytest.mark.parametrize("seed", [1, 2])
def test_last_hit_equals_fold(spark, seed):
    rng = random.Random(seed)
    hits, deaths, held, expected = [], [], {}, {}
    for i in range(1500):
        t, v = i * rng.choice([0.5, 1]) + rng.random(), rng.choice("ab")
        (hits if rng.random() < 0.3 else deaths).append((t, v, i))
    timeline = sorted([(t, i, "h", v) for t, v, i in hits] + [(t, i, "d", v) for t, v, i in deaths])
    for t, i, what, v in timeline:
        if what == "h":
            held[v] = (t, f"p{i}")
        else:
            last = held.get(v)
            expected[i] = last[1] if last and round((t - last[0]) * 1e6) <= 3_000_000 else None
    h = make(spark, [(v, f"p{i}", t, i) for t, v, i in hits], HIT)
    d = make(spark, [(v, t, i) for t, v, i in deaths], PROBE)
    got = {r.id: r.attacker for r in att.attribute_last_hit(d, h, sec(3), span=sec(5)).collect()}
    assert got == expected


PRIME = "id long, ts timestamp_ntz, world_key string, x int, y int, z int, actor_uuid string, actor_name string, kind string"
CELLED = "id long, ts timestamp_ntz, world_key string, x int, y int, z int"


def test_prime_rules(spark):
    def prime(i, t, x, uuid="u", kind="PLAYER_DIRECT"):
        return (i, t, "w", x, 0, 0, uuid, "n", kind)

    primes = make(
        spark,
        [prime(1, 0, 0), prime(2, 0, 1), prime(3, 0, 2, None), prime(4, 0, 3, kind="NATURAL_SPAWN"), prime(5, 0, 4),
         prime(6, 0, 5, "u", "PLAYER_INDIRECT"), prime(7, 1, 0, "new")],
        PRIME,
    )
    blasts = make(
        spark,
        [(10, 300, "w", 1, 0, 0), (11, 301, "w", 1, 0, 0), (12, 5, "w", 2, 0, 0), (13, 5, "w", 3, 0, 0), (14, 301, "w", 4, 0, 0),
         (15, 5, "w", 5, 0, 0), (16, 5, "w", 0, 0, 0), (17, 6, "w", 0, 0, 0), (18, 5, "w2", 0, 0, 0)],
        CELLED,
    )
    got = {r.id: (r.prime_uuid, r.distance) for r in att.attribute_prime(blasts, primes).collect()}
    assert got == {
        10: ("u", 0), 11: (None, None), 12: (None, None), 13: (None, None), 14: (None, None), 15: ("u", 1),
        16: ("new", 0), 17: (None, None), 18: (None, None),
    }
    kept = {r.id: r.prime_uuid for r in att.peek_prime(blasts, primes).collect()}
    assert kept[16] == kept[17] == "new" and kept[13] == "u" and kept[14] is None


def test_prime_equals_fold(spark):
    rng = random.Random(5)
    rows = [(i, i + rng.random(), rng.random() < 0.4, rng.choice([0, 1]), rng.choice(["PLAYER_DIRECT", "NATURAL_SPAWN", "PLAYER_OWNER"]))
            for i in range(1200)]
    held, expected = {}, {}
    for i, t, is_prime, x, kind in sorted(rows, key=lambda r: (r[1], r[0])):
        if is_prime:
            held[x] = (t, f"u{i}", kind)
        else:
            last = held.pop(x, None)
            ok = last and round((t - last[0]) * 1e6) <= 4_000_000 and last[2].startswith("PLAYER")
            expected[i] = last[1] if ok else None
    primes = make(spark, [(i, t, "w", x, 0, 0, f"u{i}", "n", k) for i, t, p, x, k in rows if p], PRIME)
    blasts = make(spark, [(i, t, "w", x, 0, 0) for i, t, p, x, k in rows if not p], CELLED)
    got = {r.id: r.prime_uuid for r in att.attribute_prime(blasts, primes, sec(4), span=sec(7)).collect()}
    assert got == expected


CAUSER = ("rid long, ts timestamp_ntz, world_key string, x int, y int, z int, actor_uuid string, actor_name string, "
          "mob string, allowed boolean")


def fire_data(rng, n, cells=6, gap=1.0):
    causers, fires, t = [], [], 0.0
    for i in range(n):
        t += rng.random() * gap
        spot = (rng.choice(["w", "v"]), rng.randrange(cells), rng.randrange(2), rng.randrange(cells))
        if rng.random() < 0.5:
            causers.append((i, t, *spot, f"u{i}", f"n{i}", "m:x", rng.random() < 0.7))
        else:
            fires.append((i, t, *spot))
    return causers, fires


def fire_fold(causers, fires, radius, ttl, take):
    """What a single watcher would do, one event after the other."""
    held, out = {}, {}
    for i, t, w, x, y, z, allowed in sorted(
        [(c[0], *c[1:6], c[9]) for c in causers] + [(f[0], *f[1:6], None) for f in fires], key=lambda r: (r[1], r[0])
    ):
        if allowed is not None:
            held[(w, x, y, z)] = (t, i, allowed)
            continue
        best = None
        for key in sorted(k for k in held if k[0] == w and max(abs(k[1] - x), abs(k[2] - y), abs(k[3] - z)) <= radius):
            if round((t - held[key][0]) * 1e6) > ttl * 1_000_000:
                continue
            if best is None or held[key][0] > held[best][0]:
                best = key
        if best is None:
            out[i] = (None, "PASSTHROUGH")
        else:
            out[i] = (held[best][1], "PAIR" if held[best][2] else "SUPPRESS")
            if take:
                del held[best]
    return out


@pytest.mark.parametrize("seed,cells,gap", [(1, 6, 1.0), (2, 3, 0.2), (3, 12, 0.5)])
def test_fire_equals_fold(spark, seed, cells, gap):
    causers, fires = fire_data(random.Random(seed), 500, cells, gap)
    c, f = make(spark, causers, CAUSER), make(spark, fires, CELLED)
    got = {r.id: (r.rid, r.verdict) for r in att.attribute_fire(f, c, span=sec(3)).collect()}
    assert got == fire_fold(causers, fires, 2, 2, True)
    peeked = {r.id: r.rid for r in att.peek_fire_causer(f, c, span=sec(3)).collect()}
    assert peeked == {k: v[0] for k, v in fire_fold(causers, fires, 2, 2, False).items()}


def test_fluid_equals_fold(spark):
    rng = random.Random(9)
    sources, flows, t = [], [], 0.0
    for i in range(500):
        t += rng.random() * 4
        spot = ("w", rng.randrange(-12, 12), rng.randrange(4), rng.randrange(-12, 12))
        if rng.random() < 0.5:
            sources.append((i, t, *spot, None if rng.random() < 0.1 else f"u{i}", f"n{i}"))
        else:
            flows.append((i, t, *spot))
    expected = {}
    for f in flows:
        standing = {}
        for s in sources:
            if s[1] <= f[1]:
                standing[s[2:6]] = s
        near = []
        for s in standing.values():
            dist = sum(abs(a - b) for a, b in zip(s[3:6], f[3:6]))
            if dist <= 8 and round((f[1] - s[1]) * 1e6) <= 120_000_000:
                near.append((dist, -s[1], s))
        best = min(near, key=lambda n: n[:2])[2] if near else None
        expected[f[0]] = (best[0], best[6], best[7] if best[6] else "#fluid") if best else (None, None, "#fluid")
    schema = "rid long, ts timestamp_ntz, world_key string, x int, y int, z int, actor_uuid string, actor_name string"
    got = att.attribute_fluid(make(spark, flows, CELLED), make(spark, sources, schema), span=sec(150)).collect()
    assert {r.id: (r.rid, r.source_uuid, r.source_name) for r in got} == expected


def test_neighbour_lookup_never_pairs_all(spark):
    causers, fires = fire_data(random.Random(4), 50)
    plan = att.peek_fire_causer(make(spark, fires, CELLED), make(spark, causers, CAUSER))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


ENTITY = ("entity string, is_player boolean, rider string, owner string, shooter string, stored_owner string, in_raid boolean")


def test_entity_chain(spark):
    def e(name, player=False, rider=None, owner=None, shooter=None, stored=None, raid=False):
        return (name, player, rider, owner, shooter, stored, raid)

    entities = spark.createDataFrame(
        [e("ann", True), e("horse", rider="bob"), e("dog", owner="cho"), e("arrow", shooter="ann"), e("arrow2", shooter="dog"),
         e("bolt", shooter="zombie"), e("zombie"), e("raider", raid=True), e("golem", stored="dee"), e("ravager", stored="dee"),
         e("p0", shooter="p1"), e("p1", shooter="p2"), e("p2", shooter="p3"), e("p3", shooter="p4"), e("p4", True),
         e("q0", shooter="p2"), e("s3", shooter="ann"), e("s0", shooter="s1"), e("s1", shooter="s2"), e("s2", shooter="ann")],
        ENTITY,
    )
    names = ["ann", "horse", "dog", "arrow", "arrow2", "bolt", "zombie", "raider", "golem", "ravager", "p0", "s0", "ghost"]
    probes = make(spark, [(n, 100, i) for i, n in enumerate(names)], "entity string, ts timestamp_ntz, id long")
    hits = make(spark, [("ravager", "eve", 90, 900), ("zombie", "fay", 70, 901)], HIT)
    got = {r.entity: (r.responsible, r.kind) for r in att.attribute_entity(probes, entities, hits).collect()}
    assert got == {
        "ann": ("ann", "PLAYER_DIRECT"), "horse": ("bob", "PLAYER_RIDER"), "dog": ("cho", "PLAYER_OWNER"),
        "arrow": ("ann", "PLAYER_PROJECTILE"), "arrow2": ("cho", "PLAYER_PROJECTILE"), "bolt": (None, "NATURAL_SPAWN"),
        "zombie": (None, "NATURAL_SPAWN"), "raider": (None, "NATURAL_RAID"), "golem": ("dee", "PLAYER_TAMER"),
        "ravager": ("eve", "PLAYER_INDIRECT"), "p0": (None, "UNKNOWN"), "s0": ("ann", "PLAYER_PROJECTILE"),
        "ghost": (None, "NATURAL_SPAWN"),
    }


def test_coupling(spark):
    rows = actions(
        spark, action(1, 0, 26, tag="#mob:dragons:fire"), action(2, 0, 26, tag="#mob:minecraft:creeper"),
        action(3, 0, 26, name="#mob:dragons:ice"), action(4, 0, 26, tag="#hopper"), action(5, 0, 1, tag="#mob:dragons:fire"),
    )
    got = {r.rid: (r.mob, r.allowed) for r in att.couple_entity_changes(rows, ("dragons:*",)).collect()}
    assert got == {1: ("dragons:fire", True), 2: ("minecraft:creeper", False), 3: ("dragons:ice", True)}


def test_displaced_fires_need_few_steps(spark, monkeypatch):
    """A row of fires at one moment each, every one of which finds its first choice taken."""
    from tracewell.operators import groups

    n, steps = 24, []
    for module in (att, groups):
        real = module.checkpointed
        monkeypatch.setattr(module, "checkpointed", lambda df, real=real: (steps.append(1), real(df))[1])
    # Causer k stands at x = k, the newer the smaller k; fires at x = 0 .. take them in turn.
    causers = [(k, 1 - k / 100, "w", k % 5, k // 5, 0, "u", "n", "m:x", True) for k in range(n)]
    fires = [(100 + k, 1.5 + k / 100, "w", 2, 2, 0) for k in range(n)]
    got = att.attribute_fire(make(spark, fires, CELLED), make(spark, causers, CAUSER))
    assert {r.id: r.rid for r in got.collect()} == {100 + k: k for k in range(n)}
    assert len(steps) <= 6


def test_fires_far_apart_are_settled_alone(spark):
    causers = [(k, 0.5, "w", 10 * k, 0, 0, "u", "n", "m:x", k % 2 == 0) for k in range(30)]
    fires = [(100 + k, 1.0, "w", 10 * k + 1, 1, 0) for k in range(30)] + [(200, 1.0, "v", 0, 0, 0)]
    got = {r.id: (r.rid, r.verdict) for r in att.attribute_fire(make(spark, fires, CELLED), make(spark, causers, CAUSER)).collect()}
    want = {100 + k: (k, "SUPPRESS" if k % 2 else "PAIR") for k in range(30)}
    assert got == {**want, 200: (None, "PASSTHROUGH")}
