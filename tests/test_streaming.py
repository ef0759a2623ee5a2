"""Streams give what the batch operators give on the same rows."""

import random
from datetime import UTC, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import action, actions, at, ids, make
from test_attribution import CAUSER, CELLED, fire_data, fire_fold
from test_storage import events
from tracewell.operators import attribution as att
from tracewell.operators import gate as g
from tracewell.plans import streams
from tracewell.sources import facts
from tracewell.streaming import carried, ingest, keyed, windows
from tracewell.streaming.ingest import quarantine_replay

ONCE = {"availableNow": True}


def as_stream(spark, df, folder, parts=4, order="ts"):
    """Files that arrive one per micro-batch, in time order."""
    rows = df.orderBy(order, "id" if "id" in df.columns else "rid").collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        part = rows[i * size:(i + 1) * size]
        if part:
            spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def collect(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(**ONCE)
    q = q.option("checkpointLocation", str(tmp_path / f"cp_{name}")).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


@pytest.mark.parametrize("delay", ["10 minutes", "1 second", None])
def test_coalesce_stream(spark, tmp_path, delay):
    rng = random.Random(1)
    t, rows = 0.0, []
    for i in range(300):
        t += rng.choice([0.1, 0.25, 0.5])
        rows.append(action(i, round(t, 3), 26, x=rng.randrange(3)))
    df = actions(spark, *rows)
    stream = keyed.coalesce_stream(as_stream(spark, df, str(tmp_path / "in")), delay=delay)
    assert sorted(ids(collect(stream, tmp_path, "coalesced"))) == sorted(ids(g.coalesce_entity_changes(df)))


@pytest.mark.parametrize("delay", ["1 second", None])
def test_throttle_stream(spark, tmp_path, delay):
    rng = random.Random(2)
    t, rows = 0.0, []
    for i in range(300):
        t += rng.choice([0.1, 0.4, 0.7])
        rows.append(action(i, round(t, 3), 32, target=rng.choice("ab")))
    df = actions(spark, *rows)
    stream = keyed.throttle_stream(as_stream(spark, df, str(tmp_path / "in")), delay=delay)
    assert sorted(ids(collect(stream, tmp_path, "throttled"))) == sorted(ids(g.throttle_spawns(df)))


def test_hit_and_prime_streams(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(3)}", i, i + rng.random(), rng.random() < 0.5, f"u{i}", rng.choice(["PLAYER_DIRECT", "NATURAL_SPAWN"]))
            for i in range(300)]
    rows = [(k, i, t, r, a if r else None, kind if r else None) for k, i, t, r, a, kind in rows]
    df = make(spark, rows, "key string, id long, ts timestamp_ntz, is_record boolean, actor string, kind string")
    hits = df.filter("is_record").select(F.col("key").alias("victim"), F.col("actor").alias("attacker"), "ts", "id")
    deaths = df.filter("not is_record").select(F.col("key").alias("victim"), "ts", "id")
    expected = {r.id: r.attacker for r in att.attribute_last_hit(deaths, hits, timedelta(seconds=3)).collect()}
    stream = as_stream(spark, df, str(tmp_path / "in"))
    got = collect(keyed.last_hit_stream(stream, timedelta(seconds=3)), tmp_path, "hits")
    assert {r.id: r.actor for r in got.collect()} == expected

    cell = [F.col("key").alias("world_key"), *[F.lit(0).alias(c) for c in "xyz"]]
    primes = df.filter("is_record").select("id", "ts", *cell, F.col("actor").alias("actor_uuid"), F.col("actor").alias("actor_name"), "kind")
    blasts = df.filter("not is_record").select("id", "ts", *cell)
    expected = {r.id: r.prime_uuid for r in att.attribute_prime(blasts, primes, timedelta(seconds=3)).collect()}
    got = collect(keyed.prime_stream(stream, timedelta(seconds=3)), tmp_path, "primes")
    assert {r.id: r.actor for r in got.collect()} == expected


def test_fire_stream(spark, tmp_path):
    causers, fires = fire_data(random.Random(6), 120, 3, 0.6)
    both = make(spark, causers, CAUSER).withColumn("fire", F.lit(False)).unionByName(
        make(spark, fires, CELLED).withColumnRenamed("id", "rid").withColumn("fire", F.lit(True)), allowMissingColumns=True
    )
    out = str(tmp_path / "out")

    def split(batch):
        return (
            batch.filter("not fire").select(*carried.CAUSERS.fieldNames()),
            batch.filter("fire").select(F.col("rid").alias("id"), "ts", "world_key", "x", "y", "z"),
        )

    def sink(found, batch_id):
        found.select("id", "rid", "verdict").write.mode("overwrite").parquet(f"{out}/b={batch_id}")

    stream = as_stream(spark, both, str(tmp_path / "in"), parts=4)
    carried.fire_stream(stream, split, sink, str(tmp_path / "cp"), trigger=ONCE).awaitTermination()
    got = {r.id: (r.rid, r.verdict) for r in spark.read.parquet(out).collect()}
    assert got == fire_fold(causers, fires, 2, 2, True)


def test_fluid_stream(spark, tmp_path):
    rng = random.Random(8)
    schema = "rid long, ts timestamp_ntz, world_key string, x int, y int, z int, actor_uuid string, actor_name string, flow boolean"
    rows = [(i, i * 5 + rng.random(), "w", rng.randrange(8), 0, rng.randrange(8), f"u{i}", f"n{i}", rng.random() < 0.5) for i in range(120)]
    df = make(spark, rows, schema)

    def split(batch):
        return (
            batch.filter("not flow").select(*carried.SOURCES.fieldNames()),
            batch.filter("flow").select(F.col("rid").alias("id"), "ts", "world_key", "x", "y", "z"),
        )

    sources, flows = split(df)
    expected = {r.id: r.rid for r in att.attribute_fluid(flows, sources).collect()}
    out = str(tmp_path / "out")

    def sink(found, batch_id):
        found.select("id", F.col("rid").alias("src")).write.mode("overwrite").parquet(f"{out}/b={batch_id}")

    stream = as_stream(spark, df, str(tmp_path / "in"), parts=3)
    carried.fluid_stream(stream, split, sink, str(tmp_path / "cp"), trigger=ONCE).awaitTermination()
    assert {r.id: r.src for r in spark.read.parquet(out).collect()} == expected


def test_rate_stream(spark, tmp_path):
    df = actions(spark, *[action(i, i, 1 + i % 2) for i in range(120)])
    got = collect(windows.rate_stream(as_stream(spark, df, str(tmp_path / "in"))), tmp_path, "rates")
    closed = got.filter((F.col("start") == F.lit(at(10)).cast("timestamp")) & (F.col("type") == 1)).collect()
    assert [(r.n, r.per_second) for r in closed] == [(15, 0.5)]


def test_rate_stream_counts_panes(spark, tmp_path):
    """Slides that do not divide the window, a null type, several micro-batches: equal to plain sums."""
    seconds = [(i * 7) % 400 for i in range(300)]
    df = actions(spark, *[action(i, at_s, None if i % 5 == 0 else i % 2) for i, at_s in enumerate(sorted(seconds))])
    rates = windows.rate_stream(as_stream(spark, df, str(tmp_path / "in")), timedelta(seconds=10), timedelta(seconds=4))
    got = collect(rates, tmp_path, "panes").collect()
    zero = int(at(0).replace(tzinfo=UTC).timestamp())
    want = {}
    for i, at_s in enumerate(sorted(seconds)):
        last = (zero + at_s) // 4 * 4 - zero
        for start in range(last, last - 12, -4):
            if start <= at_s < start + 10 and start + 10 <= max(seconds) - 10:
                key = (start, None if i % 5 == 0 else i % 2)
                want[key] = want.get(key, 0) + 1
    start = lambda r: round((r.start - at(0)).total_seconds())
    assert {(start(r), r.type): r.n for r in got} == want
    assert all(r.per_second == r.n / 10 for r in got)


def test_container_stream(spark, tmp_path):
    slot = "array<struct<slot:int,item:string,count:int>>"
    schema = f"id long, session string, ts timestamp_ntz, slots {slot}"
    opens = [(1, "a", at(0), [(0, "diamond", 5), (2, "dirt", 1)]), (2, "b", at(1), [(0, "x", 1)]), (3, "c", at(2), [])]
    closes = [(4, "a", at(60), [(0, "diamond", 2), (1, "gold", 4), (2, "dirt", 1)]), (5, "b", at(400), [(0, "x", 9)])]
    left = as_stream(spark, spark.createDataFrame(opens, schema), str(tmp_path / "o"), 1)
    right = as_stream(spark, spark.createDataFrame(closes, schema), str(tmp_path / "c"), 1)
    got = collect(windows.container_stream(left, right), tmp_path, "sessions")
    assert {(r.session, r.slot, r.item, r.type, r.amount) for r in got.collect()} == {("a", 0, "diamond", 4, 3), ("a", 1, "gold", 3, 4)}


def test_ingest_stream_and_replay(spark, tmp_path):
    root = str(tmp_path / "root")
    rows = events(
        spark, action(1, 0, 1), action(2, 1, 5), action(3, 2, None), action(4, 3, 10, target="//pay me now"), action(5, 4, 12, target="1.2.3.4"),
        action(6, 5, 1, name="n" * 70), action(7, 6, 26, tag="#mob:a:b"), action(8, 7, 9),
    )
    stream = as_stream(spark, rows, str(tmp_path / "in"), 3)
    cfg = g.GateConfig(g.Toggles(items=False), entity_allow_list=())
    query = ingest.ingest_stream(stream, root, str(tmp_path / "cp"), ONCE, cfg=cfg, salt="s")
    query.awaitTermination()
    got = {r.id: r for r in facts.scan_actions(spark, root).collect()}
    assert sorted(got) == [1, 4, 5, 8]
    assert got[4].target == "/pay" and got[5].target.startswith("sha256:")
    assert {r.id: r.quarantine_reason for r in spark.read.parquet(f"{root}/quarantine").collect()} == {3: "type", 6: "name"}

    def repair(df):
        return df.withColumn("actor_name", F.substring("actor_name", 1, 64))

    for _ in range(2):
        left = quarantine_replay(spark, root, repair)
        assert [(r.id, r.tries) for r in left.collect()] == [(3, 1)]
        assert sorted(ids(facts.facts(spark, root))) == [1, 4, 5, 6, 8]


def test_batch_replay_is_idempotent(spark, tmp_path):
    root = str(tmp_path)
    rows = events(spark, action(1, 0, 1), action(2, 1, None))
    for _ in range(2):
        ingest.process_batch(rows, root, 7)
    assert ids(facts.facts(spark, root)) == [1]
    assert spark.read.parquet(f"{root}/quarantine").count() == 1
    fixed = quarantine_replay(spark, root, lambda df: df.withColumn("type", F.lit(1)))
    assert fixed.count() == 0 and sorted(ids(facts.facts(spark, root))) == [1, 2]
    assert not list((tmp_path / "quarantine").glob("batch=main-*"))


def test_replay_keeps_rows_that_share_an_id(spark, tmp_path):
    root = str(tmp_path)
    rows = events(spark, action(1, 0, None, amount=1), action(1, 0, None, amount=2), action(1, 0, 1, amount=3), action(2, 0, None))
    ingest.process_batch(rows, root, 0)
    fix = lambda df: df.withColumn("type", F.when(F.col("id") == 1, 2).otherwise(F.col("type")))
    assert [(r.id, r.tries) for r in quarantine_replay(spark, root, fix).collect()] == [(2, 1)]
    ingest.process_batch(events(spark, action(3, 0, None)), root, 1)
    # The row tried before is left alone, the new one is tried.
    left = quarantine_replay(spark, root, lambda df: df.withColumn("type", F.lit(5)))
    assert [(r.id, r.tries) for r in left.collect()] == [(2, 1)]
    assert quarantine_replay(spark, root, lambda df: df.withColumn("type", F.lit(6)), again=True).count() == 0
    assert sorted((r.id, r.type, r.amount) for r in facts.facts(spark, root).collect()) == [
        (1, 1, 3), (1, 2, 1), (1, 2, 2), (2, 6, 1), (3, 5, 1),
    ]


@pytest.mark.parametrize("kind", ["coalesce", "hits", "primes"])
def test_state_ends_with_the_window(spark, tmp_path, kind):
    """Every micro-batch has keys of its own: the state holds those of a window, not all."""
    n = 8
    rows = [(f"k{i}", i, i * 3600.0, True, "u", "PLAYER_DIRECT") for i in range(n)]
    if kind == "coalesce":
        df = actions(spark, *[action(i, i * 3600.0, 26, x=i) for i in range(n)])
        stream = keyed.coalesce_stream(as_stream(spark, df, str(tmp_path / "in"), n), delay="1 second")
    else:
        df = make(spark, rows, "key string, id long, ts timestamp_ntz, is_record boolean, actor string, kind string")
        run = keyed.last_hit_stream if kind == "hits" else keyed.prime_stream
        stream = run(as_stream(spark, df, str(tmp_path / "in"), n), delay="1 second")
    keyed.use_keyed_state(spark)
    q = stream.writeStream.format("memory").queryName(f"ends_{kind}").option("checkpointLocation", str(tmp_path / "cp"))
    q = q.outputMode("append").trigger(**ONCE).start()
    q.awaitTermination()
    held = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    # A value and a timer for each key that is still held.
    assert max(held) <= 2 * 3 * 2 and held[-1] <= 4 and max(held) > 0, held


def test_stretches_arrive_whole(spark, tmp_path, monkeypatch):
    """A stretch of time is a micro-batch, of as many files as its rows call for."""
    monkeypatch.setattr(streams, "FILE_ROWS", 40)
    # Most of the time has few rows: stretches go by rows.
    rows = actions(spark, *[action(i, i if i < 900 else i * 1000, 1) for i in range(1000)])
    stream = streams._in_files(spark, rows, "stretches")
    seen = []

    def look(batch, number):
        if not batch.isEmpty():
            read = batch.select("id", F.input_file_name().alias("file")).collect()
            seen.append((sorted(r.id for r in read), len({r.file for r in read})))

    stream.writeStream.foreachBatch(look).option("checkpointLocation", str(tmp_path)).trigger(**ONCE).start().awaitTermination()
    assert [i for batch, _ in seen for i in batch] == list(range(1000))
    assert len(seen) == 4 and {files for _, files in seen} == {min(len(b) for b, _ in seen) // 40}
    # No rows, rows without a time, and rows of one time.
    for few in ([], [action(1, None, 1)], [action(i, 7, 1) for i in range(300)]):
        stream = streams._in_files(spark, actions(spark, *few), "few")
        assert collect(stream.select("id"), tmp_path, f"few_{len(few)}").count() == sum(r[1] is not None for r in few)
