"""Streaming forms (S) over the event files, run to the end of the input."""

from __future__ import annotations

import itertools
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracewell.operators.attribution import couple_entity_changes
from tracewell.functions.timing import micros, ts_lit
from tracewell.operators.gate import GateConfig, Toggles
from tracewell.plans.attribution import ALLOW as MOBS
from tracewell.plans.binding import NOW, as_events, fact_stream, facts, oracle
from tracewell.plans.diffs import SESSIONS_SQL, snapshots
from tracewell.plans.gating import ALLOW, GATE_SQL, LISTED, OVERRIDES, TOGGLES, rules
from tracewell.plans.registry import ORACLES, query
from tracewell.session import scratch_folder
from tracewell.sources import facts as store
from tracewell.streaming import carried, ingest, keyed, windows

ONCE = {"availableNow": True}
CELL = ["world_key", "x", "y", "z"]


def finished(stream, name):
    """Run a stream over all input there is and read what it wrote."""
    spark = stream.sparkSession
    keyed.use_keyed_state(spark)
    folder = scratch_folder(spark, name)
    out = stream.writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append")
    out.option("checkpointLocation", f"{folder}/checkpoint").trigger(**ONCE).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("ingest_stream", oracle(f"""{GATE_SQL}
SELECT gated.id, a.type, a.actor_name, a.world_key, gated.target FROM gated JOIN a ON a.id = gated.id WHERE gate_reason IS NULL"""))
def ingest_stream(spark, sf):
    folder = scratch_folder(spark, "ingest")
    cfg = GateConfig(TOGGLES, True, OVERRIDES, ALLOW, coalesce_window=timedelta(hours=72))
    preds = [F.when(F.col("type").isin(34, 35), F.lit(True)), F.when(F.col("y") == 60, F.lit(False))]
    events = as_events(fact_stream(spark, sf))
    ingest.ingest_stream(
        events, f"{folder}/root", f"{folder}/checkpoint", ONCE, cfg=cfg, rules=rules(spark), predicates=preds
    ).awaitTermination()
    return store.scan_actions(spark, f"{folder}/root").select("id", "type", "actor_name", "world_key", "target")


@query("coalesce_stream", f"SELECT id FROM ({ORACLES['coalesce_entity_changes']})")
def coalesce_stream(spark, sf):
    """Four stretches of time, one per micro-batch, as in the other keyed streams: the
    state is handed on, and ends by the time of the events."""
    rows = _in_files(spark, facts(spark, sf), "coalesce-in").select("id", "ts", "type", "actor_uuid", "actor_name", *CELL)
    return finished(keyed.coalesce_stream(rows, timedelta(hours=72)), "coalesce").select("id")


@query("throttle_stream", f"SELECT id FROM ({ORACLES['throttle_spawns']})")
def throttle_stream(spark, sf):
    rows = _in_files(spark, facts(spark, sf), "throttle-in").select("id", "ts", "type", "target")
    return finished(keyed.throttle_stream(rows, timedelta(hours=6)), "throttle").select("id")


@query("rate_stream", oracle("""
, w AS (SELECT type, date_trunc('hour', ts) - CAST(k AS int) * INTERVAL 1 HOUR AS "start" FROM a, (SELECT unnest(range(6)) AS k))
SELECT "start", "start" + INTERVAL 6 HOUR AS "end", type, count(*) AS n, CAST(count(*) AS double) / CAST(21600 AS double) AS per_second
FROM w GROUP BY "start", type HAVING "start" + INTERVAL 6 HOUR <= (SELECT max(ts) FROM a) - INTERVAL 10 SECOND"""))
def rate_stream(spark, sf):
    rows = fact_stream(spark, sf).select("ts", "type")
    rates = finished(windows.rate_stream(rows, timedelta(hours=6), timedelta(hours=1)), "rate")
    return rates.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("last_hit_stream", f"SELECT id, CAST(attacker AS varchar) AS actor FROM ({ORACLES['attribute_last_hit']})")
def last_hit_stream(spark, sf):
    hit = F.col("type") == 33
    rows = _in_files(spark, facts(spark, sf), "hits-in", keep=("user_id",)).filter(F.col("type").isin(7, 33)).select(
        F.concat_ws(":", "world_key", F.col("x").cast("string")).alias("key"), "ts", "id", hit.alias("is_record"),
        F.when(hit, F.col("user_id").cast("string")).alias("actor"), F.lit(None).cast("string").alias("kind"),
    )
    return finished(keyed.last_hit_stream(rows, timedelta(hours=24)), "hits").select("id", "actor")


@query("prime_stream", f"SELECT id, prime_uuid AS actor, prime_kind AS kind FROM ({ORACLES['attribute_prime']})")
def prime_stream(spark, sf):
    prime = F.col("type") == 16
    kind = F.get(F.array(F.lit("PLAYER_DIRECT"), F.lit("PLAYER_INDIRECT"), F.lit("NATURAL_SPAWN")), F.col("amount") % 3)
    cell = F.concat_ws(":", "world_key", F.col("x").cast("string"), (F.col("z") - F.col("z") % 2).cast("string"))
    rows = _in_files(spark, facts(spark, sf), "primes-in").filter(F.col("type").isin(8, 16)).select(
        cell.alias("key"), "ts", "id", prime.alias("is_record"),
        F.when(prime, F.col("actor_uuid")).alias("actor"), F.when(prime, kind).alias("kind"),
    )
    return finished(keyed.prime_stream(rows, timedelta(hours=240)), "primes")


def _carried(run, stream, split, columns, ttl, name):
    spark = stream.sparkSession
    folder = scratch_folder(spark, name)

    def sink(found, batch_id):
        found.select(*columns).write.mode("overwrite").parquet(f"{folder}/out/b={batch_id}")

    run(stream, split, sink, f"{folder}/checkpoint", ttl=ttl, trigger=ONCE).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(*columns)


@query("fire_stream", ORACLES["attribute_fire"])
def fire_stream(spark, sf):
    def split(batch):
        fires = batch.filter(F.col("type").isin(15, 16)).select("id", "ts", *CELL)
        return couple_entity_changes(batch, MOBS).select(*carried.CAUSERS.fieldNames()), fires

    columns = ["id", "rid", "causer_mob", "verdict"]
    return _carried(carried.fire_stream, fact_stream(spark, sf), split, columns, timedelta(hours=6), "fire")


@query("fluid_stream", f"SELECT id, rid, dist, source_uuid, source_name FROM ({ORACLES['attribute_fluid']})")
def fluid_stream(spark, sf):
    def split(batch):
        sources = batch.filter(F.col("type") == 23).withColumnRenamed("id", "rid").select(*carried.SOURCES.fieldNames())
        return sources, batch.filter(F.col("type") == 40).select("id", "ts", *CELL)

    columns = ["id", "rid", "dist", "source_uuid", "source_name"]
    return _carried(carried.fluid_stream, fact_stream(spark, sf), split, columns, timedelta(hours=6), "fluid")


@query("container_stream", oracle(SESSIONS_SQL))
def container_stream(spark, sf):
    rows = fact_stream(spark, sf)
    moves = windows.container_stream(snapshots(rows, (3, 27, 29)), snapshots(rows, (4, 28, 30)), timedelta(hours=24))
    return finished(moves, "containers").withColumn("closed", F.col("closed").cast("timestamp_ntz"))


# Rows of a file that arrives.
FILE_ROWS = 250_000


def _in_files(spark, rows, name, parts=4, keep=()):
    """The events as files that arrive one stretch of time after the other, each stretch
    a micro-batch; with the columns ``keep`` besides those of an event.

    Stretches hold about as many rows each, and all come as equally many files, by which
    a trigger takes one of them: a stretch is written, read and stored by as many tasks as
    it has files.
    """
    folder = scratch_folder(spark, name)
    # Derived once: every stretch reads what is stored here.
    as_events(rows, keep).write.parquet(f"{folder}/all")
    rows = spark.read.parquet(f"{folder}/all").filter(F.col("ts").isNotNull())
    at = rows.select(micros(F.col("ts")).alias("at"))
    edges = sorted({int(edge) for edge in at.approxQuantile("at", [i / parts for i in range(1, parts)], 0.01)})
    stretch = sum(((F.col("at") >= edge).cast("int") for edge in edges), F.lit(0))
    counted = at.withColumn("stretch", stretch).groupBy("stretch").count()
    sizes = [r["count"] for r in counted.collect()]
    files = max(1, min(sizes) // FILE_ROWS) if len(sizes) > len(edges) else 1
    edges = [None, *(datetime(1970, 1, 1) + timedelta(microseconds=edge) for edge in edges), None]
    for i, (first, end) in enumerate(itertools.pairwise(edges)):
        part = rows if first is None else rows.filter(F.col("ts") >= ts_lit(first))
        if end is not None:
            part = part.filter(F.col("ts") < ts_lit(end))
        # Dealt out in turn, so no file stays empty and is left out.
        part.repartition(files).write.parquet(f"{folder}/part={i}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/part=*")


def _cfg():
    cfg = GateConfig(TOGGLES, True, OVERRIDES, ALLOW, coalesce_window=timedelta(hours=72))
    preds = [F.when(F.col("type").isin(34, 35), F.lit(True)), F.when(F.col("y") == 60, F.lit(False))]
    return cfg, preds


# A name that no store takes, for some of the rows: they wait in the quarantine.
LONG_NAME = "n" * 80
TOO_LONG = "a.id % 7 = 0 AND a.actor_uuid IS NOT NULL"


@query("ingest_files", oracle(f"""{GATE_SQL.replace(f"coalesce({LISTED}, false)", "false")}
SELECT gated.id, a.type, gated.target, CASE WHEN {TOO_LONG} THEN 'name' END AS refused
FROM gated JOIN a ON a.id = gated.id WHERE gate_reason IS NULL"""))
def ingest_files(spark, sf):
    """Four stretches of time, one per micro-batch: coalescing goes across them; what is stored and
    what waits in the quarantine. No block rules: they would see the long names."""
    long = F.when((F.col("id") % 7 == 0) & F.col("actor_uuid").isNotNull(), F.lit(LONG_NAME))
    rows = facts(spark, sf)
    stream = _in_files(spark, rows, "files")
    cfg, preds = _cfg()
    folder = scratch_folder(spark, "ingest-files")
    root = f"{folder}/root"
    ingest.ingest_stream(
        stream.withColumn("actor_name", F.coalesce(long, F.col("actor_name"))), root, f"{folder}/checkpoint", ONCE,
        cfg=cfg, rules=None, predicates=preds,
    ).awaitTermination()
    kept = store.facts(spark, root).select("id", "type", "target", F.lit(None).cast("string").alias("refused"))
    waiting = ingest.quarantined(spark, root)
    return kept.unionByName(waiting.select("id", "type", "target", F.col("quarantine_reason").alias("refused")))


@query("two_streams", oracle(f"""{GATE_SQL}
SELECT gated.id, a.type, a.actor_name, gated.target FROM gated JOIN a ON a.id = gated.id WHERE gate_reason IS NULL"""))
def two_streams(spark, sf):
    """Two streams with checkpoints of their own write into one root."""
    folder = scratch_folder(spark, "two")
    cfg, preds = _cfg()
    for i in range(2):
        mine = F.pmod(F.xxhash64("actor_name"), F.lit(2)) == i
        ingest.ingest_stream(
            as_events(fact_stream(spark, sf).filter(mine)), f"{folder}/root", f"{folder}/checkpoint-{i}", ONCE,
            cfg=cfg, rules=rules(spark), predicates=preds,
        ).awaitTermination()
    return store.scan_actions(spark, f"{folder}/root").select("id", "type", "actor_name", "target")


@query("replay_gated", oracle("""
SELECT id, CASE WHEN id % 3 = 0 THEN 10 ELSE type END AS type,
       CASE WHEN id % 3 = 0 OR type = 10 THEN concat('/', regexp_extract(target, '^/*([^ ]+)', 1)) ELSE target END AS target
FROM a WHERE NOT (id % 3 <> 0 AND type = 9)"""))
def replay_gated(spark, sf):
    """Rows that wait for a type become commands: the replay redacts them like the
    ingest, and chat is switched off for both."""
    root = scratch_folder(spark, "replay")
    rows = as_events(facts(spark, sf).withColumn("type", F.when(F.col("id") % 3 != 0, F.col("type"))))
    cfg = GateConfig(Toggles(chat=False), strict=False)
    ingest.process_batch(rows, root, 0, cfg=cfg)
    ingest.quarantine_replay(spark, root, lambda df: df.withColumn("type", F.coalesce("type", F.lit(10))), cfg=cfg)
    return store.facts(spark, root).select("id", "type", "target")


@query("quarantine_replay", oracle("SELECT id, actor_name FROM a"))
def quarantine_replay(spark, sf):
    """A third of the rows has no type at first; the replay repairs them."""
    root = scratch_folder(spark, "quarantine")
    rows = as_events(facts(spark, sf).withColumn("type", F.when(F.col("id") % 3 != 0, F.col("type"))))
    ingest.process_batch(rows, root, 0, GateConfig(strict=False))
    ingest.quarantine_replay(spark, root, lambda df: df.withColumn("type", F.coalesce("type", F.lit(39))))
    return store.scan_actions(spark, root).select("id", "actor_name")


@query("replay_shared_ids", oracle("""
SELECT id, type, amount, 'stored' AS place FROM a WHERE id % 3 <> 0 UNION ALL
SELECT id, 39, amount + k, 'stored' FROM a, (SELECT unnest([0, 1]) AS k) WHERE id % 3 = 0 AND amount % 2 = 0 UNION ALL
SELECT id, NULL, amount + k, 'tried 1' FROM a, (SELECT unnest([0, 1]) AS k) WHERE id % 3 = 0 AND amount % 2 <> 0"""))
def replay_shared_ids(spark, sf):
    """Two different rows of every quarantined id, half of them repaired by the first of two
    replays: each row is stored once or waits once, and none is tried a second time."""
    root = scratch_folder(spark, "replay-shared")
    waits = F.col("id") % 3 == 0
    rows = facts(spark, sf).withColumn("fixable", F.col("amount") % 2 == 0)
    twice = rows.unionByName(rows.filter(waits).withColumn("amount", F.col("amount") + 1))
    mark = F.when(F.col("fixable"), F.lit("yes")).otherwise(F.lit("no"))
    events = as_events(twice.withColumn("meta", mark).withColumn("type", F.when(~waits, F.col("type"))))
    ingest.process_batch(events, root, 0, GateConfig(strict=False))

    def repair(df):
        return df.withColumn("type", F.when(F.col("meta") == "yes", F.coalesce("type", F.lit(39))).otherwise(F.col("type")))

    for _ in range(2):
        left = ingest.quarantine_replay(spark, root, repair)
    waiting = left.select("id", "type", "amount", F.concat(F.lit("tried "), "tries").alias("place"))
    return store.facts(spark, root).select("id", "type", "amount", F.lit("stored").alias("place")).unionByName(waiting)
