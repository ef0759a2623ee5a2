"""Rows and tables that the tests build."""

from datetime import datetime, timedelta

START = datetime(2024, 1, 1)


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


def make(spark, rows, schema):
    """Rows with ``ts`` given in seconds after the start."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    where = names.index("ts") if "ts" in names else None
    fixed = [
        tuple(at(v) if i == where and v is not None else v for i, v in enumerate(row)) for row in rows
    ]
    return spark.createDataFrame(fixed, schema)


ACTION = (
    "id long, ts timestamp_ntz, type int, user_id long, actor_uuid string, actor_name string, world_key string, "
    "x int, y int, z int, target string, meta string, amount int, rolled_back int, source_tag string"
)


def action(id, ts, type, x=0, y=64, z=0, target="minecraft:stone", world="minecraft:overworld", name="ann",
           uuid=None, meta=None, amount=1, rolled_back=0, tag=None, user=1):
    return (id, ts, type, user, uuid, name, world, x, y, z, target, meta, amount, rolled_back, tag)


def actions(spark, *rows):
    return make(spark, list(rows), ACTION)


def ids(df):
    return [r.id for r in df.select("id").collect()]
