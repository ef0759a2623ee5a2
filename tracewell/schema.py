"""Tables, column types and the action-type dimension."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.literals import pick


@dataclass(frozen=True)
class ActionType:
    id: int
    name: str
    token: str
    category: str
    direction: str  # "+" place, "-" break, "0" neutral
    verb: str       # history wording


# Action types. Ids are stored in facts and are never renumbered.
ACTION_TYPES = tuple(
    ActionType(*row)
    for row in (
        (1, "BLOCK_PLACE", "+block", "BLOCK", "+", "placed"),
        (2, "BLOCK_BREAK", "-block", "BLOCK", "-", "broke"),
        (3, "CONTAINER_DEPOSIT", "+container", "CONTAINER", "+", "deposited"),
        (4, "CONTAINER_WITHDRAW", "-container", "CONTAINER", "-", "withdrew"),
        (5, "ITEM_DROP", "-item", "ITEM", "-", "dropped"),
        (6, "ITEM_PICKUP", "+item", "ITEM", "+", "picked up"),
        (7, "ENTITY_KILL", "kill", "ENTITY", "0", "killed"),
        (8, "EXPLOSION", "explosion", "WORLD", "-", "exploded"),
        (9, "CHAT", "chat", "MESSAGE", "0", "said"),
        (10, "COMMAND", "command", "MESSAGE", "0", "ran"),
        (11, "SIGN", "sign", "MESSAGE", "0", "signed"),
        (12, "SESSION_JOIN", "+session", "SESSION", "+", "joined"),
        (13, "SESSION_LEAVE", "-session", "SESSION", "-", "left"),
        (14, "USERNAME_CHANGE", "username", "SESSION", "0", "renamed"),
        (15, "BURN", "burn", "BLOCK", "-", "broke"),
        (16, "IGNITE", "ignite", "BLOCK", "+", "placed"),
        (17, "FADE", "fade", "BLOCK", "-", "broke"),
        (18, "FORM", "form", "BLOCK", "+", "placed"),
        (19, "SPREAD", "spread", "BLOCK", "+", "placed"),
        (20, "DISPENSE", "dispense", "BLOCK", "0", "dispensed"),
        (21, "PISTON_EXTEND", "+piston", "BLOCK", "+", "placed"),
        (22, "PISTON_RETRACT", "-piston", "BLOCK", "-", "broke"),
        (23, "BUCKET_EMPTY", "+bucket", "BLOCK", "+", "placed"),
        (24, "BUCKET_FILL", "-bucket", "BLOCK", "-", "broke"),
        (25, "LEAVES_DECAY", "decay", "BLOCK", "-", "broke"),
        (26, "ENTITY_CHANGE_BLOCK", "entityblock", "BLOCK", "0", "changed block"),
        (27, "INVENTORY_DEPOSIT", "+inventory", "CONTAINER", "+", "deposited"),
        (28, "INVENTORY_WITHDRAW", "-inventory", "CONTAINER", "-", "withdrew"),
        (29, "HOPPER_PUSH", "+hopper", "CONTAINER", "+", "deposited"),
        (30, "HOPPER_PULL", "-hopper", "CONTAINER", "-", "withdrew"),
        (31, "ITEM_CRAFT", "craft", "ITEM", "0", "crafted"),
        (32, "ENTITY_SPAWN", "spawn", "ENTITY", "+", "spawned"),
        (33, "ENTITY_INTERACT", "einteract", "ENTITY", "0", "interacted with"),
        (34, "HANGING_PLACE", "+hanging", "ENTITY", "+", "placed"),
        (35, "HANGING_BREAK", "-hanging", "ENTITY", "-", "broke"),
        (36, "STRUCTURE_GROW", "grow", "WORLD", "+", "grew"),
        (37, "PORTAL_CREATE", "portal", "WORLD", "+", "created portal"),
        (38, "CHUNK_POPULATE", "populate", "WORLD", "+", "populated"),
        (39, "CLICK", "click", "INTERACT", "0", "clicked"),
        (40, "FLUID_FLOW", "fluid", "BLOCK", "+", "placed"),
    )
)

# Ids with special handling.
KILL, EXPLOSION, CHAT, COMMAND, SIGN = 7, 8, 9, 10, 11
JOIN, LEAVE, RENAME = 12, 13, 14
ENTITY_CHANGE, SPAWN, FLUID = 26, 32, 40
NON_POSITIONAL = (9, 10, 12, 13, 14)
ROLLBACKABLE = (1, 2, 3, 4, 7, 8, 15, 16, 17, 23, 24, 25, 26, 29, 30, 34, 35, 36, 37, 40)
NEWEST_WINS = (1, 2, 15, 16, 17, 23, 24, 25, 26, 36, 37, 40)

# Names and defaults that stored rows rely on.
AIR = "minecraft:air"
UNKNOWN_ACTOR = "#unknown"
DEFAULT_WORLD = "minecraft:overworld"
CONSOLE_ACTOR = "00000000-0000-0000-0000-000000000000"
SCHEMA_VERSION = 5

PAYLOAD_COLUMNS = ("old_block_state", "new_block_state", "block_entity_nbt", "item_nbt", "entity_nbt")

ACTIONS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("ts", T.TimestampNTZType(), False),
        T.StructField("type", T.IntegerType(), False),
        T.StructField("user_id", T.LongType(), False),
        T.StructField("world_id", T.LongType(), False),
        T.StructField("x", T.IntegerType(), False),
        T.StructField("y", T.IntegerType(), False),
        T.StructField("z", T.IntegerType(), False),
        T.StructField("target", T.StringType(), False),
        T.StructField("meta", T.StringType()),
        T.StructField("amount", T.IntegerType(), False),
        T.StructField("rolled_back", T.IntegerType(), False),
        T.StructField("source_tag", T.StringType()),
        T.StructField("sign_side", T.StringType()),
        T.StructField("sign_dye_color", T.StringType()),
        T.StructField("sign_waxed", T.BooleanType()),
        T.StructField("old_block_state", T.StringType()),
        T.StructField("new_block_state", T.StringType()),
        T.StructField("block_entity_nbt", T.BinaryType()),
        T.StructField("item_nbt", T.BinaryType()),
        T.StructField("entity_nbt", T.BinaryType()),
        T.StructField("dt", T.DateType()),
        T.StructField("batch", T.StringType()),
    ]
)

USERS = T.StructType(
    [
        T.StructField("user_id", T.LongType(), False),
        T.StructField("uuid", T.StringType()),
        T.StructField("name", T.StringType(), False),
        T.StructField("first_seen", T.TimestampNTZType(), False),
        T.StructField("last_seen", T.TimestampNTZType(), False),
    ]
)

WORLDS = T.StructType(
    [
        T.StructField("world_id", T.LongType(), False),
        T.StructField("world_key", T.StringType(), False),
    ]
)

BATCHES = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType(), False),
        T.StructField("actor_uuid", T.StringType()),
        T.StructField("mode", T.IntegerType(), False),
        T.StructField("affected", T.LongType(), False),
        T.StructField("filter_json", T.StringType()),
        T.StructField("undoes", T.LongType()),  # the batch that this one reverts
        T.StructField("status", T.StringType(), False),
        T.StructField("batch_id", T.LongType(), False),
    ]
)

BATCH_ACTIONS = T.StructType(
    [
        T.StructField("action_id", T.LongType(), False),
        T.StructField("step", T.StringType(), False),  # planned or applied
        T.StructField("batch_id", T.LongType(), False),
    ]
)

# What a producer hands in: names instead of keys, everything nullable.
EVENTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("type", T.IntegerType()),
        T.StructField("actor_uuid", T.StringType()),
        T.StructField("actor_name", T.StringType()),
        T.StructField("world_key", T.StringType()),
        T.StructField("x", T.IntegerType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("z", T.IntegerType()),
        T.StructField("target", T.StringType()),
        T.StructField("meta", T.StringType()),
        T.StructField("amount", T.IntegerType()),
        T.StructField("rolled_back", T.IntegerType()),
        T.StructField("source_tag", T.StringType()),
        T.StructField("sign_side", T.StringType()),
        T.StructField("sign_dye_color", T.StringType()),
        T.StructField("sign_waxed", T.BooleanType()),
        T.StructField("old_block_state", T.StringType()),
        T.StructField("new_block_state", T.StringType()),
        T.StructField("block_entity_nbt", T.BinaryType()),
        T.StructField("item_nbt", T.BinaryType()),
        T.StructField("entity_nbt", T.BinaryType()),
    ]
)

MUTATION_COLUMNS = (
    "action_id", "step", "verb", "world_key", "x", "y", "z", "object", "amount", "meta", "state", "payload",
)


def types_in(category: str) -> list[int]:
    return [t.id for t in ACTION_TYPES if t.category == category.upper()]


def types_with(direction: str) -> list[int]:
    return [t.id for t in ACTION_TYPES if t.direction == direction]


def type_is(ids) -> Column:
    """Membership in a list of type ids."""
    return F.expr(f"type IN ({', '.join(str(int(i)) for i in ids)})") if ids else F.lit(False)


def type_attribute(name: str, type_col: Column | str = "type") -> Column:
    """Attribute of the action type as an array lookup: ids are dense from 1,
    so no join is needed. Unknown ids give null."""
    column = F.col(type_col) if isinstance(type_col, str) else type_col
    return pick([getattr(t, name) for t in ACTION_TYPES], column - 1)


def action_type_table(spark: SparkSession) -> DataFrame:
    """The dimension as rows (40, so always safe to broadcast)."""
    rows = [(t.id, t.name, t.token, t.category, t.direction, t.verb) for t in ACTION_TYPES]
    return spark.createDataFrame(
        rows, "type int, name string, token string, category string, direction string, verb string"
    )
