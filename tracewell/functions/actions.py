"""Row-level meaning of actions: defaults, redaction, wording, classification."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.literals import look_up
from tracewell.functions.timing import MICROS_PER_SECOND, micros, ts_lit
from tracewell.schema import (
    COMMAND,
    DEFAULT_WORLD,
    JOIN,
    NON_POSITIONAL,
    PAYLOAD_COLUMNS,
    UNKNOWN_ACTOR,
    type_attribute,
)

# Actor names that stand for a cause rather than a player.
SENTINELS = (
    "#creeper", "#tnt", "#end_crystal", "#wither_skull", "#fireball", "#portal", "#hopper",
    "#command", "#bed", "#respawn_anchor", "#fire", "#lava", "#water", "#piston", "#fall",
    "#drown", "#suffocate", "#magic", "#zombie", "#skeleton", "#enderman", "#explosion",
    "#fluid", "#unknown",
)

# Tags of high-volume producers, and the prefix of a mob tag.
HOT_PREFIXES = ("#fire", "#natural", "#dispenser", "#fluid")
MOB_PREFIX = "#mob:"

# Tag per damage cause and per entity kind.
CAUSE_TAGS = {
    "fall": "#fall",
    "drown": "#drown",
    "inWall": "#suffocate",
    "lava": "#lava",
    "inFire": "#fire",
    "onFire": "#fire",
    "lightningBolt": "#lightning",
    "magic": "#magic",
    "explosion": "#explosion",
    "explosion.player": "#explosion",
}
ENTITY_TAGS = {
    "minecraft:creeper": "#creeper",
    "minecraft:tnt": "#tnt",
    "minecraft:wither_skull": "#wither_skull",
    "minecraft:fireball": "#fireball",
    "minecraft:small_fireball": "#fireball",
    "minecraft:ender_dragon": "#dragon",
    "minecraft:arrow": "#arrow",
    "minecraft:spectral_arrow": "#arrow",
    "minecraft:trident": "#trident",
}


def is_sentinel(name: Column) -> Column:
    return name.isNotNull() & name.isin(*SENTINELS)


def is_hot_source(tag: Column) -> Column:
    hot = F.lit(False)
    for prefix in HOT_PREFIXES:
        hot = hot | tag.startswith(prefix)
    return F.coalesce(hot, F.lit(False))


def mob_key(tag: Column) -> Column:
    """``#mob:ns:path`` -> ``ns:path``; null for any other tag."""
    return F.when(tag.startswith(MOB_PREFIX), F.substring(tag, len(MOB_PREFIX) + 1, 1 << 30))


def is_positional(type_col: Column) -> Column:
    return ~type_col.isin(*NON_POSITIONAL)


def has_payload() -> Column:
    present = F.lit(False)
    for name in PAYLOAD_COLUMNS:
        present = present | F.col(name).isNotNull()
    return present


def default_actor_name(uuid: Column, name: Column) -> Column:
    """A row without any actor belongs to the unknown sentinel."""
    return F.when(uuid.isNull() & name.isNull(), F.lit(UNKNOWN_ACTOR)).otherwise(name)


def default_amount(amount: Column) -> Column:
    return F.coalesce(amount, F.lit(1))


def default_target(target: Column) -> Column:
    return F.coalesce(target, F.lit(""))


def default_world(world: Column) -> Column:
    return F.coalesce(world, F.lit(DEFAULT_WORLD))


def command_head(message: Column) -> Column:
    """``/head`` of a command line: leading slashes and blanks go, a quoted
    head is unquoted and cut at its first blank, arguments are lost."""
    text = F.regexp_replace(F.coalesce(message, F.lit("")), r"^[\s/]+", "")
    quoted = F.coalesce(
        F.nullif(F.regexp_extract(text, r"^'([^']*)'", 1), F.lit("")),
        F.regexp_extract(text, r'^"([^"]*)"', 1),
    )
    head = F.when(text.rlike("^['\"]"), F.regexp_extract(quoted, r"^(\S*)", 1)).otherwise(
        F.regexp_extract(text, r"^(\S*)", 1)
    )
    return F.when(head == "", F.lit("")).otherwise(F.concat(F.lit("/"), head))


def redact_command(type_col: Column, target: Column) -> Column:
    return F.when(type_col == COMMAND, command_head(target)).otherwise(target)


def pseudonym(value: Column, salt: str) -> Column:
    """Salted, shortened hash of an address; nothing stays nothing."""
    digest = F.substring(F.sha2(F.concat(F.lit(salt), value), 256), 1, 16)
    return F.when(value.isNull() | (value == ""), F.lit("")).otherwise(F.concat(F.lit("sha256:"), digest))


def pseudonymize_join(type_col: Column, target: Column, salt: str) -> Column:
    return F.when(type_col == JOIN, pseudonym(target, salt)).otherwise(target)


def age_text(ts: Column, now: datetime) -> Column:
    """``5s``, ``3m``, ``7h``, ``13d``, ``2w``: whole units, rounded down."""
    elapsed = F.greatest(micros(ts_lit(now)) - micros(ts), F.lit(0))

    def whole(unit_seconds: int) -> Column:
        return F.floor(elapsed / F.lit(unit_seconds * MICROS_PER_SECOND)).cast("string")

    seconds = elapsed / F.lit(MICROS_PER_SECOND)
    return (
        F.when(seconds < 60, F.concat(whole(1), F.lit("s")))
        .when(seconds < 3_600, F.concat(whole(60), F.lit("m")))
        .when(seconds < 86_400, F.concat(whole(3_600), F.lit("h")))
        .when(seconds < 14 * 86_400, F.concat(whole(86_400), F.lit("d")))
        .otherwise(F.concat(whole(7 * 86_400), F.lit("w")))
    )


def history_line(now: datetime) -> Column:
    position = F.concat_ws(",", *[F.col(c).cast("string") for c in "xyz"])
    return F.concat(
        age_text(F.col("ts"), now),
        F.lit(" ago - "),
        F.coalesce(F.col("actor_name"), F.lit(UNKNOWN_ACTOR)),
        F.lit(" "),
        type_attribute("verb"),
        F.lit(" "),
        F.coalesce(F.col("target"), F.lit("?")),
        F.lit(" ("),
        position,
        F.lit(")"),
        F.when(F.col("rolled_back") == 1, F.lit(" [rolled back]")).otherwise(""),
    )


def previous_name(target: Column) -> Column:
    """Old name of a rename row; ``?`` when the row does not tell."""
    return F.when(F.instr(target, " -> ") > 0, F.substring_index(target, " -> ", 1)).otherwise("?")


def cause_tag(cause: Column) -> Column:
    return look_up(CAUSE_TAGS, cause)


def entity_tag(entity: Column) -> Column:
    """A known kind's tag, else ``#mob:<id>``."""
    known = F.coalesce(look_up(ENTITY_TAGS, entity), F.concat(F.lit(MOB_PREFIX), entity))
    return F.when(entity.isNotNull(), known)


def block_tag(block: Column) -> Column:
    path = F.regexp_replace(block, "^[^:]*:", "")
    namespace = F.regexp_extract(block, "^([^:]*):", 1)
    return (
        F.when(path.contains("lava"), "#lava")
        .when(path.contains("water"), "#fluid:water")
        .when(path.contains("fire"), "#fire")
        .when(path == "tnt", "#tnt")
        .when(path.contains("piston"), "#piston")
        .when(path.contains("bed"), "#bed")
        .when(path.contains("respawn_anchor"), "#respawn_anchor")
        .when(namespace != "minecraft", F.concat(F.lit("#modded:"), namespace))
        .when(block.isNotNull(), F.concat(F.lit("#block:"), block))
    )


def source_tag_of(cause: Column, direct: Column, causing: Column) -> Column:
    """Tag of a damage source: the cause if it is a known one, else the direct
    entity, else the entity behind it."""
    return F.coalesce(cause_tag(cause), entity_tag(direct), entity_tag(causing))


def json_line() -> Column:
    """Log-line form of a fact: fixed field order, nulls kept."""
    row = F.struct(
        F.floor(micros(F.col("ts")) / F.lit(1_000)).cast("long").alias("ts"),
        type_attribute("name").alias("type"),
        F.struct(F.col("actor_uuid").alias("uuid"), F.col("actor_name").alias("name")).alias("actor"),
        F.col("world_key").alias("world"),
        F.array("x", "y", "z").alias("pos"),
        F.col("target"),
        F.col("amount"),
        F.col("source_tag").alias("source"),
        F.col("meta"),
    )
    return F.to_json(row, {"ignoreNullFields": "false"})
