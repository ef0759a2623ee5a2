"""Block categories used when watching natural changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.literals import look_up

# Category per block id or id ending.
CATEGORY_IDS = {
    "fire": ("minecraft:fire", "minecraft:soul_fire"),
    "ice": (
        "minecraft:ice", "minecraft:frosted_ice", "minecraft:packed_ice", "minecraft:blue_ice",
        "minecraft:snow", "minecraft:snow_block",
    ),
    "grass": ("minecraft:grass_block", "minecraft:mycelium", "minecraft:podzol"),
    "dirt": ("minecraft:dirt", "minecraft:coarse_dirt", "minecraft:rooted_dirt"),
    "obsidian": ("minecraft:obsidian",),
    "cobblestone": ("minecraft:cobblestone",),
    "stone": ("minecraft:stone",),
    "basalt": ("minecraft:basalt",),
    "water": ("minecraft:water", "minecraft:flowing_water"),
    "lava": ("minecraft:lava", "minecraft:flowing_lava"),
}
CATEGORY_ENDINGS = {"leaves": "_leaves", "powder": "_concrete_powder", "concrete": "_concrete"}
HOT_CATEGORIES = ("fire", "ice", "leaves", "powder", "concrete", "grass", "dirt", "water", "lava")
FLUID_PRODUCTS = ("obsidian", "cobblestone", "stone", "basalt")
NO_CATEGORY = "-"


def block_category(block: Column) -> Column:
    """Category of a block id; null for the many ids that are not watched."""
    by_id = {i: category for category, ids in CATEGORY_IDS.items() for i in ids}
    by_ending = F.lit(None).cast("string")
    for category, ending in CATEGORY_ENDINGS.items():
        by_ending = F.when(block.endswith(ending), category).otherwise(by_ending)
    return F.coalesce(look_up(by_id, block), by_ending)


def is_hot_category(category: Column) -> Column:
    return F.coalesce(category.isin(*HOT_CATEGORIES), F.lit(False))


def change_between(was: str, now: str) -> str | None:
    """What a change from one category to another means, if anything."""
    if was == "fire" or now == "fire":
        return None if was == now else "BURN" if was == "fire" else "IGNITE"
    if was == "ice":
        return None if now == "ice" else "FADE"
    if (was, now) == ("powder", "concrete") or (was in ("water", "lava") and now in FLUID_PRODUCTS):
        return "FORM"
    if now == "ice" and was in ("water", NO_CATEGORY):
        return "FORM"
    if (was, now) == ("dirt", "grass"):
        return "SPREAD"
    return "LEAVES_DECAY" if was == "leaves" and now != "leaves" else None


def natural_change(prev_block: Column, block: Column) -> Column:
    """Action name of a change of block; null when it says nothing. A first
    sight of fire counts as an ignition.

    The rules become one literal map over pairs of categories, so each category
    is computed once per row.
    """
    names = [NO_CATEGORY, *CATEGORY_IDS, *CATEGORY_ENDINGS]
    pairs = {f"{a}>{b}": change_between(a, b) for a in names for b in names}
    known = {pair: change for pair, change in pairs.items() if change}

    def named(b: Column) -> Column:
        return F.coalesce(block_category(b), F.lit(NO_CATEGORY))

    # A cell seen for the first time was something unlike any category.
    first = {f"?>{c}": "IGNITE" for c in ("fire",)}
    before = F.when(prev_block.isNull(), F.lit("?")).otherwise(named(prev_block))
    pair = F.concat(before, F.lit(">"), named(block))
    return F.when(~prev_block.eqNullSafe(block), look_up({**known, **first}, pair))
