"""Dimension resolution and fact-dimension joins.

Dimension tables grow with the data, so no join here is hinted: Catalyst (from
file sizes) and AQE (from shuffle sizes) broadcast them while they are small
and split skewed keys when they are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.actions import (
    default_actor_name,
    default_amount,
    default_target,
    default_world,
)
from tracewell.schema import type_attribute


def user_key() -> Column:
    """Natural key of an actor: the uuid if it has one, else the name."""
    return F.coalesce(F.col("actor_uuid"), default_actor_name(F.col("actor_uuid"), F.col("actor_name")))


def user_id() -> Column:
    """Stable surrogate that needs no counter: a hash of the natural key,
    marked with its kind so a name can never meet a uuid."""
    kind = F.when(F.col("actor_uuid").isNull(), F.lit("n:")).otherwise(F.lit("u:"))
    return F.xxhash64(F.concat(kind, user_key()))


def world_id() -> Column:
    return F.xxhash64(default_world(F.col("world_key")))


def normalize_actions(events: DataFrame) -> DataFrame:
    """Defaults of a stored row; rows without type or world are not actions."""
    name = F.coalesce(default_actor_name(F.col("actor_uuid"), F.col("actor_name")), F.lit(""))
    return (
        events.filter(F.col("type").isNotNull() & F.col("world_key").isNotNull())
        .withColumn("actor_name", name)
        .withColumn("amount", default_amount(F.col("amount")))
        .withColumn("target", default_target(F.col("target")))
    )


def resolve_users(events: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per actor with its first-seen name and first/last sighting.

    With ``existing`` only actors that table lacks are returned. A plain
    aggregate: partial results per task, so a hot actor costs one row per task.
    """
    users = (
        events.withColumn("user_key", user_key())
        .groupBy("user_key")
        .agg(
            F.max("actor_uuid").alias("uuid"),
            F.min_by(
                F.coalesce(default_actor_name(F.col("actor_uuid"), F.col("actor_name")), F.lit("")),
                F.struct("ts", "id"),
            ).alias("name"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
        )
    )
    if existing is None:
        return users
    return users.join(existing.select("user_key").distinct(), "user_key", "left_anti")


def resolve_worlds(events: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    worlds = events.select(default_world(F.col("world_key")).alias("world_key")).distinct()
    if existing is None:
        return worlds
    return worlds.join(existing.select("world_key").distinct(), "world_key", "left_anti")


def with_dimensions(actions: DataFrame, users: DataFrame, worlds: DataFrame) -> DataFrame:
    """Facts with actor and world names in place of keys."""
    actors = users.select("user_id", F.col("uuid").alias("actor_uuid"), F.col("name").alias("actor_name"))
    return actions.join(actors, "user_id").join(worlds.select("world_id", "world_key"), "world_id")


def decode_type(actions: DataFrame) -> DataFrame:
    """Token (sign stripped), category and direction of each row's type."""
    return (
        actions.withColumn("action", F.ltrim(type_attribute("token"), F.lit("+-")))
        .withColumn("category", type_attribute("category"))
        .withColumn("direction", type_attribute("direction"))
    )
