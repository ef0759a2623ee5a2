"""Affected-block lists of explosions.

Stored form: ``x:y:z=id[|meta[|base64]]`` joined by commas. Parsed form:
``array<struct<x,y,z,block,meta,payload>>``; the base64 tail stays text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: one well-formed entry (position, id, optional meta and tail).
ENTRY_PATTERN = r"^\s*([^=:]*):([^=:]*):([^=:]*)=([^|]*)(?:\|([^|]*))?(?:\|(.*))?$"


def parse_affected(target: Column) -> Column:
    """Array of structs; malformed entries are dropped, order is kept."""

    def entry(raw: Column) -> Column:
        def part(i: int) -> Column:
            return F.regexp_extract(raw, ENTRY_PATTERN, i)

        def number(i: int) -> Column:
            return F.trim(part(i)).try_cast("int")

        return F.struct(
            number(1).alias("x"),
            number(2).alias("y"),
            number(3).alias("z"),
            F.trim(part(4)).alias("block"),
            F.nullif(part(5), F.lit("")).alias("meta"),
            F.nullif(F.trim(part(6)), F.lit("")).alias("payload"),
        )

    def usable(e: Column) -> Column:
        return e["x"].isNotNull() & e["y"].isNotNull() & e["z"].isNotNull() & (e["block"] != "")

    pieces = F.split(F.coalesce(target, F.lit("")), ",")
    trimmed = F.transform(pieces, lambda piece: F.trim(piece))
    return F.filter(F.transform(trimmed, entry), usable)


def serialize_affected(entries: Column) -> Column:
    """Stored form of a parsed list; the inverse of :func:`parse_affected`."""

    def text(e: Column) -> Column:
        position = F.concat_ws(":", e["x"].cast("string"), e["y"].cast("string"), e["z"].cast("string"))
        meta = F.coalesce(e["meta"], F.lit(""))
        tail = F.when(e["payload"].isNotNull(), F.concat(F.lit("|"), meta, F.lit("|"), e["payload"]))
        tail = tail.when(meta != "", F.concat(F.lit("|"), meta)).otherwise("")
        return F.concat(position, F.lit("="), e["block"], tail)

    return F.array_join(F.transform(entries, text), ",")


def any_affected_in_box(entries: Column, x: int, z: int, radius: int, y: int | None = None) -> Column:
    """Whether any affected block lies in the box; a negative radius has no
    bound and the height counts only if the centre has one."""
    if radius < 0:
        return F.lit(True)

    def inside(e: Column) -> Column:
        hit = e["x"].between(x - radius, x + radius) & e["z"].between(z - radius, z + radius)
        return hit if y is None else hit & e["y"].between(y - radius, y + radius)

    return F.exists(entries, inside)


def any_affected_is(entries: Column, ids: list[str]) -> Column:
    return F.exists(entries, lambda e: e["block"].isin(ids))
