"""Filters over facts. Every function returns a ``Column``; callers AND them.

The functions build plain comparisons on stored columns, so Catalyst pushes
them to the scan. :class:`ActionFilter` bundles the arguments of one lookup.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.affected import any_affected_in_box, any_affected_is, parse_affected
from tracewell.functions.timing import ts_lit
from tracewell.schema import ACTION_TYPES, ENTITY_CHANGE, EXPLOSION, type_is, types_in

# Names that stand for several types, and short world names.
TYPE_ALIASES = {"login": (12,), "logout": (13,), "inventory": (27, 28)}
WORLD_ALIASES = {
    "overworld": "minecraft:overworld",
    "nether": "minecraft:the_nether",
    "the_nether": "minecraft:the_nether",
    "end": "minecraft:the_end",
    "the_end": "minecraft:the_end",
}

# Beyond this many ids a join is cheaper than a literal list.
MAX_LITERAL_IDS = 1_000

EVERYWHERE = -1


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def any_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates)


def with_ids(df: DataFrame, ids: list[int] | DataFrame) -> DataFrame:
    """Rows with one of the given ids: a literal list while it is short, else a
    semi join on a distinct id table."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select("id").distinct(), "id", "left_semi")
    if len(ids) <= MAX_LITERAL_IDS:
        return df.filter(F.col("id").isin(list(ids)))
    table = df.sparkSession.createDataFrame([(i,) for i in set(ids)], "id long")
    return df.join(table, "id", "left_semi")


def by_users(names: list[str] = (), uuids: list[str] = ()) -> Column:
    """Any of the uuids, or any of the names; sentinel names (``#…``) are
    stored in lower case and matched so."""
    parts = []
    if uuids:
        parts.append(F.col("actor_uuid").isin([str(u) for u in uuids]))
    if names:
        parts.append(F.col("actor_name").isin([n.lower() if n.startswith("#") else n for n in names]))
    return any_of(parts)


def since(bound: datetime, day_column: str | None = None) -> Column:
    """Inclusive lower bound. Catalyst does not derive a partition bound from a
    bound on ``ts``, so pass the day column of a partitioned table."""
    predicate = F.col("ts") >= ts_lit(bound)
    if day_column:
        predicate = predicate & (F.col(day_column) >= F.lit(bound.date()))
    return predicate


def until(bound: datetime, day_column: str | None = None) -> Column:
    """Inclusive upper bound; see :func:`since` for ``day_column``."""
    predicate = F.col("ts") <= ts_lit(bound)
    if day_column:
        predicate = predicate & (F.col(day_column) <= F.lit(bound.date()))
    return predicate


def age_bounds(now: datetime, a: timedelta, b: timedelta | None = None) -> tuple[datetime, datetime | None]:
    """``a`` ago until now, or the range between two ages in either order. An
    age is cut to whole milliseconds and is at least one second."""
    def clean(age: timedelta) -> timedelta:
        whole = timedelta(milliseconds=age // timedelta(milliseconds=1))
        return max(whole, timedelta(seconds=1))

    if b is None:
        return now - clean(a), None
    older, newer = max(clean(a), clean(b)), min(clean(a), clean(b))
    return now - older, now - newer


def world_key(name: str) -> str:
    key = name.lower()
    return key if ":" in key else WORLD_ALIASES.get(key, key)


def in_world(name: str | None, default: str | None = None) -> Column:
    """One world; ``"#global"`` means all. The default applies only when no
    world was asked for."""
    chosen = name if name is not None else default
    if chosen is None or chosen == "#global":
        return F.lit(True)
    return F.col("world_key") == world_key(chosen)


def within_radius(x: int, z: int, radius: int, y: int | None = None) -> Column:
    """A box, not a sphere; the height counts only if the centre has one."""
    if radius < 0:
        return F.lit(True)
    parts = [F.col("x").between(x - radius, x + radius), F.col("z").between(z - radius, z + radius)]
    if y is not None:
        parts.append(F.col("y").between(y - radius, y + radius))
    return all_of(parts)


def within_box(box: tuple[int, int, int, int, int, int]) -> Column:
    """Inclusive box ``(min_x, min_y, min_z, max_x, max_y, max_z)``."""
    lo, hi = box[:3], box[3:]
    return all_of([F.col(c).between(a, b) for c, a, b in zip("xyz", lo, hi)])


def resolve_types(names: list[str | int]) -> list[int]:
    """Ids for ids, tokens (``+block``), families (``block``) and aliases."""
    tokens = {t.token: t.id for t in ACTION_TYPES}
    ids: list[int] = []
    for name in names:
        if isinstance(name, int):
            found = [name]
        else:
            key = name.lower()
            found = TYPE_ALIASES.get(key) or ([tokens[key]] if key in tokens else types_in(key))
            if not found:
                raise ValueError(f"unknown action {name!r}")
        ids += [i for i in found if i not in ids]
    return ids


def by_types(names: list[str | int]) -> Column:
    return type_is(resolve_types(names))


def by_family(category: str) -> Column:
    """All types of a category, as a literal list that reaches the scan."""
    return by_types([category])


def _listed_in_explosion(ids: list[str]) -> Column:
    """``LIKE '%=id,%' OR LIKE '%=id|%' OR LIKE '%=id'`` over all ids, as one
    pattern. "_" in an id stays a wildcard, as it is under LIKE; the exact form
    is :func:`include_exploded`."""
    wild = {"_": ".", "%": ".*"}
    alternatives = "|".join("".join(wild.get(c, re.escape(c)) for c in i) for i in ids)
    return F.col("target").rlike(rf"(?s)=(?:{alternatives})(?:[,|]|\z)")


def include_targets(ids: list[str]) -> Column:
    ids = list(ids)
    return (
        F.col("target").isin(ids)
        | ((F.col("type") == ENTITY_CHANGE) & F.col("meta").isin(ids))
        | ((F.col("type") == EXPLOSION) & _listed_in_explosion(ids))
    )


def exclude_targets(ids: list[str]) -> Column:
    """Three negated conjuncts under three-valued logic: an entity change
    without meta is neither in nor out, so it is dropped."""
    ids = list(ids)
    return (
        ~F.col("target").isin(ids)
        & ~((F.col("type") == ENTITY_CHANGE) & F.col("meta").isin(ids))
        & ~((F.col("type") == EXPLOSION) & _listed_in_explosion(ids))
    )


def include_exploded(ids: list[str]) -> Column:
    """Exact form of the explosion part of :func:`include_targets`."""
    return (F.col("type") == EXPLOSION) & any_affected_is(parse_affected(F.col("target")), list(ids))


def rolled_back_state(state: bool | None) -> Column:
    if state is None:
        return F.lit(True)
    return F.col("rolled_back") == int(state)


_ID_PART = re.compile(r"[A-Za-z0-9_./-]+")


def qualify_id(name: str) -> str:
    """Default namespace and lower case for a block or entity id."""
    namespace, colon, path = name.partition(":")
    if not colon:
        namespace, path = "minecraft", name
    if not _ID_PART.fullmatch(namespace) or not _ID_PART.fullmatch(path):
        raise ValueError(f"bad id {name!r}")
    return f"{namespace}:{path}".lower()


@dataclass(frozen=True)
class ActionFilter:
    """Arguments of one lookup, rollback or purge."""

    ids: tuple[int, ...] = ()
    names: tuple[str, ...] = ()
    uuids: tuple[str, ...] = ()
    since: datetime | None = None
    until: datetime | None = None
    world: str | None = None
    x: int | None = None
    y: int | None = None
    z: int | None = None
    radius: int | None = None
    box: tuple[int, int, int, int, int, int] | None = None
    types: tuple[str | int, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    rolled_back: bool | None = None
    day_column: str | None = field(default=None, compare=False)

    @property
    def has_centre(self) -> bool:
        return self.x is not None and self.z is not None

    @property
    def has_finite_radius(self) -> bool:
        return self.radius is not None and self.radius >= 0 and self.has_centre

    def type_ids(self) -> list[int]:
        return resolve_types(list(self.types))

    def admits(self, type_id: int) -> bool:
        return not self.types or type_id in self.type_ids()

    def but(self, **changes) -> ActionFilter:
        return replace(self, **changes)

    def spatial(self) -> list[Column]:
        parts = []
        if self.has_finite_radius:
            parts.append(within_radius(self.x, self.z, self.radius, self.y))
        if self.box is not None:
            parts.append(within_box(self.box))
        return parts

    def non_spatial(self) -> list[Column]:
        """Everything but position and type."""
        parts = []
        if self.names or self.uuids:
            parts.append(by_users(list(self.names), list(self.uuids)))
        if self.since is not None:
            parts.append(since(self.since, self.day_column))
        if self.until is not None:
            parts.append(until(self.until, self.day_column))
        if self.world is not None:
            parts.append(in_world(self.world))
        if self.include:
            parts.append(include_targets(list(self.include)))
        if self.exclude:
            parts.append(exclude_targets(list(self.exclude)))
        if self.rolled_back is not None:
            parts.append(rolled_back_state(self.rolled_back))
        return parts

    def stored_bounds(self) -> list[Column]:
        """What of this filter the columns of stored facts express: day, time, place, type,
        and world and users as their surrogates, so that all of it reaches the scan. A
        bound, not the filter: names that are looked up and other conditions are left
        to ``apply``."""
        parts = self.spatial()
        if self.since is not None:
            parts.append(since(self.since, "dt"))
        if self.until is not None:
            parts.append(until(self.until, "dt"))
        if self.types:
            parts.append(by_types(list(self.types)))
        if self.world is not None and self.world != "#global":
            parts.append(F.col("world_id") == F.xxhash64(F.lit(world_key(self.world))))
        if self.uuids and not self.names:
            parts.append(F.col("user_id").isin(*(F.xxhash64(F.lit(f"u:{u}")) for u in self.uuids)))
        return parts

    def _parts(self) -> list[Column]:
        parts = self.non_spatial() + self.spatial()
        return [*parts, by_types(list(self.types))] if self.types else parts

    def apply(self, df: DataFrame) -> DataFrame:
        parts = self._parts()
        out = df.filter(all_of(parts)) if parts else df
        return with_ids(out, list(self.ids)) if self.ids else out

    def condition(self) -> Column:
        """The whole filter as one predicate; null where it is unknown."""
        return all_of([*self._parts(), F.col("id").isin(list(self.ids))] if self.ids else self._parts())

    def widened_explosions(self, reach: int) -> Column:
        """Explosions centred outside the box but within ``reach`` of it, with
        an affected block inside it."""
        wide = within_radius(self.x, self.z, self.radius + reach, self.y)
        here = within_radius(self.x, self.z, self.radius, self.y)
        hit = any_affected_in_box(parse_affected(F.col("target")), self.x, self.z, self.radius, self.y)
        return (F.col("type") == EXPLOSION) & wide & ~here & hit

    def to_json(self) -> str:
        """What a batch keeps of the filter it was planned with."""
        shown = {
            k: (v.isoformat() if isinstance(v, datetime) else list(v) if isinstance(v, tuple) else v)
            for k, v in self.__dict__.items()
            if k != "day_column"
        }
        return json.dumps(shown, sort_keys=True)


def filter_from_json(text: str | None) -> ActionFilter:
    """The filter that a batch was planned with (see ``ActionFilter.to_json``)."""
    kept = json.loads(text) if text else {}
    times = {k: datetime.fromisoformat(kept[k]) for k in ("since", "until") if kept.get(k)}
    return ActionFilter(**{k: tuple(v) if isinstance(v, list) else v for k, v in kept.items()} | times)


def guard_radius(flt: ActionFilter, maximum: int) -> ActionFilter:
    if flt.radius is not None and flt.radius > maximum:
        raise ValueError(f"radius {flt.radius} is over the maximum {maximum}")
    return flt


def guard_time(flt: ActionFilter) -> ActionFilter:
    if flt.since is None and flt.until is None:
        raise ValueError("a rollback or restore needs a lower or upper time bound")
    return flt


# Fixed value: box around the caller when a rollback names no place.
DEFAULT_ROLLBACK_RADIUS = 10


def default_rollback_scope(flt: ActionFilter, caller: tuple[int, int, int]) -> ActionFilter:
    """Radius 10 around the caller unless a radius, world or box is given."""
    if flt.radius is not None or flt.world is not None or flt.box is not None:
        return flt
    return flt.but(x=caller[0], y=caller[1], z=caller[2], radius=DEFAULT_ROLLBACK_RADIUS)
