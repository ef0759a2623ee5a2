"""Affected-block lists as rows, and back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.affected import any_affected_in_box, parse_affected, serialize_affected
from tracewell.operators.chains import greedy_chain
from tracewell.schema import EXPLOSION

# Entries looked at and characters joined per stored row.
MAX_ENTRIES, MAX_CHARS = 96, 3_800

# Entries per task and group when packing; any multiple of MAX_ENTRIES will do.
PACK_SEGMENT = 128 * MAX_ENTRIES


def explosions(actions: DataFrame) -> DataFrame:
    return actions.filter(F.col("type") == EXPLOSION)


def explode_affected(actions: DataFrame) -> DataFrame:
    """One row per affected block, with its place in the list."""
    return explosions(actions).select(
        "id", "ts", "world_key", F.posexplode(parse_affected(F.col("target"))).alias("pos", "e")
    ).select("id", "ts", "world_key", "pos", "e.x", "e.y", "e.z", "e.block", "e.meta", "e.payload")


def normalise_affected(actions: DataFrame) -> DataFrame:
    """Stored lists rewritten from their parsed form (malformed parts gone)."""
    return explosions(actions).select("id", serialize_affected(parse_affected(F.col("target"))).alias("target"))


def explosions_touching(
    actions: DataFrame, world: str, x: int, z: int, radius: int, y: int | None = None
) -> DataFrame:
    hit = any_affected_in_box(parse_affected(F.col("target")), x, z, radius, y)
    return explosions(actions).filter((F.col("world_key") == world) & hit)


def merge_sidecar(blocks: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Per-block overrides from a side table (id, x, y, z, meta, payload); a
    value there wins if it is set."""
    extra = sidecar.select("id", "x", "y", "z", F.col("meta").alias("_meta"), F.col("payload").alias("_payload"))
    return (
        blocks.join(extra, ["id", "x", "y", "z"], "left")
        .withColumn("meta", F.coalesce("_meta", "meta"))
        .withColumn("payload", F.coalesce("_payload", "payload"))
        .drop("_meta", "_payload")
    )


def _next_chunk(pdf: pd.DataFrame) -> np.ndarray:
    """Sequence number at which the chunk after one starting here begins."""
    size = pdf["size"].to_numpy(np.int64)  # text length + separator, 0 for an empty id
    index = np.arange(len(size))
    total = np.cumsum(size)
    before = total - size
    # First entry that would push the joined text over the limit.
    over = np.searchsorted(total, before + MAX_CHARS + 1, side="right")
    # An over-long first entry is taken all the same: the next filled one ends the chunk.
    filled = np.append(np.flatnonzero(size > 0), [len(size), len(size)])
    first = np.searchsorted(filled, index)
    over = np.maximum(over, filled[np.minimum(first + 1, len(filled) - 1)])
    seq = pdf["seq"].to_numpy(np.int64)
    ends = np.append(seq, seq[-1:] + MAX_ENTRIES)
    return np.minimum(seq + MAX_ENTRIES, ends[np.minimum(over, len(size))])


def _chunks(group: list[str]):
    """The chunks of a list that lies within one segment."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable").reset_index(drop=True)
        seq, following = pdf["seq"].to_numpy(np.int64), _next_chunk(pdf)
        found, at = [], 0
        while at < len(seq):
            end = int(np.searchsorted(seq, following[at], side="left"))
            texts = pdf["text"].iloc[at:end].dropna()
            if len(texts):
                found.append((int(seq[at]), ",".join(texts)))
            at = max(end, at + 1)
        chunks = pd.DataFrame(found, columns=["chunk", "target"])
        keys = pdf[group].iloc[[0] * len(chunks)].reset_index(drop=True)
        return pd.concat([keys, chunks], axis=1)

    return run


def pack_affected(blocks: DataFrame, group: list[str]) -> DataFrame:
    """Block rows to stored chunks: greedy, at most 96 entries and 3,800
    characters each; a first entry is always taken, entries without an id are
    left out but count towards the 96.

    ``blocks`` has the group columns, ``seq`` (its place in the list; a missing
    place counts like an entry without an id), x, y, z and block. Result: group, ``chunk`` (sequence number of its first entry)
    and ``target``.
    """
    named = F.col("block").isNotNull() & (F.col("block") != "")
    text = F.concat_ws(":", F.col("x").cast("string"), F.col("y").cast("string"), F.col("z").cast("string"))
    entries = blocks.select(
        *group, F.col("seq").cast("long").alias("seq"), F.when(named, F.concat(text, F.lit("="), "block")).alias("text")
    ).withColumn("size", F.coalesce(F.length("text") + 1, F.lit(0)).cast("long")).filter(F.col("seq").isNotNull())
    # Most lists lie within one segment: they need no chain, only one pass.
    part = F.floor(F.col("seq") / F.lit(PACK_SEGMENT))
    longer = entries.groupBy(*group).agg(F.min(part).alias("_from"), F.max(part).alias("_to"))
    longer = longer.filter(F.col("_from") != F.col("_to")).select(*group)
    types = {f.name: f.dataType for f in entries.schema.fields}
    out = T.StructType([
        *(T.StructField(g, types[g]) for g in group), T.StructField("chunk", T.LongType()), T.StructField("target", T.StringType()),
    ])
    short = entries.join(longer, group, "left_anti").groupBy(*group).applyInPandas(_chunks(group), out)
    cut = entries.join(longer, group, "left_semi")
    placed = greedy_chain(
        cut.select(*group, "seq", "size"),
        group, "seq", _next_chunk, segment=PACK_SEGMENT, reach=MAX_ENTRIES, lookahead=MAX_ENTRIES,
    )
    long = (
        cut.drop("size").join(placed, [*group, "seq"])
        .filter(F.col("text").isNotNull())
        .groupBy(*group, F.col("start").alias("chunk"))
        .agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("parts"))  # at most 96
        .select(*group, "chunk", F.array_join(F.col("parts.text"), ",").alias("target"))
    )
    return short.unionByName(long)
