"""Near-duplicate documents by SimHash, found with multi-index hashing.

A fingerprint is cut into segments. If two fingerprints differ in at most ``r``
bits, then in some segment i they differ in at most ``t_i`` bits, where the t_i
add up to r - m + 1 (m segments). So every fingerprint is filed once under the
value of each segment, the balls of radius t_i around its segments are
enumerated as probes, and what meets under a value is compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm import jaccard
from tracewell.llm.common import connected_groups, documents, free_name, per_text, text_of
from tracewell.llm.registry import query
from tracewell.session import broadcast_if_small, checkpointed

BITS = 64
# Home rows of a bucket that are compared in one piece; larger buckets are cut into blocks.
BLOCK = 4096
# Rows of a bucket up to which buckets are compared many at a time.
SMALL = 16
_STEP = 1 << 15


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles of a whole text, as a signed 64-bit number; 0 without words."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z only, six space characters
    n = len(words)
    if not n:
        return 0
    whole = b" ".join(words)
    if n <= shingle:
        pieces = [whole]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        pieces = [whole[a:b] for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, seed) for p in pieces), np.uint64, len(pieces))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _STEP):
        part = hashes[at : at + _STEP]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``fp`` (long); one pass, no shuffle."""

    def compute(texts: list[str]) -> list[pa.Array]:
        return [pa.array([fingerprint(t) for t in texts], pa.int64())]

    return per_text(docs, keep, compute, "fp long")


def plan_segments(rows: int, distance: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) per segment. More fingerprints want longer segments
    and so fewer of them; every plan finds all pairs, only the cost differs."""
    segments = 4 if rows <= 1 << 25 else 3 if rows <= 1 << 33 else 2
    if distance > 8 and rows <= 1 << 18:
        segments = 5  # wide balls are costly, short segments are not
    segments = max(1, min(segments, distance + 1))
    spare = distance - segments + 1
    bounds = [BITS * i // segments for i in range(segments + 1)]
    return [
        (a, b - a, spare // segments + (i < spare % segments))
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))
    ]


def _filed(fps: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """(bucket, probe, fp): one home row per segment and its ball without the centre as probes."""
    balls = [
        F.struct(
            F.lit(first).alias("first"), F.lit((1 << bits) - 1).cast("long").alias("mask"),
            F.lit(sum(1 << bit for bit in flipped)).cast("long").alias("turn"),
            F.lit(number).alias("number"), F.lit(size > 0).alias("probe"),
        )
        for number, (first, bits, radius) in enumerate(plan)
        for size in range(radius + 1)
        for flipped in combinations(range(bits), size)
    ]
    value = F.expr("shiftrightunsigned(fp, r.first)").bitwiseAND(F.col("r.mask")).bitwiseXOR(F.col("r.turn"))
    return fps.select("fp", F.explode(F.array(*balls)).alias("r")).select(
        (value * len(plan) + F.col("r.number")).alias("bucket"), F.col("r.probe").alias("probe"), "fp"
    )


def _forest(homes: np.ndarray, labels: np.ndarray, items: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Compares all homes with all items. ``labels`` of homes are merged in place;
    returned is, for each item with a link, one edge to a home of its group."""
    edges: list[tuple[int, int]] = []
    for at in range(0, len(items), 1024):
        part = items[at : at + 1024]
        h, i = np.nonzero(np.bitwise_count(homes[:, None] ^ part[None, :]) <= distance)
        if not len(h):
            continue
        while True:
            roots = labels[h]
            mine = np.full(len(part), len(homes), np.int64)
            np.minimum.at(mine, i, roots)
            if (mine[i] == roots).all():
                break
            np.minimum.at(labels, roots, mine[i])
            while (labels[labels] != labels).any():
                labels[:] = labels[labels]
        linked_items = np.flatnonzero(mine < len(homes))
        to = homes[mine[linked_items]]
        other = part[linked_items] != to
        edges += zip(part[linked_items][other].tolist(), to[other].tolist(), strict=True)
    return edges


def _linked_rows(place: np.ndarray, probe: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of small buckets, all at once: each row is compared with the one before it, with
    that before the last, and so on, ``place`` being its place in its bucket. A link of two
    rows is left out if a row between them is linked to both."""
    links: list[np.ndarray] = []
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for back in range(1, int(place.max(initial=0)) + 1):
        rows = np.flatnonzero(place >= back)
        rows = rows[~probe[rows - back]]
        rows = rows[np.bitwise_count(fp[rows] ^ fp[rows - back]) <= distance]
        mark = np.zeros(len(place), bool)
        mark[rows] = True
        for near in range(1, back):
            rows = rows[~(links[near - 1][rows] & links[back - near - 1][rows - near])]
        links.append(mark)
        found.append((fp[rows], fp[rows - back]))
    a, b = (np.concatenate([f[k] for f in found]) if found else fp[:0] for k in (0, 1))
    return a[a != b], b[a != b]


def _links(distance: int):
    """Streams rows sorted by (bucket, block, probe) and emits spanning edges of each
    bucket's links. Held at a time: the homes of one block and one batch of probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes, labels = None, [], None
        closed: np.ndarray | None = None

        def merged() -> list[tuple[int, int]]:
            if closed is None:
                return []
            roots = closed[labels]
            moved = np.flatnonzero(labels != np.arange(len(closed)))
            return list(zip(closed[moved].tolist(), roots[moved].tolist(), strict=True))

        def seal() -> list[tuple[int, int]]:
            nonlocal closed, labels
            if closed is not None or not homes:
                return []
            # Smallest first: the forest then points at the same nodes in every bucket.
            closed = np.unique(np.concatenate(homes).view(np.int64)).view(np.uint64)
            labels = np.arange(len(closed))
            return _forest(closed, labels, closed, distance) if len(closed) > 1 else []

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(0).to_numpy()
            block = batch.column(1).to_numpy()
            probe = batch.column(2).to_numpy(zero_copy_only=False)
            fp = batch.column(3).to_numpy().view(np.uint64)
            # Most buckets hold one row, which meets nobody; only rows at the ends of the
            # batch may belong to a bucket that goes on.
            alike = (np.diff(bucket) == 0) & (np.diff(block) == 0)
            some = np.concatenate([[True], alike]) | np.concatenate([alike, [True]])
            bucket, block, probe, fp = bucket[some], block[some], probe[some], fp[some]
            cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(block) != 0)) + 1
            edges: list[tuple[int, int]] = []
            starts, ends = np.append(0, cuts), np.append(cuts, len(bucket))
            # Buckets that begin and end in this batch and are small need no state.
            alone = ends - starts <= SMALL
            alone[0] &= (int(bucket[0]), int(block[0])) != key
            alone[-1] = False
            inside = np.repeat(alone, ends - starts)
            place = (np.arange(len(bucket)) - np.repeat(starts, ends - starts))[inside]
            yield _edges(np.stack(_linked_rows(place, probe[inside], fp[inside], distance), axis=1))
            for a, b in zip(starts[~alone].tolist(), ends[~alone].tolist(), strict=True):
                here = (int(bucket[a]), int(block[a]))
                if here != key:
                    edges += seal() + merged()
                    key, homes, labels, closed = here, [], None, None
                if probe[b - 1] and not probe[a]:
                    middle = a + int(np.argmax(probe[a:b]))
                else:
                    middle = a if probe[a] else b
                if middle > a:
                    homes.append(fp[a:middle].copy())
                if middle < b and homes:
                    edges += seal()
                    edges += _forest(closed, labels, fp[middle:b], distance)
            yield _edges(edges)
        yield _edges(seal() + merged())

    return run


def _edges(pairs: list[tuple[int, int]] | np.ndarray) -> pa.RecordBatch:
    both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def linked(fps: DataFrame, distance: int = 4, block: int = BLOCK, rows: int | None = None) -> DataFrame:
    """(a, b): edges among the distinct fingerprints ``fps`` (fp) whose connected groups
    are those of all pairs that differ in at most ``distance`` bits."""
    rows = fps.count() if rows is None else rows
    plan = plan_segments(rows, distance)
    return linked_within(_filed(fps, plan), distance, rows * len(plan), block)


def _crowded(homes: DataFrame, rows: int, block: int) -> DataFrame | None:
    """(bucket, blocks) of the buckets with more than ``block`` of about ``rows`` rows, or
    None. Cells of many buckets are counted first; only buckets of full cells are counted
    one by one."""
    cells = max(1, 2 * rows // block)
    cell = F.pmod(F.xxhash64("bucket"), F.lit(cells))
    full = checkpointed(homes.groupBy(cell.alias("cell")).count().filter(F.col("count") > block).select("cell"))
    if full.isEmpty():
        return None
    suspects = homes.withColumn("cell", cell).join(broadcast_if_small(full, 100_000), "cell", "left_semi")
    sizes = suspects.groupBy("bucket").count().filter(F.col("count") > block)
    hot = checkpointed(sizes.select("bucket", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    return None if hot.isEmpty() else hot


def linked_within(filed: DataFrame, distance: int, homes: int, block: int = BLOCK) -> DataFrame:
    """(a, b): edges whose connected groups are those of all pairs of ``filed`` (bucket,
    probe, fp) that meet in a bucket, not both as probes, and differ in at most
    ``distance`` bits. Rows may be repeated; about ``homes`` of them are no probes.

    All pairs are compared, but a dense bucket gives a spanning forest, not its
    pairs. A bucket of more than ``block`` homes is dealt out: homes into blocks by
    hash, and every home and probe also as a probe of the other blocks.
    """
    hot = _crowded(filed.filter(~F.col("probe")).select("bucket"), homes, block)
    if hot is None:
        dealt = filed.withColumn("block", F.lit(0))
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        dealt = (
            filed.join(broadcast_if_small(hot, 100_000), "bucket", "left")
            .withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            # A home meets the homes of blocks before its own there; probes meet all.
            .filter(F.col("probe") | (F.col("block") <= F.col("own")))
            .withColumn("probe", F.col("probe") | (F.col("block") < F.col("own")))
        )
    return (
        dealt.select("bucket", "block", "probe", "fp")
        .repartition("bucket", "block").sortWithinPartitions("bucket", "block", "probe")
        .mapInArrow(_links(distance), "a long, b long")
    )


def near_duplicates(docs: DataFrame, distance: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) of every row of ``docs``.

    ``component_id`` is the smallest id reachable over links, the row's own
    included; ids that are null count last, and a group without any id has a null
    one. ``root`` is the smallest fingerprint of the group. Texts without words
    (null, empty, blank) have fingerprint 0 and are linked like any other. Rows
    with equal fingerprints are one node, so copies cost nothing.
    """
    marked = checkpointed(
        with_fingerprints(
            docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), "text"), ["doc_id", "text_hash"]
        )
    )
    nodes = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = connected_groups(linked(nodes.select("fp"), distance))
    rooted = nodes.join(groups, nodes["fp"] == groups["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = checkpointed(rooted)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(ids, "root")
    return marked.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def set_fingerprints(sets: DataFrame) -> DataFrame:
    """(node, fp) of ``sets`` (node, tokens): the majority of the bits of distinct shingle hashes."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = []
            for tokens in batch.column(1).to_pylist():
                hashes = np.frombuffer(tokens, np.uint8).reshape(-1, 8)
                counts = np.zeros(BITS, np.int64)
                for at in range(0, len(hashes), _STEP):
                    counts += np.unpackbits(hashes[at : at + _STEP], axis=1, bitorder="little").sum(0, dtype=np.int64)
                fps.append(int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["node", "fp"])

    return sets.select("node", "tokens").mapInArrow(compute, "node long, fp long")


# At a similarity of 0.8 fingerprints differ in 9.7 of 64 bits on average, in 13 or fewer
# of 10 pairs in 9.
WIDE = 13


def similar_groups(docs: DataFrame, shingle: int = 5, percent: int = 80, distance: int = WIDE) -> DataFrame:
    """(doc_id, text_hash, group) of every row of ``docs``: near duplicates by the shingles
    of their words, copies included.

    Sets of which too few shingles stand in any other document are left out first. The
    balls of ``distance`` bits around the fingerprints of the others are met with the
    multi-index; what meets forms loose clusters, in which the sets themselves decide: rows
    are linked if 100 times the shingles they share is at least ``percent`` times those of
    both. Texts without words (null, empty, blank) are copies of each other.
    """
    rows, nodes, sets = jaccard.candidates(docs, shingle, percent)
    sets = sets.select("node", "n", "tokens", F.lit(0).cast("long").alias("cluster"))
    sets = checkpointed(jaccard.supported(sets, percent)).drop("cluster")
    fps = checkpointed(set_fingerprints(sets))
    loose = connected_groups(linked(fps.select("fp").distinct(), distance)).withColumnRenamed("node", "print")
    clustered = fps.join(loose, fps["fp"] == loose["print"], "left").select("node", F.coalesce("root", "fp").alias("cluster"))
    clustered = checkpointed(clustered)
    several = clustered.groupBy("cluster").count().filter("count > 1").select("cluster")
    edges = jaccard.links_within(sets, clustered.join(several, "cluster"), jaccard.frequency_classes(sets), percent)
    groups = connected_groups(edges).withColumnRenamed("node", "member")
    named = nodes.join(groups, nodes["node"] == groups["member"]).select("print_a", "print_b", "root")
    return rows.join(named, ["print_a", "print_b"], "left").select(
        "doc_id", "text_hash",
        F.struct(
            F.col("root").isNotNull().alias("linked"), F.coalesce("root", "print_a").alias("a"),
            F.when(F.col("root").isNull(), F.col("print_b")).alias("b"),
        ).alias("group"),
    )


def first_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, distance: int = WIDE) -> DataFrame:
    """One document of each group of ``similar_groups``, the one with the smallest id (null
    last; among equal ids the text of the smallest hash), with the columns of ``docs``,
    whatever they are called. Rows that repeat that document go too."""
    mark, place, winner, its_hash = (free_name(docs, n) for n in ("_text_hash", "_place", "_winner", "_winner_hash"))
    best = similar_groups(docs, shingle, percent, distance).groupBy("group").agg(F.min(jaccard.first_place()).alias("w"))
    winners = best.select(F.col("w.doc_id").alias(winner), F.col("w.text_hash").alias(its_hash))
    again = Window.partitionBy("doc_id", mark).orderBy("doc_id")
    return (
        docs.withColumn(mark, F.xxhash64(text_of()))
        .join(winners, F.col("doc_id").eqNullSafe(F.col(winner)) & (F.col(mark) == F.col(its_hash)), "left_semi")
        .withColumn(place, F.row_number().over(again)).filter(F.col(place) == 1)
        .select(*(F.col(f"`{c}`") for c in docs.columns))
    )


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
