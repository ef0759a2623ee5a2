"""Hard negatives by exact inner product, found with an inverted multi-index.

Vectors are cut into halves, each with a codebook of its own; a cell holds the vectors of
one pair of codewords. For an anchor, no vector of a codeword scores more on its half than
the codeword itself plus the anchor's length times the codeword's radius. Cells are visited
from a heap by the sum of both halves' bounds, largest first, until what is wanted is
certified: no cell that is left can reach the last place of any window.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.registry import query
from tracewell.session import checkpointed, scratch_folder

# Codewords of a half, and vectors at most that they are learned from.
CODEWORDS = 16
SAMPLE = 20_000
# Vectors of a shard, which has cells of its own, and anchors that meet it together.
SHARD = 16_384
ANCHORS = 8_192
# Scaled components from here on leave a vector out: scores stay within 64 bits up to 2**11 components.
LARGEST = 1 << 26


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v): rows that take part, with whole components ``floor(scale * x)``.

    Left out are rows with a null label or vector, or with a component that is null, not
    finite or as large as ``LARGEST`` once scaled. A null vec_id takes part, but is no anchor.
    """
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LARGEST))
    return vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        scaled.cast("array<bigint>").alias("v"),
    )


def codebook(rows: np.ndarray, size: int, rounds: int = 8) -> np.ndarray:
    """At most ``size`` centres of ``rows`` (Lloyd's method from evenly spaced distinct rows)."""
    start = np.unique(rows, axis=0)
    centres = start[np.linspace(0, len(start) - 1, min(size, len(start))).astype(int)]
    for _ in range(rounds):
        mine = nearest(rows, centres)
        for c in range(len(centres)):
            if (mine == c).any():
                centres[c] = rows[mine == c].mean(0)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * rows @ centres.T, axis=1)


def learn_codebooks(vectors: DataFrame, size: int = CODEWORDS, sample: int = SAMPLE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Codebooks of both halves by number of components, from at most ``sample`` vectors
    (chosen by a hash). They decide the cost of a search, never its result; vectors of a
    length that the sample lacks share one cell."""
    chosen = vectors.orderBy(F.xxhash64("row"), "row").limit(sample).select("v").collect()
    by_length: dict[int, list] = {}
    for r in chosen:
        by_length.setdefault(len(r.v), []).append(r.v)
    books = {}
    for length, rows in by_length.items():
        table = np.array(rows, float).reshape(len(rows), length)
        books[length] = tuple(codebook(part, size) for part in (table[:, : length // 2], table[:, length // 2 :]))
    return books


@dataclass
class Index:
    """One shard: its vectors sorted by cell, and by codeword the radius."""

    vectors: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    cells: dict[tuple[int, int], tuple[int, int]]
    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]


# Orders a null id last.
NO_ID = np.iinfo(np.int64).max


def build(ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray, books) -> Index:
    half = vectors.shape[1] // 2
    parts = (vectors[:, :half], vectors[:, half:])
    if books is None:
        books = tuple(np.zeros((1, p.shape[1])) for p in parts)
    codes = [nearest(p, b) for p, b in zip(parts, books, strict=True)]
    radii = []
    for part, book, code in zip(parts, books, codes, strict=True):
        far = np.sqrt(((part - book[code]) ** 2).sum(1))
        radius = np.zeros(len(book))
        np.maximum.at(radius, code, far)
        radii.append(radius)
    order = np.lexsort((codes[1], codes[0]))
    first, second = codes[0][order], codes[1][order]
    cuts = np.flatnonzero((np.diff(first) != 0) | (np.diff(second) != 0)) + 1
    ends = [0, *cuts.tolist(), len(order)]
    cells = {(int(first[a]), int(second[a])): (a, b) for a, b in zip(ends[:-1], ends[1:], strict=True) if b > a}
    return Index(vectors[order], ids[order], rows[order], labels[order], cells, tuple(books), tuple(radii))


def visits(index: Index, anchor: np.ndarray) -> Iterator[tuple[float, float, int, int]]:
    """(bound, least, first, last) of the cells, by falling bound of their scores; ``least``
    is a lower bound. The multi-sequence walk: a cell enters the heap once both its
    predecessors along the sorted half bounds have left it."""
    half = len(anchor) // 2
    tops, spans = [], []
    for part, book, radius in zip((anchor[:half], anchor[half:]), index.books, index.radii, strict=True):
        score, reach = book @ part, radius * np.sqrt(part @ part)
        top = score + reach
        order = np.argsort(-top, kind="stable")
        tops.append((order, top[order]))
        spans.append(2 * reach)
    (order_a, top_a), (order_b, top_b) = tops
    # What rounding may have taken off a bound.
    slack = 1e-6 * (1 + abs(top_a).max(initial=0) + abs(top_b).max(initial=0))
    heap = [(-(top_a[0] + top_b[0]), 0, 0)]
    gone = np.full(len(order_a), -1)  # last column that left, by row
    while heap:
        bound, i, j = heapq.heappop(heap)
        gone[i] = j
        # Right neighbour: its upper neighbour must be gone; lower: its left one.
        if j + 1 < len(order_b) and (i == 0 or gone[i - 1] >= j + 1):
            heapq.heappush(heap, (-(top_a[i] + top_b[j + 1]), i, j + 1))
        if i + 1 < len(order_a) and gone[i + 1] == j - 1:
            heapq.heappush(heap, (-(top_a[i + 1] + top_b[j]), i + 1, j))
        a, b = int(order_a[i]), int(order_b[j])
        first, last = index.cells.get((a, b), (0, 0))
        yield -bound + slack, -bound - spans[0][a] - spans[1][b] - slack, first, last


def best_positives(index: Index, anchor_id: int, label: int, anchor: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(score, id, row) of the ``k`` best rows of the anchor's label in this shard."""
    found: list[tuple[int, int, int]] = []
    for bound, _, a, b in visits(index, anchor):
        if len(found) >= k and bound < found[k - 1][0]:
            break
        own = a + np.flatnonzero((index.labels[a:b] == label) & (index.ids[a:b] != anchor_id))
        if len(own):
            scores = (index.vectors[own] @ anchor).astype(np.int64)
            found += zip(scores.tolist(), index.ids[own].tolist(), index.rows[own].tolist(), strict=True)
            found = sorted(found, key=lambda r: (-r[0], r[1], r[2]))[:k]
    return found


def best_in_windows(
    index: Index, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int
) -> tuple[list[list[tuple[int, int]]], int]:
    """For each window (least, most score, both included) the ``k`` best (score, id) of
    another label in this shard, and the number of cells visited. A window is certified
    once no cell that is left reaches its least score or, with ``k`` found, its last one."""
    found: list[list[tuple[int, int]]] = [[] for _ in windows]
    visited = 0
    highest = max((most for _, most in windows), default=0)

    def open_(w: int, bound: float) -> bool:
        least = windows[w][0]
        return bound >= least and (len(found[w]) < k or bound >= found[w][k - 1][0])

    for bound, floor, a, b in visits(index, anchor):
        left = [w for w in range(len(windows)) if open_(w, bound)]
        if not left:
            break
        if floor > highest or a == b:
            continue
        visited += 1
        other = a + np.flatnonzero(index.labels[a:b] != label)
        scores = (index.vectors[other] @ anchor).astype(np.int64)
        for w in left:
            least, most = windows[w]
            if len(found[w]) >= k:
                least = max(least, found[w][k - 1][0])
            inside = np.flatnonzero((scores >= least) & (scores <= most))
            if len(inside):
                ids = index.ids[other[inside]]
                order = np.lexsort((ids, -scores[inside]))[:k]
                new = zip(scores[inside[order]].tolist(), ids[order].tolist(), strict=True)
                found[w] = sorted([*found[w], *new], key=lambda r: (-r[0], r[1]))[:k]
    return found, visited


def _index_of(table: pa.Table, books: dict) -> Index:
    """The index of a group of rows (vec_id, row, label, v), all of one length."""
    lists = table.column("v").combine_chunks()
    length = len(lists[0])
    # Doubles hold the whole components and, below 2**53, their products' sums exactly.
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    vectors = flat.reshape(len(lists), length)
    vectors = vectors.astype(float) if length * (int(np.abs(flat).max(initial=0)) ** 2) < 1 << 53 else vectors
    ids = table.column("vec_id").fill_null(NO_ID).to_numpy()
    return build(ids, table.column("row").to_numpy(), table.column("label").to_numpy(), vectors, books.get(length))


def _same_kind(anchor: list, index: Index) -> np.ndarray:
    """The anchor as doubles if all sums are exact that way, as whole numbers otherwise."""
    q = np.array(anchor, np.int64)
    if index.vectors.dtype.kind == "f":
        largest = int(np.abs(index.vectors).max(initial=0)) * int(np.abs(q).max(initial=0)) * max(1, len(q))
        if largest < 1 << 53:
            return q.astype(float)
        index.vectors = index.vectors.astype(np.int64)
    return q


def _id(value: int) -> int | None:
    return None if value == NO_ID else value


def _dealt(rows: DataFrame, anchors: DataFrame) -> tuple:
    """Index rows and anchors grouped so that every anchor block meets every shard of its length."""
    counts = rows.groupBy("length").agg(F.count("*").alias("n"))
    asked = anchors.groupBy("length").agg(F.count("*").alias("m"))
    # One row per length of vectors.
    sizes = checkpointed(counts.join(asked, "length").select(
        "length", F.ceil(F.col("n") / SHARD).cast("int").alias("shards"), F.ceil(F.col("m") / ANCHORS).cast("int").alias("blocks")
    ))
    shards = (
        rows.join(sizes, "length").withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("length", "shard", "block", "vec_id", "row", "label", "v")
    )
    blocks = (
        anchors.join(sizes, "length").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards", "blocks")
    )
    # New names' ids: anchors are usually rows of the index themselves.
    return shards, blocks.toDF(*blocks.columns)


def positives(rows: DataFrame, anchors: DataFrame, books: dict, k: int) -> DataFrame:
    """(anchor, number, positive_id, positive_score): the first ``k`` of each anchor (its row number)."""

    def find(index_rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if index_rows.num_rows:
            index = _index_of(index_rows, books)
            for r in asked.to_pylist():
                q = _same_kind(r["v"], index)
                out += [(r["row"], _id(i), row, s) for s, i, row in best_positives(index, r["vec_id"], r["label"], q, k)]
        names = ["anchor", "positive_id", "row", "positive_score"]
        return pa.table([pa.array([o[c] for o in out], pa.int64()) for c in range(4)], names=names)

    shards, blocks = _dealt(rows, anchors)
    keys = ["length", "shard", "block"]
    found = shards.groupBy(*keys).cogroup(blocks.select(*keys, "vec_id", "row", "label", "v").groupBy(*keys)).applyInArrow(
        find, "anchor long, positive_id long, row long, positive_score long"
    )
    order = Window.partitionBy("anchor").orderBy(
        F.col("positive_score").desc(), F.col("positive_id").asc_nulls_last(), "row"
    )
    numbered = found.withColumn("number", F.row_number().over(order)).filter(F.col("number") <= k)
    return numbered.select("anchor", "number", "positive_id", "positive_score")


def negatives(rows: DataFrame, asked: DataFrame, books: dict, k: int, low: int, high: int) -> DataFrame:
    """(anchor, number, rank, negative_id, negative_score); ``asked`` are anchors with their ``wanted`` positives."""

    def find(index_rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if index_rows.num_rows:
            index = _index_of(index_rows, books)
            for r in anchors.to_pylist():
                scores = [p["positive_score"] for p in r["wanted"]]
                windows = [(-(-low * s // 100), high * s // 100) for s in scores]
                q = _same_kind(r["v"], index)
                best, _ = best_in_windows(index, r["label"], q, windows, k)
                for p, found in zip(r["wanted"], best, strict=True):
                    out += [(r["row"], p["number"], _id(i), s) for s, i in found]
        names = ["anchor", "number", "negative_id", "negative_score"]
        return pa.table([pa.array([o[c] for o in out], pa.int64()) for c in range(4)], names=names)

    shards, blocks = _dealt(rows, asked)
    keys = ["length", "shard", "block"]
    found = shards.groupBy(*keys).cogroup(blocks.select(*keys, "row", "label", "v", "wanted").groupBy(*keys)).applyInArrow(
        find, "anchor long, number long, negative_id long, negative_score long"
    )
    order = Window.partitionBy("anchor", "number").orderBy(
        F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last()
    )
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` and ``anchors`` are rows (vec_id, row, label, v), ``row`` unique. For each
    anchor and each of its ``n_positives`` best rows of the same label, the ``n_negatives``
    best rows of another label whose score is between ``low`` and ``high`` per cent of the
    positive's. Equal scores go by id, null last. Rows with the anchor's vec_id are not its
    positives; rows whose vectors have another length never meet; repeated anchor rows
    each have their results.

    Every row is indexed and every result exact. A task holds one shard's index and one
    block of anchors; a shard gives at most the wanted number of rows per anchor.
    """
    books = learn_codebooks(vectors)
    rows = vectors.withColumn("length", F.size("v"))
    asked = anchors.withColumn("length", F.size("v"))
    chosen = checkpointed(positives(rows, asked, books, n_positives))
    wanted = chosen.groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("number", "positive_score"))).alias("wanted")  # at most n_positives
    )
    windows = asked.join(wanted, asked["row"] == wanted["anchor"]).drop("anchor")
    found = negatives(rows, windows, books, n_negatives, low, high)
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return found.join(chosen, ["anchor", "number"]).join(named, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


SQL = f"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(256 * x::DOUBLE) >= {LARGEST})) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, o.vec_id AS vec_id, a.label = o.label AS same,
         CAST(list_dot_product(a.v, o.v) AS BIGINT) AS score
  FROM e a JOIN e o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""


@query("op13_negatives", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    folder = scratch_folder(spark, "vectors")
    # Written once: row numbers must not change between the two searches.
    vectors.withColumn("label", moved).withColumn("row", F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.parquet(folder)
    return hard_negatives(rows, rows.filter(F.col("vec_id") % 100 == 0))
