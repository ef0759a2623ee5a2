"""Ranked lexical search of many queries at once, with shared work done once.

The items of a block are mined for term sets that they share: terms wanted by the same
items are one leaf, and pairs of nodes that stand together in several items become nodes
of their own. The nodes form a DAG whose roots are the items. For every slice of documents
one accumulator per node is filled, leaves from the postings and the others by adding two
rows, and an item's scores are the sum of the few nodes that are left of it.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import bound_batches, documents, free_name, running_total
from tracewell.llm.registry import query
from tracewell.session import checkpointed, scratch_folder

# Terms of the items that are answered together; what a task holds follows from it.
BLOCK_TERMS = 100_000
# Most shared nodes of an item among which pairs are looked for. Only the amount of
# sharing depends on it, no score does.
MINED = 64
# Bytes of the accumulators of one slice of documents.
SLICE_BYTES = 32 << 20
# Parts that an item's candidates are first ranked in.
LOTS = 64

# A term is a run of ASCII letters, digits and characters beyond ASCII; A-Z count as a-z.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order, with repeats."""
    return text.translate(_FOLD).split()


@dataclass
class Dag:
    """``leaf[t]``: the leaf of term t. ``pairs``: for each node after the leaves, the two
    nodes it adds up. ``items``: for each item, the nodes that make up its score."""

    leaf: np.ndarray
    leaves: int
    pairs: list[tuple[int, int]]
    items: list[list[int]]

    def additions(self) -> int:
        """Row additions per slice, with the sharing."""
        return len(self.pairs) + sum(max(0, len(nodes) - 1) for nodes in self.items)


def mine(wanted: list[set[int]], n_terms: int, mined: int = MINED) -> Dag:
    """The query-sharing DAG of items given as sets of term numbers."""
    users: dict[int, list[int]] = defaultdict(list)
    for item, numbers in enumerate(wanted):
        for t in numbers:
            users[t].append(item)
    by_users: dict[tuple[int, ...], int] = {}
    leaf = np.zeros(n_terms, np.int64)
    for t in sorted(users):
        leaf[t] = by_users.setdefault(tuple(users[t]), len(by_users))
    leaves = len(by_users)
    # node -> items that still list it
    standing: dict[int, set[int]] = {n: set(items) for items, n in by_users.items()}
    nodes: list[set[int]] = [set() for _ in wanted]
    for n, items in standing.items():
        for i in items:
            nodes[i].add(n)
    together: Counter = Counter()
    for listed in nodes:
        shared = sorted((n for n in listed if len(standing[n]) > 1), key=lambda n: (-len(standing[n]), n))
        top = sorted(shared[:mined])
        together.update((a, b) for k, a in enumerate(top) for b in top[k + 1 :])
    heap = [(-count, pair) for pair, count in together.items() if count > 1]
    heapq.heapify(heap)
    pairs: list[tuple[int, int]] = []
    while heap:
        count, (a, b) = heapq.heappop(heap)
        both = standing[a] & standing[b]
        if len(both) < 2:
            continue
        if len(both) < -count:  # out of date: back in line with what is left
            heapq.heappush(heap, (-len(both), (a, b)))
            continue
        new = leaves + len(pairs)
        pairs.append((a, b))
        standing[new] = both
        standing[a], standing[b] = standing[a] - both, standing[b] - both
        beside: Counter = Counter()
        for i in both:
            nodes[i] -= {a, b}
            beside.update(sorted((n for n in nodes[i] if len(standing[n]) > 1), key=lambda n: -len(standing[n]))[:mined])
            nodes[i].add(new)
        for other, n in beside.items():
            if n > 1:
                heapq.heappush(heap, (-n, (other, new)))
    return Dag(leaf, leaves, pairs, [sorted(n) for n in nodes])


def accumulate(dag: Dag, doc: np.ndarray, term: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
    """items x documents: the sums of ``value`` over each item's terms."""
    rows = np.empty((dag.leaves + len(dag.pairs), n_docs), np.int64)
    # Sums stay below 2**53, so adding them as doubles is exact.
    flat = np.bincount(dag.leaf[term] * n_docs + doc, weights=value, minlength=dag.leaves * n_docs)
    rows[: dag.leaves] = flat.reshape(dag.leaves, n_docs)
    for at, (a, b) in enumerate(dag.pairs):
        np.add(rows[a], rows[b], out=rows[dag.leaves + at])
    scores = np.zeros((len(dag.items), n_docs), np.int64)
    for item, nodes in enumerate(dag.items):
        for n in nodes:
            scores[item] += rows[n]
    return scores


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of every item. Rows that share an id are one
    item with the terms of all of them; a null text has none."""
    bound_batches(items.sparkSession)
    kind = items.schema["item_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms(t or b""))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"]
            )

    texts = items.select("item_id", F.col("text").cast("binary"))
    split_up = texts.mapInArrow(split, f"item_id {kind}, terms array<binary>")
    return split_up.select("item_id", F.explode("terms").alias("term")).distinct()


def query_blocks(items: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(block, item_id, terms): items in blocks of about ``block_terms`` terms."""
    grouped = item_terms(items).groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    grouped = checkpointed(grouped)
    sizes = grouped.select("item_id", F.size("terms").cast("long").alias("n"))
    placed = running_total(sizes, [F.col("item_id").asc_nulls_last()], {"before": "n"})
    blocks = placed.select(F.col("item_id").alias("i"), F.floor(F.col("before") / block_terms).alias("block"))
    return grouped.join(blocks, F.col("item_id").eqNullSafe(F.col("i"))).select("block", "item_id", "terms")


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs): for every document its number of terms, and which of the
    vocabulary it holds how often. One pass, no shuffle; whole texts."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    number = {t: i for i, t in enumerate(vocabulary)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.get
        for batch in batches:
            sizes, ids, tfs, ends = [], [], [], [0]
            for text in batch.column(1):
                found = terms(text.as_py() or b"")
                sizes.append(len(found))
                held = Counter(map(get, found))
                held.pop(None, None)
                ids.extend(held)
                tfs.extend(held.values())
                ends.append(len(ids))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64())),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    texts = docs.select("doc_id", F.col("text").cast("binary"))
    return texts.mapInArrow(count, f"doc_id {kind}, n bigint, terms array<int>, tfs array<bigint>")


def _ranked(dag: Dag, weights: np.ndarray, docs: int, words: int, k: int, item_ids: list):
    """Scores batches of postings and emits, per task, the best ``k`` of every item."""
    nodes = dag.leaves + len(dag.pairs) + len(dag.items) + 1
    step = max(1, SLICE_BYTES // (8 * nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.ones(len(dag.items), np.int64)
        kept = [np.empty(0, np.int64) for _ in range(3)]  # item, score, id
        kept.append(np.empty(0, bool))  # id is null

        def shrink() -> None:
            item, score, ids, absent = kept
            order = np.lexsort((ids, absent, -score, item))
            item = item[order]
            place = np.arange(len(item)) - np.searchsorted(item, item)
            order = order[place < k]
            full = place == k - 1
            floor[item[full]] = score[np.lexsort((ids, absent, -score, kept[0]))][full]
            kept[:] = [part[order] for part in kept]

        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                n_docs = part.num_rows
                lists = part.column(2)
                held = np.diff(lists.offsets.to_numpy())
                doc = np.repeat(np.arange(n_docs), held)
                term = lists.flatten().to_numpy()
                tf = part.column(3).flatten().to_numpy()
                # Whole numbers of any size, as the product may pass 64 bits.
                m = np.array([10 + 90 * n * docs // words for n in part.column(1).to_pylist()], np.int64)
                value = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                scores = accumulate(dag, doc, term, value, n_docs)
                item, d = np.nonzero(scores >= floor[:, None])
                ids = part.column(0)
                new = [item, scores[item, d], ids.fill_null(0).to_numpy()[d], ids.is_null().to_numpy(zero_copy_only=False)[d]]
                kept[:] = [np.concatenate(p) for p in zip(kept, new, strict=True)]
                if len(kept[0]) > 4 * k * len(dag.items):
                    shrink()
        shrink()
        item, score, ids, absent = kept
        yield pa.RecordBatch.from_arrays(
            [pa.array([item_ids[i] for i in item.tolist()], pa.int64()), pa.array(ids, pa.int64(), mask=absent), pa.array(score)],
            names=["item_id", "doc_id", "score"],
        )

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item.

    The weights and the score are whole numbers (see the README), so sums along any
    order of nodes agree. Documents without terms (null, empty) count nowhere and are
    never found; repeated rows are documents of their own; equal scores go by doc_id,
    null last. Items without terms, or whose terms no document holds, have no rows.

    Items are answered in blocks of bounded size, each with one pass over the texts; only
    an item block's terms and their document counts come to the driver. Each task keeps
    ``k`` rows per item, and an item's rows are ranked in ``LOTS`` parts first.
    """
    spark = docs.sparkSession
    blocks = checkpointed(query_blocks(items, block_terms))
    result = None
    for block in [r.block for r in blocks.select("block").distinct().orderBy("block").collect()]:
        rows = blocks.filter(F.col("block") == block).orderBy("item_id").select("item_id", "terms").collect()
        found = _search_block(spark, docs, [r.item_id for r in rows], [list(map(bytes, r.terms)) for r in rows], k)
        result = found if result is None else result.unionByName(found)
    if result is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return result


def _search_block(spark: SparkSession, docs: DataFrame, item_ids: list, wanted: list[list[bytes]], k: int) -> DataFrame:
    vocabulary = sorted({t for item in wanted for t in item})
    number = {t: i for i, t in enumerate(vocabulary)}
    folder = scratch_folder(spark, "postings")
    postings(docs, vocabulary).write.parquet(folder)
    table = spark.read.parquet(folder)
    with_terms = table.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, n_words = with_terms[0], with_terms[1]
    holding = np.zeros(len(vocabulary), np.int64)
    for r in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the vocabulary
        holding[r["t"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in holding], np.int64)
    dag = mine([{number[t] for t in item} for item in wanted], len(vocabulary))
    best = table.filter(F.size("terms") > 0).mapInArrow(
        _ranked(dag, weights, n_docs, n_words, k, item_ids), "item_id long, doc_id long, score long"
    )
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    lot, place = free_name(best, "lot"), free_name(best, "place")
    first = Window.partitionBy("item_id", lot).orderBy(*order)
    # The lot follows the document, so a retried task deals its rows as before.
    lots = best.withColumn(lot, F.pmod(F.xxhash64("doc_id"), F.lit(LOTS)))
    few = lots.withColumn(place, F.row_number().over(first)).filter(F.col(place) <= k).drop(place, lot)
    last = Window.partitionBy("item_id").orderBy(*order)
    ranked = few.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_SPLIT = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS ts FROM documents
), s AS (
  SELECT r, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0
), k AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM s
), q AS (
  SELECT DISTINCT item_id, unnest({_SPLIT}) AS term FROM benchmark
), p AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY r, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM p, k GROUP BY term
), a AS (
  SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN s USING (r), k
  GROUP BY item_id, r
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM a JOIN s USING (r) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""


@query("op11_search", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
