"""N-gram Jaccard join with multiple global token orders.

If two sets have a Jaccard similarity of at least t, then under *any* order of all tokens
their prefixes share a token; prefixes lengthened by l - 1 tokens share at least l. Three
orders are used, one after the other, each on what the ones before have left:

1. by hash, over all documents: a document whose lengthened prefix shares too few tokens
   with other prefixes has no partner at all and is done; so is a distinct set of which too
   few tokens stand in any other that is left;
2. rare tokens first, over what is left: sets whose prefixes share a token are filed
   together, in clusters;
3. within a cluster, a pair is verified if its prefixes share a token under the rare
   order, under the hash order and under the hash order from its other end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import bound_batches, connected_groups, documents, running_total, text_of
from tracewell.llm.registry import query
from tracewell.session import broadcast_if_small, checkpointed, scratch_folder

SHINGLE = 5
# A similarity of PERCENT / 100; whole numbers keep the test exact.
PERCENT = 80
# Tokens that are grouped at a time. So few that nearly every shared token is a row of its
# own at any size: what is counted grows in proportion.
CHUNK = 1 << 16
# Counters of the rare order. More tokens than counters make it coarser, not wrong.
SLOTS = 1 << 20
COMMON = 8
# Tokens (and so many for each set besides) of a block of a cluster.
BLOCK = 1 << 20
_ROW = 512
_LONE = -1


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of a whole text: A-Z in lower case,
    words parted by the six space characters. With fewer words the whole sequence is one."""
    words = text.encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    whole = b" ".join(words)
    if n <= size:
        return np.array([xxhash.xxh3_64_intdigest(whole)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(whole[a:b]) for a, b in spans), np.uint64, n - size + 1))


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Tokens that a set of ``n`` shares with any set that is similar enough."""
    return -(-percent * n // 100)


def spare(n: int) -> int:
    """The l of a set's lengthened prefix."""
    return max(1, n // 10)


def prefix_length(n: int, more: int = 1, percent: int = PERCENT) -> int:
    return n - least_overlap(n, percent) + more


def _row_numbers() -> int:
    return TaskContext.get().partitionId() << 33


def _deal(tokens: np.ndarray, owners: np.ndarray, chunks: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(chunk, tokens, owners) of one batch. A token that several of the batch own is sent
    once, without owner, and so stays a few rows however many documents hold it; that it is
    shared is known already, and goes with a chunk below zero as (counts, owners)."""
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    again = np.zeros(len(tokens), bool)
    again[1:] = tokens[1:] == tokens[:-1]
    shared = again.copy()
    shared[:-1] |= again[1:]
    credited, credits = np.unique(owners[shared], return_counts=True)
    if len(credited):
        yield -1 - int(credited[0]) % (1 << 16), credits.astype(np.int64).tobytes(), credited.tobytes()
    tokens, owners = tokens[~again], np.where(shared, _LONE, owners)[~again]
    chunk = (tokens & np.uint64(chunks - 1)).astype(np.int64)
    order = np.argsort(chunk, kind="stable")
    chunk, tokens, owners = chunk[order], tokens[order], owners[order]
    cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield int(chunk[a]), tokens[a:b].tobytes(), owners[a:b].tobytes()


def _chunks(tokens: int) -> int:
    return 1 << (tokens // CHUNK).bit_length()


def _shared(dealt: DataFrame) -> DataFrame:
    """(row, shared) of what ``_deal`` gives."""
    sorted_ = dealt.repartition("chunk").sortWithinPartitions("chunk")
    return sorted_.mapInArrow(_credited, "row long, shared long").groupBy("row").agg(F.sum("shared").alias("shared"))


def _hashed(chunks: int, percent: int, size: int):
    """Per batch of (doc_id, text_hash, text): one row per document, and the tokens of the
    lengthened prefixes by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = _row_numbers()
        for batch in batches:
            n_docs = batch.num_rows
            sizes, prints, prefixes = np.zeros(n_docs, np.int32), [], []
            for i, text in enumerate(batch.column(2)):
                found = shingles(text.as_py(), size)
                sizes[i] = n = len(found)
                prints.append(xxhash.xxh3_128_digest(found.tobytes()))
                prefixes.append(found[: prefix_length(n, spare(n), percent)] if n else found)
            rows = np.arange(row, row + n_docs)
            row += n_docs
            two = np.frombuffer(b"".join(prints), "<i8").reshape(-1, 2)
            yield _table(
                kind=np.zeros(n_docs, np.int32), doc_id=batch.column(0), text_hash=batch.column(1), row=rows, n=sizes,
                print_a=two[:, 0], print_b=two[:, 1],
            )
            out = list(_deal(np.concatenate(prefixes), np.repeat(rows, [len(p) for p in prefixes]), chunks))
            if out:
                chunk, a, b = zip(*out, strict=True)
                yield _table(kind=np.ones(len(out), np.int32), chunk=np.array(chunk), tokens=a, owners=b)

    return run


_HASHED = "kind int, doc_id long, text_hash long, row long, n int, print_a long, print_b long, chunk long, tokens binary, owners binary"
_TYPES = {
    "kind": pa.int32(), "doc_id": pa.int64(), "text_hash": pa.int64(), "row": pa.int64(), "n": pa.int32(),
    "print_a": pa.int64(), "print_b": pa.int64(), "chunk": pa.int64(), "tokens": pa.binary(), "owners": pa.binary(),
}


def _table(**columns) -> pa.RecordBatch:
    rows = len(columns["kind"])
    arrays = [
        pa.nulls(rows, kind) if name not in columns
        else columns[name] if isinstance(columns[name], pa.Array) else pa.array(columns[name], kind)
        for name, kind in _TYPES.items()
    ]
    return pa.RecordBatch.from_arrays(arrays, names=list(_TYPES))


def _credited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams chunk rows sorted by chunk and emits (row, shared): how many of a document's
    tokens in the chunk others have too. Chunks below zero carry counts found before."""
    key, tokens, owners = None, [], []

    def closed() -> pa.RecordBatch:
        t, o = np.concatenate(tokens or [np.empty(0, np.uint64)]), np.concatenate(owners or [np.empty(0, np.int64)])
        order = np.argsort(t, kind="stable")
        t, o = t[order], o[order]
        again = t[1:] == t[:-1]
        shared = np.zeros(len(t), bool)
        shared[1:] |= again
        shared[:-1] |= again
        row, count = np.unique(o[shared & (o != _LONE)], return_counts=True)
        return _counts(row, count)

    for batch in batches:
        for chunk, t, o in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if chunk < 0:
                yield _counts(np.frombuffer(o, np.int64), np.frombuffer(t, np.int64))
                continue
            if chunk != key:
                yield closed()
                key, tokens, owners = chunk, [], []
            tokens.append(np.frombuffer(t, np.uint64))
            owners.append(np.frombuffer(o, np.int64))
    yield closed()


def _counts(rows: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(counts, pa.int64())], names=["row", "shared"])


def hashed(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(rows, candidates): one row per document (doc_id, text_hash, row, n, print_a,
    print_b), and the ``row`` of those that the first order leaves."""
    spark = docs.sparkSession
    bound_batches(spark)
    letters = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = _chunks(letters // 6 * (100 - percent + 10) // 100)
    keyed = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    folder = scratch_folder(spark, "shingles")
    keyed.mapInArrow(_hashed(chunks, percent, size), _HASHED).write.parquet(folder)
    table = spark.read.parquet(folder)
    rows = table.filter("kind = 0").select("doc_id", "text_hash", "row", "n", "print_a", "print_b")
    shared = _shared(table.filter("kind = 1").select("chunk", "tokens", "owners"))
    # A partner has at least ``smaller`` tokens, which bounds its spare from below.
    smaller = F.ceil(F.col("n") * percent / 100)
    needed = F.greatest(F.lit(1), F.floor(smaller / 10))
    left = rows.join(shared, "row").filter(F.col("shared") >= needed).select("row")
    return rows, left


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, n, tokens) of the sets of ``wanted`` (node, doc_id, text_hash)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, size) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(f) for f in found], pa.int32()), pa.array([f.tobytes() for f in found], pa.binary())],
                names=["node", "n", "tokens"],
            )

    keyed = docs.select("doc_id", F.xxhash64(text_of()).alias("h"), text_of().alias("text"))
    where = broadcast_if_small(wanted.select("node", F.col("doc_id").alias("i"), F.col("text_hash").alias("t")), 200_000)
    texts = keyed.join(where, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("t"))).select("node", "text")
    # Rows that share id and text are read once each; one is enough.
    return texts.mapInArrow(compute, "node long, n int, tokens binary").dropDuplicates(["node"])


def _mixed(tokens: np.ndarray, group: int) -> np.ndarray:
    """Tokens that are only equal within one group."""
    return tokens ^ np.uint64(xxhash.xxh64_intdigest(group.to_bytes(8, "little", signed=True)))


def supported(sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``sets`` (node, n, tokens, cluster) of which others in the cluster hold
    as many tokens, each alone or together, as a partner would."""
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    chunks = _chunks(total)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, groups = (batch.column(i).to_pylist() for i in (0, 1))
            found = [_mixed(np.frombuffer(t, np.uint64), g) for t, g in zip(batch.column(2).to_pylist(), groups, strict=True)]
            if not found:
                continue
            out = list(_deal(np.concatenate(found), np.repeat(np.array(nodes, np.int64), [len(f) for f in found]), chunks))
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)],
                names=["chunk", "tokens", "owners"],
            )

    dealt = sets.select("node", "cluster", "tokens").mapInArrow(deal, "chunk long, tokens binary, owners binary")
    shared = _shared(dealt)
    enough = sets.select("node", "n").join(shared, F.col("node") == F.col("row"))
    enough = enough.filter(100 * F.col("shared") >= percent * F.col("n")).select("node")
    return sets.join(enough, "node", "left_semi")


def frequency_classes(sets: DataFrame) -> np.ndarray:
    """For each of SLOTS hash slots the bit length of the number of tokens in it, 0 if it
    is not COMMON times as full as the mean: a table of fixed size that orders tokens from
    rare to common."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for tokens in batch.column(0).to_pylist():
                np.add.at(held, _slots(np.frombuffer(tokens, np.uint64)), 1)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at])], names=["slot", "held"])

    sums = sets.select("tokens").mapInArrow(count, "slot long, held long").groupBy("slot").agg(F.sum("held").alias("held"))
    sums = checkpointed(sums)
    total = sums.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    # Fewer than SLOTS / COMMON slots can hold that many times the mean.
    found = sums.filter(F.col("held") >= COMMON * (1 + total // SLOTS)).toArrow()
    classes = np.zeros(SLOTS, np.uint8)
    classes[found["slot"].to_numpy()] = np.frexp(found["held"].to_numpy().astype(float))[1]
    return classes


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(20)) & np.uint64(SLOTS - 1)


def rare_first(tokens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return tokens[np.lexsort((tokens, classes[_slots(tokens)]))]


def clusters(sets: DataFrame, order: Callable[[np.ndarray], np.ndarray], percent: int) -> DataFrame:
    """(node, cluster): ``sets`` (node, tokens, cluster) of a cluster joined by tokens that
    their prefixes under ``order`` share. Sets that share none are left out."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = []
            for group, tokens in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = np.frombuffer(tokens, np.uint64)
                heads.append(_mixed(order(found)[: prefix_length(len(found), 1, percent)], group))
            nodes = np.repeat(batch.column(0).to_numpy(), [len(h) for h in heads])
            flat = np.concatenate(heads).view(np.int64) if heads else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(nodes, pa.int64())], names=["token", "node"])

    filed = checkpointed(sets.select("node", "cluster", "tokens").mapInArrow(file, "token long, node long"))
    hubs = filed.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("token", "a")
    links = filed.join(hubs, "token").select("a", F.col("node").alias("b")).distinct()
    return connected_groups(links).select("node", F.col("root").alias("cluster"))


def overlaps(homes: list[np.ndarray], visitors: list[np.ndarray]) -> np.ndarray:
    """homes x visitors: the number of tokens that each pair shares. Tokens of many sets
    go through a matrix product, the others are matched one by one."""
    shape = (len(homes), len(visitors))
    ht, vt = np.concatenate(homes), np.concatenate(visitors)
    ho, vo = np.repeat(np.arange(shape[0]), [len(h) for h in homes]), np.repeat(np.arange(shape[1]), [len(v) for v in visitors])
    known = np.intersect1d(ht, vt)
    total = np.zeros(shape, np.float32)
    if not len(known):
        return total
    kept = []
    for tokens, owners in ((ht, ho), (vt, vo)):
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        fits = known[at] == tokens
        at, owners = at[fits], owners[fits]
        order = np.argsort(at, kind="stable")
        kept.append((at[order], owners[order]))
    (hk, ho), (vk, vo) = kept
    hc, vc = np.bincount(hk, minlength=len(known)), np.bincount(vk, minlength=len(known))
    dense = hc * vc > shape[0] * shape[1] / 50
    number = np.cumsum(dense) - 1
    for at in range(0, int(dense.sum()), 2048):
        part = []
        for keys, owners, rows in ((hk, ho, shape[0]), (vk, vo, shape[1])):
            mine = dense[keys] & (number[keys] >= at) & (number[keys] < at + 2048)
            matrix = np.zeros((rows, 2048), np.float32)
            matrix[owners[mine], number[keys[mine]] - at] = 1
            part.append(matrix)
        total += part[0] @ part[1].T
    # Every light token's visitors, once for each of its homes.
    light = ~dense[hk]
    keys, owners = hk[light], ho[light]
    first = np.cumsum(vc) - vc
    ends = np.cumsum(vc[keys])
    flat = np.zeros(shape[0] * shape[1], np.int64)
    start = 0
    while start < len(keys):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (1 << 22), side="right")))
        k, o = keys[start:stop], owners[start:stop]
        held = vc[k]
        at = np.repeat(first[k] - (np.cumsum(held) - held), held) + np.arange(int(held.sum()))
        flat += np.bincount(np.repeat(o, held) * shape[1] + vo[at], minlength=len(flat))
        start = stop
    return total + flat.reshape(shape)


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the smallest node that the links (a, b) connect it to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for x in (a, b):
            np.minimum.at(root, before[x], low)
        while (root[root] != root).any():
            root = root[root]
        if (root[a] == root[b]).all():
            return root


def similar_pairs(homes: list[np.ndarray], visitors: list[np.ndarray], classes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(i, j, verified): the pairs of a home and a visitor that are similar enough, and how
    many passed the filters of all three orders."""
    sizes = [np.array([len(s) for s in side]) for side in (homes, visitors)]
    small, large = np.minimum.outer(*sizes), np.maximum.outer(*sizes)
    passed = 100 * small >= percent * large
    for order in (lambda s: rare_first(s, classes), lambda s: s, lambda s: s[::-1]):
        if not passed.any():
            break
        heads = [[order(s)[: prefix_length(len(s), 1, percent)] for s in side] for side in (homes, visitors)]
        passed &= overlaps(*heads) > 0
    i, j = np.flatnonzero(passed.any(1)), np.flatnonzero(passed.any(0))
    if not len(i):
        return i, j, 0
    shared = overlaps([homes[x] for x in i], [visitors[x] for x in j]).astype(np.int64)
    union = sizes[0][i][:, None] + sizes[1][j][None, :] - shared
    a, b = np.nonzero((100 * shared >= percent * union) & passed[np.ix_(i, j)])
    return i[a], j[b], int(passed.sum())


def _verified(classes: np.ndarray, percent: int):
    """Streams rows sorted by (cluster, low, high, visitor) and emits spanning edges of the
    similar pairs. Held at a time: the sets of two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, nodes = None, ([], []), ([], [])

        def closed() -> pa.RecordBatch:
            homes, visitors = sides
            edges = np.empty((0, 2), np.int64)
            if homes and (visitors or key[1] == key[2] and len(homes) > 1):
                own = not visitors
                i, j, _ = similar_pairs(homes, homes if own else visitors, classes, percent)
                names = np.array(nodes[0] if own else nodes[0] + nodes[1], np.int64)
                root = spanning(i, j if own else j + len(homes), len(names))
                moved = np.flatnonzero(root != np.arange(len(names)))
                edges = np.stack([names[moved], names[root[moved]]], 1)
            return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

        for batch in batches:
            for cluster, low, high, visitor, node, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cluster, low, high) != key:
                    if key is not None:
                        yield closed()
                    key, sides, nodes = (cluster, low, high), ([], []), ([], [])
                sides[visitor].append(np.frombuffer(tokens, np.uint64))
                nodes[visitor].append(node)
        if key is not None:
            yield closed()

    return run


def linked_sets(sets: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(a, b): edges among the distinct ``sets`` (node, n, tokens) whose connected groups
    are those of all pairs with ``100 * shared >= percent * union``."""
    sets = checkpointed(supported(sets.select("node", "n", "tokens", F.lit(0).cast("long").alias("cluster")), percent))
    classes = frequency_classes(sets)
    found = clusters(sets, lambda tokens: rare_first(tokens, classes), percent)
    return links_within(sets, found, classes, percent, block)


def links_within(sets: DataFrame, found: DataFrame, classes: np.ndarray, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Spanning edges of the similar pairs of ``sets`` that are in one cluster of ``found``
    (node, cluster).

    A cluster is cut into blocks of bounded size along the sizes of its sets, and every
    two blocks that may hold similar sizes meet in one task.
    """
    members = sets.select("node", "n").join(found, "node")
    weighed = members.withColumn("weight", F.col("n").cast("long") + _ROW)
    order = [F.col("cluster").asc(), F.col("n").asc(), F.col("node").asc()]
    placed = running_total(weighed, order, {"before": "weight"}).withColumn("block", F.floor(F.col("before") / block))
    placed = checkpointed(placed.select("node", "cluster", "n", "block"))
    spans = checkpointed(placed.groupBy("cluster", "block").agg(F.min("n").alias("least"), F.max("n").alias("most")))
    low = spans.select("cluster", F.col("block").alias("low"), F.col("most").alias("low_most"))
    high = spans.select("cluster", F.col("block").alias("high"), F.col("least").alias("high_least"))
    meet = checkpointed(
        low.join(high, "cluster").filter("low <= high").filter(100 * F.col("low_most") >= percent * F.col("high_least"))
        .select("cluster", "low", "high")
    )
    rows = placed.select("node", "cluster", "block").join(sets.select("node", "tokens"), "node")
    homes = rows.join(meet.withColumn("block", F.col("low")), ["cluster", "block"]).withColumn("visitor", F.lit(0))
    visitors = rows.join(meet.filter("low < high").withColumn("block", F.col("high")), ["cluster", "block"]).withColumn("visitor", F.lit(1))
    names = ["cluster", "low", "high", "visitor", "node", "tokens"]
    return (
        homes.select(*names).unionByName(visitors.select(*names))
        .repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high", "visitor")
        .mapInArrow(_verified(classes, percent), "a long, b long")
    )


def candidates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, nodes, sets): one row per document, the distinct sets that the first order
    leaves (print_a, print_b, least, first, node), and their tokens (node, n, tokens)."""
    rows, left = hashed(docs, size, percent)
    nodes = checkpointed(
        rows.join(left, "row", "left_semi").groupBy("print_a", "print_b")
        .agg(F.min("doc_id").alias("least"), F.min(first_place()).alias("first"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    folder = scratch_folder(docs.sparkSession, "sets")
    _sets(docs, nodes.select("node", "first.doc_id", "first.text_hash"), size).write.parquet(folder)
    return rows, nodes, docs.sparkSession.read.parquet(folder)


def first_place() -> Column:
    """What orders rows: ids by value, null last, then texts by hash."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")


def similar_documents(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, n, root, component_id) of every row of ``docs``.

    ``n`` counts the distinct shingles of the whole text. Rows are linked if 100 times the
    shingles they share is at least ``percent`` times those of both; ``component_id`` is
    the smallest id reachable, null ids last, and null for a group without any id. A text
    without words (null, empty, blank) is linked with nothing, not even with its copies.
    Rows with equal sets are one node, so copies cost nothing; ``root`` names the group's
    smallest node and is null for rows that are linked with no other.
    """
    rows, nodes, sets = candidates(docs, size, percent)
    groups = connected_groups(linked_sets(sets, percent)).withColumnRenamed("node", "member")
    rooted = checkpointed(
        nodes.join(groups, nodes["node"] == groups["member"], "left")
        .select("print_a", "print_b", "least", F.coalesce("root", "node").alias("root"))
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("print_a", "print_b", "root").join(ids, "root")
    found = rows.join(named, ["print_a", "print_b"], "left")
    alone = F.col("root").isNull()
    return found.select(
        "doc_id", "text_hash", "n", "root", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS t
  FROM d
), k AS (
  SELECT t, min(r) AS node, min(doc_id) AS least FROM (SELECT r, doc_id, list_sort(t) AS t FROM s WHERE len(t) > 0) GROUP BY t
), x AS (
  SELECT node, len(t) AS n, unnest(t) AS token FROM k
), y AS (
  SELECT * FROM x WHERE token IN (SELECT token FROM x GROUP BY token HAVING count(*) > 1)
), l AS (
  SELECT a.node AS a, b.node AS b FROM y a JOIN y b ON a.token = b.token AND a.node <> b.node
  GROUP BY a.node, b.node HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), c(node, other) AS (
  SELECT node, node FROM k UNION SELECT c.node, l.b FROM c JOIN l ON c.other = l.a
), m AS (
  SELECT c.node, min(k.least) AS component_id FROM c JOIN k ON k.node = c.other GROUP BY c.node
)
SELECT s.doc_id, CAST(len(s.t) AS BIGINT) AS n_shingles,
       CASE WHEN len(s.t) = 0 THEN s.doc_id ELSE m.component_id END AS component_id
FROM s LEFT JOIN k ON k.t = list_sort(s.t) LEFT JOIN m ON m.node = k.node
"""


@query("op12_jaccard", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id"
    )
