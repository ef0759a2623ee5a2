"""Language-model scores from a nested hierarchical Pitman-Yor model.

Every word before another one is a context with a restaurant of its own, and the word
restaurant is the parent of all of these: its customers are their tables. Its base
distribution spells words letter by letter: restaurants for the contexts of up to three
letters, each with the restaurant of the next shorter context as its parent. Word pairs
and words are spread over Spark by hash; the number of letter restaurants is bounded by
the alphabet. Seating is sampled by Gibbs, and predictive probabilities are averages over
samples.
"""

from __future__ import annotations

import functools
import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracewell.llm.common import bound_batches, documents, remainder, text_of
from tracewell.llm.registry import query
from tracewell.session import scratch_folder, shuffles_freed
from tracewell.sources.folders import drop

# Documents and bytes of a chunk: what one group of the scoring step holds.
CHUNK_ROWS, CHUNK_BYTES = 8192, 24 << 20
# Characters of text whose word pairs make a bucket: what one group of the seating holds.
BUCKET_CHARS = 16 << 20
# Documents whose word pairs are packed together, and answers that are.
BLOCK, ANSWERS = 512, 1 << 20
# Stands before and after a text; no word has a space.
END = b" "
# Strength of all restaurants; discounts are estimated from counts of counts.
STRENGTH = 1.0
BURN_IN, SAMPLES = 6, 4

# --- the alphabet: 66 symbols, so at most 66**4 letter contexts with a next letter ----
# 0 ends a word; letters; digits; signs; full stop; comma; control; first bytes of a
# longer character; its further bytes below A0, and one symbol for each from A0 on.
ALPHABET = 66
ORDER = 3


def _symbols() -> np.ndarray:
    table = np.full(256, 28, np.uint8)
    table[97:123] = np.arange(1, 27)
    table[48:58] = 27
    table[46], table[44] = 29, 30
    table[:32] = 31
    table[127] = 31
    table[128:160] = 33
    table[160:192] = np.arange(34, 66)
    table[192:] = 32
    return table


SYMBOL = _symbols()


def _laid_out(words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, symbol, byte, word) of every letter of all words, each closed by symbol 0."""
    lengths = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8) if len(words) else np.empty(0, np.uint8)
    owner = np.repeat(np.arange(len(words)), lengths + 1)
    starts = np.cumsum(lengths + 1) - lengths - 1
    place = np.arange(len(data)) - starts[owner]
    symbol = SYMBOL[data].astype(np.int64)
    closing = place == lengths[owner]
    symbol[closing] = 0
    context = np.zeros(len(data), np.int64)
    for back in range(ORDER, 0, -1):
        before = np.zeros(len(data), np.int64)
        before[back:] = symbol[:-back]
        before[place < back] = 0
        context = context * ALPHABET + before
    return context, symbol, np.where(closing, -1, data.astype(np.int64)), owner


# --- seating ------------------------------------------------------------------------


# Customers up to which the number of tables of a dish is drawn from its exact distribution,
# and cells of the weights that are looked at together.
EXACT, CELLS = 1024, 1 << 19


@functools.lru_cache(maxsize=8)
def _ways(discount: float) -> np.ndarray:
    """log of the generalised Stirling numbers: [c, t] weighs all ways to seat c customers
    at t tables, for up to ``EXACT`` customers."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, EXACT + 1)
    for c in range(1, EXACT):
        some = t[:c]
        out[c + 1, 1 : c + 1] = np.log(c - discount * some) + out[c, 1 : c + 1]
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c + 1, 1 : c + 2], out[c, : c + 1])
    return out


class Seating:
    """Tables of many dishes at once. A dish is a (restaurant, what is served) pair with
    ``customers``. Which customer sits where is summed out: every step is a Gibbs step
    that takes all customers of each dish off their tables and draws how many tables they
    take when seated again."""

    def __init__(self, customers: np.ndarray, discount: float, rng: np.random.Generator) -> None:
        self.customers, self.discount, self.rng = customers, discount, rng
        # About as many tables as a restaurant without a base would open.
        self._tables = np.clip(np.rint(customers.astype(float) ** discount), 1, customers).astype(np.int64)

    def tables(self) -> np.ndarray:
        return self._tables

    @property
    def dish(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.customers)), self._tables)

    @property
    def size(self) -> np.ndarray:
        """Customers of each table, spread evenly: the sizes are summed out."""
        dish, tables = self.dish, self._tables
        rank = np.arange(len(dish)) - (np.cumsum(tables) - tables)[dish]
        return self.customers[dish] // tables[dish] + (rank < self.customers[dish] % tables[dish])

    def now(self, customers: np.ndarray) -> None:
        """Other numbers of customers; tables stay as far as there are customers for them."""
        self.customers, self._tables = customers, np.clip(self._tables, 1, customers)

    def _drawn(self, weights: np.ndarray, each: np.ndarray) -> np.ndarray:
        """For every row a number of tables t, with log weights ``weights[t] + t * each``."""
        out = np.empty(len(each), np.int64)
        t = np.arange(1, len(weights))
        step = max(1, CELLS // len(t))
        for at in range(0, len(each), step):
            log = weights[1:] + t * each[at : at + step, None]
            total = np.cumsum(np.exp(log - log.max(1, keepdims=True)), 1)
            out[at : at + step] = 1 + (total[:, :-1] < self.rng.random(len(log))[:, None] * total[:, -1:]).sum(1)
        return out

    def step(self, opening: np.ndarray) -> None:
        """``opening``: for each dish the weight of a new table, (strength + discount *
        tables of the restaurant) * probability of the dish in the parent.

        t tables weigh opening**t times the ways to seat the customers at t tables. Beyond
        ``EXACT`` customers the first so many are drawn given that c come in all, and those
        who follow open a Poisson number of tables: each opens one with opening / n and it
        leaves less room for others, to first order in tables / customers.
        """
        c, d, ways, log = self.customers, self.discount, _ways(self.discount), np.log(opening)
        order = np.argsort(c, kind="stable")
        cuts = np.flatnonzero(np.diff(np.minimum(c[order], EXACT + 1))) + 1
        for group in np.split(order, cuts):
            if not len(group) or c[group[0]] < 2:
                self._tables[group] = c[group]
            elif c[group[0]] <= EXACT:
                n = int(c[group[0]])
                self._tables[group] = self._drawn(ways[n, : n + 1], log[group])
            else:
                share = (EXACT / c[group]) ** d
                later = np.minimum(opening[group] / d * (1 - share), c[group] - EXACT)
                first = self._drawn(ways[EXACT], log[group] + np.log(share))
                self._tables[group] = np.minimum(first + self.rng.poisson(later), c[group])


def discount_of(once: float, twice: float) -> float:
    """The usual estimate from the numbers of dishes with one and with two customers."""
    return float(np.clip(once / (once + 2 * twice), 0.05, 0.95)) if once + twice > 0 else 0.5


# --- the letter restaurants -----------------------------------------------------------


@dataclass
class Letters:
    """``row[context]`` is the row of ``log`` of the longest context seen; ``emit`` is the
    share of a byte among those of its symbol."""

    row: np.ndarray
    log: np.ndarray
    emit: np.ndarray

    def log10(self, words: list[bytes]) -> np.ndarray:
        context, symbol, byte, owner = _laid_out(words)
        each = self.log[self.row[context], symbol] + np.where(byte >= 0, self.emit[byte], 0.0)
        return np.bincount(owner, each, len(words))


def spell(grams: np.ndarray, weights: np.ndarray, bytes_: np.ndarray, seed: int = 1) -> Letters:
    """Gibbs over all letter restaurants. ``grams`` are codes of (context, letter) with
    their numbers of customers, ``bytes_`` the customers of each byte value."""
    rng = np.random.default_rng(seed)
    a = ALPHABET
    counts = [None] * (ORDER + 1)
    codes = [None] * (ORDER + 1)
    seats: list[Seating | None] = [None] * (ORDER + 1)
    codes[ORDER], counts[ORDER] = grams, weights.astype(np.int64)
    total = None
    order = np.argsort(codes[ORDER])
    codes[ORDER], counts[ORDER] = codes[ORDER][order], counts[ORDER][order]

    def parents(n: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the parents of level n's dishes, and where each dish's parent is."""
        return np.unique(codes[n] % a**n, return_inverse=True)

    # A level's tables are its parent level's customers.
    up: list[np.ndarray | None] = [None] * (ORDER + 1)
    for n in range(ORDER, -1, -1):
        d = discount_of(float((counts[n] == 1).sum()), float((counts[n] == 2).sum()))
        seats[n] = Seating(counts[n], d, rng)
        if n:
            codes[n - 1], up[n] = parents(n)
            counts[n - 1] = np.bincount(up[n], seats[n].tables(), len(codes[n - 1])).astype(np.int64)

    def probabilities() -> list[np.ndarray]:
        """For each level, the predictive probability of each of its dishes."""
        out: list[np.ndarray] = []
        for n in range(ORDER + 1):
            seat = seats[n]
            room, inside = np.unique(codes[n] // a, return_inverse=True)
            c, t = np.bincount(inside, seat.customers), np.bincount(inside, seat.tables())
            base = out[n - 1][up[n]] if n else np.full(len(codes[0]), 1 / a)
            own = seat.customers - seat.discount * seat.tables()
            out.append((own + (STRENGTH + seat.discount * t[inside]) * base) / (STRENGTH + c[inside]))
        return out

    def dense() -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each level the contexts seen and their whole rows of probabilities."""
        rooms: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        for n in range(ORDER + 1):
            seat = seats[n]
            room, inside = np.unique(codes[n] // a, return_inverse=True)
            t = seat.tables()
            c_room, t_room = np.bincount(inside, seat.customers), np.bincount(inside, t)
            if n:
                base = rows[n - 1][np.searchsorted(rooms[n - 1], room % a ** (n - 1))]
            else:
                base = np.full((len(room), a), 1 / a)
            table = base * ((STRENGTH + seat.discount * t_room) / (STRENGTH + c_room))[:, None]
            table[inside, codes[n] % a] += (seat.customers - seat.discount * t) / (STRENGTH + c_room[inside])
            rooms.append(room)
            rows.append(table)
        return rooms, rows

    for turn in range(BURN_IN + SAMPLES):
        for n in range(ORDER, -1, -1):
            p = probabilities()
            seat = seats[n]
            _, inside = np.unique(codes[n] // a, return_inverse=True)
            t = np.bincount(inside, seat.tables())
            base = p[n - 1][up[n]] if n else np.full(len(codes[0]), 1 / a)
            seat.step((STRENGTH + seat.discount * t[inside]) * base)
            if n:
                # The tables are the customers of the parent level, which is seated next.
                seats[n - 1].now(np.bincount(up[n], seat.tables(), len(codes[n - 1])).astype(np.int64))
        if turn >= BURN_IN:
            rooms, rows = dense()
            total = rows if total is None else [x + y for x, y in zip(total, rows, strict=True)]
    row = np.zeros(a**ORDER, np.int32)
    first = np.cumsum([0, *(len(r) for r in rooms)])
    for n in range(ORDER + 1):
        every = np.arange(a**ORDER) % a**n
        at = np.minimum(np.searchsorted(rooms[n], every), len(rooms[n]) - 1)
        seen = rooms[n][at] == every
        row[seen] = first[n] + at[seen]
    log = np.log10(np.concatenate(total) / SAMPLES).astype(np.float32)
    emit = np.zeros(256, np.float32)
    for s in range(1, a):
        of = np.flatnonzero(SYMBOL == s)
        emit[of] = np.log10((bytes_[of] + 1) / (bytes_[of].sum() + len(of)))
    return Letters(row, log, emit)


def uniform_letters() -> Letters:
    emit = np.array([-np.log10((SYMBOL == s).sum()) for s in SYMBOL], np.float32)
    return Letters(np.zeros(ALPHABET**ORDER, np.int32), np.full((1, ALPHABET), -np.log10(ALPHABET), np.float32), emit)


# --- counting ---------------------------------------------------------------------------

_CHUNKS = (
    "kind string, chunk int, doc_ids array<{id}>, held_out array<boolean>, train_docs int, n_words binary, at binary, times binary, "
    "first int, range int, words array<binary>, train array<int>, bucket int, numbers binary, pairs binary, counts binary"
)
_WORDS_PER_ROW = 1 << 16


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers by byte, the low ones of all first, compressed: high bytes are mostly 0."""
    values = np.ascontiguousarray(values, np.int64).view(np.uint64)
    width = (int(values.max(initial=0)).bit_length() + 7) // 8
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return len(values).to_bytes(4, "little") + bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    n, width = int.from_bytes(packed[:4], "little"), packed[4]
    out = np.zeros((n, 8), np.uint8)
    planes = pa.decompress(packed[5:], n * width, codec="zstd", asbytes=True)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.reshape(-1).view(np.int64)


def _packed_rising(values: np.ndarray) -> bytes:
    """For ``values`` that hardly ever fall: only what each adds is packed."""
    return _packed(np.diff(values, prepend=np.int64(0)))


def _unpacked_rising(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(packed))


def _hashes(words: list[bytes]) -> np.ndarray:
    """As Spark's xxhash64."""
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words)).view(np.int64)


def _ranges(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Which of so many equal ranges of the hashes, in their order."""
    return ((((hashes.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z in lower case, and how many each has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    there = pc.not_equal(words, "")  # white space at an end of a text leaves an empty one
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    return words.filter(there).cast(pa.binary()), np.bincount(owner[there.to_numpy(zero_copy_only=False)], minlength=len(texts))


def _numbered(words: DataFrame) -> DataFrame:
    """(id, word, c, keys) of the distinct ones of ``words`` (chunk, first, range, words, train).
    Ids follow the order of the hashes, as the numbers of a chunk do, and are dense within a range."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        lists = rows.column("words").combine_chunks()
        found = lists.flatten().dictionary_encode()
        every, of_word = found.dictionary, found.indices.to_numpy()
        by_hash = np.argsort(_hashes(every.to_pylist()), kind="stable")
        rank = np.empty(len(every), np.int64)
        rank[by_hash] = np.arange(len(every))
        of_word = rank[of_word]
        sizes = np.diff(lists.offsets.to_numpy())
        start = (rows.column("chunk").to_numpy().astype(np.int64) << 32) + rows.column("first").to_numpy()
        keys = np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(of_word))
        times = np.bincount(of_word, minlength=len(every))
        counts = np.bincount(of_word, rows.column("train").combine_chunks().flatten().to_numpy(), len(every))
        return pa.table({
            "id": (key[0].as_py() << 40) + np.arange(len(every)), "word": every.take(pa.array(by_hash)), "c": counts.astype(np.int64),
            "keys": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(times)).astype(np.int32)), pa.array(keys[np.argsort(of_word, kind="stable")])),
        })

    return words.groupBy("range").applyInArrow(run, "id long, word binary, c long, keys array<long>")


def _buckets(left: np.ndarray, right: np.ndarray, buckets: int) -> np.ndarray:
    mixed = left.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ right.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def _chunks(docs: DataFrame, held_out: Column, buckets: int) -> DataFrame:
    """By ``kind``: documents as numbers of word pairs of their chunk (at, times), the words of
    each chunk, and its pairs by bucket; words and pairs with how often training documents of
    the chunk have them (train, counts).

    Words are numbered in the order of their hashes, and a row has those of a range of these.
    A row of pairs has the numbers of its distinct words once; a pair is the place of its left
    word among these, times how many there are, plus that of the right one. A document's pair
    is its number among the pairs of the chunk, plus their number times the document's place
    in its row.
    """
    schema = StructType.fromDDL(_CHUNKS.format(id=dict(docs.dtypes)["doc_id"]))
    kinds = to_arrow_schema(schema)

    def batch(kind: str, **columns: pa.Array) -> pa.RecordBatch:
        n = len(columns["chunk"])
        columns["kind"] = pa.array([kind] * n)
        return pa.RecordBatch.from_arrays(
            [columns[k.name].cast(k.type) if k.name in columns else pa.nulls(n, k.type) for k in kinds], names=kinds.names
        )

    def chunk_rows(number: int, ids: list, held: list, texts: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        parts = [_split(part) for part in texts]
        sizes = np.concatenate([n for _, n in parts])
        found = pa.concat_arrays([words for words, _ in parts]).dictionary_encode()
        every = [END, *found.dictionary.to_pylist()]
        tokens = np.zeros(sizes.sum() + len(sizes), np.int32)
        inside = np.ones(len(tokens), bool)
        inside[np.cumsum(sizes + 1) - 1] = False
        tokens[inside] = found.indices.to_numpy() + 1
        del parts, found, inside
        hashes = _hashes(every)
        by_hash = np.argsort(hashes, kind="stable")
        rank = np.empty(len(every), np.int32)
        rank[by_hash] = np.arange(len(every))
        every, hashes = [every[i] for i in by_hash], hashes[by_hash]
        right = rank[tokens]
        del tokens
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
        train = ~np.array(held, bool)[owner]
        counts = np.bincount(right[train], minlength=len(every))
        # What stands before a text is what stands after the one before it: the end.
        codes = right.astype(np.int64)
        codes[1:] |= codes[:-1] << 32
        codes[0] |= int(rank[0]) << 32
        del right
        # By sorting once: np.unique keeps several copies more.
        order = np.argsort(codes)
        codes = codes[order]
        new = np.append(True, codes[1:] != codes[:-1])
        codes = codes[new]
        of_pair = np.empty(len(order), np.int32)
        of_pair[order] = np.cumsum(new, dtype=np.int32) - 1
        del order, new
        pair_counts = np.bincount(of_pair[train], minlength=len(codes)).astype(np.int32)
        left, right = (codes >> 32).astype(np.int32), (codes & 0xFFFFFFFF).astype(np.int32)
        some = (slice(at, at + CELLS) for at in range(0, len(codes), CELLS))
        bucket = np.concatenate([_buckets(hashes[left[x]], hashes[right[x]], buckets) for x in some])
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        left, right, pair_counts, bucket = left[order], right[order], pair_counts[order], bucket[order]
        placed = place[of_pair]
        ends = np.append(0, np.cumsum(sizes + 1))
        del codes, of_pair, order, place, train
        for first in range(0, len(sizes), BLOCK):
            some = slice(first, first + BLOCK)
            mine = slice(ends[first], ends[min(first + BLOCK, len(sizes))])
            used, times = np.unique((owner[mine] - first).astype(np.int64) * len(left) + placed[mine], return_counts=True)
            yield batch(
                "documents", chunk=pa.array([number]), doc_ids=pa.array([ids[some]], pa.list_(id_kind)), held_out=pa.array([held[some]]),
                train_docs=pa.array([held[some].count(False)]), n_words=pa.array([_packed(sizes[some])]),
                at=pa.array([_packed_rising(used)]), times=pa.array([_packed(times - 1)]),
            )
        of_range = _ranges(hashes, buckets)
        cuts = np.union1d(np.arange(0, len(every), _WORDS_PER_ROW), np.flatnonzero(np.diff(of_range)) + 1)
        for first, end in itertools.pairwise([*cuts.tolist(), len(every)]):
            yield batch(
                "words", chunk=pa.array([number]), first=pa.array([first]), range=pa.array([int(of_range[first])]),
                words=pa.array([every[first:end]], pa.list_(pa.binary())), train=pa.array([counts[first:end].astype(np.int32)], pa.list_(pa.int32())),
            )
        starts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        for at in range(0, len(starts) - 1, 64):
            rows = defaultdict(list)
            for a, b in itertools.pairwise(starts[at : at + 65].tolist()):
                numbers, which = np.unique(np.concatenate([left[a:b], right[a:b]]), return_inverse=True)
                for name, value in (
                    ("chunk", number), ("first", a), ("bucket", int(bucket[a])), ("numbers", _packed_rising(numbers)),
                    ("pairs", _packed_rising(which[: b - a] * len(numbers) + which[b - a :])), ("counts", _packed(pair_counts[a:b])),
                ):
                    rows[name].append(value)
            yield batch("pairs", **{name: pa.array(values) for name, values in rows.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 12
        ids, held, texts, held_bytes = [], [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids += part.column(0).to_pylist()
                held += part.column(1).to_pylist()
                texts.append(part.column(2))
                held_bytes += part.column(2).nbytes
                if len(ids) >= CHUNK_ROWS or held_bytes >= CHUNK_BYTES:
                    yield from chunk_rows(number, ids, held, texts)
                    number += 1
                    ids, held, texts, held_bytes = [], [], [], 0
        if texts:
            yield from chunk_rows(number, ids, held, texts)

    id_kind = kinds.field("doc_ids").type.value_type
    return docs.select("doc_id", held_out.alias("held"), text_of().alias("text")).mapInArrow(run, schema)


# --- the restaurants of contexts ----------------------------------------------------------


def _listed(rows: pa.Table, *names: str) -> Iterator[tuple]:
    return zip(*(rows.column(name).to_pylist() for name in names), strict=True)


def _pairs(packed: bytes, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The left and the right ones of ``words`` of the pairs of a row."""
    left, right = np.divmod(_unpacked_rising(packed), len(words))
    return words[left], words[right]


def _merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(left, right, customers) of the distinct pairs of a bucket, and for the pairs of each
    of its rows where they are among them."""
    found = [(*_pairs(pairs, _unpacked_rising(ids)), _unpacked(counts)) for ids, pairs, counts in _listed(rows, "ids", "pairs", "counts")]
    left, right, train = map(np.concatenate, zip(*found, strict=True))
    order = np.lexsort((right, left))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)
    where = np.empty(len(order), np.int64)
    where[order] = np.cumsum(new) - 1
    first = order[new]
    customers = np.bincount(where, train, len(first)).astype(np.int64)
    return left[first], right[first], customers, np.split(where, np.cumsum([len(x[0]) for x in found])[:-1])


def _per_word(left: np.ndarray, right: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, tables in its restaurant, tables that serve it) of the words of some pairs."""
    words, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    n = len(left)
    return words, np.bincount(at[:n], tables, len(words)), np.bincount(at[n:], tables, len(words))


def _answers(words: DataFrame, packs: dict[str, Callable[[np.ndarray], bytes]]) -> DataFrame:
    """Some columns of ``words`` (with keys) for the chunks that ask for them, each packed as
    ``packs`` says: (chunk, at, ...), at being the numbers of some of its words. Nothing moves:
    a partition answers to every chunk."""

    def packed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, *values = map(np.concatenate, zip(*held, strict=True))
        order = np.argsort(key)
        key, values = key[order], [v[order] for v in values]
        cuts = np.flatnonzero(np.diff(key >> 32)) + 1
        parts = list(itertools.pairwise([0, *cuts.tolist(), len(key)]))
        return pa.RecordBatch.from_arrays([
            pa.array([int(key[a]) >> 32 for a, _ in parts], pa.int32()),
            pa.array([_packed_rising(key[a:b] & 0xFFFFFFFF) for a, b in parts], pa.binary()),
            *(pa.array([pack(v[a:b]) for a, b in parts], pa.binary()) for v, pack in zip(values, packs.values(), strict=True)),
        ], names=["chunk", "at", *packs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            keys = batch.column(0)
            times = np.diff(keys.offsets.to_numpy())
            held.append((keys.flatten().to_numpy(), *(np.repeat(column.to_numpy(), times) for column in batch.columns[1:])))
            size += len(held[-1][0])
            if size >= ANSWERS:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    return words.select("keys", *packs).mapInArrow(run, ", ".join(["chunk int, at binary", *(f"{name} binary" for name in packs)]))


def _with_ids(pairs: DataFrame, told: DataFrame) -> DataFrame:
    """``pairs`` with the ids of their words, from ``told`` (chunk, at, id)."""

    def run(key, rows: pa.Table, found: pa.Table) -> pa.Table:
        parts = [(_unpacked_rising(at), _unpacked_rising(id_)) for at, id_ in _listed(found, "at", "id")]
        ids = np.zeros(sum(len(at) for at, _ in parts), np.int64)
        for at, id_ in parts:
            ids[at] = id_
        mine = [_packed_rising(ids[_unpacked_rising(numbers)]) for numbers, in _listed(rows, "numbers")]
        return rows.append_column("ids", pa.array(mine, pa.binary()))

    columns = ["chunk", "first", "bucket", "numbers", "pairs", "counts"]
    return pairs.select(*columns).groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(
        run, "chunk int, first int, bucket int, numbers binary, pairs binary, counts binary, ids binary"
    )


def _opened(pairs: DataFrame) -> DataFrame:
    """(bucket, id, inside, serving, asked, once, twice): for the words of a bucket their tables
    before any sampling, one for each pair, and whether a pair of theirs has more customers
    than one; and (id null) how many pairs have one and two customers."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        left, right, c, _ = _merged(rows)
        seen, many = c > 0, c > 1
        words, inside, serving = _per_word(left[seen], right[seen], np.ones(int(seen.sum())))
        asked = np.isin(words, np.concatenate([left[many], right[many]]))
        n = len(words)
        listed = lambda values, kind: pa.concat_arrays([pa.array(values).cast(kind), pa.nulls(1, kind)])
        return pa.table({
            "bucket": pa.array(np.full(n + 1, key[0].as_py(), np.int32)), "id": listed(words, pa.int64()),
            "inside": listed(inside.astype(np.int64), pa.int64()), "serving": listed(serving.astype(np.int64), pa.int64()),
            "asked": listed(asked, pa.bool_()),
            "once": pa.array([None] * n + [int((c == 1).sum())], pa.int64()), "twice": pa.array([None] * n + [int((c == 2).sum())], pa.int64()),
        })

    return pairs.select("bucket", "ids", "pairs", "counts").groupBy("bucket").applyInArrow(
        run, "bucket int, id long, inside long, serving long, asked boolean, once long, twice long"
    )


def _seated_pairs(pairs: DataFrame, known: DataFrame, discount: float, seed: int) -> DataFrame:
    """Seats the pairs of each bucket, given ``known`` (bucket, id, p, inside): log10 of the
    probability of each word in the parent, and the tables of its own restaurant. One
    customer takes one table whatever these are, so words of such pairs alone need not be known.

    Rows are (chunk, first, c, t): customers of the pairs of a row of ``pairs``, and the tables
    of those with more customers than one, summed over samples; and (id, inside, serving): how
    many tables more than one for each pair a word has in the bucket.
    """

    def run(key, rows: pa.Table, facts: pa.Table) -> pa.Table:
        left, right, c, where = _merged(rows)
        many = np.flatnonzero(c > 1)
        t = np.zeros(len(c), np.int64)
        if len(many):
            ids = facts.column("id").to_numpy()
            order = np.argsort(ids)
            find = lambda words, name: facts.column(name).to_numpy()[order[np.searchsorted(ids[order], words)]]
            opening = (STRENGTH + discount * find(left[many], "inside")) * 10 ** np.maximum(find(right[many], "p"), -300)
            seats = Seating(c[many], discount, np.random.default_rng([seed, key[0].as_py()]))
            for _ in range(SAMPLES):  # the weights stay, so each is a draw of its own
                seats.step(opening)
                t[many] += seats.tables()
        more = many[t[many] != SAMPLES]
        words, inside, serving = _per_word(left[more], right[more], t[more] / SAMPLES - 1)
        n, m = rows.num_rows, len(words)
        lead = lambda values, kind: pa.concat_arrays([pa.array(values, kind), pa.nulls(m, kind)])
        tail = lambda values, kind: pa.concat_arrays([pa.nulls(n, kind), pa.array(values, kind)])
        return pa.table({
            "chunk": lead(rows.column("chunk").to_pylist(), pa.int32()), "first": lead(rows.column("first").to_pylist(), pa.int32()),
            "c": lead([_packed(c[at]) for at in where], pa.binary()), "t": lead([_packed(t[at][c[at] > 1]) for at in where], pa.binary()),
            "id": tail(words, pa.int64()), "inside": tail(inside, pa.float64()), "serving": tail(serving, pa.float64()),
        })

    mine = pairs.select("bucket", "chunk", "first", "ids", "pairs", "counts")
    return mine.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(
        run, "chunk int, first int, c binary, t binary, id long, inside double, serving double"
    )


def _spelling_counts(words: DataFrame) -> DataFrame:
    """(gram, n) over ``words`` (word, t): letter grams weighted by tables; byte values
    are given as negative grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = batch.column(1).to_numpy().astype(np.float64)
            context, symbol, byte, owner = _laid_out(batch.column(0).to_pylist())
            codes = np.concatenate([context * ALPHABET + symbol, -1 - byte[byte >= 0]])
            each = np.concatenate([weight[owner], weight[owner[byte >= 0]]])
            distinct, inverse = np.unique(codes, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(distinct), pa.array(np.bincount(inverse, each, len(distinct)).astype(np.int64))],
                names=["gram", "n"],
            )

    return words.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _spelled(words: DataFrame, seed: int) -> Letters:
    """At most 66**4 + 256 counts come to the driver, however many words there are."""
    table = _spelling_counts(words).toArrow()
    gram, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
    letters = gram >= 0
    if not letters.any():
        return uniform_letters()
    bytes_ = np.zeros(256)
    bytes_[-1 - gram[~letters]] = n[~letters]
    return spell(gram[letters], n[letters], bytes_, seed)


def _seated(words: DataFrame, letters: Letters, discount: float, tables: float, end_share: float, seed: int) -> DataFrame:
    """``words`` (id, word, c, inside, k) with (t, base): the mean number of tables of the k
    customers of each over samples, and log10 of the base probability. Words of one batch are
    seated together; the restaurant's total of tables is that of the round before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            rng = np.random.default_rng([seed, part, number])
            words_, c = batch.column("word").to_pylist(), batch.column("k").to_numpy().astype(np.int64)
            base = letters.log10(words_) + np.log10(1 - end_share)
            base[[w == END for w in words_]] = np.log10(end_share)
            seated = np.flatnonzero(c > 0)
            t = np.zeros(len(c))
            seats = Seating(c[seated], discount, rng)
            opening = (STRENGTH + discount * tables) * 10 ** np.maximum(base[seated], -300)
            for _ in range(SAMPLES):  # the weights stay, so each is a draw of its own
                seats.step(opening)
                t[seated] += seats.tables() / SAMPLES
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t), pa.array(base)], names=[*batch.schema.names, "t", "base"])

    return words.select("id", "word", "c", "inside", "k").mapInArrow(
        run, "id long, word binary, c long, inside double, k long, t double, base double"
    )


def _covered(words: DataFrame, letters: Letters, share: float) -> float:
    """The base probability that falls on the known ``words`` (word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = share * 10 ** np.maximum(letters.log10(batch.column(0).to_pylist()), -300)
            yield pa.RecordBatch.from_arrays([pa.array([float(p.sum())])], names=["p"])

    return min(1 - 1e-9, words.select("word").mapInArrow(run, "p double").agg(F.sum("p")).first()[0] or 0.0)


# --- scores -----------------------------------------------------------------------------


def score(docs: DataFrame, held_out: Column | None = None, seed: int = 42) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and open_score
    of every row of ``docs`` (doc_id, text).

    Words that no training document has are one event for ``score``, as they are for
    ``base_score`` (its V + 1st type): the model's probability of opening a table for any
    word not known. ``open_score`` also spells them, letter by letter.

    Training documents are those for which ``held_out`` is false. A null or empty text is
    the end token alone. Without any training document every known count is 0 and the
    letters are uniform. Repeated rows count as documents of their own, as given.

    Words and pairs of words are counted per chunk of documents, so a frequent one is one
    row or item per chunk. Pairs meet in buckets by hash, whose number follows the text;
    the answers go back to the chunks. What many rows share is packed before it is moved or
    kept, and tables of a step are dropped when the next one is there.
    """
    with shuffles_freed(docs.sparkSession):
        return _scored(docs, held_out, seed)


def _scored(docs: DataFrame, held_out: Column | None, seed: int) -> DataFrame:
    spark = docs.sparkSession
    bound_batches(spark)
    held_out = F.lit(False) if held_out is None else held_out
    folder = scratch_folder(spark, "hpylm")

    def kept(table: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
        table.write.option("compression", "zstd").partitionBy(*by).parquet(f"{folder}/{name}")
        return spark.read.schema(table.schema).parquet(f"{folder}/{name}")

    chars = docs.agg(F.sum(F.length(text_of()).cast("long"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS))
    chunks = kept(_chunks(docs, held_out, buckets), "chunks", ["kind"])
    words = kept(_numbered(chunks.filter("kind = 'words'").select("chunk", "first", "range", "words", "train")), "words")
    facts = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    total, distinct = facts.n, facts.v
    ends = chunks.filter("kind = 'documents'").agg(F.sum("train_docs")).first()[0] or 0
    end_share = ends / total if total else 0.5

    pairs = kept(_with_ids(chunks.filter("kind = 'pairs'"), _answers(words, {"id": _packed_rising})), "pairs")
    for kind in ("pairs", "words"):
        drop(spark, f"{folder}/chunks/kind={kind}")
    opened = kept(_opened(pairs), "opened")
    pair_facts = opened.agg(F.sum("once").alias("once"), F.sum("twice").alias("twice")).first()
    pair_discount = discount_of(pair_facts.once or 0, pair_facts.twice or 0)

    def customers(of: DataFrame, tables: DataFrame, name: str) -> tuple[DataFrame, float]:
        """``of`` (id, word, c, inside, k) with the ``tables`` added: k those that serve each in the
        restaurants of contexts, and inside those of its own; and the discount of the word restaurant."""
        sums = tables.filter("id IS NOT NULL").groupBy("id").agg(F.sum("inside").alias("more"), F.sum("serving").alias("serving"))
        found = kept(of.select("id", "word", "c", "inside", "k").join(sums, "id", "left").select(
            "id", "word", "c", (F.col("inside") + F.coalesce("more", F.lit(0))).cast("double").alias("inside"),
            F.rint(F.col("k") + F.coalesce("serving", F.lit(0))).cast("long").alias("k"),
        ), name)
        rare = found.agg(F.count_if(F.col("k") == 1).alias("once"), F.count_if(F.col("k") == 2).alias("twice")).first()
        return found, discount_of(rare.once, rare.twice)

    def spelled(found: DataFrame, weight: Column, seed: int) -> Letters:
        return _spelled(found.filter((F.col("k") > 0) & (F.col("word") != F.lit(END))).select("word", weight.alias("t")), seed)

    def probabilities(found: DataFrame, letters: Letters, discount: float, tables: float, seed: int, name: str) -> tuple[DataFrame, float, float]:
        """``found`` with (t, p): log10 of the probability in the word restaurant; the weight of its base; its norm."""
        seated = kept(_seated(found, letters, discount, tables, end_share, seed), name)
        sums = seated.agg(F.sum("t").alias("t"), F.sum("k").alias("k")).first()
        new, norm = STRENGTH + discount * (sums.t or 0.0), STRENGTH + (sums.k or 0)
        log = F.log10((F.col("k") - discount * F.col("t") + F.lit(new) * F.pow(F.lit(10.0), "base")) / F.lit(norm))
        # A base below the range of doubles is added as a logarithm.
        log = F.when(F.col("k") > 0, log).otherwise(F.col("base") + F.lit(float(np.log10(new / norm))))
        return seated.withColumn("p", log), new, norm

    # Round one: every word type is spelled once, every pair has one table. Round two: words
    # are spelled as often as they have tables, pairs are seated. Round three: words again.
    none = F.lit(0).cast("long")
    found, discount = customers(words.withColumns({"inside": none, "k": none}), opened, "found")
    letters = spelled(found, F.lit(1).cast("long"), seed)
    tables = float(found.filter("k > 0").agg(F.sum(F.pow(F.col("k"), F.lit(discount)))).first()[0] or 0.0)
    first, new, _ = probabilities(found, letters, discount, tables, seed, "first")
    drop(spark, f"{folder}/found")
    heard = opened.filter("asked").select("bucket", "id").join(first.select("id", "p", "inside"), "id")
    seated_pairs = kept(_seated_pairs(pairs, heard, pair_discount, seed + 1), "seated")
    drop(spark, f"{folder}/opened")

    tables = (new - STRENGTH) / discount
    letters = spelled(first, F.greatest(F.rint("t").cast("long"), F.lit(1)), seed + 2)
    found, discount = customers(first, seated_pairs, "found_again")
    drop(spark, f"{folder}/first")
    last, new, norm = probabilities(found, letters, discount, tables, seed + 3, "last")
    drop(spark, f"{folder}/found_again")
    known = last.filter((F.col("c") > 0) & (F.col("word") != F.lit(END)))
    beyond = 1 - _covered(known, letters, 1 - end_share) - end_share * (ends > 0)
    unknown_log = float(np.log10(new / norm * max(beyond, 1e-9)))

    answers = kept(_answers(
        words.select("id", "keys").join(last.select("id", F.col("c").alias("word_c"), F.col("p").alias("word_p"), F.col("inside").alias("word_inside")), "id"),
        {
            "word_c": _packed, "word_p": lambda p: _packed(p.astype(np.float32).view(np.uint32)),
            "word_inside": lambda tables: _packed(np.rint(tables * SAMPLES)),
        },
    ), "answers")
    for name in ("words", "last"):
        drop(spark, f"{folder}/{name}")
    id_type = dict(docs.dtypes)["doc_id"]

    def run(key, rows: pa.Table, found: pa.Table) -> pa.Table:
        # Words: their numbers of the chunk, customers, probability and tables.
        word = [
            (_unpacked_rising(at), _unpacked(c), _unpacked(p).astype(np.uint32).view(np.float32), _unpacked(inside) / SAMPLES)
            for at, c, p, inside in _listed(found.filter(found.column("at").is_valid()), "at", "word_c", "word_p", "word_inside")
        ]
        size = sum(len(x[0]) for x in word)
        logs, counts, inside = np.zeros(size), np.zeros(size, np.int64), np.zeros(size)
        for at, c, p, tables in word:
            counts[at], logs[at], inside[at] = c, p, tables
        # Pairs: both words, and what the restaurant of the left one knows of the right one.
        in_order = lambda t: t.filter(t.column("first").is_valid()).sort_by("first")
        left, right = map(np.concatenate, zip(*(
            _pairs(packed, _unpacked_rising(numbers)) for packed, numbers in _listed(in_order(rows), "pairs", "numbers")
        ), strict=True))
        seats = list(_listed(in_order(found), "pair_c", "pair_t"))
        pair_c = np.concatenate([_unpacked(c) for c, _ in seats])
        pair_t = np.minimum(pair_c, 1).astype(float)
        pair_t[pair_c > 1] = np.concatenate([_unpacked(t) for _, t in seats]) / SAMPLES
        served = pair_c - pair_discount * pair_t
        fresh = np.log10((STRENGTH + pair_discount * inside) / (STRENGTH + counts))[left]
        seen = np.log10(np.maximum(served, 1e-300) / (STRENGTH + counts[left]))

        def given(word_logs: np.ndarray) -> np.ndarray:
            lower = fresh + word_logs[right]
            return np.where(served > 0, np.logaddexp(seen * np.log(10), lower * np.log(10)) / np.log(10), lower)

        base = np.log10((counts + 1) / (total + distinct + 1))
        values = [(counts > 0)[right], base[right], given(np.where(counts > 0, logs, unknown_log)), given(logs)]
        docs_ = rows.filter(rows.column("at").is_valid())
        n_words, sums = [], []
        for packed, at, times in _listed(docs_, "n_words", "at", "times"):
            n_words.append(_unpacked(packed))
            owner, flat = np.divmod(_unpacked_rising(at), len(left))
            often = _unpacked(times) + 1
            sums.append([np.bincount(owner, v[flat] * often, len(n_words[-1])) for v in values])
        n_words = np.concatenate(n_words)
        n_known, based, scored, spelled_ = map(np.concatenate, zip(*sums, strict=True))
        return pa.table({
            "doc_id": docs_.column("doc_ids").combine_chunks().flatten(), "held_out": docs_.column("held_out").combine_chunks().flatten(),
            "n_tokens": pa.array(n_words + 1), "n_known": pa.array(n_known.astype(np.int64)),
            "train_tokens": pa.array(np.full(len(n_words), total, np.int64)),
            "base_score": pa.array(based), "score": pa.array(scored), "open_score": pa.array(spelled_),
        })

    rows = chunks.filter("kind = 'documents'").select("chunk", "doc_ids", "held_out", "n_words", "at", "times").unionByName(
        pairs.select("chunk", "first", "numbers", "pairs"), allowMissingColumns=True
    )
    told = answers.unionByName(
        seated_pairs.filter("chunk IS NOT NULL").select("chunk", "first", F.col("c").alias("pair_c"), F.col("t").alias("pair_t")),
        allowMissingColumns=True,
    )
    return rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(
        run,
        f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
        "open_score double",
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity per token over documents, by ``held_out``."""
    return scored.groupBy("held_out").agg(
        F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"),
        F.pow(F.lit(10.0), -F.sum("base_score") / F.sum("n_tokens")).alias("base_perplexity"),
    )


@query("op8_hpylm")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), remainder("doc_id", 7) == 2)
