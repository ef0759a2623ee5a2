"""Best-fit packing of documents into token sequences by a grouping genetic algorithm.

Documents are tokenized and cut into pieces of at most one sequence. Pieces that
fill a sequence are done; the others are dealt out into shards of bounded size. In
each shard several islands evolve packings: a child takes over whole well-filled
bins of one parent, drops the other parent's bins that share a document with
them, and best-fits what was displaced. Elites move on to the next island.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import documents, per_text
from tracewell.llm.registry import query
from tracewell.session import checkpointed

LENGTH = 2048
VOCABULARY = "word_bpe_49k.json"
# Documents of a shard: what one task packs at a time.
SHARD = 4096
# Words, and pieces of words, whose ids a worker remembers before it starts anew. Each takes
# some 200 bytes, in two generations, and an executor has a worker for each of its cores.
REMEMBERED = 120_000


# How the tokenizer file cuts a lower-case word, and the signs that stand
# for bytes in its vocabulary (those without a sign of their own come after 255).
_CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# The same for words of printable ASCII signs.
_CUT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ a-z0-9]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_SIGNS = {**{b: chr(b) for b in _SHOWN}, **{b: chr(256 + n) for n, b in enumerate(_HIDDEN)}}
_BYTES = dict(_SIGNS)
# Words of these characters are cut here; others, and those that may hold the name of a
# special token, go through the whole tokenizer.
_COMMON = regex.compile(r"[!-~\u00c0-\u024f]+")


def _ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Known(dict):
    """What ``make`` gives for a word, remembered: at most ``REMEMBERED`` words, and those of the
    generation before, from which words asked for again are taken over."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make, self.before = make, {}

    def __missing__(self, word: str) -> bytes:
        found = self.before.get(word)
        if found is None:
            found = self.make(word)  # may ask for, and remember, parts of the word
        if len(self) >= REMEMBERED:
            self.before = {}  # before the copy: three generations are never held
            self.before = dict(self)
            self.clear()
        self[word] = found
        return found


class Encoder:
    """Ids of whole texts. The tokenizer drops white space and never joins across it, so
    ids are looked up word by word, and those of new words piece by piece: the
    tokenizer's model is asked only for pieces not seen lately."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.known, self.pieces = _Known(self._word), _Known(self._piece)

    def _piece(self, piece: str) -> bytes:
        signs = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)
        return _ids([t.id for t in self.tokenize(signs)])

    def _known_piece(self, piece: str) -> bytes:
        return self.known[piece] if piece.isascii() and piece.isalpha() else self.pieces[piece]

    def _word(self, word: str) -> bytes:
        if word.isascii():
            if word.isalpha():
                # A lower-case word is a piece itself, and remembered once.
                return self._piece(word) if word.islower() else self.known[word.lower()]
            plain = word.isprintable() and "<|" not in word
        else:
            plain = "<|" not in word and _COMMON.fullmatch(word)
        if not word:
            return b""
        if not plain:
            return _ids(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if not word.isascii():
            # Common signs are composed already, and lower-cased one by one in any word.
            word = word.lower()
            return self._piece(word) if word.isalpha() else b"".join([self._known_piece(p) for p in _CUT.findall(word)])
        return b"".join([self._known_piece(p) for p in _CUT_ASCII.findall(word.lower())])

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit numbers."""
        ids = self.known.__getitem__
        return [b"".join(map(ids, text.replace("\n", " ").replace("\t", " ").split(" "))) for text in texts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def pieces(
    docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end: int = 0, ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ``ids``) of every piece.

    A document is its ids and then ``end``; a null or empty text is ``end`` alone.
    ``vocabulary`` is the path of a tokenizer file that every executor has.
    """
    path = vocabulary or vocabulary_path()
    closing = np.array([end], "<u4").tobytes()

    def compute(texts: list[str]) -> list[pa.Array]:
        rows = []
        for found in encoder(path).encode(texts):
            whole = found + closing
            rows.append([
                {
                    "piece": k, "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part),
                    **({"ids": np.frombuffer(part, "<u4").astype(np.int32)} if ids else {}),
                }
                for k, at in enumerate(range(0, len(whole), 4 * length))
                for part in (whole[at : at + 4 * length],)
            ])
        kinds = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
        if ids:
            kinds.append(("ids", pa.list_(pa.int32())))
        return [pa.array(rows, pa.list_(pa.struct(kinds)))]

    struct = "piece:int,start:bigint,length:bigint,ids_crc32:bigint" + (",ids:array<int>" if ids else "")
    return per_text(docs, ["doc_id"], compute, f"p array<struct<{struct}>>").select("doc_id", F.inline("p"))


# --- one shard -----------------------------------------------------------------


class Packing:
    """Bins of item numbers, and what is free in each."""

    def __init__(self, sizes: np.ndarray, capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []

    def best_fit(self, items: list[int]) -> None:
        """Puts the items, in order, where they leave least; a set of bits says which
        amounts of free space exist, its lowest one above the size is the best fit."""
        spaces: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        exist = 0
        for number, free in enumerate(self.free):
            spaces[free].append(number)
            exist |= 1 << free
        for item in items:
            size = int(self.sizes[item])
            above = exist >> size
            if above:
                space = size + (above & -above).bit_length() - 1
                number = spaces[space].pop()
                if not spaces[space]:
                    exist &= ~(1 << space)
                self.bins[number].append(item)
            else:
                space, number = self.capacity, len(self.bins)
                self.bins.append([item])
                self.free.append(0)
            left = space - size
            self.free[number] = left
            spaces[left].append(number)
            exist |= 1 << left

    def fitness(self) -> tuple[int, float]:
        """Fewer bins, then fuller full ones (the mean square of the free space counts)."""
        free = np.array(self.free, float)
        return -len(self.bins), float((free**2).sum())

    def copy_without(self, dropped: set[int]) -> Packing:
        out = Packing(self.sizes, self.capacity)
        for number, (content, free) in enumerate(zip(self.bins, self.free, strict=True)):
            if number not in dropped:
                out.bins.append(list(content))
                out.free.append(free)
        return out

    def assignment(self) -> np.ndarray:
        out = np.empty(len(self.sizes), np.int32)
        for number, content in enumerate(self.bins):
            out[content] = number
        return out

    @classmethod
    def of(cls, sizes: np.ndarray, capacity: int, assignment: np.ndarray) -> Packing:
        out = cls(sizes, capacity)
        out.bins = [[] for _ in range(int(assignment.max()) + 1 if len(assignment) else 0)]
        for item, number in enumerate(assignment.tolist()):
            out.bins[number].append(item)
        out.free = [capacity - int(sizes[b].sum()) for b in out.bins]
        return out


def crossover(giver: Packing, taker: Packing, rng: np.random.Generator) -> Packing:
    """The taker with some of the giver's fullest bins put in whole."""
    count = len(giver.bins)
    fullest = np.argsort(giver.free, kind="stable")[: max(1, count // 2)]
    chosen = rng.choice(fullest, size=max(1, len(fullest) // 3), replace=False)
    injected = [giver.bins[k] for k in chosen.tolist()]
    inside = {i for content in injected for i in content}
    owner = taker.assignment()
    hit = {int(owner[i]) for i in inside}
    # The emptiest bins go as well, so that their documents find better places.
    emptiest = np.argsort(taker.free, kind="stable")[::-1][: 1 + int(rng.integers(0, 4))]
    hit.update(int(k) for k in emptiest)
    child = taker.copy_without(hit)
    displaced = [i for k in hit for i in taker.bins[k] if i not in inside]
    for k, content in zip(chosen.tolist(), injected, strict=True):
        child.bins.append(list(content))
        child.free.append(giver.free[k])
    displaced.sort(key=lambda i: (-int(giver.sizes[i]), i))
    child.best_fit(displaced)
    return child


def evolve(
    sizes: np.ndarray, capacity: int, seed: int, elites: list[np.ndarray] = (), population: int = 4, generations: int = 8
) -> Packing:
    """The best packing an island finds; stops at the lower bound on the number of bins."""
    rng = np.random.default_rng(seed)
    bound = -(-int(sizes.sum()) // capacity)
    pool = [Packing.of(sizes, capacity, e) for e in elites]
    order = np.argsort(-sizes, kind="stable")
    while len(pool) < population:
        start = Packing(sizes, capacity)
        # The first is best-fit decreasing; the others decrease only roughly.
        noise = rng.normal(0, capacity / 40, len(sizes)) if pool else 0
        start.best_fit(np.argsort(-(sizes + noise), kind="stable").tolist() if pool else order.tolist())
        pool.append(start)
        if len(start.bins) <= bound:
            return start
    pool.sort(key=Packing.fitness, reverse=True)
    for _ in range(generations):
        if len(pool[0].bins) <= bound:
            break
        a, b = rng.choice(len(pool), 2, replace=False)
        child = crossover(pool[int(min(a, b))], pool[int(max(a, b))], rng)
        if child.fitness() > pool[-1].fitness():
            pool[-1] = child
            pool.sort(key=Packing.fitness, reverse=True)
    return pool[0]


def _island(capacity: int, seed: int) -> Callable:
    """(key, items, elites) of one shard and island -> its elite."""

    def run(key, items: pa.Table, elites: pa.Table) -> pa.Table:
        shard, island = (k.as_py() for k in key)
        order = np.argsort(items.column("item").to_numpy(), kind="stable")
        sizes = items.column("length").to_numpy()[order]
        brought = [np.array(a, np.int32) for a in elites.column("bins").to_pylist()]
        best = evolve(sizes, capacity, hash((seed, shard, island, len(brought))) % 2**32, brought)
        bound = -(-int(sizes.sum()) // capacity)
        return pa.table({
            "shard": pa.array([shard], pa.int32()), "island": pa.array([island], pa.int32()),
            "count": pa.array([len(best.bins)], pa.int32()), "spare": pa.array([len(best.bins) - bound], pa.int32()),
            "rank": pa.array([best.fitness()[1]]),
            "bins": pa.array([best.assignment().tolist()], pa.list_(pa.int32())),
        })

    return run


_ELITE = "shard int, island int, count int, spare int, rank double, bins array<int>"


def _packed(items: DataFrame, capacity: int, islands: int, epochs: int, seed: int) -> DataFrame:
    """(item, shard, bin) for ``items`` (item, length), all shorter than the capacity."""
    shards = max(1, -(-items.count() // SHARD))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int"))
    spread = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    spark = items.sparkSession
    elites = spark.createDataFrame([], _ELITE)
    best = F.min_by("bins", F.struct(F.col("count"), -F.col("rank"), F.col("island")))
    run = _island(capacity, seed)
    for epoch in range(epochs):
        if epoch:
            # Shards at the lower bound are done; in the others every island sends its
            # elite to the next one and keeps its own.
            open_shards = elites.groupBy("shard").agg(F.min("spare").alias("s")).filter("s > 0").select("shard")
            kept = elites.join(open_shards, "shard", "left_anti")
            moving = elites.join(open_shards, "shard", "left_semi")
            sent = moving.withColumn("island", (F.col("island") + 1) % islands)
            todo, brought = spread.join(open_shards, "shard", "left_semi"), moving.unionByName(sent)
            if moving.isEmpty():
                break
        else:
            todo, brought, kept = spread, elites, elites
        found = (
            todo.groupBy("shard", "island").cogroup(brought.groupBy("shard", "island")).applyInArrow(run, _ELITE)
        )
        elites = checkpointed(kept.unionByName(found))
    winners = elites.groupBy("shard").agg(best.alias("bins"))

    def spelled(key, part: pa.Table, winner: pa.Table) -> pa.Table:
        numbers = part.column("item").to_numpy()
        order = np.argsort(numbers, kind="stable")
        return pa.table({
            "item": pa.array(numbers[order]), "length": pa.array(part.column("length").to_numpy()[order]),
            "shard": pa.array(np.full(len(order), key[0].as_py(), np.int32)),
            "bin": winner.column("bins").chunk(0).values.cast(pa.int32()),
        })

    return dealt.groupBy("shard").cogroup(winners.groupBy("shard")).applyInArrow(
        spelled, "item long, length long, shard int, bin int"
    )


def pack(
    docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end: int = 0, islands: int = 3,
    epochs: int = 3, seed: int = 42,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Only documents of more than ``length`` ids are cut. Pieces of a full sequence
    have one of their own; the rest is packed per shard, and what lies in bins that
    are less than nine tenths full is packed once more across shards. Repeated rows
    are packed as often as they occur; ids may be null; other columns are not read.
    """
    cut = checkpointed(
        pieces(docs, vocabulary, length, end).withColumn("item", F.monotonically_increasing_id())
    )
    loose = cut.filter(F.col("length") < length).select("item", "length")
    first = checkpointed(_packed(loose, length, islands, epochs, seed))
    fill = first.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
    slack = fill.filter(F.col("fill") < 0.9 * length).select("shard", "bin")
    again = checkpointed(first.join(slack, ["shard", "bin"], "left_semi").select("item", "length"))
    second = _packed(again, length, islands, epochs, seed + 1)
    numbered = (
        first.join(slack, ["shard", "bin"], "left_anti").select("item", "length", F.lit(0).alias("turn"), "shard", "bin")
        .unionByName(second.select("item", "length", F.lit(1).alias("turn"), "shard", "bin"))
        .withColumn("sequence_id", -((F.col("shard").cast("long") * 2 + F.col("turn")) * SHARD * 4 + F.col("bin")) - 1)
    )
    before = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    placed = numbered.select(
        "item", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset")
    )
    return cut.join(placed, "item", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("sequence_id", "item").alias("sequence_id"),
        F.coalesce("offset", F.lit(0).cast("long")).alias("offset"),
    )


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
