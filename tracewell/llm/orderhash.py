"""Document fingerprints by Order MinHash. DataFrame functions only.

A text becomes its word k-mers, each with the number of its occurrence, so that
repeats count. Their hashes fall into a fixed number of cells by their top bits;
in each cell the smallest ``TUPLE`` k-mers are selected, put back into text order,
and hashed as a tuple. Two texts that share the selected k-mers in another order
differ, which makes the share of equal cells follow the edit distance.

Hash and place of a k-mer share one 64-bit number (40 and 24 bits), so that the
two sorts per text are sorts of plain numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import documents, text_of
from tracewell.llm.registry import query
from tracewell.session import checkpointed

KMER = 3
TUPLE = 2
CELL_BITS = 6
# Bits of a cell's tuple hash that the fingerprint keeps.
KEPT_BITS = 16

_PLACE_BITS = 24
_PLACE = (1 << _PLACE_BITS) - 1
_SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once per row however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_PLACE).cast("long"))


def _with_place(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(F.lit(~_PLACE).cast("long")).bitwiseOR(_place(place.cast("long")))


def _run_starts(ordered: Column, bits: int) -> Column:
    """Indexes (from 0) at which the top ``bits`` of sorted numbers change."""
    drop = 64 - bits
    return F.filter(
        F.sequence(F.lit(0), F.size(ordered) - 1),
        lambda i: (i == 0) | (F.shiftright(F.get(ordered, i), drop) != F.shiftright(F.get(ordered, i - 1), drop)),
    )


def _occurrences(starts: Column, total: Column) -> Column:
    """0, 1, 2, ... within each run."""
    return F.flatten(F.transform(
        starts, lambda start, j: F.sequence(F.lit(0), F.coalesce(F.get(starts, j + 1), total) - start - 1)
    ))


def signature(text: Column, kmer: int = KMER) -> Column:
    """array<int>: for every cell with a k-mer, the cell and ``KEPT_BITS`` of its tuple's
    hash; ordered by cell. A text of fewer than ``kmer`` words is one k-mer; one without
    words is the k-mer of the empty word. Never null or empty."""
    words = F.split(F.btrim(text, F.lit(_SPACES)), r"[\x20\x09-\x0D]+")

    def kmers(hashes: Column) -> Column:
        last = F.greatest(F.size(hashes) - kmer, F.lit(0))
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: _with_place(F.xxhash64(*(F.get(hashes, i + step) for step in range(kmer))), i),
        )

    def numbered(ordered: Column) -> Column:
        def renamed(occurrence: Column) -> Column:
            return F.transform(ordered, lambda v, i: _with_place(
                F.xxhash64(F.shiftright(v, _PLACE_BITS), F.get(occurrence, i)), _place(v)
            ))

        return let(_run_starts(ordered, 64 - _PLACE_BITS), lambda starts: let(
            F.when(F.size(starts) == F.size(ordered), F.array_repeat(F.lit(0), F.size(ordered)))
            .otherwise(_occurrences(starts, F.size(ordered))),
            renamed,
        ))

    def cells(ordered: Column) -> Column:
        def tuple_of(start: Column) -> Column:
            cell = F.shiftright(F.get(ordered, start), 64 - CELL_BITS)
            chosen = F.filter(
                F.slice(ordered, start + 1, TUPLE), lambda v: F.shiftright(v, 64 - CELL_BITS) == cell
            )
            # Text order: the place in front, then the k-mer.
            placed = F.sort_array(F.transform(chosen, lambda v: F.struct(_place(v), F.shiftright(v, _PLACE_BITS))))
            names = F.transform(placed, lambda p: p["col2"])
            kept = F.xxhash64(names).bitwiseAND(F.lit((1 << KEPT_BITS) - 1).cast("long"))
            return ((cell + (1 << (CELL_BITS - 1))) * (1 << KEPT_BITS) + kept).cast("int")

        return F.transform(_run_starts(ordered, CELL_BITS), tuple_of)

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: let(
        F.sort_array(kmers(hashes)), lambda ordered: let(F.sort_array(numbered(ordered)), cells)
    ))


def likeness(a: Column, b: Column) -> Column:
    """Share of the cells filled in either signature that are equal, 0 to 1."""
    cell = lambda s: F.transform(s, lambda v: F.shiftright(v, KEPT_BITS))
    filled = F.size(F.array_union(cell(a), cell(b)))
    return F.size(F.array_intersect(a, b)) / filled


def spelled(signature: Column) -> Column:
    """Six hexadecimal digits per filled cell."""
    return F.lower(F.array_join(F.transform(signature, lambda v: F.lpad(F.hex(v), 6, "0")), ""))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row; null texts count as empty. No shuffle."""
    return docs.select("doc_id", spelled(signature(text_of())).alias("fingerprint"))


def _next_of(ids: DataFrame) -> DataFrame:
    """(doc_id, half, next_id): for every distinct id the next one in descending order,
    null last; after the last comes the first.

    Ids are dealt out by range, so a predecessor is in the same range or is the last
    of an earlier one: no task sees all ids.
    """
    ascending = F.col("doc_id").asc_nulls_first()
    dealt = checkpointed(ids.repartitionByRange(ascending).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range").orderBy(ascending)
    lasts = dealt.groupBy("_range").agg(F.max("doc_id").alias("last"))
    # One row per range; the first range's predecessor is the largest id of all.
    earlier = Window.orderBy("_range")
    before = lasts.select(
        "_range", F.lag("last").over(earlier).alias("before"), (F.row_number().over(earlier) == 1).alias("lowest")
    ).join(F.broadcast(ids.agg(F.max("doc_id").alias("highest")))).select(
        "_range", F.when(F.col("lowest"), F.col("highest")).otherwise(F.col("before")).alias("before")
    )
    return dealt.withColumn("place", F.row_number().over(inside)).withColumn("lag", F.lag("doc_id").over(inside)).join(
        F.broadcast(before), "_range"
    ).select(
        "doc_id", "half", F.when(F.col("place") == 1, F.col("before")).otherwise(F.col("lag")).alias("next_id")
    )


def _key(column: str, prefix: str) -> list[Column]:
    """An id as two columns that are never null, so that null ids meet each other too."""
    return [F.col(column).isNull().alias(f"{prefix}0"), F.coalesce(F.col(column), F.lit(0)).alias(f"{prefix}1")]


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next of every row of ``docs`` (doc_id, text).

    The edited text has its last half of code points (rounded down) replaced by as many
    from the start of the next document in descending id order. Null texts are empty; a
    null id comes last; several rows with one id each give a row, and the one with the
    smallest text hash stands for the id as somebody's next document. A single document
    is its own next.

    Texts are shuffled once, by id, and the starts of texts once more, to whom they go.
    """
    base = docs.select(*_key("doc_id", "k"), text_of().alias("text"))
    own = base.withColumn("sig", signature(F.col("text"))).repartition("k0", "k1")
    # The longest text of an id says how much of the next one may be needed.
    ids = docs.select("doc_id", F.floor(F.length(text_of()) / 2).alias("half")).groupBy("doc_id").agg(
        F.max("half").alias("half")
    )
    follows = _next_of(ids).select(*_key("doc_id", "u"), *_key("next_id", "k"), "half")
    one = Window.partitionBy("k0", "k1").orderBy(F.xxhash64("text"))
    starts = (
        own.withColumn("place", F.row_number().over(one)).filter("place = 1")
        .join(follows, ["k0", "k1"])
        .select(
            F.col("u0").alias("k0"), F.col("u1").alias("k1"), F.col("sig").alias("next_sig"),
            F.substring(F.col("text"), F.lit(1), F.col("half").cast("int")).alias("start"),
        )
    )
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("start"), F.lit(1), half))
    both = own.join(starts, ["k0", "k1"]).select(
        F.when(~F.col("k0"), F.col("k1")).alias("doc_id"), n.cast("long").alias("n_chars"),
        "sig", "next_sig", edited.alias("edited"),
    )
    # A generator hands the edited signature on: it is computed once, not once per use.
    marked = both.select(
        "doc_id", "n_chars", "sig", "next_sig", F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(signature(F.col("edited")))).alias("edited_sig"),
    )
    return marked.select(
        "doc_id", "n_chars", "edited_sha256", spelled(F.col("sig")).alias("fingerprint"),
        spelled(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


@query("op10_orderhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
