"""What the operators of this package share: reading, keys, running totals, connected groups."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewell.operators.groups import connected_groups  # noqa: F401
from tracewell.session import checkpointed

# A word is a run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(modulus))


def labelled(
    docs: DataFrame, marks: DataFrame, label: str, usable: Column, max_rows: int
) -> DataFrame:
    """(doc_id, text, y, fold) of at most ``max_rows`` labelled documents.

    Labels that are null or neither 0 nor 1 are left out; an id labelled twice
    counts once, with the larger label. Which rows are taken depends on a hash
    of the id alone. The labels taken are at most ``max_rows`` narrow rows, so
    they are broadcast to the documents.
    """
    chosen = (
        marks.select("doc_id", F.col(label).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & usable)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .withColumn("h", F.xxhash64("doc_id"))
        .orderBy("h", "doc_id")
        .limit(max_rows)
        .select("doc_id", "y", F.pmod(F.col("h"), F.lit(5)).cast("int").alias("fold"))
    )
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")


def running_total(df: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with, for every ``new: value`` in ``sums``, the total of ``value``
    over all rows before this one in ``order``.

    Rows are dealt out by range, each range sums up alone, and the totals of
    the ranges (one row per partition) are added in front; no task sees all rows.
    Rows equal in ``order`` follow each other in any order.
    """
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per_range = dealt.groupBy("_range").agg(*(F.sum(v).alias(f"_{n}") for n, v in sums.items()))
    offsets = per_range.select(
        "_range", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums)
    )
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: as many as the session has shuffle partitions.
    return dealt.join(F.broadcast(offsets), "_range").select(
        *(f"`{c}`" for c in df.columns),
        *((F.coalesce(F.sum(v).over(within), F.lit(0)) + F.col(f"_{n}")).alias(n) for n, v in sums.items()),
    )


_NAME = re.compile(r"[^0-9A-Za-z_]")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    name = _NAME.sub("_", name)
    while name.lower() in taken:
        name += "_"
    return name


# Bytes of one Arrow batch: texts have no bound, so rows alone must not decide.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session, unless it names a bound itself."""
    if int(spark.conf.get(_BATCH_SETTING, str(2**31 - 1))) >= 2**31 - 1:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def per_text(
    docs: DataFrame, keep: Sequence[str], compute: Callable[[list[str]], Sequence[pa.Array]], schema: str,
    text: str = "text",
) -> DataFrame:
    """The ``keep`` columns unchanged, and what ``compute`` makes of the texts of a
    batch: one Arrow array per column of ``schema``. No shuffle; null texts are empty."""
    bound_batches(docs.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    width = len(keep)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            # Bounded pieces: a batch of very long texts is not held twice at once.
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                new = compute(part.column(width).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *new], names=names)

    names = [*keep, *StructType.fromDDL(schema).names]
    kept = [f"`{c}` {types[c]}" for c in keep]
    return docs.select(*(f"`{c}`" for c in keep), text_of(text).alias(free_name(docs, "_text"))).mapInArrow(
        batches, ", ".join([*kept, schema])
    )


# Cells of 64 bits that a sieve has at most: what is broadcast does not grow beyond.
SIEVE_CELLS = 1 << 19


def sieved(df: DataFrame, mark: str, key: Column, wanted: DataFrame, most: int = SIEVE_CELLS) -> DataFrame:
    """``df`` with the boolean ``mark``: whether ``key`` (a hash of 64 bits, not null) may be
    one of the hashes in ``wanted`` (one column).

    True for every one that is, and for some others: one in 32 or so while ``wanted`` has
    no more than two rows a cell, more beyond. Rows are not moved for it.
    """
    cell, bits = (free_name(df, mark + end) for end in ("_cell", "_bits"))
    wanted = wanted.toDF("h")
    cells = F.lit(min(most, 1 + wanted.count() // 2)).cast("long")

    def place(of: Column) -> Column:
        return F.pmod(F.shiftright(of, 6), cells)

    def bit(of: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), of.bitwiseAND(F.lit(63)).cast("int"))

    table = wanted.groupBy(place(F.col("h")).alias(cell)).agg(F.bit_or(bit(F.col("h"))).alias(bits))
    found = F.coalesce(F.col(bits).bitwiseAND(bit(key)) != 0, F.lit(False))
    return df.withColumn(cell, place(key)).join(F.broadcast(table), cell, "left").withColumn(mark, found).drop(cell, bits)
