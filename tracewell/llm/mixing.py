"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Every source gets a target number of words; a document is then expected
``target / source size`` times. Documents of a source are put in a fixed order,
their expected copies are summed up along it, one offset per source is added,
and a document is emitted once per whole number that its stretch crosses.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import WORD, documents, free_name, running_total
from tracewell.llm.registry import query
from tracewell.session import checkpointed

# A source is used at most this many times over.
MOST = 3
# Expected copies are whole multiples of 2**-20: sums along any order are exact.
UNIT = 1 << 20


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size: one row per source) with ``target``.

    Sources by code point, null last, weigh ``weights`` in turn. The targets add
    up to all sizes, in proportion to the weights, but no target is above
    ``most`` times its source; what is above goes to the rest by weight. In the
    order of ``most * size / weight`` the capped sources are a prefix, so the
    level that the rest shares comes from two running totals.
    """
    order = [F.col("source").isNull().asc(), F.col("source").asc()]
    ranked = running_total(sizes.withColumn("one", F.lit(1)), order, {"rank": "one"}).drop("one")
    choice = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = ranked.withColumn("weight", choice.cast("long")).withColumn(
        "cap", (F.col("source_size") * most).cast("long")
    )
    ratio = [(F.col("cap") / F.col("weight")).asc(), F.col("rank").asc()]
    summed = running_total(weighed, ratio, {"caps": "cap", "weights": "weight"})
    # One row each.
    total = sizes.agg(F.sum("source_size").alias("all_words"))
    heavy = weighed.agg(F.sum("weight").alias("all_weights"))
    levels = summed.join(F.broadcast(total)).join(F.broadcast(heavy)).withColumn(
        "level", (F.col("all_words") - F.col("caps")) / (F.col("all_weights") - F.col("weights"))
    )
    level = levels.filter(F.col("level") <= F.col("cap") / F.col("weight")).agg(F.max("level").alias("shared"))
    return weighed.join(F.broadcast(level)).select(
        "source", "source_size",
        F.least(F.col("cap").cast("double"), F.col("shared") * F.col("weight")).alias("target"),
    )


def size_class(size: Column) -> Column:
    """Sizes of about the same eighth of an octave: the bit length and the next three bits."""
    bits = F.length(F.bin(size))
    return F.when(size < 16, size).otherwise(
        (bits * 8 + F.floor(size / F.pow(F.lit(2.0), bits - 4)) % 8).cast("long")
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = MOST,
    draws: int = 16,
    seed: int = 42,
) -> DataFrame:
    """One row per document (a repeated row counts as another document): doc_id,
    source, size, source_size, target, copies.

    The order within a source is: size class from large to small, a bucket, the
    id. Going by size makes the words taken come near the target: the copies run
    at most one document ahead of or behind the expected ones all along the
    order, so the error is about one largest document at most. Of ``draws``
    offsets drawn from the seed, each source uses the one that comes nearest.

    Offsets, sums and places are whole numbers, so reruns agree.

    A null text has size 0, a null source is a source of its own, a source of
    size 0 has target 0 and gives no copies. Rows that share id, source and text
    are told apart by nothing and share their copies in any order. Documents of
    one source are never in one task: places are counted per (source, size class,
    bucket) block and the blocks are summed up, with about sqrt(n) / 8 buckets.
    """
    sized = checkpointed(docs.select("doc_id", "source", word_count().alias("size")))
    return _copies(sized, weights, most, draws, seed)


def _copies(sized: DataFrame, weights: tuple[int, ...], most: int, draws: int, seed: int) -> DataFrame:
    n = sized.count()
    buckets = max(1, math.isqrt(n) // 8)
    classed = sized.withColumn("class", size_class(F.col("size"))).withColumn(
        "bucket", F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(buckets)).cast("int")
    )
    block = ["source", "class", "bucket"]
    blocks = classed.groupBy(*block).agg(F.count("*").alias("docs"), F.sum("size").alias("words"))
    blocks = checkpointed(blocks)
    goal = targets(
        blocks.groupBy("source").agg(F.sum("words").cast("long").alias("source_size")), weights, most
    ).withColumn(
        "rate",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT + 0.5)).otherwise(0).cast("long"),
    )
    before = (
        Window.partitionBy("source").orderBy(F.col("class").desc(), "bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = blocks.withColumn("first", F.coalesce(F.sum("docs").over(before), F.lit(0))).alias("b").join(
        goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))
    ).select("b.source", "class", "bucket", "first", "source_size", "target", "rate")
    inside = Window.partitionBy(*block).orderBy("doc_id", "size")
    ranked = classed.withColumn("place", F.row_number().over(inside))
    joined = ranked.alias("d").join(
        placed.alias("p"),
        F.col("d.source").eqNullSafe(F.col("p.source"))
        & (F.col("d.class") == F.col("p.class")) & (F.col("d.bucket") == F.col("p.bucket")),
    ).select("doc_id", "d.source", "size", "source_size", "target", "rate", (F.col("first") + F.col("place")).alias("k"))
    joined = checkpointed(joined)
    offsets = [((seed + draw) * 2654435761) % UNIT for draw in range(draws)]

    def taken(offset: Column) -> Column:
        upto = F.shiftright(F.col("k") * F.col("rate") + offset, 20)
        return upto - F.shiftright((F.col("k") - 1) * F.col("rate") + offset, 20)

    misses = joined.groupBy("source").agg(
        F.max("target").alias("target"),
        *(F.sum(taken(F.lit(o)) * F.col("size")).alias(f"w{i}") for i, o in enumerate(offsets)),
    )
    nearest = F.array_min(F.array(*(
        F.struct(F.abs(F.col(f"w{i}") - F.col("target")).alias("miss"), F.lit(o).cast("long").alias("offset"))
        for i, o in enumerate(offsets)
    )))
    chosen = misses.select("source", nearest["offset"].alias("offset"))
    return joined.alias("j").join(
        chosen.alias("c"), F.col("j.source").eqNullSafe(F.col("c.source"))
    ).select("doc_id", "j.source", "size", "source_size", "target", taken(F.col("offset")).alias("copies"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with the
    columns of ``docs`` only. Takes the settings of ``mix``."""
    key, lot, number, i, s, n = (free_name(docs, f"_mix_{x}") for x in ("size", "lot", "number", "id", "source", "words"))
    lots = (
        mix(docs, **settings).groupBy("doc_id", "source", "size")
        .agg(F.sort_array(F.collect_list("copies")).alias(lot))
        .select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("size").alias(n), lot)
    )
    same = Window.partitionBy("doc_id", "source", key).orderBy("doc_id")
    numbered = docs.withColumn(key, word_count()).join(
        lots,
        F.col("doc_id").eqNullSafe(F.col(i)) & F.col("source").eqNullSafe(F.col(s)) & (F.col(key) == F.col(n)),
    ).withColumn(number, F.row_number().over(same))
    times = F.element_at(F.col(lot), F.col(number)).cast("int")
    return numbered.withColumn(
        number, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))
    ).select(*(F.col(f"`{c}`") for c in docs.columns))


SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3
              WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS weight,
         row_number() OVER (ORDER BY source IS NULL, source) AS rk, source_size * 3 AS cap
  FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))
          / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM r
  WINDOW w AS (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (
  SELECT max(level) AS shared FROM l WHERE level <= cap / weight
), g AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), shared * weight) AS target FROM r, v
), h AS (
  SELECT *, CASE WHEN source_size > 0
                 THEN CAST(floor(target / source_size * 1048576 + 0.5) AS BIGINT) ELSE 0 END AS rate
  FROM g
), b AS (
  SELECT *, greatest(1, CAST(floor(floor(sqrt((SELECT count(*) FROM d))) / 8) AS BIGINT)) AS buckets,
         CASE WHEN size < 16 THEN size
              ELSE length(bin(size)) * 8 + CAST(floor(size / pow(2.0, length(bin(size)) - 4)) AS BIGINT) % 8
         END AS class
  FROM d
), k AS (
  SELECT *, row_number() OVER (
           PARTITION BY source
           ORDER BY class DESC, ((coalesce(doc_id, 0) % buckets) + buckets) % buckets, doc_id, size) AS k
  FROM b
), j AS (
  SELECT k.doc_id, k.source, k.size, h.source_size, h.target, h.rate, k.k
  FROM k JOIN h ON k.source IS NOT DISTINCT FROM h.source
), o AS (
  SELECT ((42 + i) * 2654435761) % 1048576 AS off FROM range(16) t(i)
), m AS (
  SELECT source, off,
         abs(sum((((k * rate + off) >> 20) - (((k - 1) * rate + off) >> 20)) * size) - max(target)) AS miss
  FROM j, o GROUP BY source, off
), c AS (
  SELECT source, off FROM m QUALIFY row_number() OVER (PARTITION BY source ORDER BY miss, off) = 1
)
SELECT j.doc_id, j.size, j.source_size, j.target,
       CAST((((k * rate + off) >> 20) - (((k - 1) * rate + off) >> 20)) * size AS BIGINT) AS taken
FROM j JOIN c ON j.source IS NOT DISTINCT FROM c.source
"""


@query("op2_mixing", SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )
