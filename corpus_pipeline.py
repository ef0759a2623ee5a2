"""From raw documents to packed training sequences: the stages of the pipeline, in order.

Each stage takes what its predecessor kept and returns the columns of ``documents``;
the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import lines, mixing, packing, quality, simhash
from tracewell.llm.common import labels, remainder
from tracewell.session import scratch_folder, ship_package


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of at least 0.3).

    Null and empty texts are scored like any other, repeated rows go or stay together, and
    columns keep their names and values, whatever they are."""
    ship_package(spark)
    model = quality.learn(docs, labels(spark, sf_dir), remainder("doc_id", 5) != 0)
    return quality.keep_good(docs, model)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur before, in them or in another document.
    Those that lose all their words that way go; ``n_chars`` follows the text. Null, empty
    and blank texts stay as they are; the first occurrence is that of the smallest id (null
    last), and rows that share id and text keep the same lines."""
    ship_package(spark)
    left = lines.deduplicated(docs)
    lost = (F.col(left.columns[-1]) > 0) & (F.btrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")) == "")
    chars = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return left.filter(~F.coalesce(lost, F.lit(False))).withColumns(chars).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id (null last), of each group of near
    duplicates: five-word shingles with a similarity of 0.8 or more. Of documents without
    words (null, empty, blank) one stays, as of any copies; of rows that repeat it, one."""
    ship_package(spark)
    return simhash.first_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it.

    A null source is a source; null and empty texts are documents of size 0, taken as often
    as others of their source; rows that share id, source and size share their copies in
    any order; a source without any word gives nothing."""
    ship_package(spark)
    return mixing.mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens. A null text is
    an empty one, with its end alone; repeated rows are packed as often as they stand."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", one_of_each),
    ("mixing sources", mixed_sources),
    ("best-fit packing", packed_sequences),
]

# Learned models and fuzzy links are not expressible in SQL; tests/llm/test_pipeline.py
# checks the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            folder = scratch_folder(spark, f"pipeline-{number}")
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs
