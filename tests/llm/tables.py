"""Small tables with every odd case, and the registered queries over them."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use themselves.
CLASHING = (
    "score", "size", "fp", "root", "y", "f", "word", "chunk", "copies", "k", "item", "shard", "norm", "node", "n_lines",
    "n_removed", "_text_hash", "_text", "_kept", "_quality", "_mix_size", "component_id", "place", "bucket", "target",
    "_of", "_of_hash", "_gone", "_winner", "_winner_hash", "_i", "_s", "_n", "_mix_id", "_mix_source", "_mix_words",
    "_place", "_mix_lot", "_mix_number", "block", "visitor", "lines", "copies_", "text_hash", "lo", "hi", "first",
)


def prose(rng, n, vocabulary=400):
    out = []
    for i in range(n):
        w = "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd"]) for _ in range(1 + rng.randrange(vocabulary) % 4))
        out.append(w + ("." if i % 11 == 10 else ""))
        if i % 29 == 28:
            out.append("\n")
    return " ".join(out).replace(" \n ", "\n")


def odd_rows():
    rng = random.Random(5)
    whole = prose(rng, 120)
    changed = whole.split(" ")
    changed[50] = "changed"
    line = "this passage of more than five words stands in many documents of the table"
    texts = [prose(rng, 30 + rng.randrange(120)) for _ in range(24)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(30 + i, texts[i] + "\n" + line, "en", "s0", None) for i in range(6)]
    rows += [(40, whole, "en", "s1", 1), (41, whole, "en", "s1", 1), (42, " ".join(changed), "en", "s2", 1)]
    rows += [(43, line, "en", "s2", 1), (43, line, "en", "s2", 1), (44, line.upper() + "!", None, None, None)]
    rows += [(50, None, None, None, None), (51, "", "en", "s0", 0), (52, " \n\t ", "en", "s0", 3), (53, "one", "de", "s9", 3)]
    rows += [(None, "a text without an id and its own words here", None, "s1", None), (None, None, None, None, None)]
    rows += [(60, "x" * 5000, "en", "s1", 5000), (61, "word " * 4000, "en", "s1", 20000), (62, "İSTANBUL ß é ́ 日本語 🎉\x1c\x85 end", "en", "s1", 9)]
    rows += [(63, "mail a.b@c.example.com, 10.0.0.1, 4111 1111 1111 1111, +1 (415) 555-0134", "en", "s1", 9), (-7, "you stupid idiot and moron", "en", "s2", 9)]
    return rows


def items_of(rows):
    """Items that share terms; without words, null, and an id that is used twice."""
    texts = [r[1] for r in rows if r[1] and len(r[1].split()) > 20][:8]
    items = [(i, " ".join(t.split()[:12] + texts[0].split()[:6])) for i, t in enumerate(texts)]
    return items and [*items, (90, None), (91, ""), (92, " .,;"), (93, "unheardof"), (94, "idiot"), (94, "MORON istanbul 日本語"), (None, "word")]


def vector_rows():
    """Vectors in clusters, with ties, repeats, other lengths and rows that take no part."""
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(330):
        label = rng.randrange(5)
        rows.append((i, [c + rng.gauss(0, 0.4) for c in centres[(label + rng.randrange(2)) % 5]], label))
    rows += [(400 + i, rows[i % 7][1], rows[i % 7][2]) for i in range(40)]
    rows += [(500, rows[0][1], None), (501, None, 1), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (503, [float("nan")] * 6, 1)]
    rows += [(504, [float("inf")] * 6, 1), (505, [1e30] * 6, 1), (506, [], 1), (600, [], 2), (507, [1.0, 2.0], 3), (700, [1.0, 2.5], 3)]
    rows += [(708, [0.5, 1.5], 1), (None, rows[3][1], 4), (800, [0.0] * 6, 1), (801, [0.0] * 6, 2), (900, [-c for c in rows[5][1]], 2)]
    return rows


def written(spark, folder, rows, marks=None, clashing=True):
    docs = spark.createDataFrame(rows, SCHEMA)
    if clashing:
        docs = docs.withColumns({c: F.lit("x") for c in CLASHING})
    docs.write.parquet(os.path.join(folder, "documents.parquet"))
    if marks is None:
        ids = sorted({r[0] for r in rows if r[0] is not None})
        marks = [(i, int(i % 4 != 0), int(i % 5 == 0)) for i in ids]
        marks += [(1, None, None), (2, 1, 1), (2, 0, 0), (None, 1, 1), (999, 1, 0)] if rows else []
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(os.path.join(folder, "labels.parquet"))
    items = spark.createDataFrame(items_of(rows), "item_id long, text string")
    vectors = spark.createDataFrame(vector_rows() if rows else [], "vec_id long, embedding array<float>, label int")
    if clashing:
        items, vectors = (t.withColumns({c: F.lit("x") for c in CLASHING}) for t in (items, vectors))
    items.write.parquet(os.path.join(folder, "benchmark.parquet"))
    vectors.write.parquet(os.path.join(folder, "embeddings.parquet"))
    return str(folder)


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("odd"), odd_rows())


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("empty"), [])
