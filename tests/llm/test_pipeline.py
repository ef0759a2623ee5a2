"""The stages over the odd table: what each decides, and that it takes effect."""

from collections import Counter

import brute
import pytest
from tables import SCHEMA, odd_rows, written

import corpus_pipeline as pipeline
from tracewell.llm import lines
from tracewell.llm.lines import normalised


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_stages(spark, request, tmp_path, which):
    folder = request.getfixturevalue(which)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, tables = docs.columns, [docs.collect()]
    for number, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        tables.append(docs.collect())
        if number < len(pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    start, good, lined, single, mixed, packed = tables
    if which == "empty":
        assert all(t == [] for t in tables)
        return
    texts = Counter((r.doc_id, r.text) for r in start)
    assert not Counter((r.doc_id, r.text) for r in good) - texts
    # Line dedup: no long line twice but in rows of one id, and n_chars follows the text.
    left = Counter(n for d, t in {(r.doc_id, r.text) for r in lined} for n in normalised(t or "") if n.count(" ") >= 4)
    assert max(left.values()) == 1
    assert all(r.n_chars == len(r.text) for r in lined if r.text is not None)
    # Near-dedup: one row of each group, the one with the smallest id.
    sets = {i: brute.shingle_set(r.text) for i, r in enumerate(lined)}
    roots = brute.groups(sets, lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    least = {}
    for i, r in enumerate(lined):
        known = [x for x in (least.get(roots[i]), r.doc_id) if x is not None]
        least[roots[i]] = min(known) if known else None
    assert Counter(r.doc_id for r in single) == Counter(least.values())
    # Mixing: copies of what was there, at most three of each; packing: all of them.
    assert set(mixed) <= set(single) and max(Counter(mixed).values()) <= 3
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in mixed)


def test_clean_documents_stay(spark, tmp_path):
    """Distinct prose of one source goes through the filters unchanged."""
    import random

    from tables import prose

    rng = random.Random(21)
    rows = [(i, prose(rng, 60 + i), "en", "s", None) for i in range(40)]
    bad = [(100 + i, "%%% ".join(prose(rng, 60).split()) + "***", "en", "s", None) for i in range(40)]
    marks = [(r[0], int(r[0] < 100), 0) for r in rows + bad]
    folder = written(spark, tmp_path, rows + bad, marks, clashing=False)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:3]:
        docs = stage(spark, docs, folder)
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert {i for i in kept if i < 100} == {r[0] for r in rows} and not {i for i in kept if i >= 100}
    assert all(kept[r[0]] == r[1] for r in rows)


def test_schema_of_tables():
    assert len(odd_rows()[0]) == SCHEMA.count(",") + 1


def test_near_copies_go(spark, tmp_path):
    """Of pairs with a similarity from 0.8 on, nine in ten at least meet; nothing else does."""
    import random

    from tables import prose

    from tracewell.llm import simhash

    rng = random.Random(31)
    rows = []
    for i in range(150):
        words = prose(rng, 150 + rng.randrange(250)).split(" ")
        other = list(words)
        # A changed word takes five shingles: these leave a similarity just above 0.8 or so.
        for _ in range(max(1, round(len(words) * rng.uniform(0.008, 0.03)))):
            other[rng.randrange(len(other))] = f"w{rng.randrange(10**6)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    sets = [brute.shingle_set(t) for _, t in rows]
    near = {i for i in range(150) if 100 * len(sets[2 * i] & sets[2 * i + 1]) >= 80 * len(sets[2 * i] | sets[2 * i + 1])}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.first_of_each(docs).collect()}
    assert {2 * i for i in range(150)} <= kept and {2 * i + 1 for i in range(150) if i not in near} <= kept
    caught = sum(2 * i + 1 not in kept for i in near)
    assert 50 < len(near) < 150 and caught >= 0.9 * len(near), (caught, len(near))


def test_line_dedup_moves_only_texts_that_lose_lines(spark, monkeypatch):
    """Stage 2 with more lines than are broadcast: other texts stay where they are read."""
    monkeypatch.setattr(lines, "broadcast_if_small", lambda df, rows: df)
    seen, sieve = [], lines.sieved
    monkeypatch.setattr(lines, "sieved", lambda *a: seen.append(sieve(*a)) or seen[-1])
    own = [" ".join(f"w{(i * 9 + k) * 7919 % 10007}" for k in range(9)) for i in range(300)]
    rows = [(i, f"{text}\none line that stands in ten of a hundred" if i % 10 == 0 else text, 0) for i, text in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    left = pipeline.without_repeated_lines(spark, docs, "")
    assert {r.doc_id: r.text for r in left.collect()} == {i: own[i] if i else rows[0][1] for i in range(300)}
    assert 29 <= seen[-1].filter("_may").count() < 100
