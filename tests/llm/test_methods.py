"""The methods themselves, on made-up small inputs."""

import itertools
import os
import random
import re
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tables import prose

from tracewell import session
from tracewell.llm import hpylm, jaccard, lines, mixing, negatives, packing, pii, quality, rules, search, simhash, toxicity
from tracewell.llm.common import connected_groups, running_total, sieved


@pytest.mark.parametrize("block", [4096, 16])
@pytest.mark.parametrize("rows", [100, 1 << 26, 1 << 34])
def test_links_of_dense_fingerprints(spark, block, rows):
    """All plans of segments, whole and dealt-out buckets: the groups of all pairs."""
    rng = np.random.default_rng(1)
    prints = set(rng.integers(-(2**62), 2**62, 20).tolist())
    for base in list(prints)[:2]:
        for _ in range(120):
            turned = base
            for _ in range(rng.integers(1, 9)):
                turned ^= 1 << int(rng.integers(0, 62))
            prints.add(turned)
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4
    want = brute.groups(prints, near)
    fps = spark.createDataFrame([(v,) for v in prints], "fp long")
    found = {r.node: r.root for r in connected_groups(simhash.linked(fps, 4, block, rows)).collect()}
    assert {p: found.get(p, p) for p in prints} == want


def test_small_buckets_are_compared_together(monkeypatch):
    """Buckets of a few rows, homes before probes, cut anywhere into batches: the groups of all
    pairs, and no work bucket by bucket."""
    calls, forest = [], simhash._forest
    monkeypatch.setattr(simhash, "_forest", lambda *a: calls.append(1) or forest(*a))
    rng = np.random.default_rng(3)
    near = lambda x: x ^ int(1 << rng.integers(0, 30)) ^ int(1 << rng.integers(0, 30))
    rows = []
    for bucket in range(3000):
        prints = [int(rng.integers(0, 2**62))]
        for _ in range(int(rng.integers(0, 9))):
            prints.append(near(prints[-1]) if rng.random() < 0.6 else int(rng.integers(0, 2**62)))
        rows += [(bucket, 0, bool(rng.random() < 0.3), p) for p in prints]
    rows.sort(key=lambda r: r[:3])
    batch = pa.RecordBatch.from_pylist([dict(zip(("bucket", "block", "probe", "fp"), r, strict=True)) for r in rows])
    batches = (batch.slice(at, 4000) for at in range(0, len(rows), 4000))
    edges = [e for found in simhash._links(4)(batches) for e in zip(*(c.to_pylist() for c in found.columns), strict=True)]
    pairs = [
        (a[3], b[3]) for k, a in enumerate(rows) for b in rows[k + 1 : k + 16]
        if a[0] == b[0] and not (a[2] and b[2]) and (a[3] ^ b[3]).bit_count() <= 4 and a[3] != b[3]
    ]

    def roots(links):
        up = {r[3]: r[3] for r in rows}
        find = lambda x: x if up[x] == x else find(up[x])
        for a, b in links:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        return {x: find(x) for x in up}

    assert roots(edges) == roots(pairs) and len(pairs) > 3000
    assert len(edges) < len(pairs) and len(calls) < 20


def test_groups_of_long_chains(spark):
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7)]
    found = {r.node: r.root for r in connected_groups(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_running_total(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(50), rng.randrange(9)) for _ in range(200)]
    df = spark.createDataFrame(rows, "k int, v long").withColumnRenamed("k", "key")
    found = running_total(df, [df["key"]], {"before": "v"}).collect()
    for r in found:
        assert sum(v for k, v in rows if k < r.key) <= r.before <= sum(v for k, v in rows if k <= r.key) - r.v


def test_targets_equal_resharing(spark):
    rng = random.Random(3)
    for _ in range(3):
        sizes = {None if i == 0 else f"s{i}": rng.choice([0, 1, 5, 50, 500, 5000]) for i in range(rng.randrange(1, 9))}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r.source: r.target for r in mixing.targets(df).collect()}
        assert found == pytest.approx(brute.targets(sizes))


def test_mixed_rows_are_the_taken_copies(spark):
    rows = [(i % 7, "w " * (1 + i % 5), f"s{i % 2}", i) for i in range(40)] + [(None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lot long")
    taken = mixing.mix(docs).groupBy("doc_id", "source", "size").sum("copies").collect()
    found = {}
    for r in mixing.mixed(docs).collect():
        key = (r.doc_id, r.source, len(brute.words(r.text)))
        found[key] = found.get(key, 0) + 1
    assert found == {(r.doc_id, r.source, r.size): r[3] for r in taken if r[3]}


def test_trees_and_calibration():
    rng = np.random.default_rng(4)
    x = rng.random((1500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = toxicity.boost(x[:1000], y[:1000], rounds=40)
    model.knots, model.levels = toxicity.isotonic(model.margin(x[:1000]), y[:1000])
    score = model.score(x[1000:])
    assert ((score > 0.5) == y[1000:]).mean() > 0.93
    assert (np.diff(model.levels) >= 0).all() and (np.diff(model.knots) > 0).all()


def test_hidden_insults_raise_features():
    plain, hidden = (toxicity.features(t, toxicity.Lexicon()) for t in ("you are kind today", "you are an id1ot today"))
    at = toxicity.FEATURES.index("hidden_hits")
    assert plain[at] == 0 and hidden[at] == 1
    near = toxicity.FEATURES.index("near_you")
    assert toxicity.features("you idiot", toxicity.Lexicon())[near] > 0


@pytest.mark.parametrize("sign", " .-_*")
def test_spelled_out_insults_count_in_every_text(sign):
    at = toxicity.FEATURES.index("hidden_hits")
    assert toxicity.features(f"you {sign.join('idiot')} over there", toxicity.Lexicon())[at] == 1


def test_capital_words_of_long_texts_count():
    at = toxicity.FEATURES.index("capital_words")
    text = "some quiet words " * 200 + "GET OUT NOW"
    assert toxicity.features(text, toxicity.Lexicon())[at] == pytest.approx(3 / 603)


def test_additive_model_learns_pairs():
    rng = np.random.default_rng(5)
    x = rng.random((2500, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    whole, single = quality.fit(x[:2000], y[:2000]), quality.fit(x[:2000], y[:2000], pairs=0)
    right = lambda m: ((m.score(x[2000:]) > 0.5) == y[2000:]).mean()
    assert right(whole) > 0.9 > 0.7 > right(single)


def test_rules_are_found_in_order():
    import pandas as pd

    rng = np.random.default_rng(6)
    rows = pd.DataFrame({"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000), "fold": rng.integers(0, 5, 3000)})
    rows["y"] = 1 - ((rows.a > 0.9) | ((rows.b < 0.2) & (rows.c > 0.5))).astype(int)
    found = rules.learn_rules(rows, ["a", "b", "c"])
    rejected = np.any([rules.covers(r, rows) for r in found], axis=0)
    assert 2 <= len(found) <= 8 and (rejected == (rows.y == 0)).mean() > 0.97
    assert rules.learn_rules(rows.assign(y=1), ["a"]) == []


def test_repeated_words_of_long_texts():
    rng = random.Random(7)
    for _ in range(50):
        text = " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))
        assert rules.repeated_words(text.encode().split()) == brute.statistics(text)[4]


def test_field_keeps_to_the_examples_and_adds_spans():
    field = pii.trained()
    for line in pii.EXAMPLES:
        tokens, tags = pii._labelled(line)
        assert pii.viterbi(field, [field.emissions(tokens)])[0].tolist() == tags
    text = "Reach Bob at bob [at] corp [dot] com or (303) 555-0199, not at 4111111111111112."
    (found,) = pii.find([text], field)
    assert found.base == [] and [text[a:b] for _, a, b in found.spans] == ["bob [at] corp [dot] com", "(303) 555-0199"]
    clean = "In 1999 version 2.0.1 cost 1,299.50 on pages 120-134."
    assert pii.find([clean], field)[0].spans == []


def planted(rng):
    """Personal data in spellings that the base patterns miss: (kind, form, text before, value)."""
    digits = lambda k: "".join(rng.choice("123456789") for _ in range(k))
    parts = lambda sep: sep.join(str(rng.randrange(1, 255)) for _ in range(4))

    def card(sep, start="4", size=16):
        number = next(d for d in iter(lambda: start + digits(size - len(start)), "") if pii.luhn(d))
        return sep.join(number[i : i + 4] for i in range(0, size, 4))

    name, host = rng.choice(["olga", "tim.hansen", "marta_k", "wiebke42", "lucia"]), rng.choice(["acme", "north-shop", "lab77", "postbox"])
    end = rng.choice(["org", "com", "net", "de", "fr"])
    forms = {
        "email": [f"{name} [at] {host} [dot] {end}", f"{name}(at){host}.{end}", f"{name} at {host} dot {end}", f"{name} @ {host} . {end}"],
        "ip": [parts("[.]"), parts("(.)"), parts("[dot]"), parts(" . "), parts(" dot ")],
        "card": [card("."), card("/"), card("  "), card("", rng.choice(["34", "37"]), 15)],
        "phone": [
            f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(2)}/{digits(7)}",
            f"+{digits(2)} (0) {digits(2)} / {digits(6)}", f"0049 {digits(2)} {digits(6)}", f"{digits(3)}-{digits(4)}",
        ],
    }
    cues = {
        "email": ["mail", "write to", "contact", "her e-mail is"], "ip": ["the host", "login from", "client", "blocked"],
        "card": ["card", "paid with card", "visa"], "phone": ["call", "phone", "tel", "reach me at", "my number is"],
    }
    for kind, values in forms.items():
        for form, value in enumerate(values):
            yield kind, form, rng.choice(cues[kind]) + " ", value


def test_field_finds_what_the_base_misses():
    """Recall and precision of the added spans on spellings with names and numbers not in the examples."""
    rng, cases = random.Random(77), []
    for _ in range(60):
        for kind, form, cue, value in planted(rng):
            before = prose(rng, rng.randrange(3, 12)) + " " + cue
            cases.append((kind, form, len(before), value, before + value + rng.choice([" ", ", ", ". "]) + prose(rng, 6)))
    found = pii.find([c[-1] for c in cases], pii.trained())
    hits, extra = {}, 0
    for (kind, form, start, value, _), f in zip(cases, found, strict=True):
        gold = (pii.KINDS.index(kind), start, start + len(value))
        added = [s for s in f.spans if s not in f.base]
        hits.setdefault((kind, form), []).append(gold in added)
        extra += len([s for s in added if s != gold])
    share = {k: sum(v) / len(v) for k, v in hits.items()}
    assert sum(share.values()) / len(share) >= 0.9 and min(share.values()) >= 0.7, share
    assert extra <= 0.03 * len(cases)
    numbers = [f"{prose(rng, 8)} {rng.randrange(10**6)} of {rng.randrange(99)}.{rng.randrange(9)} in {rng.randrange(1900, 2030)}, {prose(rng, 4)}" for _ in range(500)]
    assert sum(len(f.spans) for f in pii.find(numbers, pii.trained())) <= 5


def test_base_patterns_equal_plain_matching():
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice("0123456789..  @@--++ab()%_") for _ in range(rng.randrange(40)))
        text = text.replace("ab", "4111 1111 1111 1111") if rng.random() < 0.1 else text
        want = sorted(brute.personal(text))
        assert sorted(pii.joined(pii.base_spans(text)).split(",")) == (want or [""])


def test_edit_distance():
    rng = random.Random(9)
    for _ in range(2000):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randrange(14))) for _ in range(2))
        most = rng.randrange(14)
        assert lines.edit_distance(a, b, most) == min(brute.levenshtein(a, b), most + 1)


def test_lines_are_similar_without_all_their_distances(monkeypatch):
    """Decided as by the edit distance, but most lines with words changed, put in or taken
    out need none."""
    asked, distance = [], lines.edit_distance
    monkeypatch.setattr(lines, "edit_distance", lambda *a: asked.append(1) or distance(*a))
    rng, alike = random.Random(13), 0
    for _ in range(300):
        a = prose(rng, 50).split()
        b = list(a)
        for _ in range(rng.randrange(1, 12)):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(2)] = ["zz"] * rng.randrange(2)
        a, b = " ".join(a), " ".join(b)
        within = distance(a, b, 1000) <= int(0.2 * max(len(a), len(b)) + 1e-9)
        assert lines._changed(a, b, 1000) >= distance(a, b, 1000) and lines.similar(a, b, 0.8) == within
        alike += within
    assert alike > 100 and len(asked) < alike / 2


def test_line_dedup_frees_its_shuffles(spark):
    """Jobs of many steps leave no shuffle files behind, and the session as it was."""
    sent = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: sum("shuffle_" in f for f in sent.getAllFiles().mkString(" ").split())
    rng = random.Random(14)
    docs = [(i, prose(rng, 30) + "\n" + prose(random.Random(i % 5), 30)) for i in range(40)]
    setting, before = spark.conf.get(session._FREED, "false"), shuffles()
    lines.removed_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert spark.conf.get(session._FREED, "false") == setting
    assert shuffles() <= before


def test_language_model_frees_its_shuffles(spark):
    sent = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: sum("shuffle_" in f for f in sent.getAllFiles().mkString(" ").split())
    rng = random.Random(15)
    before = shuffles()
    hpylm.score(spark.createDataFrame([(i, prose(rng, 20)) for i in range(20)], "doc_id long, text string"))
    assert shuffles() <= before


def test_language_model_keeps_few_bytes_a_pair(spark):
    """Pairs of words are kept and moved packed, and tables of a step go with it."""
    folder = session.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    rng = np.random.default_rng(21)
    words = [f"w{k:05d}" for k in range(20000)]
    docs = [(i, " ".join(words[k] for k in rng.integers(0, 20000, 500))) for i in range(400)]
    hpylm.score(spark.createDataFrame(docs, "doc_id long, text string"))
    mine = [n for n in os.listdir(folder) if n.startswith("hpylm-") and n not in before]
    assert len(mine) == 1
    files = [os.path.join(d, f) for d, _, names in os.walk(os.path.join(folder, mine[0])) for f in names]
    # 200,000 pairs, nearly all different ones; two hashes of a pair alone would be 16 bytes.
    assert sum(map(os.path.getsize, files)) < 16 * 200_000


def test_pairs_of_words_are_counted_whole(spark):
    """Packed pairs, by bucket and with ids of their words, are those of the texts."""
    rng = random.Random(22)
    texts = [" ".join(rng.choices(["a", "B", "\u00c4b", "c,", "\u4e2d"], k=rng.randrange(40))) for _ in range(700)] + ["", " \t x\u00a0y \n", "\x1fz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(3)
    from tracewell.llm.common import remainder

    chunks = hpylm._chunks(docs, remainder("doc_id", 7) == 2, 5).persist()
    words = hpylm._numbered(chunks.filter("kind = 'words'")).persist()
    rows = hpylm._with_ids(chunks.filter("kind = 'pairs'"), hpylm._answers(words, {"id": hpylm._packed_rising})).toArrow()
    word_of = {r.id: bytes(r.word) for r in words.collect()}
    held = {r.doc_id for r in docs.filter(remainder("doc_id", 7) == 2).collect()}
    expected, total = Counter(), Counter()
    for i, text in enumerate(texts):
        mine = [hpylm.END, *text.encode().lower().split(), hpylm.END]
        expected.update({p: int(i not in held) * n for p, n in Counter(itertools.pairwise(mine)).items()})
        total.update((mine[1:]) * (i not in held))
    left, right, c, where = hpylm._merged(rows)
    found = {(word_of[a], word_of[b]): n for a, b, n in zip(left.tolist(), right.tolist(), c.tolist(), strict=True)}
    assert found == expected and len(found) == len(left)
    assert [len(w) for w in where] == [len(hpylm._unpacked(x)) for x in rows.column("counts").to_pylist()]
    assert {bytes(r.word): r.c for r in words.collect() if r.c} == total
    chunks.unpersist(), words.unpersist()


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [3, 1 << 62, 0, 255, 256], list(range(1000))])
def test_packed_numbers(values):
    values = np.array(values, np.int64)
    assert hpylm._unpacked(hpylm._packed(values)).tolist() == values.tolist()
    for rising in (np.sort(values) - (1 << 40), values):  # also where one falls
        assert hpylm._unpacked_rising(hpylm._packed_rising(rising)).tolist() == rising.tolist()


def test_fuzzy_lines_form_groups(spark):
    rng = random.Random(10)
    base = [" ".join(prose(rng, 60).split()) for _ in range(12)]
    docs = []
    for i, line in enumerate(base):
        words = line.split(" ")
        words[rng.randrange(60)] = "zz"
        docs += [(3 * i, line), (3 * i + 1, " ".join(words)), (3 * i + 2, line.upper() + "!!")]
    docs.append((99, "another line\n" + base[0]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    left = {r.doc_id: r.text for r in lines.deduplicated(df).collect()}
    texts = dict(docs)
    kept = [i for i, t in left.items() if t]
    assert all(left[3 * i] == base[i] and left[3 * i + 2] == "" for i in range(12)) and left[99] == "another line"
    # One word of sixty changed: most are found, and what is removed is similar to what stays.
    assert len([i for i in kept if i % 3 == 1 and i < 36]) <= 5
    for i in range(12):
        assert lines.similar(lines.normalised(texts[3 * i])[0], lines.normalised(texts[3 * i + 1])[0], 0.8)


@pytest.mark.parametrize("most", [1 << 19, 3])
def test_sieve_lets_all_that_are_wanted_pass(spark, most):
    """Whatever the cells; with enough of them few others pass, and no row is moved or lost."""
    rows = spark.range(4000).selectExpr("id", "xxhash64(id) AS h", "id AS may_cell")
    seen = sieved(rows, "may", F.col("h"), rows.filter("id % 10 = 0").selectExpr("h AS id"), most)
    assert seen.columns == ["id", "h", "may_cell", "may"]
    found = {r.id: r.may for r in seen.collect()}
    assert len(found) == 4000 and all(found[i] for i in range(0, 4000, 10))
    assert most == 3 or sum(found.values()) < 700
    assert not any(r.may for r in sieved(rows, "may", F.col("h"), rows.filter("false").select("h"), most).collect())


def _moved(df):
    """The columns of the rows that the plan of ``df`` shuffles, by shuffle."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [set(re.findall(r"(\w+)#", found)) for found in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)]


def test_texts_are_sieved_where_they_are_read(spark, monkeypatch):
    """With more lines than are broadcast: only the lines looked for are moved, never whole texts
    to find them, and of the texts only those that lose lines; the result is the same."""
    monkeypatch.setattr(lines, "broadcast_if_small", lambda df, rows: df)
    spelled, texts = [], lines._texts
    monkeypatch.setattr(lines, "_texts", lambda *a: spelled.append(texts(*a)) or spelled[-1])
    seen, sieve = [], lines.sieved
    monkeypatch.setattr(lines, "sieved", lambda *a: seen.append((a[1], sieve(*a))) or seen[-1][1])
    rng = random.Random(7)
    own = ["\n".join(prose(rng, 12) for _ in range(3)) for _ in range(200)]
    common = prose(rng, 12)
    rows = [(i, f"{t}\n{common}" if i < 20 else t) for i, t in enumerate(own)]
    left = lines.deduplicated(spark.createDataFrame([*rows, (None, None), (900, "")], "doc_id long, text string"))
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in left.collect()}
    want = {i: (own[i] if i else rows[0][1], 3 + (i < 20), int(0 < i < 20)) for i in range(200)}
    assert got == want | {None: (None, 1, 0), 900: ("", 1, 0)}
    moved = _moved(spelled[0])
    assert moved and not any("text" in columns for columns in moved)
    may = [df.filter("_may").count() for mark, df in seen if mark == "_may"]
    assert len(may) == 1 and 19 <= may[0] < 60


def test_short_lines_and_lines_without_spaces(spark):
    """Equal lines of any length are one; a script without spaces is compared by characters."""
    signs = "".join(chr(0x4E00 + 37 * i % 20000) for i in range(1500))
    rows = [(0, "And ornd.\n\n---\n" + signs), (1, "and  ORND!\n\n---\nanother"), (2, signs), (3, signs[:60] + "X" + signs[60:])]
    left = {r.doc_id: r.text for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {0: rows[0][1], 1: "\n---\nanother", 2: "", 3: ""}


def test_large_clusters_are_streamed():
    """Visitors meet the homes of a block, are not kept, and link nobody among themselves."""
    import gc
    import weakref

    import pyarrow as pa

    class Text(str):
        pass

    held = []

    class Batch:
        def __init__(self, rows):
            self.columns = [self.Column(c) for c in zip(*rows, strict=True)]

        class Column(list):
            def to_pylist(self):
                return list(self)

    def rows():
        home = "the words of this one line are the same everywhere"
        yield Batch([(1, 0, False, 1, 0, home), (1, 0, False, 2, 0, home + "s")])
        for start in range(100, 1100, 100):
            texts = [Text(home[:-1] + "x") if n % 2 else Text("visitors that are alike among themselves %d" % (n % 4)) for n in range(start, start + 100)]
            held.extend(map(weakref.ref, texts))
            yield Batch([(1, 0, True, n, 0, t) for n, t in zip(range(start, start + 100), texts, strict=True)])
            del texts

    edges, most = [], 0
    for batch in lines._verified(0.8, 10)(rows()):
        assert isinstance(batch, pa.RecordBatch)
        edges += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        gc.collect()
        most = max(most, sum(r() is not None for r in held))
    assert {a for a, _ in edges} == {2, *range(101, 1100, 2)} and {b for _, b in edges} <= {1, 2}
    assert most <= 200


def test_very_long_line_is_hashed_in_pieces():
    long = " ".join(f"w{i}" for i in range(70_000)).encode()
    lo, hi = lines._simhashes([b"a b c d e", long, b"a b c d f"])
    assert lines._simhashes([long])[0][0] == lo[1] and lo[0] != lo[2]


def test_packing_evolves():
    rng = np.random.default_rng(11)
    sizes = rng.integers(100, 1200, 400)
    start = packing.Packing(sizes, 2048)
    start.best_fit(np.argsort(-sizes, kind="stable").tolist())
    other = packing.Packing(sizes, 2048)
    other.best_fit(list(range(len(sizes))))
    child = packing.crossover(start, other, rng)
    for packed in (start, other, child, packing.evolve(sizes, 2048, 1, generations=30)):
        assert sorted(i for b in packed.bins for i in b) == list(range(len(sizes)))
        assert all(sizes[b].sum() + f == 2048 and f >= 0 for b, f in zip(packed.bins, packed.free, strict=True))
    assert len(packing.evolve(sizes, 2048, 1, generations=30).bins) <= len(start.bins)


def test_words_encode_as_the_tokenizer_does():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, mine = Tokenizer.from_file(path), packing.Encoder(path)
    rng = random.Random(12)
    letters = [chr(i) for i in range(1, 0x300)] + list("日本ΑΣσςﬁ½🎉​́<|>") + ["'s", "'LL", "<|endoftext|>"] + [" "] * 40
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 12)))
        got = np.frombuffer(mine.encode([text])[0], "<u4").tolist()
        assert got == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_known_take_little_memory():
    """Words of one piece are remembered once, and in bounded space."""
    import sys

    import public_tokenizers

    mine = packing.Encoder(public_tokenizers.path(packing.VOCABULARY))
    mine._piece = lambda piece: packing._ids([len(piece)] * 3)
    letters = [chr(97 + k) for k in range(26)]
    words = ["".join(letters[k // 26**n % 26] for n in range(4)) for k in range(350_000)]
    for at in range(0, len(words), 10_000):
        mine.encode([" ".join(words[at : at + 10_000])])
    held = [d for known in (mine.known, mine.pieces) for d in (known, known.before)]
    assert sum(sys.getsizeof(d) + sum(sys.getsizeof(w) + sys.getsizeof(i) for w, i in d.items()) for d in held) < 60e6


def test_frequent_words_stay_known(monkeypatch):
    """A word that comes again and again is cut once, however many others come between."""
    import public_tokenizers

    asked, piece = [], packing.Encoder._piece
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    monkeypatch.setattr(packing.Encoder, "_piece", lambda self, p: asked.append(p) or piece(self, p))
    mine = packing.Encoder(public_tokenizers.path(packing.VOCABULARY))
    letters = "abcdefghij"
    texts = [f"often x{letters[k // 100]}{letters[k // 10 % 10]}{letters[k % 10]}, often" for k in range(400)]
    found = mine.encode(texts)
    assert asked.count("often") == 1 and asked.count(",") == 1
    assert len(mine.known) <= 50 and len(mine.pieces) <= 50
    for text, ids in zip(texts, found, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == mine.tokenizer.encode(text, add_special_tokens=False).ids


def test_seating_keeps_customers():
    rng = np.random.default_rng(13)
    customers = rng.integers(1, 60, 200)
    seats = hpylm.Seating(customers, 0.6, rng)
    for _ in range(20):
        seats.step(np.full(200, 2.0))
        assert (np.bincount(seats.dish, seats.size, 200) == customers).all() and (seats.size > 0).all()
    rare, common = hpylm.Seating(customers, 0.6, rng), hpylm.Seating(customers, 0.6, rng)
    for _ in range(60):
        rare.step(np.full(200, 1e-6))
        common.step(np.full(200, 1e6))
    assert rare.tables().sum() < seats.tables().sum() < common.tables().sum()


def _one_by_one(customers, opening, discount, rng, sweeps):
    """Mean number of tables when customers leave and come back one after the other."""
    sizes, found = [customers], []
    for sweep in range(sweeps):
        for _ in range(customers):
            at = rng.choices(range(len(sizes)), sizes)[0]
            sizes[at] -= 1
            sizes = [s for s in sizes if s]
            at = rng.choices(range(len(sizes) + 1), [s - discount for s in sizes] + [opening])[0]
            sizes = [s + (i == at) for i, s in enumerate(sizes)] + [1] * (at == len(sizes))
        found.append(len(sizes))
    return np.mean(found[sweeps // 10 :])


@pytest.mark.parametrize(("customers", "opening"), [(5, 0.1), (30, 1.0), (60, 8.0)])
def test_seating_is_that_of_a_sequential_sampler(customers, opening):
    seats = hpylm.Seating(np.full(4000, customers), 0.6, np.random.default_rng(17))
    seats.step(np.full(4000, opening))
    expected = _one_by_one(customers, opening, 0.6, random.Random(18), 1500)
    assert seats.tables().mean() == pytest.approx(expected, rel=0.05)


@pytest.mark.parametrize("opening", [0.01, 1.0, 20.0, 200.0])
def test_seating_of_many_customers(opening, monkeypatch):
    """The first-order form against the exact distribution of the same number."""
    seats = hpylm.Seating(np.full(2000, 1000), 0.6, np.random.default_rng(19))
    seats.step(np.full(2000, opening))
    exact = seats.tables().mean()
    monkeypatch.setattr(hpylm, "EXACT", 500)
    hpylm._ways.cache_clear()
    seats.step(np.full(2000, opening))
    hpylm._ways.cache_clear()
    assert seats.tables().mean() == pytest.approx(exact, rel=0.05)


def test_letters_are_a_distribution():
    words = [w.encode() for w in prose(random.Random(14), 300).split()]
    context, symbol, byte, _ = hpylm._laid_out(words)
    grams, n = np.unique(context * hpylm.ALPHABET + symbol, return_counts=True)
    bytes_ = np.bincount(byte[byte >= 0], minlength=256)
    letters = hpylm.spell(grams, n, bytes_)
    assert np.allclose((10.0**letters.log).sum(1), 1, atol=1e-4)
    seen, unseen = letters.log10([b"thereon", b"xqzwkv\xc3\xa9"])
    assert unseen < seen < 0


def test_model_beats_add_one_on_documents_it_has_not_seen(spark):
    rng = random.Random(15)
    docs = spark.createDataFrame([(i, prose(rng, 80)) for i in range(150)], "doc_id long, text string")
    from tracewell.llm.common import remainder

    found = {r.held_out: r for r in hpylm.perplexity(hpylm.score(docs, remainder("doc_id", 7) == 2)).collect()}
    assert found[True].perplexity < found[True].base_perplexity


def test_words_are_scored_in_their_order(spark):
    """Contexts count: the same words in an order that training texts have are likelier."""
    from pyspark.sql import functions as F

    rng = random.Random(16)
    after = {w: rng.sample("abcdefghij", 2) for w in "abcdefghij"}
    rows = []
    for i in range(120):
        words = [rng.choice("abcdefghij")]
        while len(words) < 30:
            words.append(rng.choice(after[words[-1]]))
        rows.append((i, " ".join(words)))
    shuffled = rows[0][1].split()
    rng.shuffle(shuffled)
    rows += [(1000, rows[0][1]), (1001, " ".join(shuffled))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in hpylm.score(docs, F.col("doc_id") >= 1000).collect()}
    assert found[1000].score > found[1001].score + 5
    assert found[1000].base_score == pytest.approx(found[1001].base_score)
    assert found[1000].train_tokens == 120 * 31


def test_query_sharing_graph():
    """Every node is the sum of its terms, each item of its own; shared sets are added once."""
    rng = random.Random(3)
    core = set(range(20))
    wanted = [core | set(rng.sample(range(20, 120), 15)) for _ in range(12)] + [set(range(5)), set(), {119}]
    dag = search.mine(wanted, 120)
    members = [set(np.flatnonzero(dag.leaf == n)) & set().union(*wanted) for n in range(dag.leaves)]
    for a, b in dag.pairs:
        assert not members[a] & members[b]
        members.append(members[a] | members[b])
    for want, nodes in zip(wanted, dag.items, strict=True):
        assert sum(len(members[n]) for n in nodes) == len(want) and set().union(*(members[n] for n in nodes), set()) == want
    assert dag.pairs and dag.additions() < sum(max(0, len(w) - 1) for w in wanted) / 2
    doc, term = np.repeat(np.arange(4), 60), np.concatenate([rng.sample(sorted(set().union(*wanted)), 60) for _ in range(4)])
    value = np.array([rng.randrange(10**10) for _ in doc])
    scores = search.accumulate(dag, doc, term, value, 4)
    for i, want in enumerate(wanted):
        for d in range(4):
            assert scores[i, d] == sum(v for o, t, v in zip(doc, term, value, strict=True) if o == d and t in want)


def test_item_blocks(spark, tmp_path):
    """Blocks of a few terms give what one block gives."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, prose(rng, 60)) for i in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(i, prose(rng, 9)) for i in range(7)], "item_id long, text string")
    one = search.search(docs, items).collect()
    assert sorted(one) == sorted(search.search(docs, items, block_terms=10).collect()) and len(one) > 20


def test_multi_sequence_visits():
    """Cells come by falling bound, each once; bounds hold; searches stop early and are exact."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 300, (6, 8))
    vectors = np.floor(centres[rng.integers(0, 6, 3000)] + rng.normal(0, 12, (3000, 8)))
    labels, ids = rng.integers(0, 4, 3000), rng.permutation(3000)
    books = (negatives.codebook(vectors[:, :4], 16), negatives.codebook(vectors[:, 4:], 16))
    index = negatives.build(ids, ids, labels, vectors, books)
    anchor = vectors[0]
    seen = list(negatives.visits(index, anchor))
    assert len(seen) == len(books[0]) * len(books[1]) and [s[0] for s in seen] == sorted((s[0] for s in seen), reverse=True)
    assert sum(b - a for _, _, a, b in seen) == 3000
    for bound, floor, a, b in seen:
        scores = index.vectors[a:b] @ anchor
        assert not len(scores) or floor <= scores.min() and scores.max() <= bound
    scores = (vectors @ anchor).astype(int)
    order = np.lexsort((ids, -scores))
    own = [(int(scores[i]), int(ids[i])) for i in order if labels[i] == 1 and ids[i] != 7][:5]
    assert [(s, i) for s, i, _ in negatives.best_positives(index, 7, 1, anchor, 5)] == own
    windows = [(-(-30 * s // 100), 90 * s // 100) for s, _ in own]
    found, visited = negatives.best_in_windows(index, 1, anchor, windows, 10)
    for (least, most), got in zip(windows, found, strict=True):
        assert got == [(int(scores[i]), int(ids[i])) for i in order if labels[i] != 1 and least <= scores[i] <= most][:10]
    assert visited < len(index.cells)


@pytest.mark.parametrize("block", [1 << 20, 6000])
def test_jaccard_links(spark, block):
    """Chains and stars of near copies with a common passage, over several blocks of a
    cluster: the groups of all pairs. Without the orders' filters all pairs would be verified."""
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = []
    for _ in range(6):
        base = np.concatenate([passage, rng.integers(0, 2**63, 90, dtype=np.uint64)])
        for _ in range(12):
            changed = base.copy()
            n = int(rng.integers(6, 12))  # around eight changes each, two copies are just similar
            changed[rng.choice(150, n, replace=False)] = rng.integers(0, 2**63, n, dtype=np.uint64)
            sets.append(np.unique(changed))
    sets += [np.unique(rng.integers(0, 2**63, int(n), dtype=np.uint64)) for n in rng.integers(1, 9, 20)]
    sets += [np.unique(np.concatenate([passage, rng.integers(0, 2**63, 200, dtype=np.uint64)])) for _ in range(20)]
    held = [set(s.tolist()) for s in sets]
    near = lambda a, b: 100 * len(held[a] & held[b]) >= 80 * len(held[a] | held[b])
    want = brute.groups(range(len(sets)), near)
    table = spark.createDataFrame([(i, len(s), bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, n int, tokens binary")
    found = {r.node: r.root for r in connected_groups(jaccard.linked_sets(table, block=block)).collect()}
    assert {i: found.get(i, i) for i in range(len(sets))} == want and len(set(want.values())) < len(sets)
    classes = np.zeros(jaccard.SLOTS, np.uint8)
    i, j, verified = jaccard.similar_pairs(sets, sets, classes, 80)
    assert {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == {(a, b) for a in range(len(sets)) for b in range(len(sets)) if near(a, b)}
    assert verified < len(sets) ** 2 / 2


def test_counts_of_shared_tokens():
    rng = np.random.default_rng(6)
    homes = [np.unique(rng.integers(0, 50, int(n), dtype=np.uint64)) for n in rng.integers(1, 40, 30)]
    visitors = [np.unique(rng.integers(30, 4000, int(n), dtype=np.uint64)) for n in rng.integers(1, 300, 70)]
    for a, b in ((homes, visitors), (homes, homes), (visitors, visitors)):
        assert (jaccard.overlaps(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()
