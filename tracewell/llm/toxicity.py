"""Toxicity scores: gradient-boosted trees over dense features, isotonic calibration.

The features are densities of lexicon words (a fixed list and one learned from
the labels, as words and as word stems), how near they stand to a second person,
capitals, punctuation, and how often letters are hidden behind digits and signs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import documents, labelled, labels, per_text, remainder
from tracewell.llm.registry import query

# Common insults, and second persons of the four languages of the tables.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown fool "
    "jerk bastard bitch asshole retard crap shit fuck fucking kill hate ugly pig vermin filth imbecile "
    "dummkopf arschloch hure idioten schwein abschaum connard salope merde imbécile pute ordure "
    "estúpido imbécil mierda puta basura cabrón gilipollas".split()
)
YOU = frozenset(
    "you your yours yourself ur u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros".split()
)
# Signs that stand for letters in hidden words.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
STEMS = (4, 5, 6)
NEAR = 5

_EDGE = " \t\n\x0b\x0c\r.,;:!?\"'()[]{}«»„“”…|*#%&$"
_APART = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r.,;:?\"()[]{}«»„“”…|#%&<>/\\-", " "))
_HIDDEN = re.compile(r"[^\W\d_]+[0-9@$!*]+[^\W\d_]+")
_SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?![^\W\d_])")
_RUN = re.compile(r"([!?])\1")

FEATURES = (
    "fixed_density", "fixed_any", "word_density", "word_any", "stem_density", "stem_any", "distinct_hits",
    "near_you", "you_density", "capital_letters", "capital_words", "exclamations", "marks", "sign_runs",
    "hidden_density", "hidden_hits", "log_words",
)


def terms_of(text: str) -> list[str]:
    """Lower-case words, cut at punctuation."""
    return text.lower().translate(_APART).split()


@dataclass(frozen=True)
class Lexicon:
    words: frozenset[str] = frozenset()
    stems: frozenset[str] = frozenset()


def features(text: str, lexicon: Lexicon) -> list[float]:
    """``FEATURES`` of a whole text; all 0 for one without words."""
    words = terms_of(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    known, stems = lexicon.words, lexicon.stems
    s4, s5, s6 = STEMS
    present = set(words)
    by_list = {w for w in present if w in INSULTS}
    by_word = {w for w in present if w in known}
    by_stem = {w for w in present if w[:s4] in stems or w[:s5] in stems or w[:s6] in stems}
    hits = by_list | by_word | by_stem
    hit_at = [i for i, w in enumerate(words) if w in hits] if hits else []
    you_at = [i for i, w in enumerate(words) if w in YOU] if not present.isdisjoint(YOU) else []
    near = 0
    if hit_at and you_at:
        gaps = np.searchsorted(you_at, hit_at)
        you = np.array([-(10**9), *you_at, 10**9])
        at = np.array(hit_at)
        near = int((np.minimum(at - you[gaps], you[gaps + 1] - at) <= NEAR).sum())
    hidden = _HIDDEN.findall(text)
    shown = [w.lower().translate(LEET).replace("*", "") for w in hidden]
    spaced = [re.sub(r"[ .\-_*]", "", w).lower() for w in _SPACED.findall(text)]
    unveiled = sum(w in INSULTS or w in known for w in shown) + sum(w in INSULTS or w in known for w in spaced)
    raw = text.encode("utf-8", "replace")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=128)
    capitals, small = int(seen[65:91].sum()), int(seen[97:123].sum())
    upper = sum(1 for w in set(text.split()) if len(w) > 2 and w.isupper())
    counts = [sum(map(s.__contains__, words)) if s else 0 for s in (by_list, by_word, by_stem)]
    return [
        counts[0] / n, float(counts[0] > 0), counts[1] / n, float(counts[1] > 0), counts[2] / n, float(counts[2] > 0),
        float(len(hits)), near / n, len(you_at) / n, capitals / max(1, capitals + small), upper / n,
        int(seen[33]) / n, int(seen[[33, 42, 35, 63]].sum()) / n, len(_RUN.findall(text)) / n,
        len(hidden) / n, float(unveiled), float(np.log1p(n)),
    ]


def learned_lexicon(sample: DataFrame, most: int = 400, support: int = 5, odds: float = 3.0) -> Lexicon:
    """Words and stems that mark toxic texts of the labelled ``sample`` (text, y).

    Counted as the number of texts of each label that have the term; kept are the
    ``most`` with the largest smoothed log odds above ``odds`` and a ``support`` of
    toxic texts.
    """

    def terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for text, y in zip(frame["text"], frame["y"], strict=True):
                words = set(terms_of(text))
                found += [("w" + w, y) for w in words]
                found += [("s" + s, y) for s in {w[:k] for w in words for k in STEMS if len(w) >= k}]
            whole = pd.DataFrame(found, columns=["term", "y"])
            yield whole.groupby("term")["y"].agg(hit="sum", n="count").reset_index()

    totals = sample.agg(F.sum("y").alias("p"), F.count("*").alias("n")).first()
    toxic, clean = (totals.p or 0), totals.n - (totals.p or 0)
    share = F.log((F.col("hit") + 0.5) / (toxic + 1.0)) - F.log((F.col("n") - F.col("hit") + 0.5) / (clean + 1.0))
    found = (
        sample.select("text", "y").mapInPandas(terms, "term string, hit long, n long")
        .groupBy("term").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"))
        .filter(F.col("hit") >= support).withColumn("odds", share).filter(F.col("odds") > odds)
        .orderBy(F.desc("odds"), "term").limit(most).collect()
    )
    return Lexicon(
        frozenset(r.term[1:] for r in found if r.term[0] == "w"),
        frozenset(r.term[1:] for r in found if r.term[0] == "s"),
    )


@dataclass
class Tree:
    """A tree of fixed depth: node k has children 2k+1 and 2k+2; ``value`` holds the last level."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaf(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), np.int64)
        depth = int(np.log2(len(self.value)))
        index = np.arange(len(rows))
        for _ in range(depth):
            at = 2 * at + 1 + (rows[index, self.feature[at]] > self.cut[at])
        return at - (len(self.value) - 1)


@dataclass
class Boosted:
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    # Calibration: margins and the probabilities that belong to them, both rising.
    knots: np.ndarray = field(default_factory=lambda: np.array([-1.0, 1.0]))
    levels: np.ndarray = field(default_factory=lambda: np.array([0.27, 0.73]))

    def margin(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.start)
        for tree in self.trees:
            total += tree.value[tree.leaf(rows)]
        return total

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.interp(self.margin(rows), self.knots, self.levels)


def _cuts(values: np.ndarray, most: int = 48) -> np.ndarray:
    distinct = np.unique(values)
    if len(distinct) <= most:
        return (distinct[1:] + distinct[:-1]) / 2
    return np.unique(np.quantile(values, np.linspace(0, 1, most + 2)[1:-1]))


def boost(
    rows: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, ridge: float = 1.0,
    least: int = 5,
) -> Boosted:
    """Trees grown level by level on histograms of gradients of the logistic loss."""
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    model = Boosted(float(np.log(share / (1 - share))))
    cuts = [_cuts(rows[:, f]) for f in range(rows.shape[1])]
    bins = np.stack([np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(cuts)], 1)
    margin = np.full(len(rows), model.start)
    inner, leaves = 2**depth - 1, 2**depth
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(rows), np.int64)
        for node in range(inner):
            here = np.flatnonzero(at == node)
            best = 1e-6
            for f, c in enumerate(cuts):
                if not len(c) or len(here) < 2 * least:
                    continue
                b = bins[here, f]
                gs = np.bincount(b, g[here], len(c) + 1).cumsum()
                hs = np.bincount(b, h[here], len(c) + 1).cumsum()
                ns = np.bincount(b, minlength=len(c) + 1).cumsum()
                gain = gs**2 / (hs + ridge) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + ridge) - gs[-1] ** 2 / (hs[-1] + ridge)
                gain[(ns < least) | (ns[-1] - ns < least)] = 0
                k = int(gain[:-1].argmax())
                if gain[k] > best:
                    best, feature[node], cut[node] = gain[k], f, c[k]
            at[here] = 2 * node + 1 + (rows[here, feature[node]] > cut[node])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        model.trees.append(Tree(feature, cut, value))
        margin += value[leaf]
    return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising levels by pooling adjacent violators: block centres and smoothed shares.
    Between centres the levels are read off a straight line, so that ranks are kept."""
    blocks: list[list[float]] = []  # sum of labels, rows, sum of margins
    for m, label in sorted(zip(margin.tolist(), y.tolist(), strict=True)):
        blocks.append([label, 1.0, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    centres = np.array([b[2] / b[1] for b in blocks])
    levels = np.array([(b[0] + 0.01) / (b[1] + 0.02) for b in blocks])
    knots = np.concatenate([[centres[0] - 8], centres, [centres[-1] + 8]])
    levels = np.maximum.accumulate(np.concatenate([[levels[0] / 2], levels, [(1 + levels[-1]) / 2]]))
    return knots, levels


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted


def with_features(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...]) -> DataFrame:
    def compute(texts: list[str]) -> list[pa.Array]:
        return [pa.array([features(t, lexicon) for t in texts], pa.list_(pa.float64()))]

    return per_text(docs, keep, compute, "f array<double>")


def learn(docs: DataFrame, marks: DataFrame, usable=None, max_labelled: int = 20_000) -> Model:
    """Learns from at most ``max_labelled`` labelled documents (a documented bound;
    only counts of terms and feature rows come to the driver). Lexicon and trees
    come from four fifths of them, the calibration from the last. With one label
    only, the score is a constant share."""
    sample = labelled(docs, marks, "toxic", F.lit(True) if usable is None else usable, max_labelled)
    lexicon = learned_lexicon(sample.filter("fold > 0"))
    rows = with_features(sample, lexicon, ("doc_id", "y", "fold")).orderBy("doc_id").toPandas()
    if rows["y"].nunique() < 2:
        share = float(rows["y"].mean()) if len(rows) else 0.0
        return Model(lexicon, Boosted(0.0, [], np.array([-1.0, 1.0]), np.array([share, share])))
    x, y, held = np.array(rows["f"].tolist()), rows["y"].to_numpy(), (rows["fold"] == 0).to_numpy()
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held = np.zeros(len(y), bool)
    model = boost(x[~held], y[~held])
    calibrate = held if held.any() else ~held
    model.knots, model.levels = isotonic(model.margin(x[calibrate]), y[calibrate])
    return Model(lexicon, model)


def score(docs: DataFrame, model: Model, at: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of every document, whole texts, in one pass.

    A null or empty text has the score of a text without any feature; equal texts
    have equal scores, repeated rows stay, other columns are not read.
    """

    def compute(texts: list[str]) -> list[pa.Array]:
        rows = np.array([features(t, model.lexicon) for t in texts]).reshape(-1, len(FEATURES))
        scores = model.trees.score(rows)
        return [pa.array(scores), pa.array((scores >= at).astype(np.int32))]

    return per_text(docs, ["doc_id"], compute, "score double, predicted int")


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs, labels(spark, sf_dir), remainder("doc_id", 3) != 1)
    return score(docs, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
