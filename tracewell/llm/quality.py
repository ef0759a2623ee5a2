"""Quality scores: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn over the features, one feature at a time, then
over the strongest pairs. What they add up to is a lookup table per feature and
per pair of binned values, so a score is a sum of table entries.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import documents, free_name, labelled, labels, per_text, remainder
from tracewell.llm.registry import query

FEATURES = (
    "log_words", "chars_per_word", "upper_share", "digit_share", "sign_share", "mark_share", "bar_share",
    "exclamation_share", "full_stops", "commas", "non_ascii_share", "distinct_words", "commonest_word",
    "words_per_line", "dup_lines", "short_lines", "ended_lines", "byte_entropy", "compression", "long_words",
    "dup_pairs", "control_share",
)
# Fixed value: bytes that compression is measured on at a time.
_BLOCK = 1 << 16


def features(text: str) -> list[float]:
    """``FEATURES`` of a whole text; all 0 for one without words."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    total = len(raw)
    chars = total - int(seen[[9, 10, 11, 12, 13, 32]].sum())
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    codes = np.fromiter(map(hash, words), np.int64, n)
    distinct, times = np.unique(codes, return_counts=True)
    pairs = codes[1:] * 31 + codes[:-1]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = seen[seen > 0] / total
    packed = sum(len(zlib.compress(raw[i : i + _BLOCK], 1)) for i in range(0, total, _BLOCK))
    marks = int(seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum())
    return [
        float(np.log1p(n)), chars / n, upper / max(1, upper + lower), int(seen[48:58].sum()) / chars,
        int(seen[[35, 36, 37, 38, 42, 60, 62]].sum()) / n, marks / n, int(seen[124]) / n, int(seen[33]) / n,
        int(seen[46]) / n, int(seen[44]) / n, int(seen[128:].sum()) / total, len(distinct) / n, int(times.max()) / n,
        n / len(lines), 1 - len(set(lines)) / len(lines), sum(len(x) < 20 for x in lines) / len(lines),
        sum(x.rstrip()[-1:] in b".!?:\"'" for x in lines) / len(lines), float(-(share * np.log2(share)).sum()),
        packed / total, sum(len(w) > 24 for w in words) / n,
        1 - len(np.unique(pairs)) / len(pairs) if len(pairs) else 0.0, int(seen[:9].sum() + seen[14:32].sum()) / total,
    ]


@dataclass
class Additive:
    """``edges[f]`` cut feature f into bins; ``single[f]`` and ``pair[(f, g)]`` are looked up by bin."""

    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    single: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def margin(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.start)
        for f, table in enumerate(self.single):
            total += table[np.searchsorted(self.edges[f], rows[:, f])]
        for (f, g), table in self.pair.items():
            total += table[np.searchsorted(self.coarse[f], rows[:, f]), np.searchsorted(self.coarse[g], rows[:, g])]
        return total

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -35, 35)))


def _edges(values: np.ndarray, most: int) -> np.ndarray:
    distinct = np.unique(values)
    if len(distinct) <= most:
        return (distinct[1:] + distinct[:-1]) / 2
    return np.unique(np.quantile(values, np.linspace(0, 1, most + 1)[1:-1]))


def _shallow(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The values of a tree over one row of bins: greedily cut into ``leaves`` runs."""
    parts = [(0, len(g))]
    cg, ch = np.concatenate([[0], g.cumsum()]), np.concatenate([[0], h.cumsum()])
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for at, (a, b) in enumerate(parts):
            if b - a > 1:
                cuts = np.arange(a + 1, b)
                gain = worth(a, cuts) + worth(cuts, b) - worth(a, b)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], at, int(cuts[k]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    values = np.zeros(len(g))
    for a, b in parts:
        values[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return values


def _quarters(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree over a grid that cuts both features once."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def quarters(c: np.ndarray) -> list[np.ndarray]:
        a, right, down, all_ = c, c[:, -1:], c[-1:, :], c[-1, -1]
        return [a, right - a, down - a, all_ - right - down + a]

    qg, qh = quarters(cg), quarters(ch)
    gain = sum(x**2 / (w + ridge) for x, w in zip(qg, qh, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    values = np.empty_like(g)
    corners = [x[i, j] / (w[i, j] + ridge) for x, w in zip(qg, qh, strict=True)]
    values[: i + 1, : j + 1], values[: i + 1, j + 1 :] = corners[0], corners[1]
    values[i + 1 :, : j + 1], values[i + 1 :, j + 1 :] = corners[2], corners[3]
    return float(gain[i, j]), values


def fit(
    rows: np.ndarray, y: np.ndarray, rounds: int = 60, pairs: int = 8, bins: int = 64, pair_bins: int = 12,
    leaves: int = 4, rate: float = 0.12, ridge: float = 2.0,
) -> Additive:
    """Cyclic boosting of the logistic loss: every round visits every feature once."""
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    model = Additive(float(np.log(share / (1 - share))))
    width = rows.shape[1]
    model.edges = [_edges(rows[:, f], bins) for f in range(width)]
    model.coarse = [_edges(rows[:, f], pair_bins) for f in range(width)]
    at = [np.searchsorted(model.edges[f], rows[:, f]) for f in range(width)]
    model.single = [np.zeros(len(e) + 1) for e in model.edges]
    margin = np.full(len(rows), model.start)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(width):
            g, h = gradients()
            n = len(model.single[f])
            step = rate * _shallow(np.bincount(at[f], g, n), np.bincount(at[f], h, n), leaves, ridge)
            model.single[f] += step
            margin += step[at[f]]
    rough = [np.searchsorted(model.coarse[f], rows[:, f]) for f in range(width)]
    size = [len(c) + 1 for c in model.coarse]
    flat = lambda f, g: rough[f] * size[g] + rough[g]

    def grid(f: int, g: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(flat(f, g), values, size[f] * size[g]).reshape(size[f], size[g])

    g, h = gradients()
    gains = {(a, b): _quarters(grid(a, b, g), grid(a, b, h), ridge)[0] for a in range(width) for b in range(a)}
    for key in sorted(gains, key=lambda k: (-gains[k], k))[:pairs]:
        model.pair[key] = np.zeros((size[key[0]], size[key[1]]))
    for _ in range(rounds // 2):
        for a, b in model.pair:
            g, h = gradients()
            step = rate * _quarters(grid(a, b, g), grid(a, b, h), ridge)[1]
            model.pair[(a, b)] += step
            margin += step[rough[a], rough[b]]
    return model


def learn(docs: DataFrame, marks: DataFrame, usable: Column | None = None, max_labelled: int = 20_000) -> Additive:
    """Learns from at most ``max_labelled`` labelled documents (a documented bound;
    only their feature rows come to the driver). With one label only, or none, the
    score is constant: that label's share, or one half."""
    sample = labelled(docs, marks, "quality", F.lit(True) if usable is None else usable, max_labelled)

    def compute(texts: list[str]) -> list[pa.Array]:
        return [pa.array([features(t) for t in texts], pa.list_(pa.float64()))]

    rows = per_text(sample, ["doc_id", "y"], compute, "f array<double>").orderBy("doc_id").toPandas()
    if rows["y"].nunique() < 2:
        share = float(rows["y"].mean()) if len(rows) else 0.5
        return Additive(float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    return fit(np.array(rows["f"].tolist()), rows["y"].to_numpy())


def score(docs: DataFrame, model: Additive, keep: tuple[str, ...] = ("doc_id",), at: float = 0.3) -> DataFrame:
    """``keep``, score and predicted of every document, whole texts, in one pass.

    A null or empty text has the score of a text without any feature; equal texts
    have equal scores, repeated rows stay.
    """

    def compute(texts: list[str]) -> list[pa.Array]:
        scores = model.score(np.array([features(t) for t in texts]).reshape(-1, len(FEATURES)))
        return [pa.array(scores), pa.array((scores >= at).astype(np.int32))]

    return per_text(docs, keep, compute, "score double, predicted int")


def keep_good(docs: DataFrame, model: Additive, at: float = 0.3) -> DataFrame:
    """The documents that score at least ``at``, with the columns of ``docs``; no shuffle."""
    mark = free_name(docs, "_quality")

    def compute(texts: list[str]) -> list[pa.Array]:
        return [pa.array(model.score(np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))))]

    return per_text(docs, docs.columns, compute, f"{mark} double").filter(F.col(mark) >= at).drop(mark)


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs, labels(spark, sf_dir), remainder("doc_id", 5) != 0)
    return score(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
