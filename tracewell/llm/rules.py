"""Quality rules as a learned decision list.

Statistics of a text come from one pass in numpy; rules are learned from labelled
statistics by sequential covering (grow a conjunction of thresholds by information
gain, prune it on rows kept aside, take out what it covers, repeat) and leave as
ordered Spark conditional expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import documents, labelled, labels, per_text
from tracewell.llm.registry import query

# Fixed values.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

_SPACE_BYTES = np.frombuffer(SPACES.encode(), np.uint8)
_SYMBOL_BYTES = np.frombuffer(SYMBOLS.encode(), np.uint8)
_MIX = np.uint64(0x9E3779B97F4A7C15)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Shares that rules may test; each is 0 for a text without words.
SHARES = (
    "chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share",
    "stop_share", "exclamation_share", "unique_share", "words_per_line", "plain_share",
)
SCHEMA = ", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in SHARES])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = codes[:n].copy()
    for step in range(1, window):
        rolled = rolled * _MIX + codes[step : step + n]
    ordered = np.sort(rolled)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(rolled, twice))
    edges = np.zeros(len(words) + 1, np.int64)
    edges[starts] += 1
    np.subtract.at(edges, starts + window, 1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def statistics(text: str) -> tuple:
    """``COUNTS`` and ``SHARES`` of a whole text."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # bytes split at exactly the six space characters
    n = len(words)
    if not n:
        return (0,) * len(COUNTS) + (0.0,) * len(SHARES)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    word_chars = len(text) - int(seen[_SPACE_BYTES].sum())
    symbols = int(seen[_SYMBOL_BYTES].sum())
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup_lines = len(lines) - len(set(lines))
    repeated = repeated_words(words)
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    return (
        n, word_chars, symbols, dup_lines, repeated,
        word_chars / n, symbols / n, dup_lines / len(lines), repeated / n, upper / max(1, upper + lower),
        int(seen[48:58].sum()) / word_chars, int(seen[46] + seen[33] + seen[63]) / n, int(seen[33]) / n,
        len(set(words)) / n, n / len(lines), (upper + lower + int(seen[128:].sum())) / max(1, len(raw)),
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, y and fold (if there) and the statistics; one pass, no shuffle."""

    def compute(texts: list[str]) -> list[pa.Array]:
        rows = [statistics(t) for t in texts]
        columns = list(zip(*rows, strict=True)) if rows else [()] * (len(COUNTS) + len(SHARES))
        return [pa.array(c, pa.int64() if i < len(COUNTS) else pa.float64()) for i, c in enumerate(columns)]

    return per_text(docs, [c for c in ("doc_id", "y", "fold") if c in docs.columns], compute, SCHEMA)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, rows: pd.DataFrame) -> np.ndarray:
        values = rows[self.feature].to_numpy()
        return values > self.threshold if self.above else values <= self.threshold

    def expression(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, rows: pd.DataFrame) -> np.ndarray:
    held = np.ones(len(rows), bool)
    for condition in rule:
        held &= condition.holds(rows)
    return held


def _grow(rows: pd.DataFrame, bad: np.ndarray, features: list[str], most: int) -> Rule:
    """Adds the threshold with the largest information gain until no good row is covered."""
    rule: Rule = ()
    inside = np.ones(len(rows), bool)
    while len(rule) < most and (inside & ~bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        now, best = np.log2(p / (p + n)), (1e-9, None)
        for feature in features:
            values = rows[feature].to_numpy()
            for cut in np.unique(np.quantile(values[inside], np.linspace(0.01, 0.99, 50))):
                for above in (True, False):
                    held = inside & ((values > cut) if above else (values <= cut))
                    p1, n1 = (held & bad).sum(), (held & ~bad).sum()
                    if p1:
                        gain = p1 * (np.log2(p1 / (p1 + n1)) - now)
                        if gain > best[0]:
                            best = (gain, Condition(feature, above, float(cut)))
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(rows)
    return rule


def _prune(rule: Rule, rows: pd.DataFrame, bad: np.ndarray) -> Rule:
    """Drops last conditions as long as that does not make it worse on rows not grown on."""

    def worth(candidate: Rule) -> float:
        held = covers(candidate, rows)
        p, n = (held & bad).sum(), (held & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=rule)


def learn_rules(
    rows: pd.DataFrame, features: list[str] | None = None, most_rules: int = 12, most_conditions: int = 4,
    precision: float = 0.97,
) -> list[Rule]:
    """Rules that reject, in order, from rows with ``y`` (1 good) and ``fold``.

    Fold 0 is kept aside for pruning and for the last word: a rule stays if, on
    the rows of that fold that earlier rules left, at least ``precision`` of what
    it covers is bad. Needs rows of both labels; with fewer than ten bad rows
    nothing is learned.
    """
    features = features or list(SHARES)
    held_back = (rows["fold"] == 0).to_numpy()
    grow, prune = rows[~held_back].reset_index(drop=True), rows[held_back].reset_index(drop=True)
    rules: list[Rule] = []
    while len(rules) < most_rules:
        bad = (grow["y"] == 0).to_numpy()
        if bad.sum() < 10 or bad.all():
            break
        rule = _prune(_grow(grow, bad, features, most_conditions), prune, (prune["y"] == 0).to_numpy())
        if not rule:
            break
        aside = covers(rule, prune)
        p, n = int((prune["y"][aside] == 0).sum()), int(aside.sum())
        trained = covers(rule, grow)
        if n < 3 or p < precision * n or (bad & trained).sum() < precision * trained.sum():
            break
        rules.append(rule)
        grow, prune = grow[~trained].reset_index(drop=True), prune[~aside].reset_index(drop=True)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True unless a rule rejects: one conditional expression, rules in order."""
    kept = F.lit(True)
    for rule in reversed(rules):
        condition = F.lit(True)
        for part in rule:
            condition &= part.expression()
        kept = F.when(condition, F.lit(False)).otherwise(kept)
    return kept


def describe(rules: list[Rule]) -> list[str]:
    return [
        "reject if " + " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.4g}" for c in rule)
        for rule in rules
    ]


def base_failed() -> Column:
    """Too short, or more than 30 % of its words in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def learned_rules(docs: DataFrame, marks: DataFrame, max_labelled: int = 20_000) -> list[Rule]:
    """The list learned from at most ``max_labelled`` labelled documents (a documented
    bound; only their statistics come to the driver)."""
    sample = labelled(docs, marks, "quality", F.lit(True), max_labelled)
    rows = with_statistics(sample).filter(~base_failed()).orderBy("doc_id").toPandas()
    return learn_rules(rows)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, statistics, base_failed and kept of every document.

    A null text has no words and fails the base; equal texts get equal verdicts;
    repeated rows come out as often as they go in.
    """
    return with_statistics(docs.select("doc_id", "text")).withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & verdict(rules)
    )


@query("op9_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rules = learned_rules(docs, labels(spark, sf_dir))
    return judge(docs, rules).select("doc_id", *COUNTS, "base_failed", "kept")
