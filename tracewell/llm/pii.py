"""Personal data: fixed patterns, and a linear-chain conditional random field that adds to them.

The field tags whitespace-separated tokens by the shapes of a token and its
neighbours. It is trained in numpy by maximum likelihood from the small table of
``pii_examples``, and decoded by Viterbi over padded batches of token windows.
"""

from __future__ import annotations

import functools
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracewell.llm.common import documents, per_text
from tracewell.llm.pii_examples import EXAMPLES
from tracewell.llm.registry import query

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # index of the kind, start, end (exclusive), in code points

# The base patterns. A digit run cannot be entered in its middle, so
# the look-behind and the possessive runs change no match, only the cost of failing.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from the @ outwards."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append((0, start, free))
        at = text.find("@", max(at + 1, free))
    return found


def valid(kind: int, value: str) -> bool:
    digits = "".join(c for c in value if "0" <= c <= "9")
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in value.split("."))
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == 0 or 8 <= len(digits) <= 15


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; failing ones are dropped."""
    found = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            if kind != 3 or "+" in text:
                found += [(kind, *m.span()) for m in pattern.finditer(text) if valid(kind, m.group())]
    return found


# --- the field -----------------------------------------------------------------

TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_SIGN = re.compile(r"[0-9@]|[\[(](?:at|ät|dot|punkt)[\])]|(?<=\s)(?:dot|punkt)(?=\s)", re.IGNORECASE)
# Ways to write the signs of an address, with a space on both sides or on none.
_AT = re.compile(r"\s+(?:at|ät|@|[\[(](?:at|ät)[\])])\s+|@|[\[(](?:at|ät)[\])]", re.IGNORECASE)
_DOT = re.compile(r"\s+(?:dot|punkt|\.|[\[(](?:\.|dot|punkt)[\])])\s+|\.|[\[(](?:\.|dot|punkt)[\])]", re.IGNORECASE)
_WRITTEN_EMAIL = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+")
_WRITTEN_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_AROUND = 5
_LONGEST = 16  # tokens at the end of a span that may be given up
_OPEN, _CLOSE = "\"'<«„“", ".,;:!?\"'>»“”"
_RUNS = re.compile(r"(.)\1+")
WORDS = frozenset(
    "call phone tel telephone telefon fax ring mobile number numero mail e-mail email contact write reach send "
    "card visa kreditkarte carte host client from to ip login at dot version page pages chapter".split()
)


def shape(token: str) -> str:
    """The token with letters as x, digits as d, runs shortened."""
    out = "".join("d" if c.isdigit() else "x" if c.isalpha() else c for c in token[:64])
    return _RUNS.sub(r"\1", out)


def name_shape(token: str) -> str:
    """The shape with digits and underscores of a token that has a letter counted as letters."""
    shaped = shape(token)
    return _RUNS.sub(r"\1", re.sub("[d_]", "x", shaped)) if "x" in shaped else shaped


def token_features(tokens: list[str], at: int) -> list[str]:
    token = tokens[at].strip(_OPEN).rstrip(_CLOSE)
    digits = sum(map(str.isdigit, token))
    low = token.lower().strip(".:,")
    shaped = shape(token)
    own = [
        "bias", "s=" + shaped, "n=" + name_shape(token), f"d={min(digits, 20)}", f"l={min(len(token), 24)}", "c=" + "".join(sorted(set(shaped)))[:12],
    ]
    if tokens[at][-1] in _CLOSE:
        own.append("closes")
    if at and tokens[at - 1][-1] in _CLOSE:
        own.append("after-close")
    if low in WORDS:
        own.append("w=" + low)
    if re.fullmatch(r"[\[(](at|ät|dot|punkt)[\])]", low):
        own.append("joint")
    if "(at)" in low or "[at]" in low or "@" in low[1:-1]:
        own.append("inner-at")
    plain = _DOT.sub(".", _AT.sub("@", token))
    if _WRITTEN_EMAIL.fullmatch(plain):
        own.append("whole-address")
    elif _WRITTEN_IP.fullmatch(plain):
        own.append("whole-ip")
    own.append(f"dots={min(3, token.count('.'))}" + ("d" if digits else "x"))
    for step in (-3, -2, -1, 1, 2, 3):
        near = tokens[at + step] if 0 <= at + step < len(tokens) else ""
        if abs(step) < 3:
            bare = near.strip(_OPEN).rstrip(_CLOSE)
            own.append(f"s{step}=" + (shape(bare) if near else "edge"))
            own.append(f"n{step}=" + (name_shape(bare) if near else "edge"))
        word = near.lower().strip(".:,")
        if (abs(step) == 1 and word in WORDS) or word in ("at", "dot", "punkt"):
            own.append(f"w{step}=" + word)
    return own


@dataclass
class Field:
    names: dict[str, int]
    weights: np.ndarray  # features x tags
    moves: np.ndarray  # tags x tags
    first: np.ndarray

    def emissions(self, tokens: list[str]) -> np.ndarray:
        out = np.zeros((len(tokens), len(TAGS)))
        for at in range(len(tokens)):
            known = [self.names[f] for f in token_features(tokens, at) if f in self.names]
            out[at] = self.weights[known].sum(0)
        return out


def _forbidden() -> np.ndarray:
    """I-k may only follow B-k or I-k."""
    closed = np.zeros((len(TAGS), len(TAGS)), bool)
    for j, tag in enumerate(TAGS):
        if tag[0] == "I":
            for i, before in enumerate(TAGS):
                closed[i, j] = before[2:] != tag[2:]
    return closed


def _labelled(line: str) -> tuple[list[str], list[int]]:
    plain, spans = "", []
    for part in re.split(r"(\{\w+:[^}]*\})", line):
        marked = re.fullmatch(r"\{(\w+):([^}]*)\}", part)
        if marked:
            spans.append((marked[1], len(plain), len(plain) + len(marked[2])))
            plain += marked[2]
        else:
            plain += part
    tokens, tags = [], []
    for m in _TOKEN.finditer(plain):
        kind = next((s for s in spans if m.start() < s[2] and m.end() > s[1]), None)
        tags.append(0 if not kind else TAGS.index(("B-" if m.start() <= kind[1] else "I-") + kind[0]))
        tokens.append(m.group())
    return tokens, tags


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@functools.lru_cache(maxsize=1)
def trained(rounds: int = 250, rate: float = 0.1, ridge: float = 0.02) -> Field:
    """Maximum likelihood by forward and backward passes over all examples at once."""
    rows = [_labelled(line) for line in EXAMPLES]
    names: dict[str, int] = {}
    ids = [[[names.setdefault(f, len(names)) for f in token_features(t, i)] for i in range(len(t))] for t, _ in rows]
    size, longest, tags = len(rows), max(len(t) for t, _ in rows), len(TAGS)
    mask = np.zeros((size, longest), bool)
    gold = np.zeros((size, longest), np.int64)
    where = [(s, t, f) for s, row in enumerate(ids) for t, fs in enumerate(row) for f in fs]
    ws, wt, wf = map(np.array, zip(*where, strict=True))
    for s, (tokens, marks) in enumerate(rows):
        mask[s, : len(tokens)], gold[s, : len(tokens)] = True, marks
    field = Field(names, np.zeros((len(names), tags)), np.zeros((tags, tags)), np.zeros(tags))
    closed = _forbidden()
    never = np.array([t[0] == "I" for t in TAGS])
    one = np.eye(tags)[gold] * mask[..., None]
    params = [field.weights, field.moves, field.first]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for turn in range(1, rounds + 1):
        emit = np.zeros((size, longest, tags))
        np.add.at(emit, (ws, wt), field.weights[wf])
        moves = np.where(closed, -1e4, field.moves)
        forward = np.zeros_like(emit)
        forward[:, 0] = emit[:, 0] + np.where(never, -1e4, field.first)
        for t in range(1, longest):
            step = _logsum(forward[:, t - 1, :, None] + moves, 1) + emit[:, t]
            forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
        total = _logsum(forward[:, -1], 1)
        backward = np.zeros_like(emit)
        edge = np.zeros((tags, tags))
        for t in range(longest - 2, -1, -1):
            onward = emit[:, t + 1] + backward[:, t + 1]
            backward[:, t] = np.where(mask[:, t + 1, None], _logsum(moves + onward[:, None, :], 2), 0.0)
            joint = forward[:, t, :, None] + moves + onward[:, None, :] - total[:, None, None]
            edge += (np.exp(np.minimum(joint, 0)) * mask[:, t + 1, None, None]).sum(0)
        # Sequences shorter than the longest end where their mask does.
        marginal = np.exp(np.minimum(forward + backward - total[:, None, None], 0)) * mask[..., None]
        gap = one - marginal
        grads = [np.zeros_like(field.weights), np.zeros((tags, tags)), gap[:, 0].sum(0)]
        np.add.at(grads[0], wf, gap[ws, wt])
        follows = mask[:, 1:]
        np.add.at(grads[1], (gold[:, :-1][follows], gold[:, 1:][follows]), 1.0)
        grads[1] -= edge
        for k, p in enumerate(params):
            g = grads[k] - ridge * p
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            p += rate * (mean[k] / (1 - 0.9**turn)) / (np.sqrt(square[k] / (1 - 0.999**turn)) + 1e-8)
    field.moves[closed] = -1e4
    field.first[never] = -1e4
    return field


def viterbi(field: Field, windows: list[np.ndarray]) -> list[np.ndarray]:
    """Best tags of many windows of emissions: one padded batch, one step per place."""
    if not windows:
        return []
    lengths = np.array([len(w) for w in windows])
    longest, tags = int(lengths.max()), len(TAGS)
    emit = np.zeros((len(windows), longest, tags))
    for i, w in enumerate(windows):
        emit[i, : len(w)] = w
    best = emit[:, 0] + field.first
    back = np.zeros((len(windows), longest, tags), np.int8)
    for t in range(1, longest):
        through = best[:, :, None] + field.moves
        back[:, t] = through.argmax(1)
        best = np.where((t < lengths)[:, None], through.max(1) + emit[:, t], best)
    tag = best.argmax(1)
    out = np.zeros((len(windows), longest), np.int64)
    for t in range(longest - 1, -1, -1):
        inside = t < lengths
        out[inside, t] = tag[inside]
        if t:
            tag = np.where(inside, back[np.arange(len(windows)), t, tag], tag)
    return [out[i, :n] for i, n in enumerate(lengths)]


def windows_of(text: str) -> list[list[tuple[int, int]]]:
    """Runs of tokens within ``_AROUND`` tokens of one with a digit, an @ or a written-out
    @; other tokens are outside by construction and need no decoding."""
    marks = [m.start() for m in _SIGN.finditer(text)]
    if not marks:
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    starts = np.array([s for s, _ in tokens])
    near = np.zeros(len(tokens), bool)
    for at in np.unique(np.searchsorted(starts, marks, side="right") - 1):
        near[max(0, at - _AROUND) : at + _AROUND + 1] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[0], near.view(np.int8), [0]])))
    return [tokens[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _spans(text: str, places: list[tuple[int, int]], tags: np.ndarray) -> list[Span]:
    found: list[tuple[int, int, list[int]]] = []  # kind, start, ends of the tokens
    for (start, end), tag in zip(places, tags, strict=True):
        if tag:
            kind = (int(tag) - 1) // 2
            if TAGS[tag][0] == "B" or not found or found[-1][0] != kind:
                found.append((kind, start, [end]))
            else:
                found[-1][2].append(end)
    out = []
    for kind, start, ends in found:
        while start < ends[0] and text[start] in _OPEN:
            start += 1
        # Tokens at the end that the field tagged too many are given up.
        for end in reversed(ends[-_LONGEST:]):
            while start < end and text[end - 1] in _CLOSE:
                end -= 1
            if start < end and _plausible(kind, text[start:end]):
                out.append((kind, start, end))
                break
    return out


def _plausible(kind: int, value: str) -> bool:
    """What a tagged span must have to be kept (the exact check after the field): with the
    signs of an address in any spelling, it is one; numbers have the length of their kind,
    seven digits for a local phone, fifteen for a card of the kinds that start with 34 or 37."""
    if kind <= 1:
        plain = _DOT.sub(".", _AT.sub("@", value) if kind == 0 else value)
        return bool((_WRITTEN_EMAIL, _WRITTEN_IP)[kind].fullmatch(plain)) and valid(kind, plain)
    if re.search(r"[^\W\d_]", value):
        return False
    digits = "".join(c for c in value if "0" <= c <= "9")
    if kind == 2:
        return valid(2, value) or (len(digits) == 15 and digits[:2] in ("34", "37") and luhn(digits))
    return 7 <= len(digits) <= 15


@dataclass(frozen=True)
class Found:
    base: list[Span]
    spans: list[Span]


def find(texts: list[str], field: Field) -> list[Found]:
    """Base spans and all spans of whole texts; the field adds spans that touch no base span."""
    base = [base_spans(t) for t in texts]
    places, owners = [], []
    for i, text in enumerate(texts):
        for window in windows_of(text):
            places.append(window)
            owners.append(i)
    added: list[list[Span]] = [[] for _ in texts]
    order = sorted(range(len(places)), key=lambda k: len(places[k]))
    for start in range(0, len(order), 512):  # batches of about equal length
        part = order[start : start + 512]
        emissions = [field.emissions([texts[owners[k]][a:b] for a, b in places[k]]) for k in part]
        for k, tags in zip(part, viterbi(field, emissions), strict=True):
            if tags.any():
                added[owners[k]] += _spans(texts[owners[k]], places[k], tags)
    out = []
    for own, more in zip(base, added, strict=True):
        new = [s for s in more if all(s[2] <= b[1] or s[1] >= b[2] for b in own)] if more else []
        out.append(Found(sorted(own), sorted(own + new)))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans, n_added.

    One pass over whole texts, no shuffle. A null or empty text has no spans;
    repeated rows and ids stay; other columns are not read.
    """

    field = trained()

    def compute(texts: list[str]) -> list[pa.Array]:
        found = find(texts, field)
        counts = [pa.array([sum(s[0] == k for s in f.base) for f in found], pa.int64()) for k in range(len(KINDS))]
        hashes = [hashlib.sha256(joined(f.base).encode()).hexdigest() for f in found]
        return [
            *counts, pa.array(hashes, pa.string()), pa.array([joined(f.spans) for f in found], pa.string()),
            pa.array([len(f.spans) - len(f.base) for f in found], pa.int64()),
        ]

    schema = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return per_text(docs, ["doc_id"], compute, schema)


@query("op4_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))
