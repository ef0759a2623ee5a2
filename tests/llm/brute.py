"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def remainder(doc_id, modulus):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def groups(nodes, linked):
    """node -> smallest node of its connected group."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    ordered = sorted(nodes)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def targets(sizes, most=3):
    """Source -> target: share by weight, cap, and share what is above again until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        level = rest / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if level * weight[s] > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in order}
        capped |= above


def simhash(text, k=4):
    w = words(lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def statistics(text, window=8):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    inside = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)
    )


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def personal(text):
    found = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c.isdigit()]
            doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
            fine = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if fine:
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return found


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _hash_long(x, seed=42):
    return xxhash.xxh64_intdigest(struct.pack("<q", x), seed)


def order_signature(text, k=3, chosen=2, cell_bits=6, kept=16):
    """The cells of an Order MinHash signature, from the definition."""
    w = WORD.findall(text) or [""]
    hashes = [_signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in w]
    kmers = []
    for i in range(max(1, len(w) - k + 1)):
        seed = 42
        for h in hashes[i : i + k]:
            seed = _hash_long(h, seed)
        kmers.append(_signed(seed) >> 24)
    seen, cells = Counter(), defaultdict(list)
    for place, kmer in enumerate(kmers):
        # The occurrence number is a 32-bit value for the hash.
        code = xxhash.xxh64_intdigest(struct.pack("<i", seen[kmer]), _hash_long(kmer))
        seen[kmer] += 1
        name = _signed(code) >> 24
        cells[name >> 34].append((name, place))
    out = set()
    for cell, members in cells.items():
        picked = sorted((place, name) for name, place in sorted(members)[:chosen])
        seed = 42
        for _, name in picked:
            seed = _hash_long(name, seed)
        out.add(((cell + (1 << (cell_bits - 1))) << kept) + (seed & ((1 << kept) - 1)))
    return out


def likeness(a, b, kept=16):
    return len(a & b) / len({x >> kept for x in a} | {x >> kept for x in b})


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(lower(text))


def search(rows, items, k=10):
    """item -> [(doc_id, score)], best first."""
    import math

    docs = [(r[0], Counter(terms(r[1]))) for r in rows]
    n_docs, n_words = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    holding = Counter(t for _, c in docs for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(terms(text))
    out = {}
    for item, words_ in wanted.items():
        scored = []
        for doc_id, count in docs:
            score = 0
            for t in words_ & set(count):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1)))
                m = 10 + 90 * sum(count.values()) * n_docs // n_words
                score += weight * (1_000_000_000 * count[t] // (1000 * count[t] + 8 * m))
            if score > 0:
                scored.append((doc_id, score))
        if scored:
            out[item] = sorted(scored, key=lambda r: (-r[1], r[0] is None, r[0] or 0))[:k]
    return out


def shingle_set(text, k=5):
    found = words(lower(text))
    return {" ".join(found[i : i + k]) for i in range(max(1, len(found) - k + 1))} if found else set()


def negatives(rows, n_positives=5, n_negatives=10):
    import math

    table = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) or abs(x) >= 2**18 for x in vector):
            continue
        scaled = [math.floor(256 * struct.unpack("f", struct.pack("f", x))[0]) for x in vector]
        table.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, scaled))
    out = []
    for anchor, label, q in table:
        if anchor is None or anchor % 100:
            continue
        scored = [
            (-sum(a * b for a, b in zip(q, v, strict=True)), i is None, i, m) for i, m, v in table if len(v) == len(q) and i != anchor
        ]
        scored.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        for score, _, positive, _ in [r for r in scored if r[3] == label][:n_positives]:
            inside = [r for r in scored if r[3] != label and 30 * -score <= 100 * -r[0] <= 90 * -score]
            out += [(anchor, positive, k + 1, r[2], -score, -r[0]) for k, r in enumerate(inside[:n_negatives])]
    return out
