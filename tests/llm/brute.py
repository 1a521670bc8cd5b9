"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeats(rows: list[tuple[int, str | None]], depth: int = 50) -> dict[int, tuple]:
    texts = [(d, (t or "").encode()) for d, t in rows]
    least: dict[bytes, int] = {}
    for d, b in texts:
        for i in range(len(b) - depth + 1):
            w = b[i : i + depth]
            least[w] = min(d, least.get(w, d))
    out = {}
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if least[b[i : i + depth]] < d:
                gone[i : i + depth] = b"\1" * depth
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text: str | None, width: int = 5) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def near(rows: list[tuple[int, str | None]], percent: int = 75) -> dict[int, tuple]:
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders: dict = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    for d, s in sets.items():
        count: dict[int, int] = {}
        for x in s:
            for e in holders[x]:
                if e < d:
                    count[e] = count.get(e, 0) + 1
        for e, both in count.items():
            if 100 * both >= percent * (len(s) + len(sets[e]) - both):
                a, b = sorted((root(d), root(e)))
                up[b] = a
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def host_measures(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    seen: dict[tuple, list[int]] = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def lexical(docs: list[tuple], items: list[tuple], k: int = 50) -> list[tuple]:
    """(item_id, rank, doc_id, score)."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    held = [(d, term.findall((t or "").translate(LOWER))) for d, t in docs]
    held = [(d, w) for d, w in held if w]
    size, length = len(held), sum(len(w) for _, w in held)
    df: dict = {}
    for _, w in held:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    asked: dict = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(term.findall((t or "").translate(LOWER)))
    out = []
    for i, terms in asked.items():
        ranked = []
        for d, w in held:
            m = 50 + (50 * len(w) * size) // length
            score = sum(math.floor(1000 * math.log((2.0 * size + 2) / (2 * df[x] + 1))) * ((10**9 * w.count(x)) // (1000 * w.count(x) + 20 * m)) for x in terms if x in w)
            if score > 0:
                ranked.append((-score, d is None, d, i))
        ranked.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(i, n + 1, r[2], -r[0]) for n, r in enumerate(ranked[:k])]
    return out


def contaminated(docs: list[tuple], items: list[tuple], width: int = 10) -> list[tuple]:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = []
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        n = min(width, len(w))
        windows += [("" if i is None else str(i), w[s : s + n]) for s in range(len(w) - n + 1) if n]
    out = []
    for d, t in docs:
        w, hit, names = word.findall((t or "").translate(LOWER)), set(), set()
        for name, x in windows:
            for s in range(len(w) - len(x) + 1):
                if w[s : s + len(x)] == x:
                    hit.update(range(s, s + len(x)))
                    names.add(name)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def divergence(docs: list[tuple], min_docs: int = 3, top: int = 200) -> list[tuple]:
    """(lang, source, part, item, value, rank) of rows (lang, source, text)."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    groups: dict = {}
    held: dict = {}
    for lang, source, text in docs:
        w = term.findall((text or "").translate(LOWER))
        groups.setdefault((lang or "", source or ""), Counter()).update(w)
        held.setdefault(lang or "", Counter()).update(set(w))
    out = []
    for lang, by in held.items():
        kept = [t for t, n in by.items() if n >= min_docs]
        own = {s: c for (x, s), c in groups.items() if x == lang}
        part = lambda c: {t: 1 + (10**9 * (c[t] + 1)) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p, q = {s: part(c) for s, c in own.items()}, part(sum(own.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s, c in own.items():
            rows = [("pair", o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in own if o != s]
            rows += [("term", t, f(p[s][t], q[t])) for t in kept if c[t] > 0 and p[s][t] > q[t]]
            for kind in ("pair", "term"):
                ranked = sorted((r for r in rows if r[0] == kind), key=lambda r: (-r[2], r[1].encode()))
                out += [(lang, s, *r, n + 1) for n, r in enumerate(ranked) if kind == "pair" or n < top]
    return out
