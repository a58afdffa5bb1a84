"""Plain Python versions of the contracts, for comparison."""

from __future__ import annotations

import re
from collections import Counter
from hashlib import sha256

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def quality(text: str | None) -> tuple:
    text = text or ""
    w = SPACED.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    n = len(w)
    failed = n < 50 or 100 * len(hit) > 50 * n
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed)


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def personal(text: str | None) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                  "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def digest(spans: list[tuple[str, int, int]]) -> str:
    return sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def phrases(text: str | None) -> tuple:
    w = ALNUM.findall((text or "").translate(LOWER))
    found = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in found]
    return (len(w), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found})))


def shingles(text: str | None, size: int) -> set:
    w = SPACED.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def groups(rows: list[tuple], size: int, percent: int) -> dict:
    """doc_id -> smallest id reachable, over all pairs."""
    sets = {d: shingles(t, size) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d in ids}


def passages(text: str | None, items: list[tuple], window: int = 10) -> tuple:
    w = ALNUM.findall((text or "").translate(LOWER))
    hit, named = set(), set()
    for item, t in items:
        p = ALNUM.findall((t or "").translate(LOWER))
        size = min(window, len(p))
        for k in range(len(p) - size + 1 if p else 0):
            for i in range(len(w) - size + 1):
                if w[i : i + size] == p[k : k + size]:
                    hit |= set(range(i, i + size))
                    named.add(item)
    return len(w), len(hit), sorted(x for x in named if x is not None)
