"""Plain versions of the native operators, on lists of (doc_id, text, lang, source, n_chars)."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WHITE = " \t\n\x0b\f\r"
LAST = 2**63 - 1


def line_key(line: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def kept_lines(rows):
    """[(row, kept lines, lines)]"""
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(line_key(line)) >= 10:
                holders[line_key(line)].add(LAST if r[0] is None else r[0])
    out = []
    for r in rows:
        lines, doc = (r[1] or "").split("\n"), LAST if r[0] is None else r[0]
        kept = [x for x in lines if len(holders.get(line_key(x), ())) < 2 or min(holders[line_key(x)]) == doc]
        out.append((r, kept, lines))
    return out


def without_shared_lines(rows) -> Counter:
    return Counter((r[0], r[1] if len(kept) == len(lines) else "\n".join(kept)) for r, kept, lines in kept_lines(rows))


def words(text) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def words_by_source(rows) -> Counter:
    out = Counter()
    for r in rows:
        out[r[3]] += words(r[1])
    return out


def targets(rows, weights=(5, 2, 1), most=3) -> dict:
    """By resharing until none is above its cap."""
    size = words_by_source(rows)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = float(sum(size.values())), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= most * size[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * size[s])
            left -= out[s]
        free -= over
    return out
