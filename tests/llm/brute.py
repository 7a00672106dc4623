"""Slow and plain versions of what the operators find."""

from __future__ import annotations

import regex

WORD = regex.compile(r"[぀-鿿]|[\p{L}\p{N}\p{M}--[぀-鿿]]+", regex.V1)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(text: str | None, n: int) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(pairs) -> dict:
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def near_pairs(texts: dict, n: int, threshold: float) -> list[tuple]:
    s = {k: shingles(t, n) for k, t in texts.items()}
    ids = sorted(k for k in s if s[k])
    out = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if min(len(s[a]), len(s[b])) >= threshold * max(len(s[a]), len(s[b])):
                both = len(s[a] & s[b])
                if both >= threshold * (len(s[a]) + len(s[b]) - both):
                    out.append((a, b))
    return out


def repeats(texts: dict, least: int) -> dict:
    """(start, stop) of the maximal passages of which every stretch of ``least`` words is in another text."""
    seen: dict = {}
    split = {k: words(t) for k, t in texts.items()}
    for k, w in split.items():
        for i in range(len(w) - least + 1):
            seen.setdefault(tuple(w[i : i + least]), set()).add(k)
    out = {}
    for k, w in split.items():
        found: list[list[int]] = []
        for i in range(len(w) - least + 1):
            if len(seen[tuple(w[i : i + least])]) > 1:
                if found and i == found[-1][1] - least + 1:
                    found[-1][1] = i + least
                else:
                    found.append([i, i + least])
        if found:
            out[k] = [tuple(x) for x in found]
    return out


def same_groups(rows, id_: str, brute: dict) -> tuple[float, bool]:
    """Share of brute's pairs that lie in one group, and whether each group is part of a brute group."""
    group = {r[id_]: r["group_id"] for r in rows}
    pairs = [(a, b) for a in brute for b in brute if a < b and brute[a] == brute[b]]
    hit = sum(a in group and group.get(a) == group.get(b) for a, b in pairs)
    sound = all(brute.get(k) is not None and brute.get(k) == brute.get(g) for k, g in group.items())
    return (hit / len(pairs) if pairs else 1.0), sound
