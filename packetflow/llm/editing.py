"""Edit distances and deletion keys shared by the matching operators."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations


@lru_cache(maxsize=200_000)
def _letters(word: str) -> int:
    """One bit for each letter that occurs; letters may share a bit."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


def osa(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between a and b; most + 1 when there are more than most."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    # An edit takes at most one letter away and brings one.
    if abs(n - m) > most or (_letters(a) ^ _letters(b)).bit_count() > 2 * most:
        return most + 1
    start = 0
    while start < n and start < m and a[start] == b[start]:
        start += 1
    while n > start and m > start and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[start:n], b[start:m]
    n, m = len(a), len(b)
    if not n or not m:
        return min(max(n, m), most + 1)
    older: list[int] = []
    last = list(range(m + 1))
    for i in range(1, n + 1):
        row, c = [i] + [0] * m, a[i - 1]
        for j in range(1, m + 1):
            d = b[j - 1]
            best = last[j - 1] + (c != d)
            if last[j] + 1 < best:
                best = last[j] + 1
            if row[j - 1] + 1 < best:
                best = row[j - 1] + 1
            if i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == d and older[j - 2] + 1 < best:
                best = older[j - 2] + 1
            row[j] = best
        if min(row) > most:
            return most + 1
        older, last = last, row
    return min(last[m], most + 1)


def deletion_keys(word: str, edits: int) -> set[str]:
    """The word with up to edits characters left out; words within that many edits share at least one key."""
    keys, n = {word}, len(word)
    for k in range(1, min(edits, n) + 1):
        for gone in combinations(range(n), k):
            at, parts = 0, []
            for g in gone:
                parts.append(word[at:g])
                at = g + 1
            parts.append(word[at:])
            keys.add("".join(parts))
    return keys


def squeeze_runs(word: str) -> str:
    """Runs of one character made one."""
    return "".join(c for i, c in enumerate(word) if not i or word[i - 1] != c)


def skeleton(word: str) -> str:
    """First letter and the consonants after it."""
    return word[:1] + "".join(c for c in word[1:] if c not in "AEIOU")
