"""Edit distance for code that runs inside Arrow functions."""

from __future__ import annotations


def distance(a: str, b: str) -> int:
    """Levenshtein distance."""
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (c != d))
    return row[-1]
