"""Words as they survive scanning: case, accents and look-alike characters folded."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

_WORD = re.compile(r"[^\W_]+")
_LOOKALIKE = str.maketrans({"0": "o", "1": "l", "i": "l", "5": "s", "6": "b", "8": "b", "j": "l"})


def plain(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def folded(word: str) -> str:
    """A word with look-alikes made one; numbers keep their digits."""
    if word.isdigit():
        return word
    return word.translate(_LOOKALIKE).replace("rn", "m").replace("vv", "w").replace("c", "e")


def words(text: str | None) -> list[str]:
    return [folded(w) for w in _WORD.findall(plain(text or ""))]


class Hasher:
    """64-bit codes of words, kept for the life of a worker up to a fixed number, and rolling codes of windows."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, most: int = 200_000):
        self.known: dict[str, int] = {}
        self.written: dict[str, int] = {}
        self.most = most

    def codes(self, tokens: list[str]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > self.most:
            known.clear()
        out = []
        for t in tokens:
            if (c := known.get(t)) is None:
                c = known[t] = xxhash.xxh64_intdigest(t)
            out.append(c)
        return np.array(out, dtype=np.uint64)

    def read(self, text: str) -> np.ndarray:
        """Codes of a text's words: a word seen before is neither folded nor hashed again."""
        import xxhash

        written = self.written
        if len(written) > self.most:
            written.clear()
        out = []
        for w in _WORD.findall(plain(text or "")):
            if (c := written.get(w)) is None:
                c = written[w] = xxhash.xxh64_intdigest(folded(w))
            out.append(c)
        return np.array(out, dtype=np.uint64)

    def windows(self, codes: np.ndarray, k: int) -> np.ndarray:
        """Karp-Rabin codes of all windows of k words, modulo 2**64."""
        n = len(codes) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k):
                out = out * self.BASE + codes[i : i + n]
        return out
