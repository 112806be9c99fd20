"""Texts as flat numpy arrays: code points, words and prefix hashes of many texts at once.

All hashes are 64-bit polynomial prefix hashes modulo 2**64 over randomised characters, so the hash
of any stretch of any text costs one subtraction and one product, and is the same in every task.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_CACHE: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _CACHE or len(_CACHE["up"]) < n:
        n = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n, U(base))
            p[0] = U(1)
            _CACHE[name] = np.cumprod(p, dtype=U)
    return _CACHE["up"], _CACHE["down"]


def is_word_char() -> np.ndarray:
    """For every code point whether it is a letter or a digit (categories L and N)."""
    if "word" not in _CACHE:
        _CACHE["word"] = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return _CACHE["word"]


class Flat:
    """Texts laid end to end, each followed by one line feed."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts) + "\n"
        self.codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.sizes = sizes
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1].astype(np.int64)
        self._prefix: np.ndarray | None = None

    @property
    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            up, _ = _powers(len(self.codes) + 1)
            x = mix(self.codes.astype(U) + _ODD) * up[: len(self.codes)]
            self._prefix = np.zeros(len(x) + 1, U)
            np.cumsum(x, dtype=U, out=self._prefix[1:])
        return self._prefix

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each stretch [start, end)."""
        _, down = _powers(len(self.codes) + 1)
        return (self.prefix[end] - self.prefix[start]) * down[start]

    def grams(self, k: int) -> np.ndarray:
        """The hash of the ``k`` characters from every place; those across two texts mean nothing."""
        _, down = _powers(len(self.codes) + 1)
        p = self.prefix
        n = len(self.codes) - k + 1
        return (p[k:] - p[:-k]) * down[:n] if n > 0 else np.zeros(0, U)

    def owner(self) -> np.ndarray:
        """The text's number at every place."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes + 1)


class Words:
    """The words of texts: maximal runs of letters and digits of the lower-cased text."""

    def __init__(self, texts: list[str]):
        self.flat = flat = Flat([t.lower() for t in texts])
        m = is_word_char()[flat.codes]
        edge = np.diff(m.astype(np.int8), prepend=0)
        self.begin, self.end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        self.text = np.searchsorted(flat.starts, self.begin, "right") - 1
        self.hash = mix(flat.hashes(self.begin, self.end))
        self.count = np.bincount(self.text, minlength=len(texts))

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text of every run of ``k`` consecutive words; hash i is of the run from word ``at[i]``."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        h = np.zeros(n, U)
        factor = 1
        for j in range(k):
            factor = factor * int(_ODD) % (1 << 64)
            h += self.hash[j : j + n] * U(factor)
        at = np.nonzero(self.text[:n] == self.text[k - 1 :])[0]
        return mix(h[at]), at


def chunks(sizes, limit: int):
    """Consecutive (start, end) with at most ``limit`` characters each, or one longer text."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n + 1
    if total:
        yield start, len(sizes)
