"""Texts as numpy arrays of code points, and tables of what kind of character each is."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

BMP = 1 << 16
LETTER, DIGIT, BLANK, BREAK, PUNCTUATION, SYMBOL, OTHER = range(7)


@lru_cache(maxsize=None)
def lowered() -> np.ndarray:
    """For the first 65,536 code points: the letter in lower case, or a space for what is no letter."""
    chars = map(chr, range(BMP))
    return np.array([ord(c.lower()[0]) if c.isalpha() else 32 for c in chars], dtype="<u4")


@lru_cache(maxsize=None)
def kinds() -> np.ndarray:
    """For the first 65,536 code points: one of the kinds above."""

    def kind(c: str) -> int:
        if c in "\n\r":
            return BREAK
        if c.isspace():
            return BLANK
        first = unicodedata.category(c)[0]
        return {"L": LETTER, "N": DIGIT, "P": PUNCTUATION, "S": SYMBOL}.get(first, OTHER)

    return np.array([kind(chr(i)) for i in range(BMP)], dtype="u1")


@lru_cache(maxsize=None)
def uppers() -> np.ndarray:
    return np.array([chr(i).isupper() for i in range(BMP)])


def mapped(codes: np.ndarray, table: np.ndarray, beyond) -> np.ndarray:
    """``table`` at each code; code points beyond it, which are rare, by ``beyond``."""
    high = codes >= BMP
    if not high.any():
        return table[codes]
    out = table[np.where(high, 0, codes)]
    known = {int(c): beyond(chr(c)) for c in np.unique(codes[high])}
    out[high] = [known[int(c)] for c in codes[high]]
    return out


def flattened(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and the texts' lengths."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), np.array([len(t) for t in texts], dtype="i8")


def pieces(texts: list[str], most: int = 1 << 20):
    """Runs of neighbouring texts with about ``most`` characters together, so that work arrays stay small; a longer text stands alone."""
    low, size = 0, 0
    for at, text in enumerate(texts):
        if size and size + len(text) > most:
            yield low, at
            low, size = at, 0
        size += len(text)
    if low < len(texts):
        yield low, len(texts)
