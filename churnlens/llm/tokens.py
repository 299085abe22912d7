"""Numbers for words, made once per distinct word of a worker process."""

from __future__ import annotations

import re
import zlib

import numpy as np

#: Words kept before a table starts anew.
TABLE_WORDS = 1_000_000
_MIX = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """Multiplicative hash of unsigned 64-bit numbers whose high bits are well spread."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX)
        return (h ^ (h >> np.uint64(32))) * np.uint64(_MIX)


class Words(dict):
    """word -> number by a function of the word alone; emptied when it has grown past TABLE_WORDS."""

    def __init__(self, number):
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> int:
        self[word] = n = self.number(word)
        return n

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > TABLE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_EDGES = re.compile(r"^\W+|\W+$")


def core(word: str) -> int:
    """crc32 of the word in lower case without marks at its ends; a word of marks alone keeps them."""
    low = word.lower()
    return zlib.crc32((_EDGES.sub("", low) or low).encode())


_SHAPES = ((re.compile(r"[^\W\d_]+"), lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a"), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w])\1+"), r"\1\1"))


def shape(word: str) -> str:
    """Letters as a (A if all are capitals), digits as 0, and at most two of the same mark in a row."""
    for pattern, put in _SHAPES:
        word = pattern.sub(put, word)
    return word[:16]
