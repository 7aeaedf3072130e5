"""The split of a text into pre-tokens, as a Python iterable of strings, with a fast path for Latin-1 texts.

A pattern's ``\\p{L}``, ``\\p{N}`` and ``\\s`` need the ``regex`` module. On a text whose characters are all below
U+0100 the same pattern with these classes spelled out gives the same matches in the standard ``re`` module, about
twice as fast. ``starts`` finds the matches of the byte-level pattern in many texts at once, with numpy.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

#: The pattern of byte-level pre-tokenizers; its matches cover a text.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE, LETTER, NUMBER, OTHER = range(4)


def _latin(cls: str) -> str:
    one = regex.compile(cls)
    return "".join(re.escape(chr(c)) for c in range(256) if one.fullmatch(chr(c)))


def _latin_pattern(pattern: str) -> re.Pattern | None:
    letters, numbers, space = _latin(r"\p{L}"), _latin(r"\p{N}"), _latin(r"\s")
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]") \
        .replace(r"\p{N}", f"[{numbers}]").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")
    return re.compile(out) if pattern.count("[") <= 1 and r"\p" not in out else None


@lru_cache(maxsize=8)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that gives all matches of ``pattern`` in a text."""
    full, latin = regex.compile(pattern).findall, _latin_pattern(pattern)
    if latin is None:
        return full
    quick = latin.findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return full(text)
        return quick(text)

    return split


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """``SPACE``, ``LETTER``, ``NUMBER`` or ``OTHER`` of every code point."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    every = np.arange(len(out), dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    for cls, runs in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for run in regex.finditer(runs, every):
            out[run.start():run.end()] = cls
    return out


def starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a match of ``BYTE_LEVEL`` starts at each code point of texts that lie side by side.

    ``first`` marks the first code points of texts; no match goes on beyond one.
    """
    cls, n = _classes()[points], len(points)
    start = first.copy()
    start[1:] |= cls[1:] != cls[:-1]
    # the last white space before something else is a match of its own, or, if it is a blank, begins the next one
    space = cls == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:])
    start[last] = True
    start[last[points[last] == ord(" ")] + 1] = False
    quotes = np.flatnonzero((points == ord("'")) & start)
    for tail in ("s", "t", "re", "ve", "m", "ll", "d"):
        at, end = quotes[quotes + len(tail) < n], len(tail) + 1
        for k, letter in enumerate(tail, 1):
            at = at[(points[at + k] == ord(letter)) & ~first[at + k]]
        start[at + 1] = False
        start[at[at + end < n] + end] = True
    return start
