"""Words of UTF-8 texts as 64-bit hashes, computed with numpy over whole byte arrays.

A word's hash is a polynomial in its bytes, mixed; equal words have equal hashes, and two of the words or shingles of
a corpus share one with probability about n^2 / 2^65. A text is taken in pieces that end between words, so memory is
bounded by the piece (or by one longer word), not by the text.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 18
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LETTER = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_BASE = 0xD6E8FEB86659FD93
_UNBASE = pow(_BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Which bytes belong to a word: all but ASCII white space, or letters, digits and all non-ASCII characters.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, dtype=_U), np.cumprod(np.full(n, base, dtype=_U))])


_POWERS = {"up": _powers(_BASE, PIECE), "down": _powers(_UNBASE, PIECE)}


def _piece(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flags = np.zeros(len(data) + 2, dtype=np.int8)
    flags[1:-1] = is_word[data]
    edges = np.flatnonzero(np.diff(flags))
    first, last = edges[::2], edges[1::2]
    up, down = _POWERS["up"], _POWERS["down"]
    if len(data) > len(up):
        up, down = _powers(_BASE, len(data)), _powers(_UNBASE, len(data))
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_LETTER[data] * up[:len(data)], out=sums[1:])
    return mix((sums[last] - sums[first]) * down[first]), first, last


def words(text, is_word: np.ndarray) -> np.ndarray:
    """The hash of every word of the text (a string, UTF-8 bytes or None) with A-Z lower-cased, in order."""
    return spans(text, is_word)[0]


def spans(text, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word of the text with A-Z lower-cased, in order."""
    raw = text.encode() if isinstance(text, str) else text
    data = LOWER[np.frombuffer(raw, dtype=np.uint8)] if raw else np.zeros(0, dtype=np.uint8)
    found, at = [], 0
    while at < len(data):
        end = at + PIECE
        if end >= len(data):
            end = len(data)
        else:
            gaps = np.flatnonzero(~is_word[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                while end < len(data) and is_word[data[end]]:
                    more = np.flatnonzero(~is_word[data[end:end + PIECE]])
                    end = end + int(more[0]) if len(more) else min(len(data), end + PIECE)
        hashes, first, last = _piece(data[at:end], is_word)
        found.append((hashes, first + at, last + at))
        at = end
    if not found:
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*found)) if len(found) > 1 else found[0]


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of ``n`` words, in order; with fewer words, but not none, of the whole sequence."""
    if not len(hashes):
        return np.zeros(0, dtype=_U)
    n = min(n, len(hashes))
    acc = np.full(len(hashes) - n + 1, n, dtype=_U)
    for j in range(n):
        acc = acc * _U(_BASE) + hashes[j:len(hashes) - n + 1 + j]
    return mix(acc)
