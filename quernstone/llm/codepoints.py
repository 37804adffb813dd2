"""Texts as arrays of code points, with per-code-point tables, for vectorised scans."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np

#: Classes of code points.
LETTER, NUMBER, OTHER, SPACE, EDGE, SPECIAL = range(6)
#: First code beyond Unicode: stands between texts; the next ones stand for special tokens.
SEPARATOR = 0x110000
N_CODES = SEPARATOR + 16

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


@functools.cache
def class_table() -> np.ndarray:
    """Class of each code: letters, numbers, white space, all else, and the codes beyond Unicode."""
    out = np.full(N_CODES, OTHER, np.uint8)
    for code in range(SEPARATOR):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            out[code] = LETTER
        elif kind == "N":
            out[code] = NUMBER
    for code in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[code] = SPACE
    out[SEPARATOR] = EDGE
    out[SEPARATOR + 1 :] = SPECIAL
    return out


@functools.cache
def lower_table() -> np.ndarray:
    """Lower case of each code that has a single-code lower case."""
    out = np.arange(N_CODES, dtype=np.uint32)
    for code in range(SEPARATOR):
        low = chr(code).lower()
        if len(low) == 1:
            out[code] = ord(low)
    return out


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def slices(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``most`` characters, or one longer text."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


class Powers:
    """Powers of an odd multiplier modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            inverse = pow(_MULTIPLIER, -1, 1 << 64)
            for name, base in (("up", _MULTIPLIER), ("down", inverse)):
                out = np.ones(1, np.uint64)
                step = base
                while len(out) < size:
                    out = np.concatenate([out, out * np.uint64(step)])
                    step = step * step & _MASK
                setattr(self, name, out[:size])
        return self.up[:n], self.down[:n]


_powers = Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``values[start:end]``, from one pass of prefix sums."""
    up, down = _powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    length = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * down[starts] + length * np.uint64(0xD6E8FEB86659FD93))
