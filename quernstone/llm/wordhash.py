"""Hashes of words and of word windows for whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from quernstone.llm.codepoints import mix, slices, span_hashes

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def hashed_words(texts: list[bytes], fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word ``[^\\x20\\x09-\\x0D]+`` of all texts in a row, and where each text's words begin (and the end).

    Bytes are taken a slice at a time, so that the arrays by byte stay small.
    """
    parts = [_hashed_slice(texts[a:b], fold) for a, b in slices(texts, 1 << 20)]
    words = np.concatenate([np.zeros(0, np.uint64), *(w for w, _ in parts)])
    return words, np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate([np.zeros(0, np.int64), *(np.diff(c) for _, c in parts)]))])


def _hashed_slice(texts: list[bytes], fold: bool) -> tuple[np.ndarray, np.ndarray]:
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    gap = _GAP[joined]
    step = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(joined) and not gap[0]:
        step = np.insert(step, 0, 0)
    first, end = step[::2], step[1::2]
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
    return span_hashes(_FOLD[joined] if fold else joined, first, end), np.searchsorted(first, begin)


def windows(words: np.ndarray, cut: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all ``width``-word windows inside one text, and their hashes."""
    if len(words) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    at = np.flatnonzero(text[: len(words) - width + 1] == text[width - 1 :])
    return at, span_hashes(words, at, at + width)


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes: lower-cased windows, or its whole sequence if it has fewer words."""
    for a, b in slices(texts, 1 << 20):
        words, cut = hashed_words(texts[a:b], True)
        at, h = windows(words, cut, width)
        where = np.searchsorted(at, cut)
        for i in range(b - a):
            n = cut[i + 1] - cut[i]
            if n >= width:
                yield np.unique(h[where[i] : where[i + 1]])
            elif n:
                whole = span_hashes(words, cut[i : i + 1], cut[i + 1 : i + 2])
                yield mix(whole + np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)
