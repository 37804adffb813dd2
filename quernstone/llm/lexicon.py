"""Fast exact encoding with a public BPE vocabulary.

A BPE tokenizer of the ``tokenizers`` library first splits a text into pieces and then
encodes each piece on its own. Pieces are found here with array operations over a whole
batch; each *distinct* piece is encoded once by the library, and its ids are kept in
an open-addressing table that is looked up for all pieces of a batch at once.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata

import numpy as np

from quernstone.llm.codepoints import EDGE, LETTER, NUMBER, OTHER, SEPARATOR, SPACE, SPECIAL, class_table, codes_of, lower_table, slices, span_hashes


class PieceTable:
    """Hash of a piece -> its token ids, for at most ``most`` pieces (some 50 MB). When full, it keeps those that were looked up again."""

    def __init__(self, most: int = 600_000) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.bits = 16
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.entry = np.zeros(1 << self.bits, np.int32)
        self.n = 0
        self.offset = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int32)
        self.again = np.zeros(1 << 16, bool)
        self.flat = np.zeros(1 << 18, np.int32)
        self.n_flat = 0

    def thin(self) -> None:
        """Forget pieces that were not looked up again since they came; all of them if few would go."""
        slots = np.flatnonzero(self.keys)
        slots = slots[self.again[self.entry[slots]]]
        keys, entry = self.keys[slots], self.entry[slots]
        count, offset, flat = self.count[entry], self.offset[entry], self.flat
        self.clear()
        if 0 < len(keys) <= self.most // 2:
            total = np.cumsum(count.astype(np.int64))
            index = np.arange(total[-1]) + np.repeat(offset - (total - count), count)
            self._append(keys, count, flat[index])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        mask = np.uint64((1 << self.bits) - 1)
        slot = (h & mask).astype(np.int64)
        got = self.keys[slot]
        out = np.where(got == h, self.entry[slot], -1)
        open_ = np.flatnonzero((got != h) & (got != 0))
        while len(open_):
            slot = slot[open_] if len(slot) == len(h) else slot
            slot = (slot + 1) & int(mask)
            got = self.keys[slot]
            hit = got == h[open_]
            out[open_[hit]] = self.entry[slot[hit]]
            more = ~hit & (got != 0)
            open_, slot = open_[more], slot[more]
            if len(slot) == len(h):
                slot = slot.copy()
        return out

    def _place(self, h: np.ndarray, entry: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            won = free & (self.keys[slot] == h)
            self.entry[slot[won]] = entry[won]
            h, entry, slot = h[~won], entry[~won], (slot[~won] + 1) & mask

    def reserve(self, n: int) -> None:
        """Make room for ``n`` more keys at a load of a half at most."""
        if (self.n + n) * 2 > 1 << self.bits:
            used = np.flatnonzero(self.keys)
            keys, entry = self.keys[used], self.entry[used]
            while (self.n + n) * 2 > 1 << self.bits:
                self.bits += 1
            self.keys = np.zeros(1 << self.bits, np.uint64)
            self.entry = np.zeros(1 << self.bits, np.int32)
            self._place(keys, entry)

    def add(self, h: np.ndarray, ids: list[list[int]]) -> None:
        """``h``: distinct hashes that are not in the table."""
        count = np.fromiter(map(len, ids), np.int32, len(ids))
        self._append(h, count, np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(count.sum())))

    def _append(self, h: np.ndarray, count: np.ndarray, flat: np.ndarray) -> None:
        n = len(h)
        self.reserve(n)
        for name, used, extra in (("offset", self.n, n), ("count", self.n, n), ("again", self.n, n), ("flat", self.n_flat, len(flat))):
            old = getattr(self, name)
            if used + extra > len(old):
                new = np.zeros(max(3 * len(old) // 2, used + extra), old.dtype)
                new[:used] = old[:used]
                setattr(self, name, new)
        self.count[self.n : self.n + n] = count
        self.offset[self.n : self.n + n] = self.n_flat + np.cumsum(count) - count
        self.flat[self.n_flat : self.n_flat + len(flat)] = flat
        self._place(h, np.arange(self.n, self.n + n, dtype=np.int32))
        self.n += n
        self.n_flat += len(flat)


def _contractions(codes: np.ndarray, cls: np.ndarray, start: np.ndarray, after_space: bool) -> None:
    """Let 's 't 'm 'd 're 've 'll be pieces where the splitting pattern would take them."""
    at = np.flatnonzero(codes == 0x27)
    at = at[(at > 0) & (at + 2 < len(codes))]  # codes end with a separator, so two letters have a sign after them
    at = at[(cls[at + 1] == LETTER) & (cls[at - 1] != OTHER)]
    if not after_space:
        at = at[codes[at - 1] != 0x20]
    if len(at):
        a, b = codes[at + 1], codes[at + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
        at, width = at[one | two], np.where(one, 2, 3)[one | two]
        start[at + 1] = False
        start[at + width] = True


def split_words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of lower-cased codes: letter runs, single numbers, runs of other signs, contractions; white space is dropped."""
    cls = class_table()[codes]
    start = np.ones(len(codes), bool)
    start[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == NUMBER) | (cls[1:] == SPECIAL)
    _contractions(codes, cls, start, True)
    first = np.flatnonzero(start)
    end = np.append(first[1:], len(codes))
    keep = (cls[first] != SPACE) & (cls[first] != EDGE)
    return first[keep], end[keep]


def split_bytes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces that keep white space: a single blank goes with the piece after it."""
    cls = class_table()[codes]
    start = np.ones(len(codes), bool)
    start[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == SPECIAL)
    _contractions(codes, cls, start, False)
    at = np.flatnonzero((cls[1:] <= OTHER) & (cls[:-1] == SPACE)) + 1
    start[at - 1] = True
    start[at[codes[at - 1] == 0x20]] = False
    first = np.flatnonzero(start)
    end = np.append(first[1:], len(codes))
    keep = cls[first] != EDGE
    return first[keep], end[keep]


class Encoder:
    """Ids of texts as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tokenizer.model)  # for pieces, which are normalised and split already
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.lower = spec["normalizer"] is not None
        self.split = split_words if self.lower else split_bytes
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.table = PieceTable()

    def codes(self, text: str) -> np.ndarray:
        """A text's codes after the tokenizer's normaliser; special strings are single codes."""
        if any(s in text for s in self.special):
            import re

            parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text)
            names = list(self.special)
            return np.concatenate([np.array([SEPARATOR + 1 + names.index(p)], np.uint32) if p in self.special else self.codes(p) for p in parts])
        codes = codes_of(text)
        if self.lower and len(codes):
            if codes.max() >= 0x300 or (codes == 0x130).any():
                codes = codes_of("".join(c.lower() for c in unicodedata.normalize("NFC", text)))
            codes = lower_table()[codes]
        return codes

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all texts with separators, starts and ends of pieces, and each text's first code."""
        edge = np.array([SEPARATOR], np.uint32)
        joined = "\x00".join(texts)
        if any(x in joined for x in self.special) or (self.lower and not joined.isascii() and ((whole := codes_of(joined)).max() >= 0x300 or (whole == 0x130).any())):
            parts = [self.codes(t) for t in texts]
        else:
            whole = codes_of(joined)
            if self.lower:
                whole = lower_table()[whole]
            whole = whole.copy()
            at = np.cumsum([len(t) + 1 for t in texts])[:-1] - 1
            whole[at] = SEPARATOR
            codes = np.concatenate([edge, whole, edge])
            begin = np.concatenate([[1], at + 2])
            return codes, *self.split(codes), begin
        size = np.array([len(p) + 1 for p in parts])
        codes = np.concatenate([edge, *(y for p in parts for y in (p, edge))])
        begin = 1 + np.cumsum(size) - size
        return codes, *self.split(codes), begin

    def entries(self, codes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The table's entry of each piece; new pieces are encoded by the library."""
        h = span_hashes(codes, first, end)
        h[h == 0] = 1
        entry = self.table.find(h)
        miss = np.flatnonzero(entry < 0)
        self.table.again[entry[entry >= 0] if len(miss) else entry] = True
        if len(miss):
            new, where = np.unique(h[miss], return_index=True)
            if self.table.n + len(new) > self.table.most:
                self.table.thin()
                entry = self.table.find(h)
                miss = np.flatnonzero(entry < 0)
                new, where = np.unique(h[miss], return_index=True)
            ids: list[list[int]] = [[]] * len(new)
            at, names = miss[where], list(self.special.values())
            own = codes[first[at]] > SEPARATOR
            for k in np.flatnonzero(own).tolist():
                ids[k] = [names[int(codes[first[at[k]]]) - SEPARATOR - 1]]
            plain = np.flatnonzero(~own)
            begin, length = first[at[plain]], (end - first)[at[plain]]
            stop = np.cumsum(length)
            together = codes[np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - (stop - length), length)].tobytes().decode("utf-32-le", "surrogatepass")
            words = [together[a:b] for a, b in zip((stop - length).tolist(), stop.tolist(), strict=True)]
            for k, e in zip(plain.tolist(), self.bare.encode_batch_fast(words, add_special_tokens=False), strict=True):
                ids[k] = e.ids
            self.table.add(new, ids)
            entry[miss] = self.table.find(h[miss])
        return entry

    def encode(self, texts: list[str], last: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each text's followed by ``last``, and the ids' number per text."""
        flats, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a, b in slices(texts):
            codes, first, end, begin = self.pieces(texts[a:b])
            entry = self.entries(codes, first, end)
            n = self.table.count[entry].astype(np.int64)
            total = np.zeros(len(n) + 1, np.int64)
            np.cumsum(n, out=total[1:])
            cut = np.append(np.searchsorted(first, begin), len(first))
            per = total[cut[1:]] - total[cut[:-1]]
            index = np.arange(total[-1]) + np.repeat(self.table.offset[entry] - total[:-1], n)
            flat = np.insert(self.table.flat[index], total[cut[1:]], last)
            flats.append(flat.astype(np.int32))
            counts.append(per + 1)
        return np.concatenate(flats), np.concatenate(counts)


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process; its table serves all later tasks of the worker."""
    return Encoder(path)
