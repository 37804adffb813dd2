"""Token counts by compiled finite-state transducers.

Two deterministic transducers run one after the other over classes of code points and code points:

* The *splitter* is compiled from the tokenizer's splitting rule. Its transitions are annotated with the pieces that they emit
  (at the character read, or at the one before where a contraction did not come about). A text is cut into
  chunks of equal length; each chunk's state map (state before -> state after) is computed for all chunks at once,
  the maps are composed by a parallel prefix scan, and each chunk then starts from its true state.
* The *word transducer* is a trie of piece prefixes, determinised on demand: a transition is compiled the first time
  it is met. The transition from a prefix to the end of a piece emits the number of tokens that the vocabulary's
  merges give the piece; it is asked of the tokenizers library once. All pieces step through it in lockstep.

Memory is bounded: the word transducer is dropped and compiled anew when it would pass ``most`` states.

Defined results: a null text is an empty one, with no bytes and tokens; repeated rows are counted each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.codepoints import EDGE, LETTER, NUMBER, OTHER, SEPARATOR, SPACE, SPECIAL, class_table, mix, slices
from quernstone.llm.lexicon import Encoder, PieceTable
from quernstone.llm.staging import bounded_batches

#: Input symbols of the splitter.
_LETTER, _SOLE, _R, _V, _L, _E, _NUMBER, _APOSTROPHE, _OTHER, _GAP = range(10)
#: Its states: nothing open, in letters, in other signs, after ', after 'r or 'v, after 'l.
_START, _LETTERS, _SIGNS, _QUOTE, _QUOTE_RV, _QUOTE_L = range(6)
CHUNK = 64


@functools.cache
def symbol_table() -> np.ndarray:
    out = np.array([{LETTER: _LETTER, NUMBER: _NUMBER, OTHER: _OTHER, SPACE: _GAP, EDGE: _GAP, SPECIAL: _GAP}[k] for k in range(6)], np.uint8)[class_table()]
    for c, k in (("s", _SOLE), ("t", _SOLE), ("m", _SOLE), ("d", _SOLE), ("r", _R), ("v", _V), ("l", _L), ("e", _E), ("'", _APOSTROPHE)):
        out[ord(c)] = k
    return out


@functools.cache
def splitter() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next state, pieces emitted at the character, pieces emitted at the one before; by symbol and state."""
    move, here, before = (np.zeros((16, 8), np.uint8) for _ in range(3))
    letters = {_LETTER, _SOLE, _R, _V, _L, _E}
    for state in range(6):
        for x in range(10):
            if x in letters:
                goal, new = _LETTERS, state != _LETTERS
            elif x == _NUMBER:
                goal, new = _START, True
            elif x == _GAP:
                goal, new = _START, False
            else:
                run = state in (_SIGNS, _QUOTE)
                goal, new = (_QUOTE if x == _APOSTROPHE and not run else _SIGNS), not run
            if state in (_QUOTE_RV, _QUOTE_L):
                if x == (_E if state == _QUOTE_RV else _L):
                    goal, new = _START, False
                else:  # no contraction: its letter had begun a piece
                    before[x, state] = 1
                    new = new and x not in letters
            elif state == _QUOTE and x in (_SOLE, _R, _V, _L):
                goal, new = {_SOLE: _START, _R: _QUOTE_RV, _V: _QUOTE_RV, _L: _QUOTE_L}[x], False
            move[x, state], here[x, state] = goal, new
    return move.ravel(), here.ravel(), before.ravel()


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive parallel prefix scan: row k becomes the map of rows 0 to k, the first applied first."""
    step = 1
    while step < len(maps):
        later = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        maps = np.concatenate([maps[:step], later])
        step *= 2
    return maps


def piece_starts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pieces, by chunk maps and their prefix scan."""
    move, here, before = splitter()
    symbols = symbol_table()[codes]
    n = len(symbols)
    rows = -(-n // CHUNK) or 1
    grid = np.full(rows * CHUNK, _GAP, np.uint8)
    grid[:n] = symbols
    columns = np.ascontiguousarray(grid.reshape(rows, CHUNK).T) << 3
    maps = np.tile(np.arange(6, dtype=np.uint8), (rows, 1))
    for column in columns:
        maps = move[column[:, None] + maps]
    state = np.zeros(rows, np.uint8)
    state[1:] = compose(maps)[:-1, _START]
    emitted = np.zeros((CHUNK, rows), np.uint8)
    late = np.zeros((CHUNK, rows), np.uint8)
    for j, column in enumerate(columns):
        at = column + state
        emitted[j], late[j], state = here[at], before[at], move[at]
    start = emitted.T.ravel()[:n].astype(bool)
    start[:-1] |= late.T.ravel()[1:n].astype(bool)
    gap = symbols == _GAP
    edge = start | gap
    first = np.flatnonzero(start)
    edges = np.append(np.flatnonzero(edge), n)
    end = edges[np.searchsorted(edges, first, "right")]
    return first, end


class WordTransducer:
    """States are piece prefixes; ``emit[state]`` is the emission of the transition that ends a piece there."""

    def __init__(self, coder: Encoder, most: int = 3_000_000) -> None:
        self.coder, self.most = coder, most
        self.clear()

    def clear(self) -> None:
        self.edges = PieceTable(most=1 << 62)
        self.emit = np.full(1 << 16, -1, np.int32)
        self.n = 1

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        key = mix(((state.astype(np.uint64) + np.uint64(1)) << np.uint64(21)) | code)
        goal = self.edges.find(key)
        if (goal < 0).any():
            new = np.unique(key[goal < 0])
            self.edges.reserve(len(new))
            self.edges._place(new, np.arange(self.n, self.n + len(new), dtype=np.int32))
            self.edges.n += len(new)
            self.n += len(new)
            if self.n > len(self.emit):
                self.emit = np.concatenate([self.emit, np.full(max(len(self.emit), self.n - len(self.emit)), -1, np.int32)])
            goal = self.edges.find(key)
        return goal

    def counts(self, codes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each piece."""
        if self.n > self.most:
            self.clear()
        length = end - first
        order = np.argsort(-np.minimum(length, 65_535).astype(np.int32), kind="stable")
        start, size = first[order], length[order]
        state = np.zeros(len(order), np.int32)
        depth, active = 0, len(order)
        while active:
            if depth < 65_535:
                active = int(np.searchsorted(-size[:active], -depth, "left"))
                if active:
                    state[:active] = self.step(state[:active], codes[start[:active] + depth])
            else:  # the order holds no longer
                rest = np.flatnonzero(size > depth)
                active = len(rest)
                state[rest] = self.step(state[rest], codes[start[rest] + depth])
            depth += 1
        out = np.empty(len(order), np.int32)
        found = self.emit[state]
        if (found < 0).any():
            new, where = np.unique(state[found < 0], return_index=True)
            where = np.flatnonzero(found < 0)[where]
            words = [codes[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(start[where].tolist(), (start + size)[where].tolist(), strict=True)]
            self.emit[new] = [len(e) for e in self.coder.bare.encode_batch_fast(words, add_special_tokens=False)]
            found = self.emit[state]
        out[order] = found
        return out


class TokenCounter:
    def __init__(self, path: str) -> None:
        self.coder = Encoder(path)
        if not self.coder.lower:
            raise ValueError("the splitter is compiled for the vocabulary that drops white space")
        self.coder.split = piece_starts
        self.words = WordTransducer(self.coder)

    def count(self, texts: list[str]) -> np.ndarray:
        out = [np.zeros(0, np.int64)]
        for a, b in slices(texts):
            codes, first, end, begin = self.coder.pieces(texts[a:b])
            n = self.words.counts(codes, first, end)
            total = np.zeros(len(n) + 1, np.int64)
            np.cumsum(n, out=total[1:])
            cut = np.append(np.searchsorted(first, begin), len(first))
            special = np.zeros(len(codes) + 1, np.int64)
            np.cumsum(codes > SEPARATOR, out=special[1:])
            out.append(total[cut[1:]] - total[cut[:-1]] + special[np.append(begin[1:], len(codes))] - special[begin])
        return np.concatenate(out)


@functools.cache
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_tokens, over_limit``."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(tokenizer)
        for batch in batches:
            if batch.num_rows:
                n = machine.count([t or "" for t in batch.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
