"""Personal data by base patterns and a skip-chain conditional random field.

Base spans come from patterns with checks. The field then labels the document's other words that could be part of personal
data: those with a digit, @ or +. (Others cannot have a label but "none", so they are left out of the graph.)
Its factors are word shapes, neighbouring words (the chain), and *skip links* between distant words that are equal or
similar: the same address, or the same last digits, in any writing. Words in base spans are observed, and each repeat is linked
with an observed word of its datum, however far that is. Neighbouring digit words that make up an observed number, as
"988 555 2485", are one candidate. Loopy sum-product message passing, until messages settle,
carries labels along chain and skip links, so that a second writing of a number that the document shows to be
personal is labelled like the first. Every document with candidate words has its field, also one without base spans: a datum that the
patterns miss, since other digits touch it, is labelled by the shapes of its words and of their neighbours. Base patterns
seldom miss, which ``miss_log_odds`` states. Neighbouring words of one label are one span.

The weights are trained on a bounded sample: of the texts of at most ``sample_chars`` characters with candidate words, the
``sample_docs`` distinct ones that come first by hash, with base spans as labels. Chain and skip tables are learned with all their
entries; a prior pulls skip links to agreement where the sample has few. Everything else covers all documents and whole texts.

Defined results: null and empty texts have no spans; repeated rows have equal results; an empty table trains nothing
and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.staging import bounded_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
_SIGNS = re.compile(r"[0-9@+]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A digit run that fails fails from each of its digits, hence the look-behind: one try for each run.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    double = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 if x > 9 else x for x in double)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, by start, then kind."""
    out: list[Span] = []
    if not _SIGNS.search(text):
        return out
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


class Graph:
    """A document's candidate words, their observed labels (-1: to be found), chain and skip links."""

    def __init__(self, text: str, spans: list[Span]) -> None:
        self.place: list[tuple[int, int]] = []
        self.observed: list[int] = []
        self.features: list[list[int]] = []
        self.links: list[tuple[int, int, int]] = []
        words: list[tuple[int, int, int, int, int]] = []  # first and last number, start, end, label
        k = 0
        # Spans of several kinds may overlap; the first one that reaches a word labels it.
        for number, m in enumerate(_WORD.finditer(text)):
            word = m.group()
            if not _SIGNS.search(word):
                continue
            while k < len(spans) and spans[k][2] <= m.start():
                k += 1
            label = -1
            at = k
            while at < len(spans) and spans[at][0] < m.end():
                if spans[at][2] > m.start():
                    label = spans[at][1] + 1
                    break
                at += 1
            words.append((number, number, m.start(), m.end(), label))
        numbers: dict[str, set[str]] = {}
        key_at: dict[int, str] = {}  # end of a base span -> its number's key, if no single word has it
        for start, kind, end in spans:
            digits = _NOT_DIGIT.sub("", text[start:end])
            if KINDS[kind] in ("card", "phone") and len(digits) >= 7:
                numbers.setdefault(digits[-7:], set()).add(digits)
                key_at[end] = digits[-7:]
        previous = -2
        observed_of: dict[str, dict[int, int]] = {}
        repeats: dict[str, list[int]] = {}
        for first, last, a, b, label in _joined(text, words, numbers) if numbers else words:
            node = len(self.place)
            self.place.append((a, b))
            self.observed.append(label)
            self.features.append(features_of(text[a:b]))
            if previous == first - 1:
                self.links.append((node - 1, node, 0))
            previous = last
            keys = {skip_key(text[a:b])} if label < 0 else {skip_key(text[a:b]), *(key_at[end] for end in range(a + 1, b + 1) if end in key_at)}
            for key in sorted(keys - {""}):
                if label < 0:
                    repeats.setdefault(key, []).append(node)
                    continue
                hubs = observed_of.setdefault(key, {})
                if hubs:
                    self.links.append((next(iter(hubs.values())), node, 1))
                hubs.setdefault(label, node)
        for key, nodes in repeats.items():
            hubs = list(observed_of.get(key, {}).values())
            self.links += [(hub, node, 1) for hub in hubs or nodes[:1] for node in nodes if node != hub]


_DIGIT_WORD = re.compile(r"[+(\[]*[0-9][0-9()./-]*[.,;:!?)\]>\"']*")


def _joined(text: str, words: list[tuple[int, int, int, int, int]], numbers: dict[str, set[str]]) -> list[tuple[int, int, int, int, int]]:
    """Words with neighbouring unobserved digit words as one where together they write an observed number, or the end of it."""
    most = max(len(x) for same in numbers.values() for x in same)
    out: list[tuple[int, int, int, int, int]] = []
    for w in words:
        out.append(w)
        digits, best, at = "", len(out) - 1, len(out) - 1
        while at >= 0 and out[at][4] < 0 and (at == len(out) - 1 or out[at][1] == out[at + 1][0] - 1) and _DIGIT_WORD.fullmatch(part := text[out[at][2] : out[at][3]]):
            digits = _NOT_DIGIT.sub("", part) + digits
            if len(digits) > most:
                break
            if any(x.endswith(digits) for x in numbers.get(digits[-7:], ())):
                best = at
            at -= 1
        if best < len(out) - 1:
            out[best:] = [(out[best][0], w[1], out[best][2], w[3], -1)]
    return out


def skip_key(word: str) -> str:
    """What distant writings of one datum share: an address in lower case, or the last seven digits."""
    if "@" in word:
        return word.strip(".,;:!?()[]<>\"'").lower()
    digits = _NOT_DIGIT.sub("", word)
    return digits[-7:] if len(digits) >= 7 else ""


N_FEATURES = 48


def features_of(word: str) -> list[int]:
    """Active shape features: digits, signs, checks."""
    digits = _NOT_DIGIT.sub("", word)
    n = len(digits)
    out = [0, 1 + min(n, 20)]
    for i, sign in enumerate("@.+-()=:/_%"):
        if sign in word:
            out.append(22 + i)
    if "@" in word and "." in word[word.index("@") :]:
        out.append(34)
    if 14 <= n <= 19:
        out.append(35 if luhn(digits) else 36)
    out.append(37 + min(4, word.count(".")))
    letters = sum(map(str.isalpha, word))
    out.append(42 + (letters > 0) + (letters > n))
    return out


class Field:
    """Weights of the random field: ``unary`` [feature, label], ``chain`` and ``skip`` [label, label], in log space."""

    def __init__(self, miss_log_odds: float = -4.0) -> None:
        self.unary = np.zeros((N_FEATURES, len(LABELS)))
        self.chain = np.zeros((len(LABELS), len(LABELS)))
        self.skip = np.zeros((len(LABELS), len(LABELS)))
        self.miss = np.array([0.0] + [miss_log_odds] * len(KINDS))

    def train(self, texts: list[str], rounds: int = 200, rate: float = 1.0, decay: float = 1e-4) -> Field:
        """Piecewise training: shapes by multinomial regression, links by smoothed agreement."""
        graphs = [g for g in (Graph(t, base_spans(t)) for t in texts) if g.place]
        if not graphs:
            return self
        rows = [(f, max(0, y)) for g in graphs for f, y in zip(g.features, g.observed, strict=True)]
        x = np.zeros((len(rows), N_FEATURES))
        y = np.zeros((len(rows), len(LABELS)))
        for i, (active, label) in enumerate(rows):
            x[i, active], y[i, label] = 1.0, 1.0
        for _ in range(rounds):
            p = np.exp((z := x @ self.unary) - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            self.unary += rate * (x.T @ (y - p) / len(rows) - decay * self.unary)
        share = y.mean(0) + 1e-3
        share /= share.sum()
        # Links of the sample outweigh the prior once there are more than ``strength`` of a pair of labels; chain links have none.
        for kind, (name, prior, strength) in enumerate((("chain", np.zeros_like(self.chain), 20.0), ("skip", 6.0 * np.eye(len(LABELS)), 50.0))):
            counts = np.full((len(LABELS), len(LABELS)), 0.5)
            for g in graphs:
                for a, b, k in g.links:
                    if k == kind:
                        counts[max(0, g.observed[a]), max(0, g.observed[b])] += 1
            counts += counts.T
            learned = np.clip(np.log(counts / counts.sum() / np.outer(share, share)), -6, 6)
            setattr(self, name, (counts * learned + strength * prior) / (counts + strength))
        return self

    def marginals(self, g: Graph, sweeps: int = 1000) -> np.ndarray:
        """Loopy sum-product until messages settle; observed nodes send their label. ``sweeps`` only stops messages that swing for ever."""
        m = len(LABELS)
        local = np.stack([self.unary[f].sum(0) for f in g.features]) + self.miss
        for i, label in enumerate(g.observed):
            if label >= 0:
                local[i] = -60.0
                local[i, label] = 0.0
        if not g.links:
            links = np.zeros((0, 3), np.int64)
        else:
            links = np.array(g.links)
        source = np.concatenate([links[:, 0], links[:, 1]])
        goal = np.concatenate([links[:, 1], links[:, 0]])
        tables = np.stack([self.chain, self.skip])[links[:, 2]] if len(links) else np.zeros((0, m, m))
        tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
        sent = np.zeros((len(source), m))
        for _ in range(sweeps if len(links) else 0):
            belief = local.copy()
            np.add.at(belief, goal, sent)
            cavity = (belief[source] - sent[back])[:, :, None] + tables
            top = cavity.max(1, keepdims=True)
            new = np.log(np.exp(cavity - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            if np.abs(new - sent).max(initial=0) < 1e-4:
                break
            sent = 0.5 * sent + 0.5 * new
        belief = local
        np.add.at(belief, goal, sent)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def more_spans(self, text: str, spans: list[Span]) -> list[Span]:
        """Words that the field labels, outside base spans; neighbours of one label are one span."""
        if not _SIGNS.search(text):
            return []
        g = Graph(text, spans)
        if all(x >= 0 for x in g.observed):
            return []
        p = self.marginals(g)
        best = p.argmax(1)
        chained = {(i, j) for i, j, kind in g.links if kind == 0}
        found: list[tuple[int, int, int, int]] = []  # start, label, end, last node
        for i, (a, b) in enumerate(g.place):
            label = int(best[i])
            if g.observed[i] >= 0 or label == 0 or p[i, label] <= 0.5:
                continue
            if found and found[-1][1] == label and found[-1][3] == i - 1 and (i - 1, i) in chained and KINDS[label - 1] in ("card", "phone") and len(_NOT_DIGIT.sub("", text[found[-1][0] : b])) <= 19:
                found[-1] = (found[-1][0], label, b, i)
            else:
                found.append((a, label, b, i))
        out: list[Span] = []
        for a, label, b, _ in found:
            word = text[a:b]
            opened = word.count("(") - word.count(")")
            a, b = a + len(word) - len(word.lstrip(".,;:!?([<\"'" if opened > 0 or not word.startswith("(") else ".,;:!?[<\"'")), b - len(word) + len(word.rstrip(".,;:!?)]>\"'"))
            if a < b:
                out.append((a, label - 1, b))
        return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(docs: DataFrame, sample_docs: int = 2000, sample_chars: int = 20_000, miss_log_odds: float = -4.0) -> DataFrame:
    """Per row: ``doc_id``, counts of base spans, ``base_sha256``, ``spans``."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The sample's hashes come first, then only its texts, each once: at most sample_docs * sample_chars characters.
    candidates = rows.where((F.length("text") <= sample_chars) & F.col("text").rlike("[0-9@+]")).select(F.xxhash64("text").alias("h"), "text")
    chosen = candidates.select("h").distinct().orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    texts = [] if chosen is None else candidates.where(F.col("h") <= chosen).dropDuplicates(["h"]).orderBy("h").collect()
    field = Field(miss_log_odds).train([r.text for r in texts])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                spans = base_spans(text)
                base = listed(spans)
                every = listed(sorted(spans + field.more_spans(text, spans)))
                kinds = [k for _, k, _ in spans]
                for column, value in zip(out, (*(kinds.count(k) for k in range(4)), hashlib.sha256(base.encode()).hexdigest(), every), strict=True):
                    column.append(value)
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return rows.mapInArrow(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
