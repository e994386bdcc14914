"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its potentials come from features of the line and of the
lines before and after it; a transition weight makes neighbours agree. Forward and
backward passes give the exact probability that a line is good, and the document's
score is their mean, weighted by the lines' lengths. The field is fitted in numpy by
gradient ascent on a bounded sample of labelled documents, whose lines carry the label
of the document.

Lines are counted from the bytes of a whole batch at once; a text longer than a piece
is read in pieces cut at line ends.

Defined results: a null or empty text is one empty line; without anything to learn from
(no label, or one class only) every score is the share of good labels, or 0.5; rows
that repeat get equal results; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from heirloom.llm.arrow_text import groups, string_parts, with_results
from heirloom.llm.language import drawn

PIECE = 1 << 20
_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _SYMBOL, _WIDE, _TAIL = range(8)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = _LOWER, _UPPER, _DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = _STOP
_CLASS[128:192], _CLASS[192:] = _TAIL, _WIDE
N_OWN = 11


@dataclass(frozen=True)
class CrfConfig:
    """``rows``: labelled documents drawn of each class, about. ``l2``: weight decay."""

    rows: int = 2500
    rounds: int = 300
    rate: float = 0.1
    l2: float = 1e-3


def _own_features(part: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Features of the lines part[begin:end], which follow each other, one byte or none between."""
    out = np.zeros((len(begin), N_OWN), np.float32)
    out[:, 0] = 1
    filled = np.flatnonzero(end > begin)
    if not len(filled):
        return out
    kind = _CLASS[part]
    first = begin[filled]
    count = {
        k: np.add.reduceat((kind == k).view(np.uint8), first, dtype=np.int64)
        for k in (_UPPER, _DIGIT, _SPACE, _STOP, _SYMBOL, _WIDE, _TAIL)
    }
    solid = kind != _SPACE
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    opens[first] = solid[first]
    words = np.add.reduceat(opens.view(np.uint8), first, dtype=np.int64)
    size = np.diff(np.append(first, len(part)))
    chars = np.maximum(size - count[_TAIL] - count[_SPACE], 1)
    last = np.minimum(end[filled], len(part)) - 1
    rows = out[filled]
    rows[:, 1] = count[_UPPER] / chars
    rows[:, 2] = count[_DIGIT] / chars
    rows[:, 3] = np.minimum(count[_SYMBOL] / chars, 0.5)
    rows[:, 4] = count[_STOP] / chars
    rows[:, 5] = np.minimum(chars / np.maximum(words, 1), 30) / 10
    rows[:, 6] = np.log1p(words) / 5
    rows[:, 7] = kind[last] == _STOP
    rows[:, 8] = count[_SYMBOL] * 4 > words
    rows[:, 9] = count[_UPPER] * 2 > chars
    rows[:, 10] = words > 0
    out[filled] = rows
    return out


def line_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, byte lengths and the document of every line of the texts; an empty text is a line."""
    breaks = np.flatnonzero(raw == 10)
    n = len(offsets) - 1
    begin = np.concatenate([offsets[:-1], breaks + 1])
    end = np.concatenate([breaks, offsets[1:]])
    # In order of the text; where texts meet, a text's end comes before the next one's begin.
    of_break = np.searchsorted(offsets[1:], breaks, "right")
    doc = np.sort(np.concatenate([np.arange(n), of_break]), kind="stable")
    begin = begin[np.lexsort((begin, np.concatenate([np.arange(n), of_break])))]
    end = end[np.lexsort((end, np.concatenate([of_break, np.arange(n)])))]
    return _own_features(raw, begin, end), end - begin, doc


def with_neighbours(own: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and those of the line after (zero at the ends)."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = doc[1:] == doc[:-1]
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    return np.concatenate([own, before, after], axis=1)


class _Chains:
    """Lines of many documents by their place, longest document first."""

    def __init__(self, doc: np.ndarray):
        size = np.bincount(doc)
        self.size = size[size > 0]
        base = np.cumsum(self.size) - self.size
        self.order = np.argsort(-self.size, kind="stable")
        self.base = base[self.order]
        self.most = int(self.size.max(initial=0))
        live = np.sort(self.size)
        self.live = len(live) - np.searchsorted(live, np.arange(self.most), "right")

    def passes(self, good: np.ndarray, keep: float) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log-odds of good against bad; ``keep`` favours equal neighbours."""

        def over(x):  # what a neighbour's log-odds say about this line
            return np.logaddexp(x + keep, 0.0) - np.logaddexp(x, keep)

        forward, backward = good.copy(), np.zeros_like(good)
        for t in range(1, self.most):
            at = self.base[: self.live[t]] + t
            forward[at] += over(forward[at - 1])
        for t in range(self.most - 2, -1, -1):
            at = self.base[: self.live[t + 1]] + t
            backward[at] = over(good[at + 1] + backward[at + 1])
        return forward, backward


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Crf:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, keep: float, steady: float | None = None):
        self.mean, self.scale, self.weights, self.keep, self.steady = mean, scale, weights, keep, steady

    def good(self, own: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The probability that each line is good."""
        x = (with_neighbours(own, doc) - self.mean) / self.scale
        odds = (x @ self.weights[:-1] + self.weights[-1]).astype(np.float64)
        forward, backward = _Chains(doc).passes(odds, self.keep)
        return _sigmoid(forward + backward)

    def scores(self, column: pa.Array) -> np.ndarray:
        raw, offsets = string_parts(column)
        out = np.zeros(len(offsets) - 1)
        if self.steady is not None:
            return out + self.steady
        for lo, hi in groups(offsets, PIECE):
            own, size, doc = _lines(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            good, weight = self.good(own, doc), size + 1.0  # an empty line counts as its end
            out[lo:hi] = np.bincount(doc, good * weight) / np.bincount(doc, weight)
        return np.clip(out, 0.0, 1.0)


def _lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line_features, for a long text in pieces cut at line ends."""
    if len(raw) <= PIECE or len(offsets) > 2:
        return line_features(raw, offsets)
    found, at = [], 0
    while True:
        end = len(raw)
        if at + PIECE < len(raw):
            cut = np.flatnonzero(raw[at + PIECE :: 1][:PIECE] == 10)
            end = at + PIECE + int(cut[0]) if len(cut) else _next_break(raw, at + 2 * PIECE)
        part = raw[at:end]
        found.append(line_features(part, np.array([0, len(part)])))
        if end == len(raw):
            break
        at = end + 1
    own, size, _ = (np.concatenate(x) for x in zip(*found))
    return own, size, np.zeros(len(size), np.int64)


def _next_break(raw: np.ndarray, at: int) -> int:
    while at < len(raw):
        cut = np.flatnonzero(raw[at : at + PIECE] == 10)
        if len(cut):
            return at + int(cut[0])
        at += PIECE
    return len(raw)


def train(texts: pa.Array, labels: np.ndarray, config: CrfConfig) -> Crf:
    """Maximum conditional likelihood with all lines labelled as their document.

    Each document counts once, however many lines it has; classes weigh as they come.
    """
    raw, offsets = string_parts(texts)
    own, _, doc = line_features(raw, offsets)
    x = with_neighbours(own, doc).astype(np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - mean) / scale
    y = labels[doc].astype(np.float64)
    chains = _Chains(doc)
    share = 1.0 / np.bincount(doc)[doc] / len(labels)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    weights, keep = np.zeros(x.shape[1] + 1), 0.0
    first, second = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
    for step in range(1, config.rounds + 1):
        odds = x @ weights[:-1] + weights[-1]
        forward, backward = chains.passes(odds, keep)
        miss = (y - _sigmoid(forward + backward)) * share
        # The chance that neighbours are equal, from the four ways they can be.
        f, b = forward[pair], odds[pair + 1] + backward[pair + 1]
        alike = np.logaddexp(f + b, 0.0) + keep
        unlike = np.logaddexp(f, b)
        equal = _sigmoid(alike - unlike)
        gain = np.append(x.T @ miss, miss.sum()) - config.l2 * weights
        gain = np.append(gain, ((1.0 - equal) * share[pair]).sum() - config.l2 * keep)
        first = 0.9 * first + 0.1 * gain
        second = 0.99 * second + 0.01 * gain**2
        move = config.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights, keep = weights + move[:-1], keep + move[-1]
    return Crf(mean, scale, weights, float(keep))


def sample_of(docs: DataFrame, labels: DataFrame, rows: int) -> pa.Table:
    """text and label (0 or 1) of about ``rows`` documents of each label, in a fixed order.

    The labels are drawn first, so what is sent to all tasks holds at most that many ids,
    and the texts of other documents stay where they are.
    """
    known = labels.select("doc_id", F.col("label").cast("int").alias("label")).dropna()
    drawn_ids, _ = drawn(known.filter("label IN (0, 1)"), "label", rows, 2)
    texts = docs.select(F.col("doc_id").alias("of"), "text")
    found = texts.join(F.broadcast(drawn_ids), F.col("of") == F.col("doc_id"))
    return found.select("doc_id", "text", "label").orderBy("doc_id", "label", F.md5("text")).toArrow()


def fit(docs: DataFrame, labels: DataFrame, config: CrfConfig | None = None) -> Crf:
    """The field learned from docs(doc_id, text) and labels(doc_id, label), 1 for good."""
    config = config or CrfConfig()
    table = sample_of(docs, labels, config.rows)
    known = table.column(2).to_numpy()
    if len(np.unique(known)) < 2:
        none = np.zeros(1)
        return Crf(none, none, none, 0.0, float(known.mean()) if len(known) else 0.5)
    return train(table.column(1), known, config)


def score(docs: DataFrame, model: Crf, keep: Sequence[str] = ("doc_id",), name: str = "score") -> DataFrame:
    """The kept columns and the score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(text: pa.Array) -> list[pa.Array]:
        return [pa.array(shared.value.scores(text))]

    return with_results(docs, keep, {"text": F.col("text")}, [StructField(name, DoubleType())], work)


def good(docs: DataFrame, model: Crf, least: float = 0.7) -> DataFrame:
    """The documents, as they came, that score ``least`` or more."""
    found = score(docs, model, docs.columns, "llm_quality")
    return found.filter(F.col("llm_quality") >= least).select(*docs.columns)
