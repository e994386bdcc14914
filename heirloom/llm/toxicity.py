"""Toxicity scores of overlapping windows from a bidirectional gated recurrent network.

A text is a row of words; windows of ``WIDTH`` words overlap by half and the last one
ends with the text. A word enters as a vector learned for it (if it is in the
vocabulary) beside the mean of vectors learned for its runs of three characters, so
words that were never seen have an input too. Gated units read a window in both
directions, attention weighs their states, and the pooled state gives the window's
log-odds. A document's score is that of its worst window, brought to a probability by a
logistic curve fitted on documents that the network was not trained on.

The network is trained in numpy on a bounded sample of labelled documents. A toxic
document says only that some window is toxic: its windows with the highest log-odds
stand for it, first by word statistics, later by the network itself.

Defined results: a null or empty text is one window without words; without two classes
to learn from every score is the share of toxic labels, or 0; rows that repeat get
equal results; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from heirloom.llm.arrow_text import groups, string_parts, with_results
from heirloom.llm.quality import sample_of

WIDTH, STRIDE = 24, 12
UNITS, WORD_DIM, CHAR_DIM, LOOK_DIM = 8, 8, 8, 8
CHAR_ROWS = 4096
PIECE = 1 << 19
#: Words whose inputs a worker keeps.
CACHE = 1 << 16

_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_IN_WORD[39] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class GruConfig:
    """``rows``: labelled documents drawn of each class, about. ``vocabulary``: words with a
    vector of their own; rarer ones have their characters only. ``steps``: updates of a
    round, after which the windows that stand for a document are chosen anew."""

    rows: int = 1500
    vocabulary: int = 20_000
    rounds: int = 3
    steps: int = 150
    batch: int = 256
    rate: float = 0.01
    seed: int = 7


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of the texts, the number of words of each text and where each word begins."""
    solid = _IN_WORD[raw]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    filled = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    opens[first], closes[last] = solid[first], solid[last]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    data = _LOWER[raw].tobytes()
    words = [data[a:b] for a, b in zip(begin.tolist(), end.tolist())]
    count = np.bincount(np.searchsorted(offsets[1:], begin, "right"), minlength=len(offsets) - 1)
    return words, count, begin


def windows(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of ``count`` words that follow each other: the text, first word and number of
    words of every window. Each text has one window at least."""
    n = np.maximum(-(-(count - WIDTH) // STRIDE), 0) + 1
    text = np.repeat(np.arange(len(count)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    base = (np.cumsum(count) - count)[text]
    start = base + np.minimum(step * STRIDE, np.maximum(count[text] - WIDTH, 0))
    return text, start, np.minimum(count[text], WIDTH)


def _grid(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of windows, one row each, and which places hold a word."""
    at = start[:, None] + np.arange(WIDTH)
    real = np.arange(WIDTH) < size[:, None]
    ids = np.append(ids, 0)
    return ids[np.where(real, at, len(ids) - 1)], real


def _trigrams(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the character table for each run of three bytes of <word>, and their numbers."""
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint32)
    size = np.array([len(w) + 2 for w in words])
    end = np.cumsum(size)
    keep = np.ones(len(data), bool)
    keep[end - 1] = keep[end - 2] = False
    code = data << 16
    code[:-1] |= data[1:] << 8
    code[:-2] |= data[2:]
    rows = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)[keep]
    return rows, size - 2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Weights by name, forward and backward passes over batches of windows."""

    def __init__(self, vocabulary: dict[bytes, int], rng: np.random.Generator):
        self.vocabulary = vocabulary
        dim = WORD_DIM + CHAR_DIM

        def random(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        # Row 0 of the word table stands for all other words.
        self.p = {"word": 0.1 * rng.normal(size=(len(vocabulary) + 1, WORD_DIM)).astype(np.float32)}
        self.p["char"] = 0.1 * rng.normal(size=(CHAR_ROWS, CHAR_DIM)).astype(np.float32)
        for way in "fb":
            self.p[f"w{way}"] = random(dim, 3 * UNITS)
            self.p[f"u{way}"] = random(UNITS, 3 * UNITS)
            self.p[f"c{way}"] = np.zeros(3 * UNITS, np.float32)
        self.p["look"], self.p["ask"] = random(2 * UNITS, LOOK_DIM), random(LOOK_DIM, 1)[:, 0]
        self.p["out"], self.p["bias"] = random(2 * UNITS, 1)[:, 0], np.zeros(1, np.float32)

    def inputs(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of words, and the rows of the tables that they are made of."""
        own = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        rows, n = _trigrams(words)
        first = np.cumsum(n) - n
        chars = np.add.reduceat(self.p["char"][rows], first, axis=0) / n[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][own], chars], axis=1), own, rows, n

    def projected(self, words: Sequence[bytes]) -> np.ndarray:
        """What words add to the gates, forward and backward."""
        x = self.inputs(words)[0]
        return np.concatenate([x @ self.p["wf"] + self.p["cf"], x @ self.p["wb"] + self.p["cb"]], axis=1)

    def _read(self, x: np.ndarray, real: np.ndarray | None, way: str, keep: list | None) -> np.ndarray:
        """States of one direction. x: (place, window, gates)."""
        u, k = self.p[f"u{way}"], UNITS
        h = np.zeros((x.shape[1], k), np.float32)
        states = np.empty((x.shape[0], x.shape[1], k), np.float32)
        for t in range(x.shape[0]) if way == "f" else range(x.shape[0] - 1, -1, -1):
            g = h @ u
            zr = _sigmoid(x[t, :, : 2 * k] + g[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            n = np.tanh(x[t, :, 2 * k :] + r * g[:, 2 * k :])
            new = n + z * (h - n)
            if real is not None:
                new = np.where(real[:, t, None], new, h)
            if keep is not None:
                keep.append((t, h, g, z, r, n))
            h = new
            states[t] = h
        return states

    def logits(self, xf: np.ndarray, xb: np.ndarray, real: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
        """Log-odds of windows. ``real``: places that hold a word, None if all do."""
        steps = {"f": [] if keep is not None else None, "b": [] if keep is not None else None}
        h = np.concatenate([self._read(xf, real, "f", steps["f"]), self._read(xb, real, "b", steps["b"])], axis=2)
        seen = np.tanh(h @ self.p["look"])
        e = seen @ self.p["ask"]
        if real is not None:
            e = np.where(real.T, e, -1e9)
        a = np.exp(e - e.max(axis=0))
        if real is not None:
            a *= real.T
        a /= np.maximum(a.sum(axis=0), 1e-9)
        pooled = (a[:, :, None] * h).sum(axis=0)
        if keep is not None:
            keep.update(h=h, seen=seen, a=a, pooled=pooled, steps=steps)
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradients(self, words: Sequence[bytes], ids: np.ndarray, real: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over windows; ``ids`` point into ``words``."""
        x, own, rows, n = self.inputs(words)
        put = {w: x @ self.p[f"w{w}"] + self.p[f"c{w}"] for w in "fb"}
        keep: dict = {}
        out = self.logits(put["f"][ids.T], put["b"][ids.T], real, keep)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        d = ((_sigmoid(out) - y) / len(y)).astype(np.float32)
        g["out"], g["bias"] = keep["pooled"].T @ d, np.array([d.sum()], np.float32)
        d_pooled = d[:, None] * self.p["out"]
        h, seen, a = keep["h"], keep["seen"], keep["a"]
        d_h = a[:, :, None] * d_pooled
        d_a = (h * d_pooled).sum(axis=2)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        g["ask"] = np.einsum("tnk,tn->k", seen, d_e)
        d_seen = d_e[:, :, None] * self.p["ask"] * (1 - seen**2)
        g["look"] = np.einsum("tni,tnk->ik", h, d_seen)
        d_h = d_h + d_seen @ self.p["look"].T
        d_x = np.zeros_like(x)
        for i, way in enumerate("fb"):
            d_put = np.zeros_like(put[way])
            own_h = d_h[:, :, i * UNITS : (i + 1) * UNITS]
            carry = np.zeros_like(own_h[0])
            u = self.p[f"u{way}"]
            for t, h0, gates, z, r, cand in reversed(keep["steps"][way]):
                carry = carry + own_h[t]
                live = np.where(real[:, t, None], carry, 0)
                d_n = live * (1 - z) * (1 - cand**2)
                d_z = live * (h0 - cand) * z * (1 - z)
                d_r = d_n * gates[:, 2 * UNITS :] * r * (1 - r)
                d_gate = np.concatenate([d_z, d_r, d_n * r], axis=1)
                np.add.at(d_put, ids[:, t], np.concatenate([d_z, d_r, d_n], axis=1))
                g[f"u{way}"] += h0.T @ d_gate
                carry = np.where(real[:, t, None], carry * z, carry) + d_gate @ u.T
            g[f"w{way}"], g[f"c{way}"] = x.T @ d_put, d_put.sum(axis=0)
            d_x += d_put @ self.p[f"w{way}"].T
        np.add.at(g["word"], own, d_x[:, :WORD_DIM])
        np.add.at(g["char"], rows, np.repeat(d_x[:, WORD_DIM:] / n[:, None], n, axis=0))
        return g


class Scorer:
    """A trained network with the curve from a document's highest log-odds to its score."""

    def __init__(self, network: Network | None, slope: float, shift: float, steady: float = 0.0):
        self.network, self.slope, self.shift, self.steady = network, slope, shift, steady
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((0, 6 * UNITS), np.float32)

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "table": self.table[:0]}

    def _ids(self, words: list[bytes]) -> np.ndarray:
        """Rows of the table with the words' inputs; new words are added to it."""
        if len(self.known) > CACHE:
            self.known, self.table = {}, self.table[:0]
        known = self.known
        new = list(dict.fromkeys(w for w in words if w not in known))
        for lo in range(0, len(new), 1 << 14):
            part = new[lo : lo + (1 << 14)]
            known.update(zip(part, range(len(self.table), len(self.table) + len(part))))
            self.table = np.concatenate([self.table, self.network.projected(part)])
        return np.fromiter((known[w] for w in words), np.int64, len(words))

    def window_logits(self, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), np.float32)
        table = self.table if len(self.table) else np.zeros((1, 6 * UNITS), np.float32)
        for full in (True, False):
            these = np.flatnonzero((size == WIDTH) == full)
            for lo in range(0, len(these), 2048):
                at = these[lo : lo + 2048]
                grid, real = _grid(ids, start[at], size[at])
                x = table[grid.T]
                out[at] = self.network.logits(x[:, :, : 3 * UNITS], x[:, :, 3 * UNITS :], None if full else real)
        return out

    def worst(self, column: pa.Array) -> np.ndarray:
        """The highest log-odds of any window of each text."""
        raw, offsets = string_parts(column)
        out = np.full(len(offsets) - 1, -np.inf)
        for lo, hi in groups(offsets, PIECE):
            part = raw[offsets[lo] : offsets[hi]]
            for texts, words, count in _pieces(part, offsets[lo : hi + 1] - offsets[lo]):
                text, start, size = windows(count)
                np.maximum.at(out, lo + texts[text], self.window_logits(self._ids(words), start, size))
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(column), self.steady)
        return _sigmoid(self.slope * self.worst(column) + self.shift)


def _pieces(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
    """Texts and their words; a long text comes in pieces that share WIDTH words."""
    if len(raw) <= PIECE or len(offsets) > 2:
        words, count, _ = words_of(raw, offsets)
        yield np.arange(len(count)), words, count
        return
    at, step = 0, PIECE
    while True:
        end = min(at + step, len(raw))
        words, count, begin = words_of(raw[at:end], np.array([0, end - at]))
        if end < len(raw):
            if len(words) <= 2 * WIDTH:
                step *= 2
                continue
            words, count = words[:-1], count - 1  # the last one may go on
        yield np.zeros(1, np.int64), words, count
        if end == len(raw):
            return
        at, step = at + int(begin[len(words) - WIDTH]), PIECE


def _vocabulary(words: list[bytes], doc: np.ndarray, y: np.ndarray, most: int) -> tuple[dict[bytes, int], np.ndarray]:
    """Words of three or more documents, the most frequent first, and how much more often
    each is in toxic documents, in standard errors."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pairs = np.unique(ids * (len(y) + 1) + doc)
    of, toxic = pairs // (len(y) + 1), y[pairs % (len(y) + 1)]
    up, down = np.bincount(of[toxic == 1], minlength=len(number)), np.bincount(of[toxic == 0], minlength=len(number))
    odds = np.log((up + 0.5) / (y.sum() + 1)) - np.log((down + 0.5) / (len(y) - y.sum() + 1))
    sure = odds / np.sqrt(1 / (up + 0.5) + 1 / (down + 0.5))
    often = np.argsort(-(up + down), kind="stable")
    often = often[(up + down)[often] >= 3][:most]
    names = list(number)
    return {names[i]: j + 1 for j, i in enumerate(often)}, np.append(0, np.clip(sure[often], -4, 8)).astype(np.float32)


def _best(value: np.ndarray, text: np.ndarray, top: int) -> np.ndarray:
    """The windows with the highest values of each text, ``top`` at most."""
    order = np.lexsort((-value, text))
    sorted_text = text[order]
    new = np.append(True, sorted_text[1:] != sorted_text[:-1])
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[place < top]


def _batches(chosen: np.ndarray, config: GruConfig, rng: np.random.Generator) -> Iterator[np.ndarray]:
    done = 0
    while done < config.steps:
        rng.shuffle(chosen)
        for lo in range(0, len(chosen), config.batch):
            done += 1
            yield chosen[lo : lo + config.batch].copy()


def train(texts: pa.Array, labels: np.ndarray, config: GruConfig) -> Scorer:
    rng = np.random.default_rng(config.seed)
    raw, offsets = string_parts(texts)
    words, count, _ = words_of(raw, offsets)
    y = labels.astype(np.int64)
    doc = np.repeat(np.arange(len(y)), count)
    aside = rng.random(len(y)) < 0.25  # documents for the curve
    for k in (0, 1):
        if aside[y == k].all() or not aside[y == k].any():
            aside[:] = False
    used = ~aside[doc]
    seen = np.flatnonzero(~aside)
    place = np.zeros(len(y), np.int64)
    place[seen] = np.arange(len(seen))
    vocabulary, sure = _vocabulary([w for w, u in zip(words, used) if u], place[doc[used]], y[seen], config.vocabulary)
    net = Network(vocabulary, rng)
    net.p["word"][:, 0] = sure / 4
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    names = list(number)
    text, start, size = windows(count)
    value = np.array([sure[vocabulary.get(w, 0)] for w in names], np.float32) if names else np.zeros(1, np.float32)
    grid, real = _grid(ids, start, size)
    value = np.where(real, np.maximum(value[grid], 0) if names else 0.0, 0).max(axis=1)
    scorer = Scorer(net, 1.0, 0.0)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    learn = ~aside[text]
    for _ in range(config.rounds):
        chosen = _best(value, text, 2)
        other = rng.choice(len(text), min(len(text), len(y)), replace=False)
        other = other[y[text[other]] == 0]
        chosen = np.unique(np.concatenate([chosen[learn[chosen]], other[learn[other]]]))
        for at in _batches(chosen, config, rng):
            used_ids, local = np.unique(grid[at], return_inverse=True)
            grads = net.gradients(
                [names[i] for i in used_ids] if names else [b""], local.reshape(grid[at].shape), real[at], y[text[at]]
            )
            step += 1
            for k, v in grads.items():
                m, s = moments[k]
                m += 0.1 * (v - m)
                s += 0.01 * (v * v - s)
                rate = config.rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
                net.p[k] = (net.p[k] - rate).astype(np.float32)
        scorer = Scorer(net, 1.0, 0.0)
        value = scorer.window_logits(scorer._ids(words), start, size)
    worst = np.full(len(y), -np.inf)
    np.maximum.at(worst, text, value)
    held = aside if aside.any() else ~aside
    slope, shift = _curve(worst[held], y[held])
    return Scorer(net, slope, shift)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's steps with a little decay."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(a @ w)
        hessian = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        w = w + np.clip(np.linalg.solve(hessian, a.T @ (y - p) - 1e-2 * w), -2, 2)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, config: GruConfig | None = None) -> Scorer:
    """The scorer learned from docs(doc_id, text) and labels(doc_id, label), 1 for toxic."""
    config = config or GruConfig()
    table = sample_of(docs, labels, config.rows)
    known = table.column(2).to_numpy()
    if len(np.unique(known)) < 2:
        return Scorer(None, 1.0, 0.0, float(known.mean()) if len(known) else 0.0)
    return train(table.column(1), known, config)


def score(docs: DataFrame, model: Scorer, keep: Sequence[str] = ("doc_id",), name: str = "score") -> DataFrame:
    """The kept columns and the score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(text: pa.Array) -> list[pa.Array]:
        return [pa.array(shared.value.scores(text).astype(np.float64))]

    return with_results(docs, keep, {"text": F.col("text")}, [StructField(name, DoubleType())], work)
