"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``order`` bytes. A byte costs
-log2 count / (n + d) bits in a context seen n times before d different bytes; a byte
the context has not seen costs its escape, -log2 d / (n + d), plus what it costs in the
context that is one byte shorter; below the empty context all 256 bytes cost alike.
Statistics are frozen after fitting, so what a byte costs after a context is a fixed
number for each language. The costs of all contexts and bytes seen in any language are
worked out once and looked up for every byte of a text; the language with the shortest
code is the prediction.

Fitting counts the byte sequences of a bounded sample (``rows`` texts of a language,
chosen by a hash of the id) in the executors and brings only the counts together.

Defined results: a null text or one without a letter is ``und`` with score 0; so is
every text if no language was learned. Ties go to the first language in order. Rows
that repeat get equal results. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from heirloom.llm.arrow_text import groups, string_parts, with_results

UNDETERMINED = "und"
PIECE = 1 << 19
SLOTS = 1 << 21


@dataclass(frozen=True)
class PpmConfig:
    """``order``: bytes of context, up to 6. ``rows``: texts drawn of each language (about,
    as each is drawn by its own hash). The number of a language stands above the bytes of a
    context in one key of 63 bits, so there can be some eight million with four bytes."""

    order: int = 4
    rows: int = 1500

    @property
    def span(self) -> int:
        """The bits of a context and a byte."""
        return 8 * (self.order + 1)

    @property
    def languages(self) -> int:
        return min(1 << 63 - self.span, (1 << 31) - 2)


def _codes(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte from data[order] on, it and the ``order`` bytes before as one number."""
    n = len(data) - order
    code = np.zeros(n, np.int64)
    for k in range(order + 1):
        code = (code << 8) | data[k : k + n]
    return code


def _text_codes(raw: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """The same for every byte of the texts; a text begins after ``order`` zero bytes."""
    size = np.diff(offsets)
    at = np.arange(len(raw)) + order * (np.repeat(np.arange(len(size)), size) + 1)
    padded = np.zeros(len(raw) + order * len(size), np.uint8)
    padded[at] = raw
    return _codes(padded, order)[at - order]


def text_codes(raw: np.ndarray, offsets: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, where the bytes of each begin in the codes, codes), a bounded piece at a time."""
    for lo, hi in groups(offsets, PIECE):
        part = raw[offsets[lo] : offsets[hi]]
        if len(part) <= PIECE:
            own = offsets[lo : hi + 1] - offsets[lo]
            filled = np.flatnonzero(np.diff(own))
            if len(filled):
                yield lo + filled, own[filled], _text_codes(part, own, order)
            continue
        padded = np.concatenate([np.zeros(order, np.uint8), part])
        for at in range(0, len(part), PIECE):
            yield np.array([lo]), np.zeros(1, np.int64), _codes(padded[at : at + PIECE + order], order)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


class Ppm:
    """Frozen costs. ``tables[k]``: the sequences of k + 1 bytes seen in any language, what
    the last byte costs after the others in each, and the escape of each from all k + 1."""

    def __init__(self, languages: list[str], order: int, language: np.ndarray, code: np.ndarray, n: np.ndarray):
        self.languages, self.order, self.tables = languages, order, []
        width = len(languages)
        lower = None
        for k in range(order + 1):
            span = 8 * (k + 1)
            # The language stands above the bytes of a key.
            key, count = _summed((language << span) | (code & ((1 << span) - 1)), n)
            of, gram = key >> span, key & ((1 << span) - 1)
            context = key >> 8
            new = np.append(True, context[1:] != context[:-1])
            group = np.cumsum(new) - 1
            total = np.bincount(group, weights=count)
            kinds = np.bincount(group)
            escape = -np.log2(kinds / (total + kinds))
            # The zero bytes before a text are a context that no text has as bytes.
            grams = np.union1d(gram, [0])
            if k == 0:
                self.nothing = np.full(width, 8.0)
                self.nothing[context[new]] += escape
                costs = np.tile(self.nothing, (len(grams), 1))
            else:
                at = np.searchsorted(lower["grams"], grams & ((1 << (span - 8)) - 1))
                costs = lower["costs"][at].copy()
                # What escaping costs where the context was seen; where not, nothing.
                heads = context[new]
                escapes = np.zeros((len(lower["grams"]), width))
                row = np.searchsorted(lower["grams"], heads & ((1 << (8 * k)) - 1))
                escapes[row, heads >> (8 * k)] = escape
                lower["escapes"] = escapes.astype(np.float32)
                costs += escapes[np.searchsorted(lower["grams"], grams >> 8)]
            costs[np.searchsorted(grams, gram), of] = -np.log2(count / (total + kinds)[group])
            lower = {"grams": grams, "costs": costs}
            self.tables.append(lower)
        for table in self.tables:
            table["costs"] = table["costs"].astype(np.float32)
        grams = self.tables[-1]["grams"]
        self.slots = np.zeros(SLOTS, np.int32)
        self.slots[self._slot(grams)] = np.arange(len(grams))

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return ((code * np.int64(-7046029254386353131)).view(np.uint64) >> np.uint64(43)).view(np.int64)

    def _find(self, k: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        grams = self.tables[k]["grams"]
        at = np.minimum(np.searchsorted(grams, code), len(grams) - 1)
        return at, grams[at] == code

    def bits(self, code: np.ndarray) -> np.ndarray:
        """What each byte costs in each language."""
        table = self.tables[-1]
        at = self.slots[self._slot(code)]
        left = np.flatnonzero(table["grams"][at] != code)
        found = table["costs"][at]
        if not len(left):
            return found
        at, hit = self._find(self.order, code[left])
        found[left[hit]] = table["costs"][at[hit]]
        left = left[~hit]
        found[left] = 0
        for k in range(self.order, 0, -1):
            # No language has this byte after these k: escape from them, then try k - 1.
            lower = self.tables[k - 1]
            at, hit = self._find(k - 1, (code[left] >> 8) & ((1 << (8 * k)) - 1))
            found[left[hit]] += lower["escapes"][at[hit]]
            at, hit = self._find(k - 1, code[left] & ((1 << (8 * k)) - 1))
            found[left[hit]] += lower["costs"][at[hit]]
            left = left[~hit]
            if not len(left):
                return found
        found[left] += self.nothing.astype(np.float32)
        return found

    def code_lengths(self, column: pa.Array) -> np.ndarray:
        """Bits of every text in every language."""
        raw, offsets = string_parts(column)
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        for texts, first, code in text_codes(raw, offsets, self.order):
            total[texts] += np.add.reduceat(self.bits(code), first, axis=0, dtype=np.float64)
        return total


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def drawn(rows: DataFrame, group: str, most: int, groups_most: int, seed: int = 0) -> tuple[DataFrame, list]:
    """About ``most`` rows of each group, by a hash of doc_id, and the groups in order."""
    counts = rows.groupBy(group).count().limit(groups_most + 1).collect()
    if len(counts) > groups_most:
        raise ValueError(f"more than {groups_most} values of {group}")
    if not counts:
        return rows.limit(0), []
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(1.0, most / r[1]))])
    at = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11) / F.lit(float(1 << 53))
    return rows.filter(at < share[F.col(group)]), sorted(r[0] for r in counts)


def fit(labelled: DataFrame, config: PpmConfig | None = None) -> Ppm | None:
    """The model of labelled(doc_id, text, lang); None if there is nothing to learn from."""
    config = config or PpmConfig()
    if config.order > 6:
        raise ValueError("up to 6 bytes of context fit a key")
    rows = labelled.select("doc_id", "text", "lang").dropna()
    sample, languages = drawn(rows, "lang", config.rows, config.languages)
    if not languages:
        return None
    index = {x: i for i, x in enumerate(languages)}
    order, span = config.order, config.span

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
            raw, offsets = string_parts(batch.column(1))
            for texts, first, code in text_codes(raw, offsets, order):
                size = np.diff(np.append(first, len(code)))
                key, n = _summed((np.repeat(of[texts], size) << span) | code, np.ones(len(code), np.int64))
                columns = [key >> span, key & ((1 << span) - 1), n]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["language", "code", "n"])

    counted = (
        sample.select("lang", "text")
        .mapInArrow(count, "language bigint, code bigint, n bigint")
        .groupBy("language", "code")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    if not counted.num_rows:
        return None
    return Ppm(languages, order, *[counted.column(i).to_numpy() for i in range(3)])


def predict(docs: DataFrame, model: Ppm | None, keep: Sequence[str] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The kept columns with lang_pred, score (the share of the best language if all are
    equally likely before) and bits (its code length a byte) of every document."""
    if model is None:
        none = {"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0), "bits": F.lit(0.0)}
        return docs.select(*keep, *[c.alias(prefix + n) for n, c in none.items()])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(text: pa.Array, lettered: pa.Array) -> list[pa.Array]:
        model = shared.value
        bits = model.code_lengths(text)
        best, least = bits.argmin(axis=1), bits.min(axis=1)
        share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
        has = lettered.to_numpy(zero_copy_only=False).astype(bool)
        name = np.where(has, np.array(model.languages, object)[best], UNDETERMINED)
        size = np.diff(string_parts(text)[1])
        return [
            pa.array(name.tolist(), pa.string()),
            pa.array(np.where(has, share, 0.0)),
            pa.array(least / np.maximum(size, 1)),
        ]

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    results = [StructField(prefix + n, t) for n, t in (("lang_pred", StringType()), ("score", DoubleType()), ("bits", DoubleType()))]
    return with_results(docs, keep, {"text": F.col("text"), "lettered": lettered}, results, work)


def spoken(docs: DataFrame, model: Ppm | None, least: float = 0.5) -> DataFrame:
    """The documents, as they came, whose language is known with a score of ``least`` or more."""
    found = predict(docs, model, docs.columns, "llm_")
    kept = found.filter((F.col("llm_lang_pred") != UNDETERMINED) & (F.col("llm_score") >= least))
    return kept.select(*docs.columns)
