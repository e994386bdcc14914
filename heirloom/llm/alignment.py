"""Alignment of two tokenizations of one text, and how well token pairs go together.

Both token sequences of a text are given by the byte places where their tokens end. Most
stretches are one to one: the two arrays of ends agree at a fixed distance of indexes. So
slices of doubling width are compared at the present distance, the last one is halved to
where they part, and the whole stretch is passed at once. Where they part, the group that
follows is resolved token by token up to the next common end; there the distance is new.

Two tokens are linked if their bytes overlap; a pair of ids counts in how many texts of
the corpus it is linked. These counts are combined before they are shuffled and cover all
texts. Counted pairs below a bound are sent to all tasks; above it the texts' pairs are
joined to them, and skewed pairs are split by the join.

Defined results: a text that is null or empty, or that either tokenizer doesn't give back
byte for byte (the second writes spaces as a mark, so a text that holds the mark itself),
has no tokens. Repeated rows each count as a text. Documents' other columns are not kept.
One text and its tokens are held by one task; nothing is cut off.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField
from tokenizers import Tokenizer

from heirloom.llm.arrow_text import groups, string_parts, with_results
from heirloom.session import materialize, materialize_counted

#: So many counted pairs are sent to all tasks at most.
FEW = 1 << 21
#: Bytes of text that are aligned at once; a longer text alone.
PIECE = 1 << 18
#: Bytes of rows that are worked on at once.
SLICE = 1 << 21
#: Fixed value: the pattern by which byte-level tokenizers part text before they merge.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What may be one long part, which the quicker of two libraries merges in quadratic time.
LONG = re.compile(r"\S{400}|\s{400}")


@dataclass(frozen=True)
class Pair:
    """Two tokenizers: the JSON of a byte-level one, the bytes of a piece model."""

    first: str
    second: bytes


def load(byte_level: str, piece_model: str) -> Pair:
    """The two tokenizers of these files, read by the driver."""
    with open(byte_level, encoding="utf-8") as file:
        text = file.read()
    kind = json.loads(text)
    before = kind.get("pre_tokenizer") or {}
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError("the first tokenizer has to be byte-level, without a prefix of its own")
    if kind.get("normalizer"):
        raise ValueError("the first tokenizer changes texts")
    with open(piece_model, "rb") as file:
        return Pair(text, file.read())


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def align(x: list[int], y: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For two lists of ends with the same last one: which tokens of each end a group, and the linked indexes.

    Ends of a list grow strictly.
    """
    n = len(x)
    x_last, y_last = bytearray(b"\1") * n, bytearray(b"\1") * len(y)
    runs: list[int] = []
    left: list[int] = []
    right: list[int] = []
    i = j = 0
    while i < n:
        at, width, shift = i, 1, j - i
        while at < n and x[at : at + width] == y[at + shift : at + shift + width]:
            at += width
            width *= 2
        at = min(at, n)
        while width > 1 and at < n:
            width //= 2
            if x[at : at + width] == y[at + shift : at + shift + width]:
                at += width
        if at > i:
            runs += (i, shift, at - i)
            i, j = at, at + shift
            if i >= n:
                break
        p, q = i, j
        while x[p] != y[q]:
            left.append(p)
            right.append(q)
            if x[p] < y[q]:
                p += 1
            else:
                q += 1
        left.append(p)
        right.append(q)
        x_last[i:p] = bytes(p - i)
        y_last[j:q] = bytes(q - j)
        i, j = p + 1, q + 1
    start, shift, size = np.array(runs, np.int64).reshape(-1, 3).T
    one = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    of_x = np.concatenate([np.array(left, np.int64), one])
    of_y = np.concatenate([np.array(right, np.int64), one + np.repeat(shift, size)])
    return np.frombuffer(x_last, bool), np.frombuffer(y_last, bool), of_x, of_y


class Aligner:
    """Both tokenizers, what bytes their tokens stand for, and how groups are written."""

    def __init__(self, pair: Pair):
        self.tokenizer = Tokenizer.from_str(pair.first)
        self.tokenizer.encode_special_tokens = True
        self.model = sentencepiece.SentencePieceProcessor(model_proto=pair.second)
        value = byte_characters()
        a_size = self.tokenizer.get_vocab_size()
        self.a_raw = [bytes(value.get(c, 0) for c in self.tokenizer.id_to_token(i) or "") for i in range(a_size)]
        self.b_raw = [self._piece_bytes(i) for i in range(self.model.get_piece_size())]
        self.a_bytes, self.b_bytes = (np.array(list(map(len, raw)), np.int64) for raw in (self.a_raw, self.b_raw))
        self.quick = self._quick(json.loads(pair.first)["model"])
        # An id inside its half of a group, the last of the first half, inside the second, the last of all.
        sizes = (a_size, a_size, len(self.b_raw), len(self.b_raw))
        self.written = [f"{i}{mark}" for mark, n in zip(",|,;", sizes, strict=True) for i in range(n)]

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        if self.model.is_byte(i):
            return bytes([int(piece[1:-1], 16)])
        return b"" if self.model.is_control(i) or self.model.is_unknown(i) else piece.replace("▁", " ").encode()

    def _quick(self, model: dict) -> tiktoken.Encoding | None:
        """The same merges in the library that knows them by the order of ids, if theirs is that order."""
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ids = [model["vocab"][m] for m in merged]
        if model.get("ignore_merges") or ids != sorted(ids):
            return None
        ranks = {self.a_raw[i]: i for token, i in model["vocab"].items() if len(token) == 1}
        ranks |= {self.a_raw[i]: i for i in ids}
        return tiktoken.Encoding("first", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})

    def first_ids(self, text: str) -> list[int]:
        if self.quick is None or LONG.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(text)

    def ids(self, texts: list[str], raws: list[bytes]) -> list[tuple[list[int], list[int]]]:
        """The ids of each text with a space before it, if both give back its bytes."""
        out = []
        for text, raw, b in zip(texts, raws, self.model.encode(texts, num_threads=1), strict=True):
            a, whole = self.first_ids(" " + text) if text else [], b" " + raw
            same = b"".join(map(self.a_raw.__getitem__, a)) == whole == b"".join(map(self.b_raw.__getitem__, b))
            out.append((a, b) if same else ([], []))
        return out

    def work(self, text: pa.Array) -> list[pa.Array]:
        raw, offsets = string_parts(text)
        found = [self._some(raw, offsets[lo : hi + 1]) for lo, hi in groups(offsets, PIECE)]
        counts, words, links, times, cuts = zip(*found, strict=True) if found else ((), (), (), (), ())
        n_a, n_b, n_groups = np.concatenate([np.zeros((3, 0), np.int64), *counts], axis=1)
        at = pa.array(np.cumsum([0, *chain.from_iterable(cuts)]).astype(np.int32))
        links = pa.array(np.concatenate([np.empty(0, np.int64), *links]))
        times = pa.array(np.concatenate([np.empty(0, np.int32), *times]))
        return [
            *map(pa.array, (n_a, n_b, n_groups)),
            pa.array(list(chain.from_iterable(words)), pa.string()),
            pa.ListArray.from_arrays(at, links),
            pa.ListArray.from_arrays(at, times),
        ]

    def _some(self, raw: np.ndarray, offsets: np.ndarray):
        """Counts of tokens and groups, groups as text, linked id pairs and how often, for some texts."""
        bodies = [raw[lo:hi].tobytes() for lo, hi in zip(offsets, offsets[1:], strict=False)]
        coded = self.ids([body.decode(errors="replace") for body in bodies], bodies)
        n_a, n_b = (np.array([len(c[k]) for c in coded], np.int64) for k in (0, 1))
        a, b = (np.fromiter(chain.from_iterable(c[k] for c in coded), np.int64) for k in (0, 1))
        a_last, b_last, of_a, of_b = align(np.cumsum(self.a_bytes[a]).tolist(), np.cumsum(self.b_bytes[b]).tolist())
        # A group's first half comes after the second halves of those before it.
        a_end, b_end = np.flatnonzero(a_last), np.flatnonzero(b_last)
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        code = np.empty(len(a) + len(b), np.int64)
        n = len(self.a_raw)
        code[np.arange(len(a)) + np.append(-1, b_end)[a_group] + 1] = a + n * a_last
        code[np.arange(len(b)) + a_end[b_group] + 1] = b + 2 * n + len(self.b_raw) * b_last
        cut = np.cumsum(np.append(0, n_a + n_b)).tolist()
        words = [
            "".join(map(self.written.__getitem__, code[lo:hi].tolist()))[:-1] for lo, hi in zip(cut, cut[1:], strict=False)
        ]
        row = np.repeat(np.arange(len(n_a)), n_a)
        n_groups = np.bincount(row[a_end], minlength=len(n_a))
        key = a[of_a] << 32 | b[of_b]
        order = np.lexsort((key, row[of_a]))
        key, of = key[order], row[of_a][order]
        new = np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])) if len(key) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(key))).astype(np.int32)
        return np.stack([n_a, n_b, n_groups]), words, key[first], times, np.bincount(of[first], minlength=len(n_a))


@lru_cache(maxsize=2)
def aligner(pair: Pair) -> Aligner:
    """The aligner of two tokenizers, once a worker."""
    return Aligner(pair)


def alignments(docs: DataFrame, pair: Pair) -> DataFrame:
    """doc_id; n_a, n_b, n_groups; ``groups`` as ``a1,a2|b1;a3|b2,b3``; the distinct ``links``
    (first id << 32 | second id) and the ``times`` of each, for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(pair)

    def work(text: pa.Array) -> list[pa.Array]:
        return aligner(sent.value).work(text)

    made = [StructField(c, LongType()) for c in ("n_a", "n_b", "n_groups")]
    made += [StructField("groups", StringType()), StructField("links", ArrayType(LongType()))]
    made += [StructField("times", ArrayType(IntegerType()))]
    return with_results(docs.select("doc_id", "text"), ["doc_id"], {"text": F.col("text")}, made, work, SLICE)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """link, n_docs (documents that have it) and best (no link of its first id has more) of all links."""
    counted = aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("n_docs"))
    counted = materialize(counted, "align-pairs")
    first = F.shiftright("link", 32).alias("first")
    most = counted.groupBy(first).agg(F.max("n_docs").alias("most"))
    joined = counted.withColumn("first", first).join(most, "first")
    return joined.select("link", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def with_pair_counts(aligned: DataFrame, few: int = FEW) -> DataFrame:
    """Written alignments with n_links, n_best (links that are their first id's most frequent)
    and count_sum (documents of their pairs, over all links)."""
    pairs, count = materialize_counted(pair_counts(aligned), "align-counted")
    rows = aligned.withColumn("n_links", F.col("n_a") + F.col("n_b") - F.col("n_groups"))
    if count <= few:
        return _looked_up(rows, pairs)
    rows = materialize(rows.withColumn("llm_row", F.monotonically_increasing_id()), "align-rows")
    each = rows.select("llm_row", F.inline(F.arrays_zip(F.col("links").alias("link"), F.col("times").alias("times"))))
    sums = each.toDF("llm_row", "link", "times").join(pairs, "link").groupBy("llm_row")
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")
    found = sums.agg(best, F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
    joined = rows.join(found, "llm_row", "left").drop("llm_row", "links", "times")
    return joined.fillna(0, ["n_best", "count_sum"])


def _looked_up(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same where all counted pairs can be sent to all tasks."""
    sent = rows.sparkSession.sparkContext.broadcast(_sorted_pairs(pairs))

    def work(links: pa.Array, times: pa.Array) -> list[pa.Array]:
        known, n_docs, best = sent.value
        size = links.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.repeat(np.arange(len(size)), size)
        at = np.searchsorted(known, links.flatten().to_numpy())
        many = times.flatten().to_numpy().astype(np.int64)
        total = np.zeros((2, len(size)), np.int64)
        np.add.at(total[0], of, many * best[at])
        np.add.at(total[1], of, many * n_docs[at])
        return [pa.array(total[0]), pa.array(total[1])]

    keep = [c for c in rows.columns if c not in ("links", "times")]
    made = [StructField("n_best", LongType()), StructField("count_sum", LongType())]
    return with_results(rows, keep, {"links": F.col("links"), "times": F.col("times")}, made, work)


def _sorted_pairs(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = pairs.toArrow()
    link, n_docs, best = (found.column(c).to_numpy() for c in ("link", "n_docs", "best"))
    by = np.argsort(link)
    return link[by], n_docs[by], best[by]
