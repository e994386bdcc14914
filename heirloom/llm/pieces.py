"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

A text's encoding is the one sequence of pieces of which every two neighbours, taken by
themselves, encode to just these two: a merge that crossed a boundary would be the best of
the whole text only if it were the best of the two pieces around it. So the encoding of
every prefix is that of a shorter prefix and one last piece. The table holds this last
piece for each prefix: an automaton names the pieces that end there, and the one that is
compatible with the last piece of the prefix before it is kept. From the whole text's end
the table is read backwards.

Texts are cut where no piece can reach across (before white space, around bytes without
a piece of their own); what stands between is looked up if it was met before.

Defined results: null is an empty text; an empty text has no ids and decodes to an empty
text. Repeated rows each have their result. Columns of the input whose names are those of
the results give way to them. A text is held by one task with four bytes a character of
its longest stretch without white space; nothing is cut off. The vocabulary, of bounded
size, is read by the driver and sent to all tasks.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField

from heirloom.llm.arrow_text import with_results

#: How the library writes a space.
SPACE = "▁"
#: Stretches and pairs of pieces that a task remembers, characters of a remembered stretch.
REMEMBERED, SHORT = 1 << 18, 48
#: Characters that are cut into stretches at once, bytes of rows that are worked on at once.
WINDOW, SLICE = 1 << 20, 1 << 21
NORMAL, CONTROL, UNKNOWN, BYTE = range(4)
#: What an unknown id decodes to; a fixed value of the library.
UNKNOWN_TEXT = " ⁇ "


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id with their scores and kinds."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: bytes


def load(path: str) -> Vocabulary:
    """The vocabulary of a model file; refuses models that normalise or are not merge-type."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    kinds = bytes(
        CONTROL if model.is_control(i) else UNKNOWN if model.is_unknown(i) else BYTE if model.is_byte(i) else NORMAL
        for i in ids
    )
    if kinds.count(BYTE) not in (0, 256) or any(model.is_unused(i) for i in ids):
        raise ValueError("byte pieces are not complete, or pieces are unused")
    words = Vocabulary(tuple(map(model.id_to_piece, ids)), tuple(map(model.get_score, ids)), kinds)
    coder = Coder(words)
    for text in ("", "  two  spaces \n\tand Ｗide, ﬁne ½ é ends ", *words.pieces[-300:]):
        if coder.encode(text) != model.encode(text) or coder.decode(coder.encode(text)) != model.decode(model.encode(text)):
            raise ValueError("only merge-type models that keep texts as they are can be used")
    return words


class Remembered(dict):
    """Values of a function; those not asked for lately are forgotten."""

    def __init__(self, made: Callable):
        self.made, self.older = made, {}

    def __missing__(self, key):
        found = self.older.pop(key, None)
        if found is None:
            found = self.made(key)
        if len(key) <= SHORT:
            if len(self) >= REMEMBERED // 2:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class Coder:
    """Ids of texts and texts of ids under one vocabulary."""

    def __init__(self, words: Vocabulary):
        self.words = words
        normal = [i for i, kind in enumerate(words.kinds) if kind == NORMAL]
        self.token = list(words.pieces)
        scores = sorted({words.scores[i] for i in normal}, reverse=True)
        order = {score: k for k, score in enumerate(scores)}
        self.rank = {words.pieces[i]: order[words.scores[i]] for i in normal}
        self.never = len(scores)
        number = {words.pieces[i]: i for i in normal}
        # Characters that are only parts of pieces stand in the table too.
        for char in sorted({c for i in normal for c in words.pieces[i]} - number.keys()):
            number[char] = len(self.token)
            self.token.append(char)
        self.size = list(map(len, self.token))
        self.history: list[tuple | None] = [None] * len(self.token)
        self.automaton = ahocorasick.Automaton()
        for piece, i in number.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.bytes = [i for i, kind in enumerate(words.kinds) if kind == BYTE]
        self.unknown = words.kinds.find(UNKNOWN)
        # By piece, whether it may follow others.
        self.after: list[dict[int, bool]] = [{} for _ in self.token]
        self.tested = 0
        self.known = Remembered(self._ids)
        self.stretch, self.cut = self._patterns([words.pieces[i] for i in normal])
        shown = {CONTROL: "", UNKNOWN: UNKNOWN_TEXT}
        self.text = [shown.get(k, p.replace(SPACE, " ")) for p, k in zip(words.pieces, words.kinds, strict=True)]
        self.raw = [t.encode() for t in self.text]
        for value, i in enumerate(self.bytes):
            self.raw[i] = bytes([value])
        for i, kind in enumerate(words.kinds):
            if kind == CONTROL:
                self.raw[i] = b"\xff"  # no UTF-8: it parts the bytes on its sides
        self.no_text = frozenset(self.bytes)

    def _patterns(self, pieces: list[str]) -> tuple[re.Pattern, re.Pattern | None]:
        """What finds stretches, and a place between two of them; pieces never reach across.

        Characters that are neighbours in a piece are of one kind, and so are those linked by
        others. Of the kinds, the largest makes stretches; the others' characters do so by kind.
        """
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            return re.compile("(?s).+"), None
        kinds: dict[str, set[str]] = {}
        for piece in pieces:
            chars = set(piece) - {SPACE}
            joined = set().union(chars, *(kinds.get(c, ()) for c in chars))
            if kinds.get(min(joined, default="")) != joined:
                kinds.update(dict.fromkeys(joined, joined))
        several = {id(k): k for k in kinds.values() if len(k) > 1}
        small = sorted(several.values(), key=len)[:-1]
        others = [f"[{''.join(sorted(map(re.escape, k)))}]+" for k in small]
        alone = "".join(sorted(re.escape(chr(c)) for c in range(128) if len(kinds.get(chr(c), "x")) == 1))
        apart = "".join([SPACE, alone, *(o[1:-2] for o in others)])
        return (
            re.compile("|".join([f"{SPACE}*[^{apart}]+", *(SPACE + "*" + o for o in others), f"{SPACE}*[{alone or SPACE}]", f"{SPACE}+"])),
            re.compile(f"(?<=[^{SPACE}]){SPACE}"),
        )

    def _history(self, piece: int) -> tuple[bool, list[tuple[int, str, str]]]:
        """Whether a piece encodes to itself, and how: rank of each merge, its first and last part before it."""
        found = self.history[piece]
        if found is None:
            found = self.history[piece] = self._merges(piece)
        return found

    def _merges(self, piece: int) -> tuple[bool, list[tuple[int, str, str]]]:
        """The best pair, the first of equals, is merged until none is left."""
        parts, steps = list(self.token[piece]), []
        while True:
            joined = [self.rank.get(x + y, self.never) for x, y in zip(parts, parts[1:], strict=False)]
            best = min(joined, default=self.never)
            steps.append((best, parts[0], parts[-1]))
            if best == self.never:
                return len(parts) == 1, steps
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, before: int, last: int) -> bool:
        """Whether two pieces (-1: nothing, or a character in no piece) stay as they are side by side.

        Their merges are played together until one across would come first.
        """
        whole, right = self._history(last)
        if before < 0 or not whole:
            return whole
        whole, left = self._history(before)
        if not whole:
            return False
        i = j = 0
        while True:
            mine, _, x = left[i]
            theirs, y, _ = right[j]
            across = self.rank.get(x + y, self.never)
            if across < mine and across <= theirs:  # of equals, the first in the text
                return False
            if mine == theirs == self.never:
                return True
            if mine <= theirs:
                i += 1
            else:
                j += 1

    def last_pieces(self, text: str) -> array:
        """The last piece of the encoding of every prefix; -1 for a character in no piece."""
        last = array("i", [-1]) * (len(text) + 1)
        size, after, end = self.size, self.after, -1
        for here, piece in self.automaton.iter(text):
            if here == end:
                continue  # this prefix has its last piece
            before = last[here + 1 - size[piece]]
            fits = after[piece].get(before)
            if fits is None:
                fits = self._fits(before, piece)
            if fits:
                end = here
                last[end + 1] = piece
        return last

    def _fits(self, before: int, piece: int) -> bool:
        """The same as ``compatible``, remembered."""
        if self.tested >= REMEMBERED:
            self.after, self.tested = [{} for _ in self.token], 0
        self.tested += 1
        found = self.after[piece][before] = self.compatible(before, piece)
        return found

    def _ids(self, text: str) -> tuple[int, ...]:
        """The ids of one stretch, from its table read backwards."""
        last, found, at = self.last_pieces(text), [], len(text)
        while at:
            piece = last[at]
            if 0 <= piece < len(self.words.pieces):
                found.append(piece)
                at -= self.size[piece]
            else:
                at -= 1
                found.extend([self.bytes[b] for b in reversed(text[at].encode())] if self.bytes else [self.unknown])
        return tuple(reversed(found))

    def encode(self, text: str) -> list[int]:
        """The ids of a text, of which some window is cut into stretches at once."""
        ids: list[int] = []
        if not text:
            return ids
        text = SPACE + text.replace(" ", SPACE)
        lo = 0
        while lo < len(text):
            found = self.cut.search(text, lo + WINDOW) if self.cut else None
            hi = found.start() if found else len(text)
            ids.extend(chain.from_iterable(map(self.known.__getitem__, self.stretch.findall(text, lo, hi))))
            lo = hi
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces are read as UTF-8, the space put before a text goes."""
        first = next((k for k, i in enumerate(ids) if self.words.kinds[i] != CONTROL), len(ids))
        lead = int(first < len(ids) and self.words.pieces[ids[first]].startswith(SPACE))
        if self.no_text.isdisjoint(ids):
            return "".join(map(self.text.__getitem__, ids))[lead:]
        raw = b"".join(map(self.raw.__getitem__, ids))
        try:
            return raw.decode()[lead:]
        except UnicodeDecodeError:
            return self._decode_broken(ids)[lead:]

    def _decode_broken(self, ids: list[int]) -> str:
        """As the library reads runs of bytes that are no UTF-8."""
        out, at = [], 0
        while at < len(ids):
            end = at
            while end < len(ids) and ids[end] in self.no_text:
                end += 1
            out.append(_marked(b"".join(self.raw[i] for i in ids[at:end])))
            out.extend(self.text[i] for i in ids[end : end + 1])
            at = end + 1
        return "".join(out)


def _marked(raw: bytes) -> str:
    """UTF-8 in which every byte that is part of no character stands for one mark."""
    out = []
    while raw:
        for size in range(1, 5):
            try:
                char = raw[:size].decode()
                break
            except UnicodeDecodeError:
                char = ""
        out.append(char or "\N{REPLACEMENT CHARACTER}")
        raw = raw[len(char.encode()) or 1 :]
    return "".join(out)


@lru_cache(maxsize=2)
def coder(words: Vocabulary) -> Coder:
    """The coder of a vocabulary, once a worker."""
    return Coder(words)


def texts(column: pa.Array) -> list[str]:
    """The strings of a column; null is empty, bytes that are no UTF-8 are marked."""
    try:
        return [t or "" for t in column.to_pylist()]
    except UnicodeDecodeError:
        return [(b or b"").decode(errors="replace") for b in column.cast(pa.large_binary()).to_pylist()]


def encode(docs: DataFrame, words: Vocabulary, column: str = "text", into: str = "ids") -> DataFrame:
    """The rows as they came and the ids of a text column, without begin or end ids."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def work(text: pa.Array) -> list[pa.Array]:
        coding = coder(sent.value)
        found = [np.array(coding.encode(t), np.int32) for t in texts(text)]
        cuts = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([np.empty(0, np.int32), *found])))]

    made = [StructField(into, ArrayType(IntegerType()))]
    return with_results(docs, docs.columns, {"text": F.col(f"`{column}`")}, made, work, SLICE)


def decode(rows: DataFrame, words: Vocabulary, column: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows as they came and the text of an id column; null ids are none."""
    sent = rows.sparkSession.sparkContext.broadcast(words)

    def work(ids: pa.Array) -> list[pa.Array]:
        coding = coder(sent.value)
        values, cuts = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        rows = zip(cuts[:-1], cuts[1:], ids.is_valid().to_pylist(), strict=True)
        return [pa.array([coding.decode(values[lo:hi].tolist() if known else []) for lo, hi, known in rows], pa.string())]

    made = [StructField(into, StringType())]
    return with_results(rows, rows.columns, {"ids": F.col(f"`{column}`")}, made, work, SLICE)
