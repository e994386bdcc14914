"""Conversation structure repair: the cheapest edits that make roles alternate.

A conversation is repaired by keeping, re-roling and deleting its rows and by inserting
empty ones, so that its role initials read ``(s?(ua)+)?``. Rows and what came before (nothing,
s, u, a) are the nodes of an acyclic graph. The weight of a way is one integer: its cost in
the high digits, and below it, in digits of fixed width from the left, the initials of its
edits; digits that a shorter way doesn't fill are zero. So the least integer is the cheapest
way and among these the ASCII-least audit, and plain minima from the last row to the first
decide everything.

Integers span a block of rows. What lies behind a block enters it as a few digits that
compare like the whole: two ways over the same rows of which one begins like the other
differ by insertions alone, so the leading insertions of what follows, the next letter and
the rank of the rest decide. A conversation of any length takes time and memory in
proportion to its rows (some bytes for each; its audit, one value, has a letter for each).

Rows are first dealt by conversation without their texts (a hash stands for a text) and
read in order; with the audit known, the texts are dealt once and pass by in order, none
is held. A conversation is one sequence by definition and so one task's work.

Defined results: null ids are one conversation; null roles and texts are one space; null
turns come first. Rows of one turn are ordered by role and SHA-256 of the text; repeated
rows stand side by side. Columns other than conv_id, turn, role and text are not kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from heirloom.session import materialize

#: ASCII white space.
BLANKS = " \t\n\x0b\x0c\r"
#: What came before a row: nothing, a system row, a user row, an assistant row.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state behind a row that is inserted or re-roled, by the state before it; its role.
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
ROLES = {AFTER_U: "user", AFTER_A: "assistant"}
#: The states in which a row of an initial may be kept, and the state behind it.
KEPT = {"s": (AFTER_S, (START,)), "u": (AFTER_U, (START, AFTER_S, AFTER_A)), "a": (AFTER_A, (AFTER_U,))}
#: Costs of edits; a truncated row that stays adds one.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Letters by digit, in ASCII order; zero is padding, digits from MARK on are ranks.
LETTERS = " DIKR"
D, I, K, R = range(1, 5)  # noqa: E741
MARK = 5
#: Bits of a digit, rows of a block.
BITS, BLOCK = 4, 128
#: Codes of rows: the initial's place in this string, then flags.
INITIALS = "suax"
MUST_GO, CUT_SHORT = 4, 8


class _Block:
    """Weights of one width: cost above, letters from the left below."""

    def __init__(self, rows: int):
        self.low = BITS * (3 * rows + 8 + rows % 2)
        self.top = self.low - BITS
        self.mask = (1 << self.low) - 1

    def edit(self, letter: int, cost: int, rest: int) -> int:
        """The weight of an edit and then ``rest``."""
        moved = (rest & self.mask) >> BITS
        return ((rest >> self.low) + cost) << self.low | letter << self.top | moved

    def digits(self, weight: int) -> list[int]:
        """The digits of a weight up to the padding."""
        raw = (weight & self.mask).to_bytes(self.low // 8, "big")
        found = [d for byte in raw for d in (byte >> BITS, byte & 15)]
        return found[: found.index(0)] if 0 in found else found

    def weight(self, cost: int, digits: list[int]) -> int:
        low = 0
        for place, digit in enumerate(digits):
            low |= digit << self.top - BITS * place
        return cost << self.low | low

    def inserted(self, base: list[int]) -> list[int]:
        """With up to two insertions before; more are never cheaper."""
        found = base
        for _ in range(2):
            found = [min(base[s], self.edit(I, INSERT, found[NEXT[s]])) for s in range(4)]
        return found

    def row(self, code: int, after: list[int]) -> list[int]:
        """The least weights from each state before a row."""
        best = [self.edit(D, DELETE, after[s]) for s in range(4)]
        if not code & MUST_GO:
            more = TRUNCATED if code & CUT_SHORT else 0
            for s in range(4):
                best[s] = min(best[s], self.edit(R, REROLE + more, after[NEXT[s]]))
            to, states = KEPT.get(INITIALS[code & 3], (START, ()))
            for s in states:
                best[s] = min(best[s], self.edit(K, more, after[to]))
        return self.inserted(best)


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of a conversation's rows, given by their codes."""
    never = DELETE * len(codes) + 2 * INSERT + 1
    behind = [(0, [], 0), (never, [], 0), (never, [], 0), (0, [], 0)]  # cost, first digits, rank of the rest
    rests: list[tuple[bytes, list | None]] = []
    for hi in range(len(codes), -1, -BLOCK):
        block = _Block(min(hi, BLOCK))
        best = [block.weight(cost, [*first, MARK + rank] if rank else first) for cost, first, rank in behind]
        if hi == len(codes):
            best = block.inserted(best)
        for code in reversed(codes[max(hi - BLOCK, 0) : hi]):
            best = block.row(code, best)
        ways = [(w >> block.low, *_parted(block.digits(w))) for w in best]
        if hi <= BLOCK:
            cost, inserts, rest = ways[START]
            letters, way = _linked(rest, rests)
            parts = [bytes([I] * inserts), letters]
            while way is not None:
                letters, way = way
                parts.append(letters)
            return cost, "".join(map(LETTERS.__getitem__, chain.from_iterable(parts)))
        order = sorted({tuple(rest) for _, _, rest in ways if rest})
        behind = [
            (cost, [I] * inserts + rest[:1], order.index(tuple(rest)) + 1 if rest else 0) for cost, inserts, rest in ways
        ]
        rests = [_linked(rest, rests) for rest in order]
    raise AssertionError("the first block ends the loop")


def _parted(digits: list[int]) -> tuple[int, list[int]]:
    """How many insertions lead, and the digits behind them."""
    lead = next((k for k, d in enumerate(digits) if d != I), len(digits))
    return lead, digits[lead:]


def _linked(digits: list[int], rests: list) -> tuple[bytes, tuple | None]:
    """The letters of a block and the rest that follows, which begins with the letter before its rank."""
    if digits and digits[-1] >= MARK:
        return bytes(digits[:-2]), rests[digits[-1] - MARK - 1]
    return bytes(digits), None


def prepared(rows: DataFrame) -> DataFrame:
    """Rows with nulls replaced, places in order, and marks of blank and cut texts. ``copies`` says
    how often a row stands (0: it only names its conversation) and is 1 where that is not given."""
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    text = F.coalesce("text", F.lit(" "))
    end = F.rtrim(text, F.lit(BLANKS))
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        text.alias("text"),
        F.sha2(text, 256).alias("digest"),
        (end == "").alias("blank"),
        (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("truncated"),
        copies.cast("int").alias("copies"),
    )


def _seen_earlier(rows: DataFrame) -> DataFrame:
    """The rows without texts, with ``earlier``: whether role and text stand at an earlier turn."""
    place = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    rows = rows.drop("text").withColumn("place", place)
    there = rows.filter("copies > 0 AND NOT blank").groupBy("conv_id", "role", "digest")
    several = there.agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first < last")
    several = several.select(*[F.col(c).alias(f"{c}_too") for c in ("conv_id", "role", "digest")], "first")
    same = F.col("conv_id").eqNullSafe(F.col("conv_id_too"))
    same &= (F.col("role") == F.col("role_too")) & (F.col("digest") == F.col("digest_too"))
    found = rows.join(several, same, "left")
    earlier = F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    return found.select(*rows.columns, earlier.alias("earlier")).drop("place")


class _Reader:
    """What is known of a conversation while its rows pass by."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.codes = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.before = self.initial = None

    def add(self, turn, role: str, digest: str, blank: bool, truncated: bool, copies: int, earlier: bool) -> None:
        if copies and turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        kind = INITIALS.find(role[:1] or "x")
        for _ in range(copies):
            again = earlier or self.before == (turn, role, digest)
            self.before = (turn, role, digest)
            self.blank += blank
            self.duplicate += again and not blank
            cut = truncated and not blank and not again
            self.truncated += cut
            if self.initial is not None:
                self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
            self.initial = role[:1]
            code = kind if kind >= 0 else INITIALS.index("x")
            self.codes.append(code | (MUST_GO if blank or again else 0) | (CUT_SHORT if cut else 0))

    def result(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        cost, audit = cheapest(bytes(self.codes))
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Conversations whole in a task, their rows in order."""
    place = [F.col("turn").asc_nulls_first(), "role", "digest"]
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, *place)


def _batches(rows: Iterator[tuple], kind: StructType, size: int = 1 << 12, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Batches of rows, closed at a number of rows or of characters in the last column."""
    schema = to_arrow_schema(kind)
    held, length = [], 0
    for row in chain(rows, [None]):
        if row is not None:
            held.append(row)
            length += len(row[-1] or "")
        if held and (row is None or len(held) >= size or length >= most):
            columns = [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
            held, length = [], 0


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of all batches, a slice of each batch at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in batch.slice(lo, 1024).columns), strict=True)


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation."""
    rows = _seen_earlier(prepared(rows))
    names = ("conv_id", "turn", "role", "digest", "blank", "truncated", "copies", "earlier")
    kind = StructType(
        [rows.schema["conv_id"], *[StructField(c, LongType()) for c in COUNTS], StructField("audit", StringType())]
    )

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        reader = None
        for conv_id, *row in _each(batches):
            if reader is None or reader.conv_id != conv_id:
                if reader is not None:
                    yield reader.result()
                reader = _Reader(conv_id)
            reader.add(*row)
        if reader is not None:
            yield reader.result()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(results(batches), kind)

    return _in_order(rows.select(*names)).mapInArrow(run, kind)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The messages of each conversation by its audit, which comes before its rows."""
    conv_id, audit, at, state, place = None, None, 0, START, 0

    def insertions() -> Iterator[tuple]:
        nonlocal at, state, place
        while audit is not None and audit[at : at + 1] == "I":
            state = NEXT[state]
            at += 1
            place += 1
            yield conv_id, place - 1, ROLES[state], ""

    def ended() -> Iterator[tuple]:
        yield from insertions()
        if audit is not None and not place:
            yield conv_id, None, None, None

    for key, plan, role, copies, text in _each(batches):
        if plan is not None:
            yield from ended()
            conv_id, audit, at, state, place = key, plan, 0, START, 0
            continue
        for _ in range(copies):
            yield from insertions()
            letter = audit[at]
            at += 1
            if letter == "D":
                continue
            if letter == "R":
                state = NEXT[state]
                role = ROLES[state]
            else:
                state = KEPT[role[0]][0]
            place += 1
            yield conv_id, place - 1, role, text
    yield from ended()


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place, role and text of the repaired messages, in order within a task and with
    conversations whole; one row of nulls for a conversation without messages."""
    rows = prepared(rows).filter("copies > 0")
    rows = rows.select("conv_id", F.lit(1).alias("part"), "turn", "role", "digest", "copies", "text")
    plans = found.select("conv_id", F.lit(0).alias("part"), "audit")
    ordered = _in_order(plans.unionByName(rows, allowMissingColumns=True), "part").select("conv_id", "audit", "role", "copies", "text")
    made = [StructField("place", LongType()), StructField("role", StringType()), StructField("text", StringType())]
    kind = StructType([ordered.schema["conv_id"], *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_edited(batches), kind)

    return ordered.mapInArrow(run, kind)


def digests(messages: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 (``role:text``, joined by line feeds) of messages as ``repaired`` gives them."""
    kind = StructType([messages.schema["conv_id"], StructField("repaired_sha256", StringType())])

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = None
        for conv_id, place, role, text in _each(batches):
            if not place:  # the first message, or none
                if held:
                    yield held[0], held[1].hexdigest()
                held = conv_id, hashlib.sha256()
            if place is not None:
                held[1].update(f"{chr(10) if place else ''}{role}:{text}".encode())
        if held:
            yield held[0], held[1].hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(results(batches), kind)

    return messages.mapInArrow(run, kind)


def report(rows: DataFrame) -> DataFrame:
    """The audits of all conversations with the digests of what they become."""
    found = materialize(audits(rows), "repair-audits")
    sums = digests(repaired(rows, found)).withColumnRenamed("conv_id", "conv_id_too")
    return found.join(sums, F.col("conv_id").eqNullSafe(F.col("conv_id_too"))).drop("conv_id_too")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with faults planted by a hash of conversation and turn: dropped (``copies`` 0), emptied,
    without sentence ends, repeated (``copies`` 2), or spoken by the user."""
    whole = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    dealt = F.crc32(F.concat(whole[0], F.lit(":"), whole[1]).cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(dealt == 4, "user").otherwise(role).alias("role"),
        F.when(dealt == 1, "").when(dealt == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(dealt == 0, 0).when(dealt == 3, 2).otherwise(1).alias("copies"),
    )
