"""SimHash near-duplicates through a Gray-order hierarchical index.

A document's fingerprint has a bit set if more than half of the hashes of its shingles
have it set. Distinct fingerprints are sorted by Gray rank, in which neighbours differ
in few bits, and dealt into blocks. In a block, runs of fingerprints make leaves and
runs of nodes make upper nodes; a node holds the bits that all below it share, as a
masked pattern (``ones`` and ``zeros``). A leaf descends the index of every block that
can hold a link: differences from the shared bits add up on the way down, and a node
beyond the radius is dropped with all below it.

Links inside a task are contracted to a forest, so a group of thousands of close
fingerprints sends on one row for each of them and not one for each pair.

Defined results: null and empty texts have fingerprint 0, which is linked like any
other; equal texts and repeated rows share a fingerprint; an empty table gives an empty
result; further columns are not looked at. Null ids count as no id when the smallest of
a component is looked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from heirloom.llm.arrow_text import groups, string_parts, with_results
from heirloom.llm.components import components
from heirloom.session import materialize, materialize_counted

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Fingerprints of a leaf and nodes below an upper node.
FAN = 64
#: Fingerprints that one task indexes, and the most blocks there may be: their shared
#: bits are sent to all tasks.
BLOCK_ROWS = 1 << 18
MOST_BLOCKS = 1 << 16
#: Bytes of text worked on at once; their shingles' bits take some hundred times as much.
PIECE = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Words of the texts raw[starts:ends]: lower-case bytes with a space after each word,
    where each word starts and ends in them, the text of each and its start in ``raw``."""
    space = _SPACE[raw]
    solid = ~space
    first = solid.copy()
    first[1:] &= space[:-1]
    inner = starts[starts < ends]
    first[inner] = solid[inner]
    begin = np.flatnonzero(first)
    number = np.cumsum(first, dtype=np.int64)[solid] - 1
    body = np.full(len(number) + len(begin), 32, np.uint8)
    body[np.arange(len(number)) + number] = _LOWER[raw[solid]]
    length = np.bincount(number, minlength=len(begin))
    stop = np.cumsum(length + 1) - 1
    text = np.searchsorted(ends, begin, "right")
    return body, stop - length, stop, text, begin


def _hashes(body: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    data, digest = body.tobytes(), xxhash.xxh64_intdigest
    found = (digest(data[a:b], SEED) for a, b in zip(start.tolist(), stop.tolist()))
    return np.fromiter(found, np.uint64, len(start))


def _votes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per group of hashes, how many have each bit set (most significant first)."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.add.reduceat(bits, first, axis=0, dtype=np.int64)


def _pack(votes: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.packbits(votes * 2 > total[:, None], axis=1).view(">u8")[:, 0].astype(np.uint64)


def _short_hashes(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of texts that are worked on together, and how many each text has."""
    body, start, stop, text, _ = _words(raw, offsets[:-1], offsets[1:])
    count = np.bincount(text, minlength=len(offsets) - 1)
    base = np.cumsum(count) - count
    here = np.arange(len(start))
    opens = here - base[text] <= np.maximum(count[text] - width, 0)
    last = np.minimum(here[opens] + width - 1, (base + count)[text[opens]] - 1)
    return _hashes(body, start[opens], stop[last]), np.bincount(text[opens], minlength=len(count))


def _short(raw: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of texts that are worked on together."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    hashes, total = _short_hashes(raw, offsets, width)
    if not len(hashes):
        return out
    with_words = np.flatnonzero(total)
    total = total[with_words]
    out[with_words] = _pack(_votes(hashes, np.cumsum(total) - total), total)
    return out


def _long_hashes(raw: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of one long text, piece by piece; pieces share width - 1 words."""
    total, at, size = 0, 0, PIECE
    while at < len(raw):
        end = min(at + size, len(raw))
        piece = raw[at:end]
        if end < len(raw):  # not within a word
            gaps = np.flatnonzero(_SPACE[piece])
            piece = piece[: gaps[-1]] if len(gaps) else piece[:0]
        body, start, stop, _, begin = _words(piece, np.zeros(1, np.int64), np.array([len(piece)]))
        if end < len(raw) and len(start) <= width:
            size *= 2
            continue
        if len(start):
            last = np.minimum(np.arange(max(len(start) - width, 0) + 1) + width - 1, len(start) - 1)
            if len(start) >= width or not total:
                yield _hashes(body, start[: len(last)], stop[last])
                total += len(last)
        if end == len(raw):
            break
        at, size = at + int(begin[len(start) - width + 1]) if width > 1 else at + len(piece), PIECE


def _long(raw: np.ndarray, width: int) -> np.uint64:
    """The fingerprint of one long text."""
    votes, total = np.zeros((1, 64), np.int64), 0
    for hashes in _long_hashes(raw, width):
        votes += _votes(hashes, np.zeros(1, np.int64))
        total += len(hashes)
    return _pack(votes, np.array([total]))[0] if total else np.uint64(0)


def fingerprint_column(column: pa.Array, width: int = SHINGLE) -> np.ndarray:
    raw, offsets = string_parts(column)
    out = np.zeros(len(offsets) - 1, np.uint64)
    for lo, hi in groups(offsets, PIECE):
        part = raw[offsets[lo] : offsets[hi]]
        if hi == lo + 1 and len(part) > PIECE:
            out[lo] = _long(part, width)
        else:
            out[lo:hi] = _short(part, offsets[lo : hi + 1] - offsets[lo], width)
    return out


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and fp, the 64-bit fingerprint as a signed number, of every document."""

    def work(text: pa.Array) -> list[pa.Array]:
        return [pa.array(fingerprint_column(text, width).view(np.int64))]

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return with_results(rows, ["doc_id", "text_hash"], {"text": F.col("text")}, [StructField("fp", LongType())], work)


def gray_rank(fp: Column) -> Column:
    """The place of a fingerprint in Gray order, as a number whose signed order is that order."""
    for step in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, step))
    return fp.bitwiseXOR(F.lit(-(2**63)))


def _shared(fps: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.bitwise_and.reduceat(fps, first), np.bitwise_and.reduceat(~fps, first)


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts a sorted block into leaves."""
    block = TaskContext.get().partitionId()
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        if not len(fps):
            continue
        first = np.arange(0, len(fps), FAN)
        ones, zeros = _shared(fps, first)
        cuts = pa.array(np.append(first, len(fps)).astype(np.int32))
        columns = [
            pa.array(np.full(len(first), block, np.int32)),
            pa.array(ones.view(np.int64)),
            pa.array(zeros.view(np.int64)),
            pa.ListArray.from_arrays(cuts, batch.column(0)),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["block", "ones", "zeros", "fps"])


def _apart(ones_a, zeros_a, ones_b, zeros_b):
    return np.bitwise_count((ones_a & zeros_b) | (zeros_a & ones_b))


class GrayIndex:
    """The leaves of one block and the levels of nodes above them."""

    def __init__(self, leaves: list[np.ndarray]):
        self.size = np.array([len(x) for x in leaves])
        self.base = np.cumsum(self.size) - self.size
        self.fps = np.concatenate(leaves)
        ones, zeros = _shared(self.fps, self.base)
        self.levels = [(ones, zeros)]
        while len(ones) > FAN:
            first = np.arange(0, len(ones), FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first)
            self.levels.append((ones, zeros))

    def descend(self, ones: np.ndarray, zeros: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a probe pattern and a leaf that can be within the radius."""
        top_ones, _ = self.levels[-1]
        probe = np.repeat(np.arange(len(ones)), len(top_ones))
        node = np.tile(np.arange(len(top_ones)), len(ones))
        known = np.zeros(len(node), np.uint64)
        apart = np.zeros(len(node), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            has, lacks = self.levels[depth]
            fresh = ~known  # bits that no node above has accounted for
            apart = apart + _apart(ones[probe] & fresh, zeros[probe] & fresh, has[node], lacks[node])
            live = apart <= radius
            probe, node, apart = probe[live], node[live], apart[live]
            if depth:
                known = has[node] | lacks[node]
                below = len(self.levels[depth - 1][0])
                child = node[:, None] * FAN + np.arange(FAN)
                real = (child < below).ravel()
                probe, apart, known = (np.repeat(x, FAN)[real] for x in (probe, apart, known))
                node = child.ravel()[real]
        return probe, node

    def links(self, fps: np.ndarray, first: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (index of a probe, index of a fingerprint here) within the radius."""
        ones, zeros = _shared(fps, first)
        count = np.diff(np.append(first, len(fps)))
        probe, leaf = self.descend(ones, zeros, radius)
        for lo in range(0, len(probe), 4096):
            p, node = probe[lo : lo + 4096], leaf[lo : lo + 4096]
            q = np.repeat(first[p], count[p]) + _within(count[p])
            node = np.repeat(node, count[p])
            has, lacks = self.levels[0]
            live = _apart(fps[q], ~fps[q], has[node], lacks[node]) <= radius
            q, node = q[live], node[live]
            for at in range(0, len(q), 16384):
                a, n = q[at : at + 16384], node[at : at + 16384]
                size = self.size[n]
                x = np.repeat(self.base[n], size) + _within(size)
                a = np.repeat(a, size)
                near = np.bitwise_count(fps[a] ^ self.fps[x]) <= radius
                yield a[near], x[near]


def _within(count: np.ndarray) -> np.ndarray:
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] with b[i]; the label of a group is its least index."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (label[a], label[b], a, b):
            np.minimum.at(new, side, low)
        while not np.array_equal(new, hop := new[new]):
            new = hop
        if np.array_equal(new, label):
            return label
        label = new


def _link_blocks(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block, each block's own leaves before those sent to it."""
        block, own, index, label = None, [], None, None

        def rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        def ready():
            nonlocal index, label
            if index is None:
                index = GrayIndex(own)
                label = np.arange(len(index.fps))
                for lo in range(0, len(own), 256):
                    hi = min(lo + 256, len(own))
                    begin = index.base[lo]
                    part = index.fps[begin : index.base[hi - 1] + index.size[hi - 1]]
                    for a, b in index.links(part, index.base[lo:hi] - begin, radius):
                        label = _merge(label, a + begin, b)

        def closed():
            ready()
            moved = np.flatnonzero(label != np.arange(len(label)))
            return rows(index.fps[moved], index.fps[label[moved]])

        def guests(leaves: list[np.ndarray]):
            nonlocal label
            ready()
            fps = np.concatenate(leaves)
            size = np.array([len(x) for x in leaves])
            for a, b in index.links(fps, np.cumsum(size) - size, radius):
                if not len(a):
                    continue
                order = np.argsort(a, kind="stable")
                a, b = a[order], b[order]
                lead = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                anchor = np.repeat(b[lead], np.diff(np.append(lead, len(a))))
                label = _merge(label, anchor, b)
                yield rows(fps[a[lead]], index.fps[b[lead]])

        for batch in batches:
            raw, cuts = batch.column(2).values.to_numpy().view(np.uint64), batch.column(2).offsets.to_numpy()
            waiting: list[np.ndarray] = []
            for i, (target, guest) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                leaf = raw[cuts[i] : cuts[i + 1]]
                if target != block:
                    if waiting:
                        yield from guests(waiting)
                        waiting = []
                    if block is not None:
                        yield closed()
                    block, own, index, label = target, [], None, None
                (waiting if guest else own).append(leaf)
                if len(waiting) >= 256:
                    yield from guests(waiting)
                    waiting = []
            if waiting:
                yield from guests(waiting)
        if block is not None:
            yield closed()

    return run


def links(classes: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """A forest (a, b) with the same components as all pairs of fp within the radius.

    ``classes`` has each fingerprint once, ``count`` of them.
    """
    spark = classes.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = min(max(tasks, -(-count // BLOCK_ROWS)), MOST_BLOCKS)
    ordered = (
        classes.select("fp", gray_rank(F.col("fp")).alias("rank"))
        .repartitionByRange(blocks, "rank")
        .sortWithinPartitions("rank")
        .select("fp")
    )
    leaves = materialize(
        ordered.mapInArrow(_leaves, "block int, ones bigint, zeros bigint, fps array<bigint>"), "gray-leaves"
    )
    # The shared bits of each block: MOST_BLOCKS rows of 20 bytes at most.
    roots = leaves.groupBy("block").agg(F.bit_and("ones"), F.bit_and("zeros")).orderBy("block").toArrow()
    name = roots.column(0).to_numpy()
    ones, zeros = (roots.column(i).to_numpy().view(np.uint64) for i in (1, 2))
    shared = spark.sparkContext.broadcast((name, ones, zeros))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ones, zeros = shared.value
        for batch in batches:
            own = batch.column(0).to_numpy()
            has, lacks = (batch.column(i).to_numpy().view(np.uint64) for i in (1, 2))
            for lo in range(0, len(own), 256):
                at = slice(lo, lo + 256)
                near = _apart(has[at, None], lacks[at, None], ones[None, :], zeros[None, :]) <= radius
                near &= name[None, :] >= own[at, None]
                near |= name[None, :] == own[at, None]
                leaf, to = np.nonzero(near)
                leaf += lo
                columns = [pa.array(name[to]), pa.array(name[to] != own[leaf]), batch.column(3).take(pa.array(leaf))]
                yield pa.RecordBatch.from_arrays(columns, ["target", "guest", "fps"])

    sent = leaves.mapInArrow(route, "target int, guest boolean, fps array<bigint>")
    met = sent.repartition("target").sortWithinPartitions("target", "guest")
    return met.mapInArrow(_link_blocks(radius), "a bigint, b bigint")


def roots(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, least_id and root, a fingerprint of its component, of every fingerprint of ``prints``."""
    classes, count = materialize_counted(
        prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-classes"
    )
    found = components(links(classes, count, radius)).select(F.col("node").alias("fp"), "root")
    return classes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, fp and component_id, the smallest id reachable over links, of every document."""
    prints = materialize(fingerprints(docs, width), "simhash")
    grown = roots(prints, radius)
    least = grown.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = materialize(grown.join(least, "root").select("fp", "component_id"), "simhash-components")
    return prints.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def keep_least(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents, as they came, of which each component's row with the smallest id stays.

    ``found`` has doc_id, text_hash and component_id of every document. Of rows that repeat
    the one that stays, one stays; where no row of a component has an id, one for each
    text does.
    """
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    key = [F.col("doc_id").alias("llm_id"), F.col("text_hash").alias("llm_hash")]
    same = F.col("doc_id").eqNullSafe(F.col("llm_id")) & (F.xxhash64("text") == F.col("llm_hash"))
    kept = docs.join(found.filter(~stays).select(*key).distinct(), same, "left_anti")
    repeats = found.filter(stays).groupBy(*key).count().filter("count > 1").drop("count")
    repeats = materialize(repeats, "simhash-repeats")
    if repeats.isEmpty():
        return kept
    once = kept.join(repeats, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeats, same, "left_anti").unionAll(once)


def distinct_documents(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents, as they came, without near duplicates by fingerprint: see ``keep_least``."""
    return keep_least(docs, materialize(near_duplicates(docs, width, radius), "simhash-found"))


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
