"""Edited copies: all pairs of documents whose five-word shingles have Jaccard 0.8 or more.

A prefix-filtered set join. A document's shingles are ordered from rare to common; two
sets that share four fifths have a shingle in common among the first fifth and one of
each, so these prefixes alone are dealt by shingle and those who meet there are candidates,
less those whose sizes or places cannot reach the bound; a set that reaches it with nobody
at a shingle goes no further with that shingle. Any order finds all pairs; that of
a sample which grows with the input, rare first, keeps common shingles out of the prefixes.

Those who meet are first compared with one of them, and the links contracted. Then, in
rounds, each component is compared with the one other set it meets that is likeliest to be
linked, and contracted again. Only pairs that are in different components after that are
compared one by one, so a group of thousands of close copies costs a few comparisons for
each and not one for each pair.

No shingles are kept but the prefixes. Of each set a sketch stays: the parity of its
hashes' low bits. Two sets differ in at least as many shingles as their sketches in bits,
so most candidates go by exact bounds before any text is cut again; only the texts of the
rest are, each once, and their shingles are dealt once, by the set they are compared with.
A sketch says little of a set of many more shingles than it has bits, so large sets have a
wider one besides, a bit for each shingle, which is read for pairs alone: the wider of two
folds to the other. Exactly the pairs of the rule are links.

Documents that op3's rule links (fingerprints of three-word shingles, two bits) stay
together, so the components here hold those of op3.

Defined results: a text of fewer than five words is one shingle; null and empty texts
have no shingles and are linked by their fingerprint alone. Repeated rows and equal texts
are one set; null ids count as no id when the smallest of a component is looked for. An
empty table gives an empty result. Further columns are not looked at. A long text is cut
piece by piece; its hashes (eight bytes a word) are held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField

from heirloom.llm import simhash
from heirloom.llm.arrow_text import groups, string_parts, with_results
from heirloom.llm.components import components
from heirloom.session import discard, materialize, materialize_counted

WIDTH = 5
#: Texts that the order of shingles is learned from at least, and the share of larger inputs.
SAMPLE, SHARE = 1 << 13, 64
#: Shingles that the order holds at most: they are sent to all tasks.
KNOWN = 1 << 20
#: While so many pairs are compared at most, the ids of their texts are sent to all tasks.
FEW = 1 << 19
#: Rows of one shingle, or sets compared with one set, that a task takes; more are dealt to several.
CELL = 1 << 12
#: Rows of one shingle that are compared with each other before they are written.
WHOLE = 1 << 6
#: Comparisons of sizes and places at once; sets that a task remembers.
STEP, SEEN = 1 << 18, 1 << 20
#: Bytes of text cut at once, which bounds the shingles that a task holds.
TEXTS = 1 << 22
#: Sketches compared at once.
PART = 1 << 14
#: Rounds in which components are compared with their likeliest neighbours at most.
ROUNDS = 4
#: Bits of a sketch.
SKETCH = 1024


def shingle_sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The distinct shingle hashes of every text, sorted, as signed numbers."""
    raw, offsets = string_parts(column)
    out = []
    for lo, hi in groups(offsets, simhash.PIECE):
        part = raw[offsets[lo] : offsets[hi]]
        if hi == lo + 1 and len(part) > simhash.PIECE:
            pieces = [np.unique(x) for x in simhash._long_hashes(part, width)]
            sets = [np.concatenate(pieces) if pieces else np.empty(0, np.uint64)]
        else:
            hashes, count = simhash._short_hashes(part, offsets[lo : hi + 1] - offsets[lo], width)
            sets = np.split(hashes, np.cumsum(count)[:-1])
        out.extend(np.unique(x.view(np.int64)) for x in sets)
    return out


def _arrays(sets: list[np.ndarray]) -> pa.Array:
    cuts = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))


def _cut(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the shingles (``grams``) of each text."""

    def work(text: pa.Array) -> list[pa.Array]:
        return [_arrays(shingle_sets(text))]

    return with_results(docs, keep, {"text": F.col("text")}, [StructField("grams", ArrayType(LongType()))], work, TEXTS)


def _learned_order(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of texts has three times or more, sorted, and how often the whole may have them."""
    count = docs.count()
    part = max(1, count // max(SAMPLE, count // SHARE))
    rows = docs.select(F.xxhash64("text").alias("text_hash"), "text").filter(F.pmod("text_hash", F.lit(part)) == 0)
    often = _cut(rows.dropDuplicates(["text_hash"]), []).select(F.explode("grams").alias("gram"))
    often = often.groupBy("gram").count().filter("count > 2")
    found = often.orderBy(F.desc("count"), "gram").limit(KNOWN).toArrow()
    gram, times = (found.column(i).to_numpy() for i in (0, 1))
    by = np.argsort(gram)
    return gram[by], times[by] * part


def _prefix(grams: np.ndarray, known: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones first: so many that similar sets share one."""
    common = np.zeros(len(grams), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        common = np.where(known[at] == grams, times[at], 0)
    return grams[np.lexsort((grams, common))[: len(grams) - (4 * len(grams) + 4) // 5 + 1]]


def _sketch(grams: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    odd = np.bincount(grams & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _wide(grams: np.ndarray) -> np.ndarray:
    """The sketch of a bit or two for each shingle; none if the usual one is as wide."""
    return _sketch(grams, 1 << (len(grams) - 1).bit_length()) if len(grams) > SKETCH else grams[:0]


def _bits_apart(a: np.ndarray, b: np.ndarray) -> int:
    """The bits in which two sketches differ, the wider folded to the other."""
    a, b = sorted((a.view(np.uint64), b.view(np.uint64)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def described(docs: DataFrame, order) -> DataFrame:
    """doc_id, text_hash, fp, set_id (null without words), size, sketch, wide sketch and prefix of every document."""

    def work(text: pa.Array) -> list[pa.Array]:
        known, times = order.value
        sets = shingle_sets(text)
        return [
            pa.array(simhash.fingerprint_column(text).view(np.int64)),
            pa.array([xxhash.xxh64_intdigest(x.tobytes()) - 2**63 if len(x) else None for x in sets], pa.int64()),
            pa.array([len(x) for x in sets], pa.int32()),
            _arrays([_sketch(x) for x in sets]),
            _arrays([_wide(x) for x in sets]),
            _arrays([_prefix(x, known, times) if len(x) else x for x in sets]),
        ]

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    made = [StructField("fp", LongType()), StructField("set_id", LongType()), StructField("size", IntegerType())]
    made += [StructField(c, ArrayType(LongType())) for c in ("sketch", "wide", "prefix")]
    return with_results(rows, ["doc_id", "text_hash"], {"text": F.col("text")}, made, work, TEXTS)


def _places(found: DataFrame, order) -> DataFrame:
    """gram, part, set_id, size and place of all prefixes, each set once while a task remembers it.

    A shingle that many are known to have is dealt in several parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = order.value
        hot, parts = known[times > CELL], times[times > CELL] // CELL + 1
        seen: set[int] = set()
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                if len(seen) > SEEN:
                    seen.clear()
                ids = batch.column(0).to_pylist()
                batch = batch.take(pa.array([i for i, x in enumerate(ids) if not (x in seen or seen.add(x))], pa.int64()))
                many = batch.column(2).value_lengths().to_numpy().astype(np.int64)
                gram = batch.column(2).flatten().to_numpy()
                owner = np.repeat(np.arange(len(many)), many)
                set_id = batch.column(0).to_numpy()[owner]
                part = np.zeros(len(gram), np.int64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, gram), len(hot) - 1)
                    part = np.where(hot[at] == gram, 1 + set_id % parts[at], 0)
                size, place = batch.column(1).to_numpy()[owner], simhash._within(many) + 1
                columns = [gram, part.astype(np.int32), set_id, size, place.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "part", "set_id", "size", "place"])

    rows = found.filter("set_id IS NOT NULL").select("set_id", "size", "prefix")
    return rows.mapInArrow(run, "gram bigint, part int, set_id bigint, size int, place int")


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set once, at shingles where another can be similar, or that many sets have or are
    known to have; rows come by shingle."""
    rest = None  # rows of the last shingle, which may go on; of one that many have only the last
    many = False  # whether those before are written
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])
        if rest is not None:
            rows = np.concatenate([rest, rows], axis=1)
        rows = rows[:, np.append(True, (rows[[0, 2], 1:] != rows[[0, 2], :-1]).any(axis=0))]
        n = rows.shape[1]
        cut = int(np.searchsorted(rows[0], rows[0, -1]))
        long = n - cut > WHOLE
        yield _met_rows(_partnered(rows[:, : n - 1 if long else cut], many))
        rest, many = rows[:, n - 1 if long else cut :], long or (many and not cut)
    if rest is not None:
        yield _met_rows(_partnered(rest, many))


def _partnered(rows: np.ndarray, many: bool) -> np.ndarray:
    """The rows whose sizes and places let another at their shingle be similar, and all at
    shingles that many have, the first one's too if ``many``."""
    gram, part, _, size, place = rows
    n = len(gram)
    if not n:
        return rows
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    length = np.diff(np.append(first, n))
    whole = length < WHOLE
    whole[0] &= not many
    keep = np.repeat(~whole, length) | (part > 0)
    later = np.where(np.repeat(whole, length), np.repeat(first + length, length) - np.arange(n) - 1, 0)
    x = np.repeat(np.arange(n), later)
    y = x + 1 + simhash._within(later)
    small, large = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
    left = np.minimum(size[x] - place[x], size[y] - place[y]) + 1
    can = (5 * small >= 4 * large) & (9 * left >= 4 * (small + large))
    keep[x[can]] = keep[y[can]] = True
    return rows[:, keep]


def _met_rows(rows: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(rows[0]), pa.array(rows[2]), *(pa.array(x.astype(np.int32)) for x in rows[3:])]
    return pa.RecordBatch.from_arrays(columns, ["gram", "set_id", "size", "place"])


def _can(size: str, place: str, other_size: str, other_place: str) -> Column:
    """Whether sizes and places of two sets at a shingle leave four fifths."""
    x, p, y, q = (F.col(c).cast("long") for c in (size, place, other_size, other_place))
    left = F.least(x - p, y - q) + 1
    return (5 * F.least(x, y) >= 4 * F.greatest(x, y)) & (9 * left >= 4 * (x + y))


def _stars(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of everyone with one of those at the same shingle."""
    head = met.groupBy("gram").agg(F.min(F.struct("set_id", "size", "place")).alias("head"))
    both = met.join(head, "gram").select("set_id", "size", "place", "head.*")
    both = both.toDF("b", "size", "place", "a", "other_size", "other_place").filter("a <> b")
    return both.filter(_can("size", "place", "other_size", "other_place")).select("a", "b").distinct()


def _across_cells(rows: DataFrame) -> DataFrame:
    """Rows gram, set_id, size, place, root and sketch in cells of bounded size, so that all pairs at a shingle meet.

    A shingle's rows are dealt into buckets, and each bucket meets each in a cell.
    """
    count = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL)
    count = count.select("gram", F.ceil(F.col("n") / CELL).cast("int").alias("buckets"))
    # One row for each CELL rows at most, so that the others, which hold sketches, are moved once only.
    rows = rows.join(F.broadcast(count), "gram", "left").withColumn("buckets", F.coalesce("buckets", F.lit(1)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("set_id"), "buckets").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    cell = F.xxhash64("gram", F.least("bucket", "other"), F.greatest("bucket", "other")).alias("cell")
    side = F.when(F.col("bucket") == F.col("other"), 0).when(F.col("bucket") < F.col("other"), 1).otherwise(2)
    return rows.select(cell, side.alias("side"), "set_id", "size", "place", "root", "sketch")


def _across(likeliest: bool):
    """Pairs of different components in cells; rows come by cell and component.

    Either all of them, or for each component in a cell the likeliest pair, and (a, a) for
    every set of any pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns[:-1]])
            rows = np.concatenate([rows, batch.columns[-1].flatten().to_numpy().reshape(len(batch), -1).T])
            rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
            cut = int(np.searchsorted(rows[0], rows[0, -1]))  # the last cell may go on
            yield from _cell_pairs(rows[:, :cut], likeliest)
            rest = rows[:, cut:]
        if rest is not None:
            yield from _cell_pairs(rest, likeliest)

    return run


def _pair_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _cell_pairs(rows: np.ndarray, likeliest: bool) -> Iterator[pa.RecordBatch]:
    """Everyone with all of later components in the same cell, if size, place and sketch let them be similar."""
    n = rows.shape[1]
    if not n:
        return
    cell, side, ids, size, place, root = rows[:6]
    sketch = np.ascontiguousarray(rows[6:].T).view(np.uint64)
    cells = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), n)
    new = np.append(True, (cell[1:] != cell[:-1]) | (root[1:] != root[:-1]))
    runs = np.append(np.flatnonzero(new), n)
    at = np.arange(n)
    begin = runs[np.searchsorted(runs, at, "right")]
    count = cells[np.searchsorted(cells, at, "right")] - begin
    run_of = np.cumsum(new) - 1
    met = np.zeros(n, bool)
    best = np.full(len(runs) - 1, np.inf)
    pair = np.zeros((2, len(runs) - 1), np.int64)
    lo, total = 0, np.cumsum(count)
    while lo < n:
        done = total[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(total, done + STEP, "right")), lo + 1)
        many = count[lo:hi]
        x, y = np.repeat(at[lo:hi], many), np.repeat(begin[lo:hi], many) + simhash._within(many)
        small, large = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
        left = np.minimum(size[x] - place[x], size[y] - place[y]) + 1
        can = (5 * small >= 4 * large) & (9 * left >= 4 * (small + large)) & ((side[x] == 0) | (side[x] != side[y]))
        x, y = x[can], y[can]
        bits = [np.bitwise_count(sketch[x[k : k + PART]] ^ sketch[y[k : k + PART]]).sum(axis=1) for k in range(0, len(x), PART)]
        bits = np.concatenate([np.zeros(0, np.int64), *bits])
        near = 9 * bits <= size[x] + size[y]
        x, y, bits = x[near], y[near], bits[near]
        if likeliest:
            met[x] = met[y] = True
            score = bits / (size[x] + size[y])
            of, score, both = np.append(run_of[x], run_of[y]), np.append(score, score), np.tile(np.arange(len(x)), 2)
            order = np.lexsort((score, of))
            first = order[np.append(True, of[order][1:] != of[order][:-1])] if len(order) else order
            first = first[score[first] < best[of[first]]]
            best[of[first]] = score[first]
            pair[:, of[first]] = x[both[first]], y[both[first]]
        else:
            yield _pair_rows(ids[x], ids[y])
        lo = hi
    if likeliest:
        x, y = pair[:, np.isfinite(best)]
        yield _pair_rows(np.append(ids[x], ids[met]), np.append(ids[y], ids[met]))


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that differ in few enough bits of their widest sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sum(batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            lists = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in batch.columns[4:]]
            x, y = ([values[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:])] for values, cuts in lists)
            bits = np.fromiter((_bits_apart(*both) for both in zip(x, y, strict=True)), np.int64, len(x))
            yield batch.select(["a", "b"]).filter(pa.array(9 * bits <= sizes))

    widest = F.when(F.size("wide") > 0, F.col("wide")).otherwise(F.col("sketch"))
    known = classes.select("set_id", "size", widest.alias("sketch"))
    near = pairs.join(known.alias("x"), F.col("a") == F.col("x.set_id"))
    near = near.join(known.alias("y"), F.col("b") == F.col("y.set_id"))
    near = near.select("a", "b", F.col("x.size").alias("m"), F.col("y.size").alias("n"), "x.sketch", F.col("y.sketch").alias("other"))
    return near.mapInArrow(run, "a bigint, b bigint")


def _similar(near: DataFrame, count: int, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs, ``count`` of them, whose sets share four fifths, compared shingle by shingle."""
    # Each set goes to those it is compared with (b), and a set that others are compared with (a) to its own parts.
    parts = near.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts"))
    guests = near.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.col("b").alias("set_id"))
    hosts = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("set_id"))
    goes = guests.unionAll(hosts).groupBy("set_id").agg(F.collect_list(F.struct("a", "part")).alias("to"))
    goes = goes.join(classes.select("set_id", "text_of.*"), "set_id")
    goes = materialize(goes.withColumnsRenamed({"doc_id": "llm_id", "text_hash": "llm_hash"}), "copies-goes")
    same = F.col("doc_id").eqNullSafe(F.col("llm_id")) & (F.xxhash64("text") == F.col("llm_hash"))
    texts = docs.select("doc_id", "text").join(F.broadcast(goes) if count <= FEW else goes, same).select("set_id", "to", "text")
    dealt = _cut(texts, ["set_id", "to"]).select("set_id", "grams", F.inline("to"))
    dealt = dealt.select("a", "part", (F.col("a") != F.col("set_id")).alias("guest"), "set_id", "grams")
    return dealt.repartition("a", "part").sortWithinPartitions("a", "part", "guest").mapInArrow(_compared, "a bigint, b bigint")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a host and each guest that shares four fifths; rows come by host, its own shingles first."""
    host, grams = None, None
    for batch in batches:
        values, cuts = batch.column(4).values.to_numpy(), batch.column(4).offsets.to_numpy()
        rows = zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), cuts[:-1], cuts[1:], strict=True)
        pairs = []
        for a, guest, set_id, lo, hi in rows:
            theirs = values[lo:hi]
            if not guest:
                host, grams = a, theirs.copy()
                continue
            if a != host:
                raise ValueError("a set came without the one it is compared with")
            at = np.minimum(np.searchsorted(grams, theirs), len(grams) - 1)
            if 9 * np.count_nonzero(grams[at] == theirs) >= 4 * (len(grams) + len(theirs)):
                pairs.append((a, set_id))
        columns = np.array(pairs, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b"])


def _open(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """The rows gram, set_id, ... of shingles that several components have, with their ``root``."""
    root = components(linked).select(F.col("node").alias("set_id"), "root")
    named = rows.join(root, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    several = named.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    return named.join(several.select("gram"), "gram", "left_semi")


def links(found: DataFrame, order, docs: DataFrame, more: DataFrame) -> DataFrame:
    """Links (a, b) of set_id that with ``more`` have the components of all similar pairs and ``more``.

    ``found`` are the descriptions of ``docs``, written.
    """
    once = found.filter("set_id IS NOT NULL").groupBy("set_id")
    text_of = F.min(F.struct("doc_id", "text_hash")).alias("text_of")
    same = [F.first(c).alias(c) for c in ("size", "sketch", "wide")]
    classes = materialize(once.agg(*same, text_of), "copies-sets")
    places = _places(found, order).repartition("gram", "part").sortWithinPartitions("gram", "set_id")
    met = materialize(places.mapInArrow(_several, "gram bigint, set_id bigint, size int, place int"), "copies-met")
    pairs = materialize(_stars(met), "copies-first")
    near, count = materialize_counted(_near(pairs, classes), "copies-near")
    linked = materialize(_similar(near, count, classes, docs).unionAll(more), "copies-stars")
    open_rows = materialize(_open(met, linked).join(classes.select("set_id", "sketch"), "set_id"), "copies-open")
    discard(met, near)
    left = ROUNDS
    while True:
        last = not left
        cells = _across_cells(open_rows).repartition("cell").sortWithinPartitions("cell", "root", "set_id")
        found_pairs = materialize(cells.mapInArrow(_across(not last), "a bigint, b bigint").distinct(), "copies-across")
        if not last:
            # Sets that no other component comes near are done with.
            active = found_pairs.filter("a = b").select(F.col("a").alias("set_id"))
            before, open_rows = open_rows, materialize(open_rows.join(active, "set_id", "left_semi"), "copies-active")
            discard(before)
        new = found_pairs.filter("a <> b").join(pairs, ["a", "b"], "left_anti")
        new, count = materialize_counted(new, "copies-pairs")
        discard(found_pairs)
        if count:
            near, near_count = materialize_counted(_near(new, classes), "copies-near")
            similar, links_found = materialize_counted(_similar(near, near_count, classes, docs), "copies-similar")
            both = materialize(linked.unionAll(similar), "copies-links")
            seen = materialize(pairs.unionAll(new), "copies-seen")
            discard(linked, near, similar, pairs)
            linked, pairs = both, seen
        discard(new)
        if last:
            break
        left = left - 1 if count and links_found else 0
        if count and links_found:
            before, open_rows = open_rows, materialize(_open(open_rows.drop("root"), linked), "copies-open")
            discard(before)
    discard(classes, pairs, open_rows)
    return linked


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and component_id, the smallest id reachable over links of either
    rule, of every document."""
    order = docs.sparkSession.sparkContext.broadcast(_learned_order(docs))
    found = materialize(described(docs, order), "copies-found")
    prints = found.select("doc_id", "text_hash", "fp", "set_id")
    grown = materialize(simhash.roots(prints).select("fp", F.col("root").alias("group")), "copies-prints")
    # Texts without words have one set of their own, apart from all others: that of their fingerprint.
    named = prints.join(grown, "fp").withColumn("set_id", F.coalesce("set_id", F.xxhash64("group")))
    named = materialize(named, "copies-groups")
    sets = named.select("group", "set_id").distinct()
    head = sets.groupBy("group").agg(F.min("set_id").alias("b"))
    more = sets.join(head, "group").filter("set_id <> b").select(F.col("set_id").alias("a"), "b")
    linked = links(found, order, docs, more)
    root = components(linked).select(F.col("node").alias("set_id"), "root")
    classes = named.groupBy("set_id").agg(F.min("doc_id").alias("least_id")).join(root, "set_id", "left")
    classes = classes.withColumn("root", F.coalesce("root", "set_id"))
    least = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    ids = materialize(classes.join(least, "root").select("set_id", "component_id"), "copies-components")
    discard(found, grown, linked)
    return named.join(ids, "set_id").select("doc_id", "text_hash", "component_id")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The documents, as they came, without copies: see ``simhash.keep_least``."""
    return simhash.keep_least(docs, materialize(copies(docs), "copies-ids"))
