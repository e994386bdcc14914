"""Benchmark decontamination: a prefix-filtered set join with exact verification.

A window is 13 consecutive words of a benchmark item (all words of a shorter item). Its
tokens are its 3-word shingles. They are ordered by how rare they are over all
documents; a text that contains the window contains its rarest shingle, so a prefix of
one token suffices for the join. Windows with a shingle that no document has are out
before it. A shingle that is the rarest of several windows of an item is joined once
for all of them. A meeting gives the only place where these windows can lie; bounds on
length and position cut it to what the text and the item hold, and the words around it
are compared one by one, which finds exactly the windows that occur.

Everything is DataFrame operations. The tables of the benchmark are written and counted
first and broadcast only where they are small; beyond that the joins shuffle, and AQE
splits the partitions of frequent shingles. A bitmap of fixed size keeps most places of
the documents, which no shingle of the benchmark can match, from becoming rows at all.

Defined results: null and empty texts have no words and no hits and are not
contaminated; items without words never match; rows that repeat each get the same
result, null ids too; an item id that is null marks words but is neither counted nor
listed; columns other than those named are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heirloom.session import evaluated_once, materialize, materialize_counted

WINDOW = 13
GRAM = 3
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words in a text that is not lower-cased yet.
RAW_NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Grams are looked up in a bitmap of fixed size before they become rows.
BITMAP_BITS = 1 << 20
#: A table of the benchmark is broadcast up to this size.
SMALL_BYTES = 32 << 20


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, UPPER.lower()), NO_WORD), "")


def _gram(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(size)])


def _bitmap(grams: DataFrame) -> Column:
    """Which remainders of grams occur, as numbers of 32 bits; BITMAP_BITS bits whatever the benchmark."""
    places = grams.select(F.pmod("gram", F.lit(BITMAP_BITS)).cast("int").alias("p")).distinct()
    cells = [0] * (BITMAP_BITS // 32)
    for p in places.toArrow().column(0).to_pylist():
        cells[p >> 5] |= 1 << (p & 31)
    # A text that the optimizer turns into one constant.
    return F.split(F.lit(",".join(map(str, cells))), ",").cast("array<bigint>")


def _listed(gram: Column, bitmap: Column) -> Column:
    place = F.pmod(gram, F.lit(BITMAP_BITS)).cast("int")
    bit = F.lit(1).cast("long")
    cell = F.get(bitmap, F.shiftright(place, 5))
    return F.call_function("getbit", cell, place.bitwiseAND(F.lit(31))) == bit.cast("byte")


def _met(rows: DataFrame, size: int, grams: DataFrame) -> DataFrame:
    """(at, gram, left, around) beside the other columns, for grams of the documents that
    may be in ``grams``: the place, and the words around it, ``left`` of them before it.

    The words of a document stay an array; only places that pass the bitmap become rows.
    """
    bitmap = _bitmap(grams)
    others = [c for c in rows.columns if c != "words"]
    words = F.col("words")
    hashed = F.transform(words, lambda w, i: F.when(i + size <= F.size(words), _gram(words, i, size)))
    rows = evaluated_once(rows.withColumn("hashed", hashed), "hashed")
    places = F.filter(
        F.transform("hashed", lambda h, i: F.when(_listed(h, bitmap), F.struct(i.alias("at"), h.alias("gram")))),
        lambda x: x.isNotNull(),
    )

    def around(x: Column) -> Column:
        left = F.least(x.at, F.lit(WINDOW - 1))
        return F.struct(
            x.at.alias("at"),
            x.gram.alias("gram"),
            left.alias("left"),
            F.slice(words, x.at - left + 1, left + WINDOW).alias("around"),
        )

    return rows.select(*others, F.inline(F.transform(places, around)))


def _grams(rows: DataFrame, size: int, *keep: str) -> DataFrame:
    """(keep..., at, gram) for each place of ``words`` where a gram begins. For items."""
    at = rows.select(*keep, "words", F.posexplode("words").alias("at", "word"))
    at = at.filter(F.col("at") + size <= F.size("words"))
    return at.select(*keep, "at", _gram(F.col("words"), F.col("at"), size).alias("gram"))


def _small(table: DataFrame, n_bytes: int) -> DataFrame:
    """A hint where the size has been seen to be small; else the join shuffles both sides."""
    return F.broadcast(table) if n_bytes <= SMALL_BYTES else table


def item_table(items: DataFrame) -> DataFrame:
    """item, item_id, words, length of a window and of a gram of every item with words."""
    words = items.select("item_id", word_array(F.col("text")).alias("words"))
    words = words.filter(F.size("words") > 0).distinct()
    size = F.size("words")
    return materialize(
        words.select(
            F.monotonically_increasing_id().alias("item"),
            "item_id",
            "words",
            F.least(size, F.lit(WINDOW)).alias("length"),
            F.least(size, F.lit(GRAM)).alias("size"),
        ),
        "bench-items",
    )


def anchors(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, int]:
    """(size, gram, item, at, low, high) and their number: the rarest gram of the item's windows low..high.

    ``at`` is its place in the item. ``docs`` has the words of every document.
    """
    of_items = []
    for size in sorted(r[0] for r in items.select("size").distinct().collect()):
        own = _grams(items.filter(F.col("size") == size), size, "item", "length", "size")
        own, n = materialize_counted(own, "bench-grams")
        wanted = own.select("gram").distinct()
        seen = _met(docs, size, wanted).select("gram").join(_small(wanted, 16 * n), "gram", "left_semi")
        of_items.append(own.join(seen.groupBy("gram").agg(F.count(F.lit(1)).alias("seen")), "gram", "left"))
    if not of_items:
        return materialize_counted(
            items.select("size", F.lit(0).cast("long").alias("gram"), "item", F.lit(0).alias("at"))
            .withColumns({"low": F.lit(0), "high": F.lit(0)})
            .limit(0),
            "bench-anchors",
        )
    ranked = reduce(DataFrame.unionAll, of_items).withColumn("seen", F.coalesce("seen", F.lit(0)))
    last = items.select("item", (F.size("words") - F.col("length")).alias("last"))
    # A gram at `at` lies in the windows that begin at at + size - length up to at.
    starts = F.sequence(
        F.greatest(F.lit(0), F.col("at") + F.col("size") - F.col("length")), F.least("at", "last")
    )
    windows = ranked.join(last, "item").withColumn("start", F.explode(starts))
    rarest = windows.groupBy("item", "size", "start").agg(
        F.min(F.struct("seen", "at", "gram")).alias("rarest")
    )
    return materialize_counted(
        rarest.filter("rarest.seen > 0")
        .groupBy("size", "rarest.gram", "item", "rarest.at")
        .agg(F.min("start").alias("low"), F.max("start").alias("high")),
        "bench-anchors",
    )


def _run(a: Column, b: Column) -> Column:
    """How many leading words are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def occurrences(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, begin, end): words begin..end-1 of the document are hit."""
    worded = docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), word_array(F.col("text")).alias("words")
    )
    items = item_table(items)
    points, n_points = anchors(worded.select("words"), items)
    met = []
    for size in sorted(r[0] for r in points.select("size").distinct().collect()):
        point = points.filter(F.col("size") == size).select(
            F.col("gram").alias("anchor"), F.col("item").alias("of"), F.col("at").alias("p"), "low", "high"
        )
        near = _met(worded, size, point.select(F.col("anchor").alias("gram")))
        met.append(near.join(_small(point, 64 * n_points), F.col("gram") == F.col("anchor")))
    if not met:
        return docs.select("doc_id", F.lit(0).cast("long").alias("text_hash")).limit(0).withColumns(
            {"item_id": F.lit(None).cast("string"), "begin": F.lit(0), "end": F.lit(0)}
        )
    n_bytes = items.agg(F.coalesce(F.sum(F.size("words") * 16 + F.length(F.array_join("words", ""))), F.lit(0))).first()[0]
    named = items.select("item", "item_id", F.col("words").alias("item_words"), "length")
    both = reduce(DataFrame.unionAll, met).join(_small(named, 2 * n_bytes), F.col("of") == F.col("item"))
    p, skip = F.col("p"), F.col("left") - F.least("left", "p")
    left = F.least("left", "p")
    before = _run(
        F.reverse(F.slice("around", skip + 1, left)), F.reverse(F.slice("item_words", p - left + 1, left))
    )
    after = _run(
        F.slice("around", F.col("left") + 1, F.size("around") - F.col("left")),
        F.slice("item_words", p + 1, F.size("around") - F.col("left")),
    )
    first = F.greatest(F.col("low"), p - before)
    last = F.least(F.col("high"), p + after - F.col("length"))
    shift = F.col("at") - p
    return (
        both.withColumns({"first": first, "last": last})
        .filter("first <= last")
        .select(
            "doc_id",
            "text_hash",
            "item_id",
            (shift + F.col("first")).alias("begin"),
            (shift + F.col("last") + F.col("length")).alias("end"),
        )
    )


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    spans = occurrences(docs, items)
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.struct("begin", "end"))),
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("hit")),
        lambda acc, x: F.struct(
            F.greatest(acc.upto, x.end).alias("upto"),
            (acc.hit + F.greatest(F.lit(0), x.end - F.greatest(x.begin, acc.upto))).alias("hit"),
        ),
        lambda acc: acc.hit,
    )
    ids = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    hits = spans.groupBy(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).agg(
        merged.alias("n_hit"), ids.alias("ids")
    )
    base = docs.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.coalesce(F.size(F.array_remove(F.split("text", RAW_NO_WORD), "")), F.lit(0)).cast("long").alias("n_words"),
    )
    joined = base.join(
        hits,
        F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")),
        "left",
    )
    n_hit, ids = F.coalesce("n_hit", F.lit(0)), F.coalesce("ids", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "text_hash",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, as they came."""
    bad = contamination(docs, items).filter("contaminated").select(
        F.col("doc_id").alias("llm_id"), F.col("text_hash").alias("llm_hash")
    )
    same = F.col("doc_id").eqNullSafe(F.col("llm_id")) & (F.xxhash64("text") == F.col("llm_hash"))
    return docs.join(bad, same, "left_anti")
