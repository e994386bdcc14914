"""Mixing sources to target weights: hash-threshold histograms.

Each source gets a target number of words. Every document has a hash; a source gives
all documents a number of full copies and one more to those whose hash lies below the
source's threshold. The thresholds come from histograms: words are summed by source
and hash bucket, the budget ends inside one bucket, and only that bucket is looked at
again with finer buckets, until it holds a single hash. Nothing is sorted and a larger
budget always takes a superset of a smaller one's documents.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; rows that repeat (same id, same size) share a hash and are taken together; an
empty table gives an empty mix. Further columns of the input are never looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heirloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
LEVEL_BITS = 12


@dataclass(frozen=True)
class MixConfig:
    """``weights`` repeat over the sources in code point order. The sources share
    ``budget`` times all words, none more than ``cap`` times its own."""

    weights: Sequence[float] = (3.0, 1.0, 2.0)
    budget: float = 1.5
    cap: float = 2.0


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column, size: Column) -> Column:
    """A document's place between 0 and 2^60, the same in every run and engine."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), size.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and place of every document."""
    words = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return words.withColumn("place", place(F.col("doc_id"), F.col("size")))


def numbered(sums: DataFrame) -> DataFrame:
    """Adds ``rank``, the place of each source in order, without bringing all to one task.

    A range sort deals the sources out in order; a source's rank is its place in its
    partition plus the sizes of the partitions before, of which there are few.
    """
    ordered = sums.orderBy(F.col("source").asc_nulls_last()).withColumn(
        "at", F.monotonically_increasing_id()
    )
    table = materialize(ordered, "mix-order").withColumn("part", F.shiftright("at", 33))
    parts = table.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return table.join(parts, "part").select(
        "source", "source_size", (F.col("at") - F.col("low") + F.col("base")).alias("rank")
    )


def targets(sources: DataFrame, config: MixConfig) -> DataFrame:
    """Adds the target of each source(source_size, rank).

    Sources above their cap are held there and the rest is shared by weight again, so
    in the end each has ``min(cap, weight * level)``. The level only rises; it is found
    with one small sum per round.
    """
    weights = F.array(*[F.lit(float(w)) for w in config.weights])
    step = (F.col("rank") % len(config.weights)).cast("int")
    table = materialize(
        sources.withColumn("weight", F.get(weights, step)).withColumn(
            "most", F.col("source_size") * F.lit(config.cap)
        ),
        "mix-sources",
    )
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, held = 0.0, -1
    while True:
        capped = F.col("most") < F.col("weight") * F.lit(level)
        row = table.agg(
            F.count_if(capped).alias("held"),
            F.coalesce(F.sum(F.when(capped, F.col("most"))), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)).alias("free"),
        ).first()
        if row.held == held or not row.free:
            break
        held, level = row.held, (config.budget * total - row.fixed) / row.free
    return table.select(
        "source",
        "source_size",
        F.least(F.col("most"), F.col("weight") * F.lit(level)).alias("target"),
    )


def thresholds(docs: DataFrame, config: MixConfig | None = None) -> DataFrame:
    """source, source_size, target, full and below: copies of each document of the source,
    and the place below which a document is taken once more. ``docs`` as from sized()."""
    config = config or MixConfig()
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(numbered(sums), config)
    size = F.col("source_size")
    full = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0))
    goal = materialize(
        goal.withColumn("full", full.cast("long")).withColumn(
            "rest", F.col("target") - F.col("full") * size
        ),
        "mix-goal",
    )
    open_ = goal.filter("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("bucket"))
    found, shift = [], HASH_BITS
    while True:
        inside = docs.select(
            F.col("source").alias("of"), "size", "place", F.shiftright("place", shift).alias("b")
        ).join(
            open_, F.col("of").eqNullSafe(F.col("source")) & (F.col("b") == F.col("bucket")), "left_semi"
        )
        shift -= LEVEL_BITS
        bars = inside.groupBy("of", F.shiftright("place", shift).alias("bar")).agg(
            F.sum("size").alias("words"), F.min("place").alias("low"), F.max("place").alias("high")
        )
        # A source has at most 2^LEVEL_BITS bars.
        before = Window.partitionBy("of").orderBy("bar").rowsBetween(Window.unboundedPreceding, -1)
        bars = bars.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        crossing = bars.join(open_, F.col("of").eqNullSafe(F.col("source"))).filter(
            "before <= rest AND before + words > rest"
        )
        at = materialize(
            crossing.select(
                "source",
                (F.col("rest") - F.col("before")).alias("rest"),
                F.col("bar").alias("bucket"),
                "words",
                "low",
                (F.col("low") == F.col("high")).alias("single"),
            ),
            "mix-bars",
        )
        # All of the last hash's rows are taken if that comes nearer to the target.
        last = F.col("low") + F.when(F.col("rest") * 2 >= F.col("words"), 1).otherwise(0)
        found.append(at.filter("single").select(F.col("source").alias("of"), last.alias("below")))
        open_ = at.filter("NOT single").select("source", "rest", "bucket")
        if open_.isEmpty():
            break
    below = reduce(DataFrame.unionAll, found)
    return materialize(
        goal.join(below, F.col("source").eqNullSafe(F.col("of")), "left").select(
            "source", "source_size", "target", "full", F.coalesce("below", F.lit(0)).alias("below")
        ),
        "mix-thresholds",
    )


def copies(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds size, source_size, target, copies and taken to rows with size and place."""
    limits = limits.withColumnRenamed("source", "llm_source")
    more = (F.col("place") < F.col("below")).cast("long")
    return (
        docs.join(limits, F.col("source").eqNullSafe(F.col("llm_source")), "left")
        .withColumn("copies", F.col("full") + more)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("llm_source", "full", "below")
    )


def mix_ledger(docs: DataFrame, config: MixConfig | None = None) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, copies, taken."""
    table = materialize(sized(docs), "mix-sized")
    return copies(table, thresholds(table, config)).drop("place")


def mix(docs: DataFrame, config: MixConfig | None = None) -> DataFrame:
    """The documents of the mix, as they came, with ``copies``: how often each is taken.

    A column of the input named ``copies`` gives way to the mix's own.
    """
    limits = thresholds(materialize(sized(docs), "mix-sized"), config)
    limits = limits.select(
        F.col("source").alias("llm_source"), F.col("full").alias("llm_full"), F.col("below").alias("llm_below")
    )
    size = n_words(F.col("text"))
    count = F.col("llm_full") + (place(F.col("doc_id"), size) < F.col("llm_below")).cast("long")
    kept = [c for c in docs.columns if c != "copies"]
    return (
        docs.join(limits, F.col("source").eqNullSafe(F.col("llm_source")), "left")
        .select(*kept, count.alias("copies"))
        .filter("copies > 0")
    )
