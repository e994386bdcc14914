"""Document fingerprints: SimHash by weighted term hashes and permuted block tables.

Terms are pairs of neighbouring words (a lone word stands for itself), weighted by how
often they occur. Every term's 64-bit hash votes on every bit with its weight, for where
the bit is set and against where not; the bits with a majority make the fingerprint. The
votes of a text are counted inside its row: eight counters of a byte share a number, and
after at most 127 terms they are added to the 64 sums, so no term becomes a row.

``within_radius`` finds all pairs of fingerprints within a Hamming radius: a fingerprint
is cut into two blocks more than the radius, so a pair agrees in two blocks at least;
for each choice of two there is a table keyed by them. Everything is DataFrame
operations.

Defined results: a null text is an empty one; a text without words has fingerprint 0;
equal texts have equal fingerprints; rows with equal ids follow each other in an order
of their own texts; null ids come last; a lone document is its own next one; further
columns are not looked at.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heirloom.session import evaluated_once

WHITE = r"[\x20\x09-\x0D]+"
BYTES = 0x0101010101010101
#: Terms that byte counters hold without reaching the sign of the highest one.
CHUNK = 127
#: Rows of a block of neighbouring documents, and the most blocks there may be.
BLOCK_ROWS = 512
MOST_BLOCKS = 1 << 16
LAST_ID = 2**63 - 1


def _term_hashes(words: Column) -> Column:
    n = F.size(words)
    pairs = F.transform(
        F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1))
    )
    return F.when(n == 1, F.transform(words, lambda w: F.xxhash64(w))).otherwise(pairs)


def _votes(hashes: Column) -> Column:
    """How many of the hashes have each of the 64 bits set."""
    start = F.struct(*[F.lit(0).cast("long").alias(f"c{k}") for k in range(8)])

    def add(acc: Column, h: Column) -> Column:
        each = [acc[f"c{k}"] + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(BYTES)) for k in range(8)]
        return F.struct(*[c.alias(f"c{k}") for k, c in enumerate(each)])

    def bits(acc: Column) -> Column:
        # Bit 8j + k is counted in byte j of counter k.
        return F.array(
            *[F.shiftrightunsigned(acc[f"c{b % 8}"], b - b % 8).bitwiseAND(F.lit(255).cast("long")) for b in range(64)]
        )

    def chunk(acc: Column, i: Column) -> Column:
        return F.zip_with(
            acc, F.aggregate(F.slice(hashes, i * CHUNK + 1, F.lit(CHUNK)), start, add, bits), lambda x, y: x + y
        )

    chunks = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / CHUNK).cast("int"))
    return F.aggregate(chunks, F.array_repeat(F.lit(0).cast("long"), 64), chunk)


def with_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the fingerprint of a text column. Each step is worked out once a row."""
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), WHITE), "")
    rows = evaluated_once(rows.withColumn("fp_words", words), "fp_words")
    rows = evaluated_once(rows.withColumn("fp_hashes", _term_hashes(F.col("fp_words"))).drop("fp_words"), "fp_hashes")
    rows = evaluated_once(rows.withColumn("fp_votes", F.when(F.size("fp_hashes") > 0, _votes(F.col("fp_hashes")))), "fp_votes")
    # The last bit is the most significant one.
    packed = F.aggregate(
        F.reverse("fp_votes"),
        F.lit(0).cast("long"),
        lambda acc, v: F.shiftleft(acc, 1).bitwiseOR((v * 2 > F.size("fp_hashes")).cast("long")),
    )
    fp = F.when(F.size("fp_hashes") > 0, packed).otherwise(F.lit(0).cast("long"))
    return evaluated_once(rows.withColumn(name, fp).drop("fp_hashes", "fp_votes"), name)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LAST_ID))


def _starts(docs: DataFrame) -> list[int]:
    """The first ids of blocks of about BLOCK_ROWS documents, at most MOST_BLOCKS of them.

    Ids are drawn by their hash, eight for each block, and every eighth is taken.
    """
    keys = docs.select(_key(F.col("doc_id")).alias("key"))
    low, n = keys.agg(F.min("key"), F.count(F.lit(1))).first()
    if not n:
        return [LAST_ID]
    share = 8.0 * min(MOST_BLOCKS, -(-n // BLOCK_ROWS)) / n
    place = F.shiftrightunsigned(F.xxhash64("key", F.lit(8)), 11) / F.lit(float(1 << 53))
    drawn = keys.filter(place < share).distinct().orderBy("key").toArrow().column(0).to_pylist()
    return sorted({low, *drawn[8::8]})


def with_next(docs: DataFrame, *names: str) -> DataFrame:
    """Adds next_<name>: the values of the next document by ascending id, after the last the first's.

    Documents are dealt into blocks of neighbours by id; the first of each block is also
    sent, as a guest, to the end of the block before. So each document moves once.
    """
    starts = _starts(docs)
    # A text that the optimizer turns into one constant.
    table = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")
    steps = max(len(starts) - 1, 1).bit_length()
    key = _key(F.col("doc_id"))
    rows = docs.withColumn("nx_key", key)
    # How many starts lie at or below the key, by halving.
    count = F.aggregate(
        F.array(*[F.lit(1 << b) for b in range(steps, -1, -1)]),
        F.lit(0),
        lambda acc, half: acc + F.when(F.get(table, acc + half - 1) <= F.col("nx_key"), half).otherwise(0),
    )
    rows = evaluated_once(rows.withColumn("nx_block", count - 1), "nx_block")
    first = F.get(table, F.col("nx_block")) == F.col("nx_key")
    before = F.when(F.col("nx_block") == 0, len(starts) - 1).otherwise(F.col("nx_block") - 1)
    own = F.struct(F.col("nx_block").alias("block"), F.lit(False).alias("guest"))
    guest = F.struct(before.alias("block"), F.lit(True).alias("guest"))
    rows = rows.select(*docs.columns, "nx_key", F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own))).alias("nx"))
    tie = [F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = rows.withColumns({"nx_text": tie[0], "nx_row": tie[1]})
    order = Window.partitionBy("nx.block").orderBy("nx.guest", "nx_key", F.col("doc_id").isNull(), "nx_text", "nx_row")
    found = rows.withColumns({f"next_{n}": F.lead(n).over(order) for n in names})
    return found.filter("NOT nx.guest").drop("nx", "nx_key", "nx_text", "nx_row")


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter replaced by as much of the beginning of the next."""
    n = F.length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(following, F.lit(1), quarter))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited and near_next of every document."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(with_fingerprint(rows, "text", "fp"), "text", "fp")
    rows = rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        "fp",
        "next_fp",
        edited(F.col("text"), F.col("next_text")).alias("edited"),
    )
    rows = with_fingerprint(rows, "edited", "edited_fp")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fp",
        "edited_fp",
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def within_radius(prints: DataFrame, radius: int = 3) -> DataFrame:
    """All pairs (a, b, apart) of different fingerprints of prints(fp), a < b, within the radius.

    A pair is reported by the first table whose two blocks agree.
    """
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    masks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(n)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    tables = list(combinations(range(n), 2))

    def agree(t: tuple[int, int]) -> int:
        both = masks[t[0]] | masks[t[1]]
        return both

    fps = prints.select("fp").distinct()
    keys = F.array(
        *[F.struct(F.lit(i).alias("no"), F.col("fp").bitwiseAND(F.lit(agree(t))).alias("key")) for i, t in enumerate(tables)]
    )
    rows = fps.select("fp", F.explode(keys).alias("t")).select("fp", "t.no", "t.key")
    other = rows.select(F.col("fp").alias("b"), F.col("no").alias("no_b"), F.col("key").alias("key_b"))
    met = rows.join(other, (F.col("no") == F.col("no_b")) & (F.col("key") == F.col("key_b")) & (F.col("fp") < F.col("b")))
    differ = F.col("fp").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(agree(t))) == 0, F.lit(i)) for i, t in enumerate(tables)])
    apart = F.bit_count(differ)
    return met.filter((apart <= radius) & (first == F.col("no"))).select(F.col("fp").alias("a"), "b", apart.alias("apart"))
