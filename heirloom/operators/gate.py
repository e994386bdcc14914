"""The quality gate: one ordered CASE that names the first rule a memory fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heirloom.config import PASS, REJECTION_REASONS, GateConfig
from heirloom.functions import text as t
from heirloom.functions.memo import per_application
from heirloom.session import evaluated_once

# Tag prefixes that carry routing, not subject matter.
ROUTING_PREFIXES = ("from:", "to:")

# Openers of a greeting, tested on the first line.
GREETING_OPENERS = ("yo ", "hey ", "hi ", "hello ", "greetings", "sup ", "howdy")

# Phrases that address a reader, tested anywhere.
DIRECT_ADDRESS = (
    "can you hear me",
    "are you there",
    "how's it going",
    "hows it going",
    "how are you",
    "testing 123",
    "just checking in",
    "first smoke test",
)


def type_excluded(memory_type: Column, cfg: GateConfig = GateConfig()) -> Column:
    return ~memory_type.isin(*cfg.include_types)


def too_short(trimmed: Column, cfg: GateConfig = GateConfig()) -> Column:
    return F.length(trimmed) < cfg.min_content


def low_salience(salience: Column, cfg: GateConfig = GateConfig()) -> Column:
    # Both sides as FLOAT: 0.3 as DOUBLE would also reject a stored 0.3f.
    return salience < F.lit(cfg.min_salience).cast("float")


def is_routing_tag(tag: Column) -> Column:
    return t.starts_with_any(F.lower(t.strip(tag)), ROUTING_PREFIXES)


def denied_tag(tags: Column, cfg: GateConfig = GateConfig()) -> Column:
    return F.exists(tags, lambda g: F.lower(g).isin(*cfg.denied_tags) | is_routing_tag(g))


def dream_derived(tags: Column) -> Column:
    return F.exists(tags, lambda g: F.lower(t.strip(g)).rlike("^dream(?:[_-]|\\z)"))


def greeting_opener(text: Column) -> Column:
    opening = F.lower(t.first_line(text))
    return t.let(opening, lambda first: t.starts_with_any(first, GREETING_OPENERS))


def direct_address(text: Column) -> Column:
    # Literal searches run several times faster than one regex alternation.
    return t.let(F.lower(text), lambda low: t.contains_any(low, DIRECT_ADDRESS))


def chatter(text: Column) -> Column:
    return greeting_opener(text) | direct_address(text)


def word_bytes(text: Column) -> Column:
    """UTF-8 bytes of the words that are not web addresses."""
    blanks = r"(?U)\s+"
    addresses = r"(?U)(?<!\S)https?://\S*|\s+"
    return F.octet_length(
        F.when(text.contains("http"), F.regexp_replace(text, addresses, "")).otherwise(
            F.regexp_replace(text, blanks, "")
        )
    )


def not_prose(trimmed: Column, cfg: GateConfig = GateConfig()) -> Column:
    alnum = F.length(F.regexp_replace(trimmed, r"[^\p{IsAlphabetic}\p{N}]+", ""))
    return (alnum * 2 < F.length(trimmed)) | (word_bytes(trimmed) < cfg.min_word_bytes)


@per_application
def assess(
    cfg: GateConfig = GateConfig(),
    trimmed: str = "_trimmed",
    memory_type: str = "memory_type",
    tags: str = "tags",
    salience: str = "salience",
) -> Column:
    """``pass`` or the first failing rule. Cheap tests come first, text scans last."""
    body = F.col(trimmed)
    rule = (
        F.when(type_excluded(F.col(memory_type), cfg), "type_excluded")
        .when(too_short(body, cfg), "too_short")
        .when(low_salience(F.col(salience), cfg), "low_salience")
        .when(denied_tag(F.col(tags), cfg), "denied_tag")
    )
    if not cfg.include_dream_derived:
        rule = rule.when(dream_derived(F.col(tags)), "dream_derived")
    return (
        rule.when(chatter(body), "chatter")
        .when(not_prose(body, cfg), "not_prose")
        .otherwise(PASS)
    )


def with_verdict(memories: DataFrame, cfg: GateConfig = GateConfig()) -> DataFrame:
    """Add ``verdict``. Map-only; the trimmed text is computed once per row."""
    judged = (
        memories.withColumn("_trimmed", t.strip(F.col("content")))
        .withColumn("verdict", assess(cfg))
        .drop("_trimmed")
    )
    return evaluated_once(judged, "verdict")


def rejection_reasons(spark: SparkSession) -> DataFrame:
    """The closed set of reasons, so that reports can show a zero."""
    return spark.createDataFrame(
        [(i, r) for i, r in enumerate(REJECTION_REASONS)], "reason_ix INT, reason STRING"
    )


def ledger(verdicts: DataFrame, column: str = "verdict") -> DataFrame:
    """Rows per verdict."""
    return verdicts.groupBy(F.col(column).alias("verdict")).agg(F.count("*").alias("n"))


def full_ledger(verdicts: DataFrame, column: str = "verdict") -> DataFrame:
    """Rows per rejection reason, with zeros for reasons that did not occur."""
    counts = verdicts.groupBy(F.col(column).alias("reason")).agg(F.count("*").alias("n"))
    return (
        rejection_reasons(verdicts.sparkSession).join(counts, "reason", "left")
        .select("reason", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    )
