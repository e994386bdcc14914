"""Projection of a stored dataset to a provider's schema, with its validation."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from heirloom.functions import text as t
from heirloom.operators.examples import from_jsonl
from heirloom.session import evaluated_once
from heirloom.sinks.dataset import dataset_lines, path_exists
from heirloom.sources.lines import SPLIT, part_number, read_lines

# Roles a stored message can have.
ROLES = ("system", "user", "assistant")


class InvalidDataset(ValueError):
    pass


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Add ``example`` to ``line_no, line``; blank lines are dropped but counted."""
    return lines.where(t.not_blank(F.col("line"))).withColumn("example", from_jsonl(F.col("line")))


def violation(example: Column) -> Column:
    """Why a stored example must not be exported, NULL when it may."""
    messages = example.getField("messages")
    sound = (
        example.isNotNull()
        & example.getField("_corrupt").isNull()
        & messages.isNotNull()
        & example.getField("provenance").getField("kind").isNotNull()
        & example.getField("instruction_kind").isNotNull()
        & F.forall(
            messages,
            lambda m: F.coalesce(m["role"].isin(*ROLES) & m["content"].isNotNull(), F.lit(False)),
        )
    )
    blank = F.filter(
        F.transform(messages, lambda m, i: F.when(t.is_blank(m["content"]), i)),
        lambda i: i.isNotNull(),
    )
    return (
        F.when(~F.coalesce(sound, F.lit(False)), "not a valid stored example")
        .when(F.size(messages) == 0, "no messages")
        .when(
            F.size(blank) > 0,
            F.concat(
                F.lit("message "), F.get(blank, F.lit(0)).cast("string"),
                F.lit(" has empty content"),
            ),
        )
        .when(
            ~F.exists(messages, lambda m: m["role"] == "assistant"),
            "no assistant turn — nothing to learn from",
        )
    )


def violations(lines: DataFrame) -> DataFrame:
    """Lines that must not be exported, with number and reason."""
    return (
        parsed_lines(lines)
        .select("line_no", violation(F.col("example")).alias("reason"))
        .where(F.col("reason").isNotNull())
    )


def provider_line(messages: Column) -> Column:
    """Messages and nothing else; members in name order, as upstream files have them."""
    ordered = F.transform(
        messages, lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role"))
    )
    return F.to_json(F.struct(ordered.alias("messages")))


def project(lines: DataFrame) -> DataFrame:
    """Provider lines of a dataset that has no violations."""
    return parsed_lines(lines).select(
        "line_no", provider_line(F.col("example.messages")).alias("line")
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    return dataset_lines(spark, path).select(
        (F.col("position") + 1).alias("line_no"), "line"
    )


def split_label(path: Column, block: Column) -> Column:
    """The name of a split of a dataset; names sort as the stored lines do."""
    name = F.element_at(F.split(path, "/"), -1)
    number = F.lpad((part_number(path) + 1).cast("string"), 19, "0")
    return F.concat_ws("-", number, name, F.lpad(block.cast("string"), 19, "0"))


def export_provider(spark: SparkSession, dataset: str, out: str) -> None:
    """Check a stored dataset and write its projection in the same order, in one scan.

    No line moves: each split is projected where it is read and written under its name, and
    names sort as the dataset does. The same pass counts lines and finds the first that
    must not be exported. Only an export without one is renamed to ``out``, which is a
    single step where the file system has one; before, nothing can be seen there.
    """
    if path_exists(spark, out):
        raise FileExistsError(f"export exists: {out}")
    lines = read_lines(spark, dataset).select(
        split_label(F.col("file_path"), F.col("block_start")).alias(SPLIT), "row_pos", F.col("value").alias("line")
    )
    rows = parsed_lines(lines).select(
        SPLIT, "row_pos", violation(F.col("example")).alias("reason"), provider_line(F.col("example.messages")).alias("line")
    )
    seen = Observation(f"export-{uuid.uuid4().hex}")
    counted = evaluated_once(rows, "reason", "line").observe(
        seen, F.count(F.lit(1)).alias("n"), F.count("reason").alias("bad")
    )
    staged = f"{out.rstrip('/')}.staged-{uuid.uuid4().hex}"
    ordered = counted.sortWithinPartitions(SPLIT, "row_pos").select(SPLIT, "line")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        ordered.write.mode("errorifexists").partitionBy(SPLIT).text(staged)
        if seen.get["bad"]:
            first = violations(numbered_lines(spark, dataset)).agg(F.min(F.struct("line_no", "reason")).alias("v")).first()["v"]
            raise InvalidDataset(f"line {first['line_no']}: {first['reason']}")
        if seen.get["n"] == 0:
            raise InvalidDataset("dataset is empty — nothing to upload")
        if not fs.rename(path(staged), path(out)):
            raise FileExistsError(f"export exists: {out}")
    finally:
        fs.delete(path(staged), True)
