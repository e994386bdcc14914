"""Memories to examples with total accounting: gate, chunk, frame.

``convert`` returns one row per input memory. Its chunks stay nested in that
row, so "was anything of this memory usable" is a property of the row and needs
no regrouping: the conversion of a corpus of any size is a single map stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heirloom.config import PASS, USED, ConvertConfig, FrameConfig
from heirloom.functions.memo import per_application
from heirloom.functions.text import let
from heirloom.operators import chunk as chunking
from heirloom.operators import examples as ex
from heirloom.operators import frame, gate
from heirloom.session import evaluated_once


@per_application
def _framed(cfg: FrameConfig) -> Column:
    def framed(tag_question: Column) -> Column:
        return F.transform(
            "chunks",
            lambda c, i: F.struct(
                i.alias("chunk_ix"),
                c["heading_path"].alias("heading_path"),
                c["body"].alias("body"),
                F.when(F.size(c["heading_path"]) > 0, frame.from_headings(c["heading_path"]))
                .otherwise(tag_question)
                .alias("question"),
                frame.instruction_kind(c["heading_path"]).alias("instruction_kind"),
            ),
        )

    return let(frame.from_tags(F.col("tags"), cfg), framed)


def with_framed_chunks(df: DataFrame, cfg: ConvertConfig = ConvertConfig()) -> DataFrame:
    """Add ``framed``: every chunk with its question (NULL when unframeable).

    The tag question is the same for all chunks of a memory and is built once.
    """
    return df.withColumn("framed", _framed(cfg.frame))


def convert(memories: DataFrame, cfg: ConvertConfig = ConvertConfig()) -> DataFrame:
    """One row per memory: ``verdict`` (``used`` or a reason) and its framed chunks.

    Columns: the order column ``src_ord``, ``memory_id``, ``agent_id``,
    ``verdict``, ``unframeable_chunks`` and ``framed`` (only framed chunks).
    """
    gated = gate.with_verdict(memories, cfg.gate).withColumn(
        "_body", F.when(F.col("verdict") == PASS, F.col("content"))
    )
    framed = with_framed_chunks(chunking.with_chunks(gated, "_body", cfg.chunk), cfg)
    kept = F.filter("framed", lambda c: c["question"].isNotNull())
    outcome = framed.withColumn("_kept", F.coalesce(kept, F.expr("array()"))).select(
        "src_ord",
        F.col("id").alias("memory_id"),
        "agent_id",
        F.when(F.col("verdict") != PASS, F.col("verdict"))
        .when(F.size("_kept") > 0, USED)
        .otherwise("unframeable")
        .alias("verdict"),
        (F.coalesce(F.size("framed"), F.lit(0)) - F.size("_kept"))
        .cast("bigint")
        .alias("unframeable_chunks"),
        F.col("_kept").alias("framed"),
    )
    return evaluated_once(outcome, "verdict", "unframeable_chunks", "framed")


def examples(converted: DataFrame, cfg: ConvertConfig = ConvertConfig()) -> DataFrame:
    """Examples of a conversion, keyed by source position and chunk position.

    Rejected memories have no framed chunks.
    """
    rows = converted.select(
        "src_ord", "memory_id", "agent_id", F.explode_outer("framed").alias("c")
    ).where(F.col("c").isNotNull())
    return rows.select(
        F.struct(F.col("src_ord"), F.col("c.chunk_ix").alias("ix")).alias("example_key"),
        ex.messages(F.col("c.question"), F.col("c.body")).alias("messages"),
        ex.provenance(
            cfg.memory_kind,
            memory_id=F.col("memory_id"),
            agent_id=F.col("agent_id"),
            heading_path=ex.empty_to_null(F.col("c.heading_path")),
        ).alias("provenance"),
        F.col("c.instruction_kind").alias("instruction_kind"),
    )


def summary(converted: DataFrame) -> DataFrame:
    """The one-row report of a conversion: what went in, what came out."""
    return converted.agg(
        F.count("*").alias("memories_in"),
        F.count_if(F.col("verdict") == USED).alias("memories_used"),
        F.coalesce(F.sum(F.size("framed")), F.lit(0)).cast("bigint").alias("examples"),
        F.count_if(F.col("verdict") != USED).alias("rejected"),
        F.coalesce(F.sum("unframeable_chunks"), F.lit(0)).alias("unframeable_chunks"),
        F.coalesce(
            F.sum(
                F.size(
                    F.filter("framed", lambda c: c["instruction_kind"] == "templated_heading")
                )
            ),
            F.lit(0),
        )
        .cast("bigint")
        .alias("framed_heading"),
        F.coalesce(
            F.sum(F.size(F.filter("framed", lambda c: c["instruction_kind"] == "templated_tag"))),
            F.lit(0),
        )
        .cast("bigint")
        .alias("framed_tag"),
    )


def framing_split(converted: DataFrame) -> DataFrame:
    """Examples per instruction kind."""
    return (
        converted.select(F.explode_outer("framed.instruction_kind").alias("instruction_kind"))
        .where(F.col("instruction_kind").isNotNull())
        .groupBy("instruction_kind")
        .agg(F.count("*").alias("n"))
    )
