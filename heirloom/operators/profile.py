"""Profiles of a memory store and of a harvest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heirloom.config import USED
from heirloom.operators.gate import dream_derived


def agents(live: DataFrame) -> DataFrame:
    """Live memories per agent, largest first."""
    return (
        live.groupBy(F.coalesce("agent_id", F.lit("(none)")).alias("agent"))
        .agg(F.count("*").alias("memories"))
        .orderBy(F.col("memories").desc(), "agent")
    )


def store_profile(memories: DataFrame) -> DataFrame:
    """Per type: rows, average length, rows with sections."""
    return memories.groupBy("memory_type").agg(
        F.count("*").alias("n"),
        F.avg(F.length("content")).alias("avg_chars"),
        F.count_if(F.col("content").rlike(r"(?m)^\s*##")).alias("sectioned"),
    )


def dream_vs_lived(memories: DataFrame) -> DataFrame:
    """Rows and average length of dream-derived and lived memories."""
    return memories.groupBy(dream_derived(F.col("tags")).alias("dream")).agg(
        F.count("*").alias("n"), F.avg(F.length("content")).alias("avg_chars")
    )


def license_mix(outcomes: DataFrame) -> DataFrame:
    """Used rounds by licence class and model.

    ``overrides`` counts rounds whose stamped class contradicts a signature.
    """
    return (
        outcomes.where(F.col("verdict") == USED)
        .groupBy("license_class", "model")
        .agg(
            F.count("*").alias("rounds"),
            F.count_if(F.col("signed") & (F.col("license_class") != "closed_hidden")).alias(
                "overrides"
            ),
        )
    )
