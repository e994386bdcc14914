"""A directory of session files to outcomes and examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heirloom.config import USED, HarvestConfig
from heirloom.operators import rounds
from heirloom.operators.messages import decode
from heirloom.session import materialize
from heirloom.sources import sessions as src


def outcomes_of(
    lines: DataFrame,
    files: DataFrame | None,
    stamps: DataFrame | None,
    cfg: HarvestConfig = HarvestConfig(),
) -> DataFrame:
    """One row per skipped file, unreadable line and round.

    ``lines`` holds ``file_path, session_id, block, pos, line``. The decoded
    messages feed several consumers (rejected lines, turns, facts, text), so they are
    written once to the shared folder instead of being parsed each time. From there
    only the text of rounds in play is shuffled, once, to where its round is gathered.
    """
    messages = materialize(decode(lines), "messages")
    numbered = rounds.with_turns(messages.where(F.col("role").isNotNull()))
    unreadable = rounds.rejected_rows(
        messages.where(F.col("role").isNull()).withColumn("line_pos", F.col("pos")),
        "unparsable",
    )
    whole = rounds.assess_rounds(numbered, stamps, cfg).unionByName(unreadable)
    if files is not None:
        skipped = files.where(F.col("file_verdict").isNotNull())
        whole = whole.unionByName(rounds.rejected_rows(skipped, F.col("file_verdict")))
    return whole


def mine_sessions(
    spark: SparkSession, directory: str, cfg: HarvestConfig = HarvestConfig()
) -> tuple[DataFrame, DataFrame]:
    """Outcomes and examples of a copied export directory."""
    globs = src.session_globs(spark, directory)
    bundle = src.read_bundle(spark, directory)
    head = bundle.select("node_id").first()
    node = src.resolve_node(directory, cfg.node_id, head["node_id"] if head else None)
    outcomes = materialize(
        outcomes_of(
            src.session_lines(spark, globs),
            src.session_files(spark, globs),
            src.stamps(bundle),
            cfg,
        ),
        "outcomes",
    )
    return outcomes, rounds.examples(outcomes, node)


def summary(outcomes: DataFrame) -> DataFrame:
    """The one-row report of a harvest."""
    used = F.col("verdict") == USED
    return outcomes.agg(
        F.count("*").alias("rounds_in"),
        F.count_if(used).alias("rounds_used"),
        F.count_if(used).alias("examples"),
        F.count_if(~used).alias("rejected"),
    )
