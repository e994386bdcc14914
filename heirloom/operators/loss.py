"""Loss curves from trainer logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def epoch_of(epoch: Column) -> Column:
    """Whole epoch of a step; missing is 0 and nothing lies below 0."""
    return F.greatest(F.floor(F.coalesce(epoch, F.lit(0.0))), F.lit(0)).cast("int")


def steps(train_log: DataFrame) -> DataFrame:
    """Rows that report a loss."""
    return train_log.where(F.col("loss").isNotNull())


def epoch_means(train_log: DataFrame) -> DataFrame:
    return (
        steps(train_log)
        .groupBy("run_id", epoch_of(F.col("epoch")).alias("epoch"))
        .agg(F.avg("loss").alias("mean_loss"), F.count("*").alias("n"))
    )


def loss_summary(train_log: DataFrame) -> DataFrame:
    """Steps and the first and last loss. Single steps mislead; prefer the means."""
    return (
        steps(train_log)
        .groupBy("run_id")
        .agg(
            F.count("*").alias("steps"),
            F.min_by("loss", "ix").alias("first_step_loss"),
            F.max_by("loss", "ix").alias("last_step_loss"),
        )
    )
