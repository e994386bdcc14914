"""Prices, estimates and what jobs cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper bound in billions of parameters, US dollars per million tokens.
PRICE_BANDS = ((0.0, 16.0, 0.48), (16.0, 69.0, 1.50), (69.0, 100.0, 2.90))
CHARS_PER_TOKEN = 4
MINIMUM_CHARGE_FACTOR = 2


def price_bands(spark: SparkSession) -> DataFrame:
    """The bands as a table: ``above`` exclusive, ``up_to`` inclusive."""
    return spark.createDataFrame(
        list(PRICE_BANDS), "above DOUBLE, up_to DOUBLE, usd_per_mtok DOUBLE"
    )


def with_price(df: DataFrame, params_b: str = "params_b") -> DataFrame:
    """Range join with the price bands; sizes outside all bands get NULL.

    The band table is a constant of three rows, hence the broadcast.
    """
    bands = F.broadcast(price_bands(df.sparkSession))
    size = F.col(params_b)
    return df.join(bands, (size > F.col("above")) & (size <= F.col("up_to")), "left").drop(
        "above", "up_to"
    )


def tokens_from_chars(chars: Column) -> Column:
    return F.ceil(chars / CHARS_PER_TOKEN).cast("bigint")


def estimate(datasets: DataFrame, epochs: int = 3, chars: str = "chars") -> DataFrame:
    """Tokens and price per dataset, from characters and ``params_b``.

    An unpriced model gets NULL, not a guess. The minimum charge is not included.
    """
    passes = max(epochs, 1)
    return (
        with_price(datasets)
        .withColumn("dataset_tokens", tokens_from_chars(F.col(chars)))
        .withColumn("training_tokens", F.col("dataset_tokens") * F.lit(passes))
        .withColumn("epochs", F.lit(passes))
        .withColumn(
            "training_usd", F.col("training_tokens") / F.lit(1_000_000.0) * F.col("usd_per_mtok")
        )
    )


def message_chars(messages: Column) -> Column:
    """Characters a provider sees of one example."""
    return F.aggregate(
        messages, F.lit(0).cast("bigint"), lambda a, m: a + F.length(m["content"])
    )


def usd(nanodollars: Column) -> Column:
    return nanodollars.cast("double") / F.lit(1e9)


def job_cost(jobs: DataFrame, minimum: Column | None = None) -> DataFrame:
    """Billed dollars by trainer and base model. Exact until the last division.

    With ``minimum`` (see ``minimum_charge``) also how many jobs it holds for.
    """
    more = [] if minimum is None else [F.count_if(minimum).alias("minimum_charges")]
    return jobs.groupBy("trainer_agent", "base_model").agg(
        F.count("*").alias("jobs"),
        usd(F.sum("total_price_nanodollars")).alias("usd"),
        *more,
    )


def minimum_charge(billed: Column, train_tokens: Column, usd_per_mtok: Column) -> Column:
    """True where the bill is more than twice what the metered tokens cost."""
    metered = train_tokens / F.lit(1_000_000.0) * usd_per_mtok
    return F.coalesce(billed > metered * MINIMUM_CHARGE_FACTOR, F.lit(False))
