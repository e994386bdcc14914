"""Registry tables: JSON record directories and Parquet tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_records(spark: SparkSession, directory: str, schema: T.StructType) -> DataFrame:
    """Every ``*.json`` record of a directory; a missing directory is empty."""
    try:
        return (
            spark.read.schema(schema)
            .option("multiLine", True)
            .option("mode", "FAILFAST")
            .json(f"{directory.rstrip('/')}/*.json")
        )
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A registry table; a missing one is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
