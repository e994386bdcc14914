"""Job logs and trainer states on disk."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heirloom.operators.jobs import parse_snapshots
from heirloom.schemas import STR, TRAINER_STATE, row
from heirloom.sources.lines import file_stem, open_files, read_lines, with_line_numbers


def read_job_log(spark: SparkSession, path: str) -> DataFrame:
    """Parsed log lines: ``file_path, line_no, job, skip_reason``.

    The log is read in splits and still numbered exactly. A missing log is empty.
    """
    try:
        lines = with_line_numbers(read_lines(spark, path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], row(file_path=STR, value=STR)).withColumn(
            "line_no", F.lit(None).cast("bigint")
        )
    return parse_snapshots(lines.select("file_path", "line_no", "value"))


def parse_trainer_states(texts: DataFrame, text: str = "value") -> DataFrame:
    """Log rows ``run_id, ix, loss, epoch`` of whole state texts; a bad text is an error."""
    history = F.from_json(F.col(text), TRAINER_STATE, {"mode": "FAILFAST"})["log_history"]
    return texts.select("run_id", F.posexplode(history).alias("ix", "r")).select(
        "run_id", "ix", "r.loss", "r.epoch"
    )


def read_trainer_state(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Trainer state files; the run is named by its file."""
    run = file_stem(F.col("_metadata.file_path")).alias("run_id")
    return parse_trainer_states(open_files(spark, "text", path, run, F.col("value"), wholetext=True))
