"""Session set-up, the shared scratch folder, and durable cut points."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_spark(app_name: str = "heirloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on.

    AQE merges small shuffle partitions and splits skewed ones. Give
    ``spark.sql.shuffle.partitions`` for the data at hand: high enough that a
    partition fits an executor, since AQE merges but does not divide evenly
    filled ones.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session in which that
    is unset (tests, a laptop) gets a fresh local folder, recorded in the session.
    Elsewhere executors would each write to their own disk, so it is an error.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        existing = spark.sparkContext.getCheckpointDir()
        if existing:
            return existing
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
        return spark.sparkContext.getCheckpointDir()
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the scratch folder that no earlier call has handed out."""
    return f"{scratch_root(spark).rstrip('/')}/heirloom-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written table.

    Used where several results derive from one expensive plan. Unlike a cache,
    the table survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def materialize_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """The same, with the number of rows counted while writing."""
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    table = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return table, seen.get["n"]


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` whose readers are written: nothing that may have to be
    computed again reads them any more."""
    for table in tables:
        path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def evaluated_once(df: DataFrame, *names: str) -> DataFrame:
    """Fix costly columns, so that filters on them do not compute them again.

    The optimizer pushes a filter below the projection that makes its column and
    repeats the expression there, once per use and level. It does not push
    filters on what an outer generator returns.
    """
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.inline_outer(F.array(F.struct(*names)))).select(*df.columns)


def local_master(default: str = "8") -> str:
    return f"local[{os.environ.get('BENCH_CPUS', default)}]"
