"""Streaming jobs, run to the end of what has arrived and read from their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heirloom.operators import jobs
from heirloom.operators.messages import decode
from heirloom.plans import fixtures as fx
from heirloom.plans import sql as q
from heirloom.plans.job_queries import PHASE, STATUS
from heirloom.plans.registry import query
from heirloom.plans.session_queries import TURNS
from heirloom.session import scratch_path
from heirloom.streaming import gate as gate_stream
from heirloom.streaming import jobs as job_stream
from heirloom.streaming import rounds as round_stream

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _landing(df: DataFrame, label: str) -> str:
    """Rows as arriving files, dealt as the input is."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


def _landing_in_order(parts: list[DataFrame], label: str, key: str) -> str:
    """Parts that arrive one after another; rows of one ``key`` stay together in each."""
    path = scratch_path(parts[0].sparkSession, label)
    for part in parts:
        part.repartition(key).write.mode("append").parquet(path)
    return path


def _stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


@query(
    "str1_stream_job_fold",
    f"""WITH ls AS (SELECT user_id, event_id, {STATUS} AS status FROM events
   QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
  SELECT CAST(user_id AS VARCHAR) AS id, event_id AS seq, {PHASE} AS phase FROM ls""",
)
def stream_job_fold(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("id"),
        F.col("event_id").alias("seq"),
        fx.event_status().alias("status"),
    )
    out = scratch_path(spark, "jobs")
    folded = job_stream.fold_stream(_stream(spark, _landing(log, "log")))
    job_stream.write_updates(folded, out, scratch_path(spark, "ckpt")).awaitTermination()
    state = job_stream.current(spark.read.parquet(out))
    return state.select("id", "seq", jobs.map_status(F.col("status")).alias("phase"))


@query(
    "str2_stream_gate",
    f"WITH {q.GATED} SELECT CASE WHEN verdict = 'pass' THEN 'accepted' ELSE 'rejected' END AS route, "
    "verdict, count(*) AS n FROM gated GROUP BY 1, 2",
)
def stream_gate(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch_path(spark, "gated")
    arriving = _stream(spark, _landing(fx.memories(spark, sf), "memories"))
    gate_stream.write_gated(arriving, out, scratch_path(spark, "ckpt")).awaitTermination()
    return spark.read.parquet(out).groupBy("route", "verdict").agg(F.count("*").alias("n"))


@query(
    "str3_stream_rounds",
    f"""{TURNS}, x AS (SELECT session_id, turn_index, min(turn) AS first_seq, count(*) AS messages
   FROM tn GROUP BY session_id, turn_index)
  SELECT session_id, turn_index, first_seq, messages FROM x""",
)
def stream_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Rounds closed by the next one, the last by the end of the session.

    The first messages of all sessions arrive before the later ones, and the marks of
    complete sessions last.
    """
    lines = fx.readable_lines(spark, sf).select("session_id", F.col("pos").alias("seq"), "line")
    lines = lines.withColumn("ends", F.lit(False))
    ends = lines.groupBy("session_id").agg((F.max("seq") + 1).alias("seq")).select(
        "session_id", "seq", F.lit('{"role":"user","content":[]}').alias("line"), F.lit(True).alias("ends")
    )
    parts = [lines.where("seq < 2"), lines.where("seq BETWEEN 2 AND 5"), lines.where("seq > 5"), ends]
    arriving = _stream(spark, _landing_in_order(parts, "lines", "session_id"))
    out = scratch_path(spark, "closed")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        closed = round_stream.close_rounds(decode(arriving))
        round_stream.write_closed(closed, out, scratch_path(spark, "ckpt")).awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(round_stream.OUTPUT).parquet(out).select(
        F.col("session_id").cast("string").alias("session_id"),
        F.col("turn_index").cast("bigint").alias("turn_index"),
        "first_seq",
        "messages",
    )
