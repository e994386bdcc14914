import time

from pyspark.sql import functions as F

from heirloom.session import scratch_path
from heirloom.streaming import rounds


def test_silence_closes_the_open_round(spark, tmp_path):
    block = "ARRAY<STRUCT<text: STRING>>"
    rows = spark.createDataFrame(
        [(1, 0, "user", [("q",)]), (1, 1, "assistant", [("a",)]), (1, 2, "user", [("r",)])],
        f"session_id INT, seq BIGINT, role STRING, blocks {block}",
    ).withColumn("session_id", F.col("session_id").cast("decimal(20,0)"))
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.coalesce(1).write.parquet(landing)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(
        key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    query = (
        rounds.close_rounds(spark.readStream.schema(rows.schema).parquet(landing), timeout_ms=500)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, "ckpt"))
        .trigger(processingTime="1 second")
        .start()
    )
    try:
        deadline, closed = time.time() + 60, []
        while time.time() < deadline and len(closed) < 2:
            time.sleep(1)
            closed = spark.read.schema(rounds.OUTPUT).parquet(out).collect() if (
                tmp_path / "out" / "_spark_metadata"
            ).exists() else []
    finally:
        query.stop()
        spark.conf.set(key, before)
    assert sorted((r["turn_index"], r["messages"], r["reason"]) for r in closed) == [
        (0, 2, "next_round"), (1, 1, "timeout"),
    ]
