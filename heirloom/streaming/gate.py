"""The quality gate on arriving memories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heirloom.config import PASS, GateConfig
from heirloom.operators.gate import with_verdict


def write_gated(
    memories: DataFrame, out: str, checkpoint: str, cfg: GateConfig = GateConfig()
) -> StreamingQuery:
    """Route each batch to ``accepted`` and ``rejected`` in one pass.

    One partitioned write replaces two filtered ones, so the gate runs once per
    row and nothing has to be cached. A replayed batch replaces its own files.
    """
    routed = with_verdict(memories, cfg).withColumn(
        "route", F.when(F.col("verdict") == PASS, "accepted").otherwise("rejected")
    )

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("route").parquet(f"{out}/batch_id={batch_id}")

    return (
        routed.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )
