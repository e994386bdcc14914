"""Current job state from a stream of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def fold_stream(snapshots: DataFrame) -> DataFrame:
    """Last snapshot per ``id`` by ``seq``. No watermark: history never expires."""
    columns = [c for c in snapshots.columns if c != "id"]
    return (
        snapshots.groupBy("id")
        .agg(F.max_by(F.struct(*columns), "seq").alias("_last"))
        .select("id", "_last.*")
    )


def write_updates(folded: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the jobs each batch changed. A replayed batch replaces its own files."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        folded.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )


def current(updates: DataFrame) -> DataFrame:
    """State after the last batch, from the written updates."""
    return (
        updates.groupBy("id")
        .agg(F.max_by(F.struct("*"), F.struct("seq", "batch_id")).alias("_last"))
        .select("_last.*")
        .drop("batch_id")
    )
