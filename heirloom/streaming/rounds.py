"""Closing rounds of sessions as their messages arrive.

Keyed state is the one thing here that built-in operators cannot express: a round
ends when the next one begins, or when its session stays silent.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from heirloom.operators.messages import starts_round

OUTPUT = "session_id DECIMAL(20,0), turn_index INT, first_seq BIGINT, messages BIGINT, reason STRING"
ClosedRound = Row("session_id", "turn_index", "first_seq", "messages", "reason")
STATE = "turn_index INT, first_seq BIGINT, messages BIGINT"


class RoundCloser(StatefulProcessor):
    """Holds one small record per session: the round that is still open."""

    def __init__(self, timeout_ms: int) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.open.get() if self.open.exists() else None
        turn, first, count = held if held else (0, None, 0)
        for r in sorted(rows, key=lambda m: m.seq):
            if r.opens and count:
                yield ClosedRound(key[0], turn, first, count, "next_round")
                turn, first, count = turn + 1, None, 0
            if r.ends:
                if count:
                    yield ClosedRound(key[0], turn, first, count, "end")
                turn, first, count = turn + 1, None, 0
                continue
            first = r.seq if first is None else first
            count += 1
        self.open.update((turn, first, count))
        if self.timeout_ms:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(
                timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
            )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.open.exists():
            turn, first, count = self.open.get()
            if count:
                yield ClosedRound(key[0], turn, first, count, "timeout")
            self.open.update((turn + 1, None, 0))

    def close(self) -> None:
        pass


def close_rounds(messages: DataFrame, timeout_ms: int = 0) -> DataFrame:
    """Closed rounds from a stream of decoded messages with ``session_id, seq, role, blocks``.

    A row whose column ``ends`` is true says that its session is complete; it closes the
    round that is open and counts as no message.

    Messages of a session have to arrive in order across batches, as they do when
    its file is shipped piece by piece; inside a batch any order will do.

    Only a flag per message enters the state operator; text stays in the stream's
    source and is joined by ``(session_id, turn)`` when a round is used. With a
    timeout the query keeps running to watch the clock, so it needs an interval
    trigger; without one it can run to the end of what has arrived.
    """
    # Ship the processor itself: executors need not have this package installed.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    narrow = messages.where(F.col("role").isNotNull()).select(
        "session_id",
        "seq",
        starts_round(F.col("role"), F.col("blocks")).alias("opens"),
        (F.coalesce("ends", F.lit(False)) if "ends" in messages.columns else F.lit(False)).alias("ends"),
    )
    return narrow.groupBy("session_id").transformWithState(
        statefulProcessor=RoundCloser(timeout_ms),
        outputStructType=OUTPUT,
        outputMode="append",
        timeMode="ProcessingTime" if timeout_ms else "None",
    )


def write_closed(closed: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return (
        closed.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
