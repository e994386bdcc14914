"""Bytes of an Arrow string column as numpy arrays, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructField, StructType


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all values and the offsets at which each begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return body, at


def groups(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of up to ``limit`` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def with_results(
    docs: DataFrame,
    keep: Sequence[str],
    inputs: dict[str, Column],
    results: Sequence[StructField],
    work: Callable[..., Sequence[pa.Array]],
    most: int | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the arrays that ``work`` makes of ``inputs``.

    Work gets the arrays of a batch by name. A kept column that has a result's name gives
    way to it. Rows stay where they are, so documents need not be joined to their results.
    Batches of more than about ``most`` bytes are worked on in pieces.
    """
    keep = [c for c in keep if c not in {r.name for r in results}]
    kept = [docs[f"`{c}`"] for c in keep]
    rows = docs.select(*kept, *[c.alias(f"llm_in_{name}") for name, c in inputs.items()])
    names = [*keep, *[r.name for r in results]]
    at = {name: len(keep) + i for i, name in enumerate(inputs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = whole.num_rows
            if most and whole.nbytes > most:
                step = max(1, step * most // whole.nbytes)
            for lo in range(0, max(whole.num_rows, 1), max(step, 1)):
                batch = whole.slice(lo, step)
                found = work(**{name: batch.column(i) for name, i in at.items()})
                columns = [batch.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, *found], names)

    return rows.mapInArrow(run, StructType([*[rows.schema[c] for c in keep], *results]))
