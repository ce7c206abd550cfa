"""Python functions of single rows, over Arrow batches, in a room that the size of a batch does not set.

Spark hands over up to 10,000 rows at once, whatever they hold. Here a batch has BATCH bytes, and only a piece
of it at a time becomes Python objects; what comes of a piece goes back before the next one begins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that Spark hands to Python at once.
BATCH = "8m"
#: Bytes of texts, and rows, that are Python objects at once.
PIECE, ROWS = 1 << 18, 1024


def small_batches(spark: SparkSession) -> None:
    """Bound the batches of this session by bytes, not by rows alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def pieces(columns: tuple[pa.Array, ...]) -> Iterator[list[list]]:
    """The columns' values in turn, a piece at a time: ROWS at most, of PIECE bytes in the first column or a single one."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(columns[0]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(ends):
        held = ends[lo - 1] if lo else 0
        hi = min(max(int(np.searchsorted(ends, held + PIECE, "right")), lo + 1), lo + ROWS)
        yield [c.slice(lo, hi - lo).to_pylist() for c in columns]
        lo = hi


def mapped(make: Callable[[], Callable], of: pa.DataType, *columns: Column, returns: str) -> Column:
    """What the function that make() gives, once a task, says of each row's values; the first column is a text."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        one = make()
        for batch in batches:
            for piece in pieces(batch):
                yield pa.array([one(*row) for row in zip(*piece, strict=True)], of)

    return F.arrow_udf(run, returns)(*columns)
