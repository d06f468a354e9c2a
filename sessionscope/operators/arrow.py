"""Arrow batches of bounded size for functions over wide rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over batches of about ``BATCH_BYTES``, however long the rows are; a longer row is a batch of its own.

    Spark's default bounds a batch by its number of rows only, so its memory grows with the length of the texts. The
    session keeps the setting; a smaller one that is set already stays.
    """
    spark = df.sparkSession
    held = spark.conf.get(_BYTES, None)
    if held is None or not held.isdigit() or not 0 < int(held) <= BATCH_BYTES:
        spark.conf.set(_BYTES, str(BATCH_BYTES))
    return df.mapInArrow(f, schema)
