"""One Arrow pass over (keys..., text): the shape that most operators here share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill import cluster


def arrow_schema(ddl: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl) if isinstance(ddl, str) else ddl)


#: Bytes in an Arrow batch, where the session still has Spark's default of 64 MiB: a worker holds several batches' worth.
BATCH_BYTES, DEFAULT_BYTES = 4 << 20, 64 << 20


def trim() -> None:
    """Gives freed memory back to the system: workers are kept from task to task, and others need it meanwhile."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, and bounds Arrow batches by bytes.

    The bound is a setting of the session and stays, as results are computed when they are read: spark.sql.execution.arrow.
    maxBytesPerBatch becomes BATCH_BYTES, unless the session has a value of its own. A longer row is a batch by itself.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in (str(DEFAULT_BYTES), f"{DEFAULT_BYTES}b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    cluster.ship(spark)


def map_text(docs: DataFrame, keys: list, make: Callable[[], Callable], ddl: str, text: str = "text") -> DataFrame:
    """docs' key columns and text through make()(keys, texts), which yields columns of ddl; make runs once a task.

    If what make returns has an attribute done, done() yields what is left at the task's end.

    Only the named columns are read, so other columns, whatever their names, do not matter.
    """
    df = docs.select(*[F.col(k) if isinstance(k, str) else k for k in keys], F.col(text).cast("string").alias("__text"))
    schema = arrow_schema(ddl)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()

        def rows(found) -> Iterator[pa.RecordBatch]:
            for got in found:
                yield pa.RecordBatch.from_arrays([to_arrow(c, f.type) for c, f in zip(got, schema, strict=True)], schema=schema)

        for batch in batches:
            n = batch.num_columns - 1
            yield from rows(step([batch.column(i) for i in range(n)], batch.column(n)))
        if hasattr(step, "done"):
            yield from rows(step.done())
        del step
        trim()

    return df.mapInArrow(run, ddl)


def to_arrow(column, kind: pa.DataType) -> pa.Array:
    if isinstance(column, pa.Array):
        return column if column.type == kind else column.cast(kind)
    return pa.array(column, type=kind)


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and row bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, type=kind))
