"""The folder that driver and executors share, and how tasks take Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes of the slice of an Arrow batch that is held as Python objects at a time.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut to slices of so many rows, and of so many bytes, at most; a longer row is a slice of its own. Spark's batches have
    thousands of rows of any length, which take many times their size as Python objects: their number, not the input, bounds a worker."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = min(rows, b.num_rows - at)
            while n > 1 and b.slice(at, n).nbytes > size:
                n = (n + 1) // 2
            yield b.slice(at, n)
            at += n


def settled(df: DataFrame) -> DataFrame:
    """df as a table in the folder that ``spark.checkpoint.dir`` names, read again; df itself where the session names none.

    The table is worked out once, and its readers take the columns that they need. The planner takes the size of its files for that of its rows;
    these are many times larger in memory, so it would have the driver collect and broadcast tables that grow with the input. Hence the
    hint: what is settled meets other tables by merge joins, whose keys (the novel) are dealt out once for all of them. Tables of a
    bounded size that are broadcast by name still are.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        return df
    at = f"{folder}/settled-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at).hint("merge")
