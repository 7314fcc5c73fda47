"""What the operators of this subpackage share: tables, the shared folder, files of any store, batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Short rows that a task writes where a table's size is known.
ROWS_A_TASK = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Where that setting is missing and everything runs in one process (local tests), a temporary folder becomes the checkpoint directory.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        held = context._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
        if base is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="chronofold-")
            context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    rows: a bound of its rows, where it is known and the rows are short; then a task writes ROWS_A_TASK of them, so that small tables don't become many files.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    schema = df.schema
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)))
    df.write.parquet(path)
    give_back()
    made = spark.read.schema(schema).parquet(path)
    made.__dict__["_scratch"] = path
    return made


def discard(*tables: DataFrame | None) -> None:
    """Delete what materialize() wrote for these tables; nothing may read them any more."""
    for df in tables:
        path = df.__dict__.pop("_scratch", None) if df is not None else None
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def open_out(folder: str, name: str):
    """(uri, stream) of a new file, through whichever file system the folder's scheme names."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    return f"{folder}/{name}", store.open_output_stream(f"{path}/{name}", compression=None)


def open_in(uri: str):
    """A seekable input file."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of a string or binary column; a longer value stands alone.

    The batches are copies, not slices: pyarrow's ascii_lower misreads the offsets of slices.
    """
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start, n = 0, batch.num_rows
        while start < n:
            held = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, held + most, side="right")))
            yield batch if stop - start == n else batch.take(pa.array(np.arange(start, stop)))
            start = stop


def distinct(x):
    """The sorted distinct elements of an array of numbers, by sorting: less time and memory than numpy.unique's hash table."""
    import numpy as np

    x = np.sort(x)
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def give_back() -> None:
    """Return memory that batches needed to the system; Python workers wait between tasks with what they hold."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library
