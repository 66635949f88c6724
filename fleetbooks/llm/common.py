"""Column buffers as numpy arrays, tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that one numpy step works on; a longer text is a step of its own.
CHUNK = 400_000


# Bytes of a batch that goes to Python. Spark's own limits, 64 MB and 10,000 rows, let
# batches of texts take hundreds of MB of a worker.
BATCH_KEY, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that go to Python, unless the session says how large they are."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, BATCH)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    Only on a local master may it be unset, as in tests: a folder of this machine
    stands in and is put into the session, for the operators that follow.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors see")
        folder = f"file://{tempfile.mkdtemp(prefix='llm-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


# Tables that this driver has written and not removed.
_tables: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends, lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession) -> int:
    """Removes all tables that ``written`` has made since the driver began, or since the last call.

    To be called when results have been written elsewhere or collected: a lazy result may still read
    these tables. Returns how many there were.
    """
    conf, gone = spark._jsc.hadoopConfiguration(), len(_tables)
    while _tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(_tables.pop())
        path.getFileSystem(conf).delete(path, True)
    return gone


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows end to end (text as UTF-8), and the n + 1 places where rows begin."""
    if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type):
        array = pc.fill_null(array.cast(pa.large_binary()), b"")
    else:
        array = pc.fill_null(array.cast(pa.large_string()), "")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, starts, data = array.buffers()
    starts = np.frombuffer(starts, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def chunks(starts: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``size`` bytes, or one row."""
    low, n = 0, len(starts) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + size, "right")) - 1)
        yield low, high
        low = high


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places starts[i] .. starts[i] + lengths[i] - 1, for all i one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A string column from its bytes; what is not UTF-8 becomes U+FFFD."""
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    made = pa.Array.from_buffers(
        pa.large_binary(), len(lengths), [None, pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(data))]
    )
    try:
        return made.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.as_py().decode("utf-8", "replace") for x in made], pa.string())


def lists(values: np.ndarray | pa.Array, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blob_bytes(df: DataFrame, *names: str) -> int:
    """Measured size of some columns, for a check before a broadcast."""
    size = sum((F.coalesce(F.length(F.col(c).cast("binary")), F.lit(0)) for c in names), F.lit(8))
    return int(df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"])
