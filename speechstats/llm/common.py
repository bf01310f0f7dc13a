"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared ``spark.checkpoint.dir``; a local one of our own only in local mode.

    What is written there lives as long as the results read from it may be asked for: the folder is the caller's to empty.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and gives the written table: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives a Python worker's freed memory back to the machine: the next task of the worker may do other work."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def running(items: Column, size: Callable[[Column], Column], block: int = 256) -> Column:
    """array<bigint>: for each item the sum of ``size`` over the items before it.

    Sums run within blocks of items and then over the blocks, so that no long array is copied for each item.
    """
    nothing = F.expr("cast(array() as array<bigint>)")
    start = lambda out: F.struct(F.lit(0).cast("long").alias("at"), out.alias("out"))
    last = F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / block)
    blocks = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: F.slice(items, (k * block + 1).cast("int"), F.lit(block)))
    add = lambda acc, x: F.struct((acc["at"] + size(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    inside = F.transform(blocks, lambda b: F.aggregate(b, start(nothing), add))
    shift = lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(b["out"], lambda x: x + acc["at"]))).alias("out"))
    return F.flatten(F.aggregate(inside, start(F.expr("cast(array() as array<array<bigint>>)")), shift, lambda acc: acc["out"]))


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of the documents that no model may learn from."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string column without nulls; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def runs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold up to ``most`` bytes together; a longer row is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, min(last, n)
        first = last
