"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``; where that is unset one of our own, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` there and gives the written table: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def by_recording(spark: SparkSession, tasks: int = 0) -> Iterator[None]:
    """Jobs that run inside join on a recording's id and a place within it without moving rows that are together by the id alone.

    A recording's rows fit a task, as every window on ``utt_id`` needs; so one exchange of each table serves all windows,
    aggregates and joins.  Nothing is broadcast: words and frames are many times the table that Spark's estimate knows of.
    ``tasks``: the least number of shuffle partitions, for a number that grows with the input; adaptive execution merges small ones.
    Plans are made when jobs run: write the result (``stored``) before leaving.
    """
    own = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        own["spark.sql.shuffle.partitions"] = str(tasks)
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
