"""Rows dealt to tasks by size; places in a total order, found without a task, a group or the driver that holds all rows of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored


def placed(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "places") -> DataFrame:
    """``rows`` with place (from 0, within ``keys`` by ``order``, nulls first) and total (rows of the same keys).

    Rows are dealt by ranges of keys and order together, sorted and written: a key with a third of all rows lies over
    many tasks.  A row's number within its written partition, and the counts of each key in the partitions before, give its
    place.  Only those counts meet in a window (a row for each key and partition it lies in).  Rows that tie in ``order``
    get different places; name enough columns where that matters.
    """
    sort = [*(F.col(k).asc_nulls_first() for k in keys), *order]
    dealt = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    written = stored(dealt.withColumn("__id", F.monotonically_increasing_id()), name).withColumn("__part", F.shiftright("__id", 33))
    counts = written.groupBy("__part", *keys).agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    own = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__n").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("__part").alias("__p"), *(F.col(k).alias(f"__{k}") for k in keys), "__first", before.alias("__before"), F.sum("__n").over(own).alias("total"))
    same = F.col("__part") == F.col("__p")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = written.join(counts, same)
    return out.select(*rows.columns, (F.col("__id") - F.col("__first") + F.col("__before")).alias("place"), "total")


def tasks_for(rows: DataFrame, weight: Column, each: int) -> int:
    """How many tasks hold about ``each`` of ``weight``."""
    return max(2, -(-int(rows.agg(F.sum(weight)).first()[0] or 0) // each))


def by_size(rows: DataFrame, key: str, weight: Column, each: int) -> DataFrame:
    """``rows`` with those of a key together, in as many partitions as hold about ``each`` of ``weight``.

    Adaptive execution sizes partitions by the bytes that are shuffled, which say nothing of what is made of the rows behind
    the shuffle.  These partitions do not grow with the input and are not merged; their number does grow with it.
    """
    return rows.repartition(tasks_for(rows, weight, each), key)
