"""Preparing speech corpora: frame features and their statistics, length buckets, batches under a token budget."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ranks import placed

# Fixed value: the gain of 16-bit samples.
GAIN = 10 ** (0.05 * 2 * 20 * math.log10(32767))


def piecewise_log(values: Column, gain: float = GAIN, exclusive: bool = False) -> Column:
    """Per element of x * gain: over e its logarithm; then what is up to e is divided by e.

    In sequence, so a logarithm up to e is divided as well; ``exclusive`` makes the two cases exclude each other.
    """
    e = math.e

    def one(x: Column) -> Column:
        y = x.cast("double") * gain
        if exclusive:
            return F.when(y > e, F.ln(y)).otherwise(y / e)
        return F.when(y > e, F.when(F.ln(y) > e, F.ln(y)).otherwise(F.ln(y) / e)).otherwise(y / e)

    return F.transform(values, one)


def normalize(frames: DataFrame, stats: DataFrame, column: str = "values") -> DataFrame:
    """(x - mean) * invstddev per dimension; ``stats`` is one row of mean and invstddev arrays, so it is broadcast."""
    one = F.broadcast(stats.select("mean", "invstddev").limit(1))
    centred = F.zip_with(column, "mean", lambda x, m: x - m)
    return frames.crossJoin(one).withColumn(column, F.zip_with(centred, "invstddev", lambda x, s: x * s)).drop("mean", "invstddev")


def _partial(frames: DataFrame, column: str, sums, schema: str) -> DataFrame:
    """One row for each dimension of each partition, from arrays summed up where they are; nulls are left out.

    ``sums(old, dim, x)`` adds a batch's values to the arrays held for the partition.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            lists = batch.column(0)
            sizes = np.diff(lists.offsets.to_numpy()) * lists.is_valid().to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            dim, some = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), flat.is_valid().to_numpy(zero_copy_only=False)
            if some.any():
                held = sums(held, dim[some], flat.to_numpy(zero_copy_only=False)[some])
        if held is not None:
            seen = np.flatnonzero(held[0])
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), *(pa.array(h[seen]) for h in held)], names=[c.split()[0] for c in schema.split(", ")])

    return frames.select(F.col(column).cast("array<double>").alias("x")).mapInArrow(add, schema)


def _padded(old: np.ndarray, n: int, value: float = 0) -> np.ndarray:
    return np.concatenate([old, np.full(n - len(old), value, old.dtype)])


def _moments(held, dim: np.ndarray, x: np.ndarray):
    """Counts, means and squared deviations, merged with those held."""
    k = max(int(dim.max()) + 1, 0 if held is None else len(held[0]))
    n = np.bincount(dim, minlength=k)
    mean = np.bincount(dim, x, k) / np.maximum(n, 1)
    m2 = np.bincount(dim, (x - mean[dim]) ** 2, k)
    if held is None:
        return n, mean, m2
    n0, mean0, m20 = (_padded(h, k) for h in held)
    total, apart = n + n0, mean - mean0
    return total, mean0 + apart * n / np.maximum(total, 1), m2 + m20 + apart**2 * n * n0 / np.maximum(total, 1)


def global_stats(frames: DataFrame, column: str = "values") -> DataFrame:
    """dim, mean, invstddev over all frames: moments of each partition, merged behind one small shuffle."""
    part = _partial(frames, column, _moments, "dim int, n bigint, mean double, m2 double")
    both = part.withColumn("all", F.sum(F.col("n") * F.col("mean")).over(Window.partitionBy("dim")) / F.sum("n").over(Window.partitionBy("dim")))
    out = both.groupBy("dim").agg(F.first("all").alias("mean"), F.sqrt(F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("all"), 2)) / F.sum("n")).alias("s"))
    return out.select("dim", "mean", F.try_divide(F.lit(1.0), F.col("s")).alias("invstddev"))


def stats_row(stats: DataFrame) -> DataFrame:
    """The same as one row of arrays."""
    both = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "invstddev"))).alias("s"))
    return both.select(F.col("s.mean").alias("mean"), F.col("s.invstddev").alias("invstddev"))


def _exponents(held, label: np.ndarray, x: np.ndarray):
    """Counts, largest values and sums of exp(x - largest), merged with those held."""
    k = max(int(label.max()) + 1, 0 if held is None else len(held[0]))
    n, top = np.bincount(label, minlength=k), np.full(k, -np.inf)
    np.maximum.at(top, label, x)
    old = (np.zeros(k, np.int64), np.full(k, -np.inf), np.zeros(k)) if held is None else tuple(_padded(h, k, v) for h, v in zip(held, (0, -np.inf, 0), strict=True))
    most = np.maximum(top, old[1])
    base = np.where(np.isfinite(most), most, 0)
    return n + old[0], most, np.bincount(label, np.exp(x - base[label]), k) + old[2] * np.exp(np.where(np.isfinite(old[1]), old[1] - base, 0))


def label_priors(frames: DataFrame, column: str = "log_probs") -> DataFrame:
    """label, log_prior: log of the mean probability over all frames, summed as exp(x - max) in each partition first."""
    part = _partial(frames, column, _exponents, "label int, n bigint, m double, s double")
    both = part.withColumn("top", F.max("m").over(Window.partitionBy("label")))
    sums = both.groupBy("label").agg(F.sum(F.col("s") * F.exp(F.col("m") - F.col("top"))).alias("s"), F.first("top").alias("m"), F.sum("n").alias("n"))
    return sums.select("label", (F.ln("s") + F.col("m") - F.ln("n")).alias("log_prior"))


def utterance_lengths(lines: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds length (characters of the text) to a manifest of ids; ``lines`` holds ``id text`` in column value."""
    p = F.split("value", " ", 2)
    texts = lines.select(F.get(p, F.lit(0)).alias("utt_id"), F.length(F.coalesce(F.get(p, F.lit(1)), F.lit(""))).alias("length"))
    return manifest.join(texts, "utt_id")


def length_buckets(df: DataFrame, n: int, column: str = "length") -> DataFrame:
    """Adds bucket: edges at equal steps from the least to the largest length; a bucket holds its upper edge."""
    if n < 1:
        raise ValueError("n must be positive")
    ends = F.broadcast(df.agg(F.min(column).cast("long").alias("__lo"), F.max(column).cast("long").alias("__hi")))  # one row
    above = (F.col(column) - F.col("__lo")) * (n - 1)
    width = F.col("__hi") - F.col("__lo")
    bucket = F.when(width == 0, 0).when(F.lit(n == 1), F.when(F.col(column) == F.col("__lo"), 0).otherwise(1)).otherwise(F.floor((above + width - 1) / width))
    return df.crossJoin(ends).withColumn("bucket", bucket.cast("long")).drop("__lo", "__hi")


def bucket_order(df: DataFrame, shuffle_seed: int | None = None) -> DataFrame:
    """Rows by bucket, the longest first, ties by pos; with a seed in random order within a bucket."""
    inside = [F.desc("length"), F.col("pos")] if shuffle_seed is None else [F.xxhash64("pos", F.lit(shuffle_seed)), F.col("pos")]
    return df.orderBy("bucket", *inside)


def _cut_runs(runs: pd.DataFrame, keys: list[str], max_tokens: int, batch_size: int | None, strict: bool) -> pd.DataFrame:
    """Of each run of rows of one length: the batch of its first row, how many rows go there, and rows a batch behind it."""
    runs = runs.sort_values(["bucket", "length"], ascending=[True, False])
    most, out = batch_size or 1 << 62, []
    batch = tokens = count = 0
    for n, rows in zip(runs["length"].tolist(), runs["rows"].tolist(), strict=True):
        if n > max_tokens and strict:
            raise ValueError(f"a row of {n} tokens exceeds the budget of {max_tokens}")
        each = max(1, min(most, max_tokens // n if n > 0 else most))
        room = max(0, min(most - count, (max_tokens - tokens) // n if n > 0 else most)) if count else each
        if not room:
            batch, tokens, count, room = batch + 1, 0, 0, each
        out.append((batch, room, each))
        if rows <= room:
            tokens, count = tokens + rows * n, count + rows
        else:
            more = -(-(rows - room) // each)
            batch, count = batch + more, rows - room - (more - 1) * each
            tokens = count * n
    first, room, each = zip(*out, strict=True)
    return runs[[*keys, "bucket", "length"] if "bucket" not in keys else [*keys, "length"]].assign(__first=first, __room=room, __each=each)


def pack_batches(df: DataFrame, max_tokens: int, batch_size: int | None = None, exact: bool = False, split: str = "split", strict: bool = True) -> DataFrame:
    """split, pos, bucket, length, batch: a batch ends before its tokens pass ``max_tokens`` or its rows ``batch_size``.

    Rows go by bucket, the longest first, ties by pos.  By default each bucket starts a new batch and counts its own;
    ``exact`` carries batches over bucket borders.  Rows of one length follow one another, so the cuts are found on the
    counts of lengths (as many rows as there are lengths, not documents), and a row's place in its run gives its batch.
    A row over the budget is an error, or with ``strict=False`` a batch of its own.  Places are found by ranges (see
    ``ranks``), so rows of one length, however many, lie over many tasks.
    """
    keys = [split] if exact else [split, "bucket"]
    rows = df.select(split, "pos", "bucket", "length")
    runs = rows.groupBy(split, "bucket", "length").agg(F.count("*").alias("rows"))
    kind = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (split, "bucket", "length"))
    cuts = runs.groupBy(*keys).applyInPandas(lambda f: _cut_runs(f, keys, max_tokens, batch_size, strict), f"{kind}, __first bigint, __room bigint, __each bigint")
    ranked = placed(rows, [split, "bucket", "length"], [F.col("pos")], "batches").drop("total").withColumnRenamed("place", "__k")
    joined = ranked.join(cuts, [split, "bucket", "length"])
    behind = F.floor((F.col("__k") - F.col("__room")) / F.col("__each")) + 1
    return joined.select(split, "pos", "bucket", "length", (F.col("__first") + F.when(F.col("__k") < F.col("__room"), 0).otherwise(behind)).cast("long").alias("batch"))


def union_splits(**splits: DataFrame) -> DataFrame:
    """All splits in one table with their name in column split."""
    out = None
    for name, df in splits.items():
        own = df.withColumn("split", F.lit(name))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no split given")
    return out
