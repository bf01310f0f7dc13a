"""Nearest neighbours by a permutation index.

``PIVOTS`` pivots are drawn from a bounded sample of the vectors.  A vector is represented by its ``PREFIX`` nearest
pivots in order.  The index is a table of blocks of up to ``ROWS`` vectors; a block holds its vectors and, for every
pivot, an inverted file: the vectors that have the pivot among their nearest, and at which position.

A search takes queries in batches of up to ``QUERIES`` (what is broadcast is bounded; more queries are more passes over
the index).  Within a block a query reads the inverted files of its own pivots only, about PREFIX**2 / PIVOTS entries a
vector, sums up the footrule distance (a pivot that only one of both has counts as if it came next after the prefix), and
reranks the ``share`` of the block with the smallest footrule, ``least`` vectors at least, by exact distance in double
precision.  Each block gives its nearest, the nearest of all are merged.  Vectors that tie in the footrule at that place are
all reranked, so copies are never lost; ``share=1`` reranks everything, which is exact search.

Defined results: a vector that is null, zero, or holds a null or non-finite component takes no part, nor does one whose
length differs from the most frequent length, or a null id; repeated rows are candidates of their own, equal distances go to the smaller id; a query's own id
is never its neighbour; a query row given twice is one query, and where different vectors share a query's id its neighbours are those
nearest to any of them, each row once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

PIVOTS, PREFIX, SAMPLE, ROWS, QUERIES, SHARE, LEAST = 256, 32, 4096, 8192, 8192, 0.15, 64
BLOCKS = "dimension int, ids binary, vectors binary, ends binary, members binary, positions binary"


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id and vector (array<double>) of the rows that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vector")).filter("id is not null and vector is not null")
    good = rows.filter(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0))
    size = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.filter(F.size("vector") == (size.n if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Pivots far from one another: k-means++ seeding over a bounded sample (smallest hashes of the ids)."""
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # up to ``sample`` vectors
    if not drawn:
        return np.zeros((0, 1))
    x = np.unique(np.array([r.vector for r in drawn], float).reshape(len(drawn), -1), axis=0)
    if len(x) <= pivots:
        return x
    rng = np.random.default_rng(4)
    chosen = [int(rng.integers(len(x)))]
    gap = ((x - x[chosen[0]]) ** 2).sum(1)
    for _ in range(pivots - 1):
        chosen.append(int(rng.choice(len(x), p=gap / gap.sum())))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
        if not gap.any():
            break
    return x[chosen]


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """Each vector's nearest pivots, in order."""
    if not len(pivots):
        return np.zeros((len(x), 0), np.int64)
    return np.argsort(((pivots**2).sum(1) - 2 * x @ pivots.T), axis=1, kind="stable")[:, :prefix]


def inverted_files(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pivot's end in the entries, and the entries: members (rows of ``x``) and positions."""
    near = nearest_pivots(x, pivots)
    pivot, member = near.ravel(), np.repeat(np.arange(len(x)), near.shape[1])
    order = np.argsort(pivot, kind="stable")
    return np.cumsum(np.bincount(pivot, minlength=len(pivots))), member[order], np.tile(np.arange(near.shape[1]), len(x))[order]


def build_index(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """One row for each block: ids, vectors, and the inverted files one after another."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cut() -> pa.RecordBatch:
            ids = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held])
            x = np.concatenate([_matrix(b.column(1)) for b in held])
            ends, members, positions = inverted_files(x, shared.value)
            held.clear()
            row = [x.shape[1], ids.astype("<i8").tobytes(), x.astype("<f8").tobytes(), ends.astype("<u4").tobytes(), members.astype("<u2").tobytes(), positions.astype("u1").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if k else pa.int32()) for k, v in enumerate(row)], [c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                if sum(b.num_rows for b in held) + some.num_rows > ROWS:
                    yield cut()
                held.append(some)
        if any(b.num_rows for b in held):
            yield cut()

    return rows.mapInArrow(blocks, BLOCKS)


def _near(block: dict, query_ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, share: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of each query's nearest in one block."""
    ids, d = np.frombuffer(block["ids"], "<i8"), block["dimension"]
    x = np.frombuffer(block["vectors"], "<f8").reshape(len(ids), d)
    ends, members, positions = np.frombuffer(block["ends"], "<u4").astype(np.int64), np.frombuffer(block["members"], "<u2"), np.frombuffer(block["positions"], np.uint8)
    starts, prefix = np.r_[0, ends[:-1]], own.shape[1]
    take = min(len(ids), max(least, k + 1, int(share * len(ids))))
    out: list[list[np.ndarray]] = [[], [], [], []]
    for q in range(len(queries)):
        # The footrule of two prefixes is a constant less what each shared pivot takes off.
        sizes = (ends - starts)[own[q]]
        at = np.arange(sizes.sum()) + np.repeat(starts[own[q]] - np.cumsum(sizes) + sizes, sizes)
        mine, theirs = np.repeat(np.arange(prefix), sizes), positions[at].astype(np.int64)
        close = np.bincount(members[at], 2 * (prefix - np.maximum(mine, theirs)), len(ids))
        some = np.flatnonzero(close >= np.partition(close, len(ids) - take)[len(ids) - take])
        some = some[ids[some] != query_ids[q]]
        distance = np.sqrt(((x[some] - queries[q]) ** 2).sum(1))
        best = np.lexsort((ids[some], distance))[:k]
        out[0].append(np.full(len(best), query_ids[q]))
        out[1].append(ids[some][best])
        out[2].append(distance[best])
        out[3].append(some[best])
    query, found, distance, row = (np.concatenate([*v, np.zeros(0)]) for v in out)
    # Vectors of one query id may find the same row: the nearest counts.
    order = np.lexsort((distance, row, query))
    query, found, distance, row = (v[order] for v in (query, found, distance, row))
    new = np.ones(len(order), bool)
    new[1:] = (query[1:] != query[:-1]) | (row[1:] != row[:-1])
    return query[new], found[new], distance[new]


def search(rows: DataFrame, queries: DataFrame, k: int = 10, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found among ``rows`` of each row of ``queries`` (both id, vector)."""
    spark = rows.sparkSession
    pivots = choose_pivots(rows)
    index = stored(build_index(rows, pivots), "index")
    wanted = stored(queries.select("id", "vector").distinct(), "queries")
    batches = max(1, -(-wanted.count() // QUERIES))
    found = None
    for part in range(batches):
        own = wanted.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(batches)) == part).orderBy("id").collect()  # about ``QUERIES``
        if not own:
            continue
        ids = np.array([r.id for r in own])
        x = np.array([r.vector for r in own], float).reshape(len(own), -1)
        shared = spark.sparkContext.broadcast((ids, x, nearest_pivots(x, pivots)))

        def scan(blocks: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in blocks:
                for block in batch.to_pylist():
                    q, v, s = _near(block, *shared.value, k, share, least)
                    yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(s.astype(float))], ["query_id", "vec_id", "score"])

        some = index.mapInArrow(scan, "query_id bigint, vec_id bigint, score double")
        found = some if found is None else found.union(some)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, every: int = 100, k: int = 10, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """Searches the rows whose id is divisible by ``every`` among all others."""
    rows = usable(vectors)
    return search(rows, rows.filter(F.col("id") % every == 0), k, share, least)
