"""Near-duplicate documents by an LSH forest over MinHash signatures, every link confirmed on the full shingle sets.

1. Each text gives its set of word shingles, a 128-bit key of the set and 125 MinHash values.  Texts with one set are
   one class with the smallest doc_id as its representative; only representatives go on.
2. The forest has 25 trees.  A tree sorts signatures by its own order of the values; five of them make a region's
   prefix, eight more bytes the label below.  Two sets of similarity 0.8 miss each other in all trees once in 20,000.
3. Round one takes few candidates: within a region, each set's neighbour in sorted order (the longest common prefix),
   the first set of its sub-region (regions over ``CROWD`` sets are cut at the depth where they hold no more), and the
   region's centre, the set that has most company over all trees.  Of these a set keeps its two likeliest.
4. Confirmed links give components.  Round two is the exact rest: in a region that still holds several components,
   every set outside the largest one meets every set of another component, block by block.  Nothing is capped there.

Defined results: null text or no words: an empty set, linked with nothing.  Repeated rows and rows with one doc_id are
one document; ``deduplicate`` keeps all rows of a doc_id that stands for several different sets, so that no text is lost.
A null doc_id has no links and is kept.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stored, utf8
from .graph import components
from .shingles import MinHash, mix, shingle_sets

TREES, DEPTH, TAIL, CROWD = 25, 5, 8, 32
VALUES = TREES * DEPTH
#: Estimates under this (five standard errors below 0.8) cannot be links.
LIKELY = 0.62


def _trees() -> tuple[np.ndarray, np.ndarray]:
    """Which values make each tree's prefix and which its label; the prefixes share no value."""
    rng = np.random.default_rng(5)
    prefix = rng.permutation(VALUES).reshape(TREES, DEPTH)
    tail = np.stack([rng.permutation(np.setdiff1d(np.arange(VALUES), own))[:TAIL] for own in prefix])
    return prefix, tail


def signatures(documents: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, set_key, signature of every row."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(VALUES)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                offsets, raw = utf8(some.column(1))
                sizes, keys, signs = [], [], []
                for own in shingle_sets(raw, offsets, n):
                    sizes.append(len(own))
                    keys.append(hashlib.md5(own.tobytes()).digest())
                    signs.append(minhash(own).tobytes() if len(own) else None)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], ["doc_id", "n_shingles", "set_key", "signature"])
        release()

    return docs.mapInArrow(sign, "doc_id bigint, n_shingles bigint, set_key binary, signature binary")


def forest(sets: DataFrame) -> DataFrame:
    """region, label, rep: each representative's place in every tree."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, tail = _trees()
        seeds = mix(np.arange(1, TREES + 1, dtype=np.uint64))
        shifts = np.uint64(8) * np.arange(TAIL - 1, -1, -1, dtype=np.uint64)
        for batch in batches:
            rep = batch.column(0).to_numpy(zero_copy_only=False)
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, VALUES).astype(np.uint64)
            region = np.tile(seeds, (len(rep), 1))
            for k in range(DEPTH):
                region = mix(region + values[:, prefix[:, k]])
            label = ((values[:, tail] & np.uint64(255)) << shifts).sum(axis=2, dtype=np.uint64)
            label ^= np.uint64(1 << 63)  # signed order is the order of the bytes
            yield pa.RecordBatch.from_arrays([pa.array(region.ravel().view(np.int64)), pa.array(label.ravel().view(np.int64)), pa.array(np.repeat(rep, TREES))], ["region", "label", "rep"])

    return sets.select("rep", "signature").mapInArrow(place, "region bigint, label bigint, rep bigint")


def _neighbours(members: DataFrame) -> DataFrame:
    """a, b: neighbours in the sorted orders, and the first sets of sub-regions."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = members.select("region", "label", "rep").repartitionByRange(parts, "region", "label", "rep").sortWithinPartitions("region", "label", "rep")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region, label, rep = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(rep):
                continue
            same = np.r_[False, region[1:] == region[:-1]]
            apart = np.r_[np.uint64(0), label.view(np.uint64)[1:] ^ label.view(np.uint64)[:-1]]
            depth = np.full(len(rep), -1)  # of the prefix that a set shares with the one before it, in label bytes
            for d in range(TAIL + 1):
                depth[same & (apart >> np.uint64(8 * (TAIL - d)) == 0 if d else same)] = d
            head = np.arange(len(rep))
            open_ = np.ones(len(rep), bool)
            for d in range(TAIL + 1):  # the shallowest sub-region without a crowd, else the deepest
                first = np.maximum.accumulate(np.where(depth < d, np.arange(len(rep)), 0))
                size = np.bincount(first, minlength=len(rep))[first]
                head[open_] = first[open_]
                open_ &= size > CROWD
            before = np.maximum(np.arange(len(rep)) - same, 0)
            a, b = np.r_[rep, rep], np.r_[rep[before], rep[head]]
            some = a != b
            yield pa.RecordBatch.from_arrays([pa.array(a[some]), pa.array(b[some])], ["a", "b"])

    return ordered.mapInArrow(pair, "a bigint, b bigint")


def _likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a < b with their estimated similarity, where set sizes and estimate allow a link."""
    both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    own = sets.select("rep", "n_shingles", "signature")
    joined = both.join(own.toDF("a", "n_a", "s_a"), "a").join(own.toDF("b", "n_b", "s_b"), "b")
    joined = joined.filter("100 * least(n_a, n_b) >= 80 * greatest(n_a, n_b)").select("a", "b", "s_a", "s_b")

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, VALUES) for k in (2, 3))
            likeness = (x == y).mean(axis=1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(likeness)], ["a", "b", "likeness"])

    return joined.mapInArrow(estimate, "a bigint, b bigint, likeness double").filter(F.col("likeness") >= LIKELY)


def _full_sets(ids: DataFrame, documents: DataFrame, n: int) -> DataFrame:
    """rep, shingles (sorted hashes) of the representatives in ``ids``."""
    texts = documents.select(F.col("doc_id").cast("long").alias("rep"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(ids, "rep", "left_semi")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                offsets, raw = utf8(some.column(1))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([x.tobytes() for x in shingle_sets(raw, offsets, n)], pa.binary())], ["rep", "shingles"])
        release()

    return texts.mapInArrow(shingle, "rep bigint, shingles binary")


def _views(column: pa.Array) -> list[np.ndarray]:
    offsets, raw = utf8(column)
    values, at = np.frombuffer(raw.tobytes(), np.uint64), offsets // 8
    return [values[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have ``100 * intersection >= percent * union``."""
    joined = pairs.select("a", "b").join(full.toDF("a", "x"), "a").join(full.toDF("b", "y"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(_views(batch.column(2)), _views(batch.column(3)), strict=True):
                both = np.sort(np.concatenate([p, q]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return joined.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint").distinct()


def _rest(label: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """a, b: the links between components that meet in a region, one for each set and component at least.

    ``label``: region, rep, c (component).  The sets outside a region's largest component meet all its sets block by
    block: up to about 128 of them with 512 others in a group, so that a set travels once for each block, not once for
    each pair, and only confirmed links leave a group.
    """
    several = label.groupBy("region", "c").agg(F.count("*").alias("n"))
    regions = several.groupBy("region").agg(F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("n"), F.count("*").alias("k")).filter("k > 1")
    regions = regions.select("region", F.col("m.c").alias("main"), F.ceil((F.col("n") - F.col("m.n")) / 128).alias("rows"), F.ceil(F.col("n") / 512).alias("columns"))
    open_ = label.join(regions, "region")
    part = lambda n: F.pmod(F.xxhash64("rep", F.lit(9)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    few = open_.filter("c <> main").select("region", "rep", "c", part("rows").alias("i"), every("columns").alias("j"), F.lit(0).alias("side"))
    all_ = open_.select("region", "rep", "c", every("rows").alias("i"), part("columns").alias("j"), F.lit(1).alias("side"))
    sets = few.union(all_).withColumn("group_no", F.xxhash64("region", "i", "j")).join(full, "rep")
    parts = int(full.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sets.select("group_no", "side", "rep", "c", "shingles").repartition(parts, "group_no").sortWithinPartitions("group_no", "side")

    def meet(side: np.ndarray, rep: np.ndarray, c: np.ndarray, own: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        split = int(np.searchsorted(side, 1))
        if not 0 < split < len(own):
            return
        values, place = np.unique(np.concatenate(own[split:]), return_inverse=True)
        sizes = np.array([len(x) for x in own])
        starts = np.r_[0, np.cumsum(sizes[split:])[:-1]]
        mark = np.zeros(len(values), np.int32)
        for k in range(split):
            at = np.searchsorted(values, own[k])
            at = at[values[np.minimum(at, len(values) - 1)] == own[k]] if len(at) else at
            mark[at] = 1
            common = np.add.reduceat(mark[place], starts)
            mark[at] = 0
            hit = np.flatnonzero((100 * common >= percent * (sizes[split:] + sizes[k] - common)) & (c[split:] != c[k])) + split
            for j in hit[np.unique(c[hit], return_index=True)[1]]:
                yield int(rep[k]), int(rep[j])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compare(rows: pa.Table) -> pa.RecordBatch:
            group, side, rep, c = (rows.column(k).to_numpy() for k in range(4))
            own, links = _views(rows.column(4)), []
            bounds = np.r_[np.flatnonzero(np.diff(group, prepend=group[0] - 1 if len(group) else 0)), len(group)]
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                links += meet(side[a:b], rep[a:b], c[a:b], own[a:b])
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(0).to_numpy()
            last = int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
            if last or (held and held[-1].column(0)[0].as_py() != int(group[0])):
                yield compare(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield compare(pa.Table.from_batches(held))

    return dealt.mapInArrow(groups, "a bigint, b bigint").distinct()


def _classes(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, set_key of every row."""
    rows = stored(signatures(documents, n), "signatures")
    full = rows.filter("n_shingles > 0 and doc_id is not null")
    sets = full.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "signature")).alias("r"))
    sets = stored(sets.select("set_key", F.col("r.doc_id").alias("rep"), "r.n_shingles", "r.signature"), "sets")

    places = forest(sets)
    crowded = places.groupBy("region").agg(F.count("*").alias("company")).filter("company > 1")
    members = stored(places.join(crowded, "region"), "regions")
    company = members.groupBy("rep").agg(F.sum("company").alias("known"))
    known = stored(members.join(company, "rep").select("region", "label", "rep", "known"), "members")
    centre = known.groupBy("region").agg(F.max(F.struct("known", (-F.col("rep")).alias("rep"))).alias("c")).select("region", (-F.col("c.rep")).alias("b"))
    stars = known.join(centre, "region").filter("rep <> b").select(F.col("rep").alias("a"), "b")

    likely = stored(_likely(_neighbours(known).union(stars), sets), "likely")
    each = likely.select(F.col("a").alias("of"), "a", "b", "likeness").union(likely.select(F.col("b"), "a", "b", "likeness"))
    best = each.withColumn("k", F.row_number().over(Window.partitionBy("of").orderBy(F.desc("likeness"), "a", "b"))).filter("k <= 2")
    full = stored(_full_sets(company.select("rep"), documents, n), "full")
    links = stored(_confirmed(best.select("a", "b").distinct(), full, percent), "links")
    found = components(links)

    label = known.join(found.toDF("rep", "c"), "rep", "left").select("region", "rep", F.coalesce("c", "rep").alias("c"))
    more = stored(_rest(label, full, percent), "links")
    found = components(links.union(more)) if not more.isEmpty() else found

    result = rows.join(sets.select("set_key", "rep"), "set_key", "left").join(found.toDF("rep", "c"), "rep", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("c", "rep")).otherwise(F.col("doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "set_key")


def near_duplicates(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept, of every row."""
    return _classes(documents, n, percent).drop("set_key")


def deduplicate(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that a kept one stands for."""
    # A doc_id with several sets may join their groups; as its rows all stay, each group still has a text.
    own = _classes(documents, n, percent).groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), (F.min("set_key") == F.max("set_key")).alias("one"))
    gone = own.filter("not kept and one").select("doc_id")
    return documents.join(gone, "doc_id", "left_anti").select(documents.columns)
