"""Token-id files: texts in document order, each shard's ids compressed by Re-Pair, read back whole or one document at a time.

File format: a Parquet folder with one row for each shard.  ``part`` numbers the ordered partitions, ``shard`` the shards
of a partition, ``ids_before`` counts the partition's ids before the shard.  ``doc_ids`` lists the documents;
``symbol_ends`` (little-endian u32) says where each document's symbols end.  ``symbols`` holds the compressed ids: a value
under ``base`` is a token id, another one is rule ``value - base``.  ``rules`` (pairs of symbols) holds the right-hand
sides, ``lengths`` (u32) how many ids each rule stands for.  Symbols take ``width`` bytes: two if the vocabulary leaves room
for ``LEAST_ROOM`` rules below 2**16, else four.  No rule crosses a document's end, so one document, or one token of it, is
decoded from its own symbols alone.

Each round replaces the most frequent pairs of a shard together (up to ``PER_ROUND``, left to right where they overlap),
until no pair occurs ``LEAST`` times or ``MOST`` rules (fewer if the symbols of two bytes run out) are made.  A pair that
gets under three places in a round, since others overlap it, is left for a later one.

Defined results: a null text is empty and has the end id alone; rows are ordered by doc_id (null first), rows with one
doc_id by text, repeated rows stay; an empty table writes no shard; other columns are ignored.  A very long text is a shard
of its own, with its ids in memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, runs, scratch_path, utf8
from .tokens import encoder

BASE, MOST, LEAST, PER_ROUND, SHARD_IDS, LEAST_ROOM = 49408, 1 << 14, 6, 2600, 1 << 20, 1 << 12
SHARDS = "part int, shard int, ids_before bigint, n_ids bigint, base int, width int, doc_ids array<bigint>, symbol_ends binary, symbols binary, rules binary, lengths binary"
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 4]
_BITS = 20


def _width(base: int) -> int:
    return 2 if base + LEAST_ROOM <= 1 << 16 else 4


def compress(ids: np.ndarray, ends: np.ndarray, base: int = BASE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, each document's end in them, rules, lengths) of ids under ``base`` whose documents end at ``ends``."""
    wide = _width(base) == 4
    key, half = (np.uint64, np.uint64(32)) if wide else (np.uint32, np.uint32(16))
    most = MOST if wide else min(MOST, (1 << 16) - base)
    seq, closes = ids.astype(key), np.zeros(len(ids), bool)
    closes[ends[ends > 0] - 1] = True
    rules: list[np.ndarray] = []
    count = 0
    spread = (np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - _BITS)) if wide else (np.uint32(0x9E3779B1), np.uint32(32 - _BITS))
    hashed = lambda x: x * spread[0] >> spread[1]
    while count < most and len(seq) > 1:
        inside = ~closes[:-1]
        keys = seq[:-1] << half | seq[1:]
        ordered = np.sort(keys[inside])
        new = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)])
        times = np.diff(np.r_[new, len(ordered)])
        often = np.flatnonzero(times >= LEAST)
        room = min(PER_ROUND, most - count)
        if len(often) > room:
            often = often[np.argpartition(times[often], -room)[-room:]]
        chosen = ordered[new[often]]
        if not len(chosen):
            break
        # Pairs by bucket; of two in one bucket the second waits for a later round.
        slot, bucket = np.full(1 << _BITS, -1, np.int32), hashed(chosen)
        slot[bucket] = np.arange(len(chosen))
        rule = slot[hashed(keys)]
        at = np.flatnonzero((rule >= 0) & inside)
        rule = rule[at]
        same = chosen[rule] == keys[at]
        at, rule = at[same], rule[same]
        first = np.diff(at, prepend=-2) != 1  # of matches that overlap, every second one
        place = np.arange(len(at))
        even = (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0
        at, rule = at[even], rule[even]
        used = np.bincount(rule, minlength=len(chosen)) >= 3
        at, rule = at[used[rule]], rule[used[rule]]
        if not len(at):
            break
        number = np.cumsum(used) - 1
        seq[at] = (base + count + number[rule]).astype(key)
        closes[at] = closes[at + 1]
        stays = np.ones(len(seq), bool)
        stays[at + 1] = False
        seq, closes = seq[stays], closes[stays]
        rules.append(chosen[used])
        count += int(used.sum())
    pairs = np.concatenate(rules) if rules else np.zeros(0, key)
    symbol = np.uint32 if wide else np.uint16
    pairs = np.stack([pairs >> half, pairs & key((1 << int(half)) - 1)], 1).astype(symbol)
    lengths = [1] * base
    for a, b in pairs.tolist():
        lengths.append(lengths[a] + lengths[b])
    return seq.astype(symbol), np.flatnonzero(closes) + 1, pairs, np.array(lengths[base:], np.int64)


class Shard:
    """Random access to the documents of one shard."""

    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        self.ends = np.frombuffer(row["symbol_ends"], "<u4").astype(np.int64)
        base, kind = row.get("base", BASE), f"<u{row.get('width', 2)}"
        self.symbols = np.frombuffer(row["symbols"], kind).astype(np.int64)
        rules, lengths = np.frombuffer(row["rules"], kind).reshape(-1, 2).tolist(), np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.lengths = np.r_[np.ones(base, np.int64), lengths]
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self.flat = np.zeros(int(self.lengths.sum()), np.uint32)
        self.flat[:base] = np.arange(base)
        starts, sizes = self.starts.tolist(), self.lengths.tolist()
        for k, (a, b) in enumerate(rules, base):
            i, n = starts[k], sizes[a]
            self.flat[i : i + n] = self.flat[starts[a] : starts[a] + n]
            self.flat[i + n : i + sizes[k]] = self.flat[starts[b] : starts[b] + sizes[b]]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.lengths[symbols]
        return self.flat[np.arange(n.sum()) + np.repeat(self.starts[symbols] - np.cumsum(n) + n, n)]

    def document(self, k: int) -> np.ndarray:
        """The ids of the shard's k-th document; nothing else is decoded."""
        return self.expand(self.symbols[self.ends[k - 1] if k else 0 : self.ends[k]])

    def token(self, k: int, i: int) -> int:
        """The i-th id of the k-th document, by the expansion lengths of its symbols."""
        own = self.symbols[self.ends[k - 1] if k else 0 : self.ends[k]]
        after = np.cumsum(self.lengths[own])
        j = int(np.searchsorted(after, i, side="right"))
        return int(self.flat[self.starts[own[j]] + i - (after[j] - self.lengths[own[j]])])

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        ids = self.expand(self.symbols)
        return ids, np.r_[0, np.cumsum(self.lengths[self.symbols])][self.ends]


def write_ids(documents: DataFrame, path: str, tokenizer: str, end: int, shard_ids: int = SHARD_IDS) -> None:
    """Encodes every text and writes the shards, ordered by doc_id over the partitions and within them."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(tokenizer), TaskContext.get().partitionId()
        base = max(own.vocabulary, end + 1)
        shard = before = held = 0
        doc_ids: list = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def cut() -> pa.RecordBatch:
            nonlocal shard, before, held, doc_ids, parts, sizes
            ids, ends = np.concatenate(parts), np.cumsum(np.concatenate(sizes))
            found = [x.astype(x.dtype.newbyteorder("<")) for x in compress(ids, ends, base)]
            symbols, symbol_ends, rules, lengths = found[0].tobytes(), found[1].astype("<u4").tobytes(), found[2].tobytes(), found[3].astype("<u4").tobytes()
            row = [part, shard, before, len(ids), base, _width(base), doc_ids, symbol_ends, symbols, rules, lengths]
            names = [x.split()[0] for x in SHARDS.split(", ")]
            shard, before, held, doc_ids, parts, sizes = shard + 1, before + len(ids), 0, [], [], []
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _KINDS, strict=True)], names)

        for batch in batches:
            offsets, raw = utf8(batch.column(1))
            for i, j in runs(offsets, min(1 << 20, shard_ids)):
                ids, bounds = own.encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end)
                doc_ids += batch.column(0).slice(i, j - i).to_pylist()
                parts.append(ids)
                sizes.append(np.diff(bounds))
                held += len(ids)
                if held >= shard_ids:
                    yield cut()
        if doc_ids:
            yield cut()
        release()

    ordered.mapInArrow(shards, SHARDS).write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Decodes the files: doc_id, start, n_tokens, ids_crc32 of every document."""
    shards = spark.read.schema(SHARDS).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, ends = Shard(row).all()
                data, starts = ids.astype("<u4"), np.r_[0, ends[:-1]]
                crc = [zlib.crc32(data[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(ends), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["ids_before"]), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    ["part", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    docs = shards.mapInArrow(decode, "part int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    # One row for each partition that was written: that few, however large the corpus is.
    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return docs.join(before, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(documents: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    path = scratch_path(documents.sparkSession, "token-ids")
    write_ids(documents, path, tokenizer, end)
    return read_ids(documents.sparkSession, path)
