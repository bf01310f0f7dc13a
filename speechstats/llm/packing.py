"""Best-fit-decreasing packing of tokenised documents into sequences of bounded length.

Documents longer than a sequence are cut into whole sequences, the remainder first.  Pieces are dealt at random into
groups of about ``GROUP`` pieces; each group is packed by itself, the longest piece first into the open sequence that it
fits most tightly.  That sequence is found in a segment tree over remaining capacities, in logarithmic time.  At most
the last few sequences of a group stay open, so grouping costs under one sequence in a thousand.

Defined results: a null or empty text is a piece with the end id alone; repeated rows are packed one by one; of pieces of
one length the one dealt first (in the order of reading) goes first, of sequences with equal room the one left last is
taken; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, runs, stored, utf8
from .tokens import encoder

GROUP, TEXTS = 16384, 1 << 20


class Capacities:
    """Open sequences by remaining room: a segment tree whose nodes say whether any leaf below has one."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.open: list[list[int]] = [[] for _ in range(self.width)]
        self.some = bytearray(2 * self.width)

    def add(self, room: int, number: int) -> None:
        self.open[room].append(number)
        k = room + self.width
        while k and not self.some[k]:
            self.some[k] = 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Takes out the open sequence with the least room that is ``need`` at least: (room, number)."""
        some, k = self.some, need + self.width
        if not some[k]:
            while k > 1 and (k & 1 or not some[k + 1]):  # up, until there is something to the right
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.width:  # down, as far left as it goes
                k = 2 * k if some[2 * k] else 2 * k + 1
        room = k - self.width
        number = self.open[room].pop()
        if not self.open[room]:
            some[k] = 0
            k >>= 1
            while k and not some[2 * k] and not some[2 * k + 1]:
                some[k] = 0
                k >>= 1
        return room, number


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, offset there) of every piece."""
    numbers, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms, used, sizes = Capacities(capacity), 0, lengths.tolist()
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = sizes[k]
        if (found := rooms.take(need)) is None:
            room, number = capacity, used
            used += 1
        else:
            room, number = found
        numbers[k], offsets[k] = number, capacity - room
        if room > need:
            rooms.add(room - need, number)
    return numbers, offsets


def pieces(documents: DataFrame, tokenizer: str, end: int = 0, capacity: int = 2048, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and salt, which deals pieces into groups.

    ``with_ids`` adds ids (little-endian u32).  About ``TEXTS`` bytes of texts, or one longer text, are held at once.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt", *(["ids"] if with_ids else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, salt = encoder(tokenizer).encode, TaskContext.get().partitionId() << 40
        for batch in batches:
            at, raw = utf8(batch.column(1))
            for i, j in runs(at, TEXTS):
                ids, bounds = encode(raw[at[i] : at[j]], at[i : j + 1] - at[i], end)
                sizes = np.diff(bounds)
                n = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                rest = (sizes - (n - 1) * capacity)[doc]  # the first piece's length
                start = np.where(piece == 0, 0, rest + (piece - 1) * capacity)
                length = np.where(piece == 0, rest, capacity)
                data = ids.astype("<u4")
                begin = (bounds[doc] + start).tolist()
                own = [data[a : a + m] for a, m in zip(begin, length.tolist(), strict=True)]
                columns = [batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(np.arange(salt, salt + len(doc)))]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array([x.tobytes() for x in own], pa.binary())] if with_ids else [])], names)
                salt += len(doc)
        encoder(tokenizer).clear()  # later tasks of this worker may need the memory for other work
        release()

    return docs.mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, salt bigint" + (", ids binary" if with_ids else ""))


def pack(parts: DataFrame, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of at most ``capacity`` and a ``salt``; reads ``parts`` twice."""
    groups = max(1, -(-parts.count() // group))
    names = [x for x in parts.columns if x != "salt"]
    dealt = parts.withColumn("group_no", F.pmod(F.xxhash64("salt"), F.lit(groups)))
    schema = ", ".join([*(f"`{x}` {parts.schema[x].dataType.simpleString()}" for x in names), "sequence_id bigint", "offset bigint"])

    def place(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("salt")
        numbers, offsets = best_fit_decreasing(frame["length"].to_numpy(np.int64), capacity)
        return frame[names].assign(sequence_id=(int(key[0]) << 32) + numbers, offset=offsets)

    return dealt.groupBy("group_no").applyInPandas(place, schema)


def pack_documents(documents: DataFrame, tokenizer: str, end: int = 0, capacity: int = 2048) -> DataFrame:
    """Where every piece goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stored(pieces(documents, tokenizer, end, capacity, with_ids=False), "pieces"), capacity)


def sequences(documents: DataFrame, tokenizer: str, end: int = 0, capacity: int = 2048) -> DataFrame:
    """The packed sequences themselves: sequence_id, doc_ids in order, ids (little-endian u32)."""
    packed = pack(stored(pieces(documents, tokenizer, end, capacity), "pieces"), capacity)
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    ordered = packed.groupBy("sequence_id").agg(inside.alias("p"))
    return ordered.select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
