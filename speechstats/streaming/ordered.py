"""Stateful processing of rows that arrive in any order, on ``transformWithState``."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: The state store that timers and list state need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_OWN = "next bigint, lowest bigint, newest bigint, timer bigint"
#: Rows that a task puts together by key before they are shuffled; a task may have any number of such lots.
LOT = 1 << 20
#: The most rows of one packed value, so that a batch of values has a size.
PIECE = 1 << 14
#: Settings for streams of many narrow rows: below the largest byte limit Spark adds up a batch's bytes again for each row, which
#: took 80 % of the time to hand frames to Python.  Batches are bounded by their rows, and packed values by ``PIECE``.
NARROW = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2**31 - 1), "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
#: Bytes of packed waiting rows up to which they lie beside a key's memory, and not in list state of their own.
INLINE = 1 << 16
#: Columns of some rows of a key, by name.
Rows = dict[str, np.ndarray]


def packed(columns: Iterable[np.ndarray]) -> bytes:
    """Arrays as bytes: whole numbers as differences of the narrowest kind, flags as bits, compressed together."""
    out = []
    for a in columns:
        if a.dtype == np.int64 and len(a):
            steps = np.diff(a)
            lo, hi = (int(steps.min()), int(steps.max())) if len(steps) else (0, 0)
            kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= lo and hi <= np.iinfo(k).max)
            out.append(("steps", int(a[0]), steps.astype(kind)))
        elif a.dtype == np.bool_:
            out.append(("bits", len(a), np.packbits(a)))
        else:
            out.append(("", 0, a))
    return zlib.compress(pickle.dumps(out, protocol=5), 1)


def unpacked(data: bytes) -> list[np.ndarray]:
    """The arrays that ``packed`` was given."""
    out = []
    for how, n, a in pickle.loads(zlib.decompress(data)):
        if how == "steps":
            a = np.cumsum(np.concatenate([np.array([n], np.int64), a]), dtype=np.int64)
        elif how == "bits":
            a = np.unpackbits(a, count=n).astype(bool)
        out.append(a)
    return out


def pack_by_key(rows: DataFrame, place: str, fields: list[str]) -> DataFrame:
    """utt_id, rows, newest: what a task holds of a key, as packed values (one for each lot and piece), and their newest event_ms if that is a field.

    So the watermark, the shuffle and the state behind it handle few rows and a small part of the bytes.
    """
    timed = "event_ms" in fields

    def lot(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        column = lambda c: pa.concat_arrays([b.column(c) for b in batches])
        keys = column("utt_id").dictionary_encode(null_encoding="encode")
        codes, held = keys.indices.to_numpy(zero_copy_only=False), [column(c).to_numpy(zero_copy_only=False) for c in fields]
        order = np.lexsort((held[fields.index(place)], codes))
        codes, n = codes[order], np.arange(len(codes))
        within = n - np.maximum.accumulate(np.where(np.diff(codes, prepend=-1) != 0, n, 0))
        firsts = np.flatnonzero(within % PIECE == 0)
        cuts = [*firsts.tolist(), len(codes)]
        held = [a[order] for a in held]
        newest = np.maximum.reduceat(held[fields.index("event_ms")], cuts[:-1]).tolist() if timed else [None] * (len(cuts) - 1)
        values = [packed(a[x:y] for a in held) for x, y in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(codes[firsts])), pa.array(values, pa.binary()), pa.array(newest, pa.int64())], ["utt_id", "rows", "newest"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = [], 0
        for b in batches:
            if b.num_rows:
                own.append(b)
                n += b.num_rows
            if n >= LOT:
                yield lot(own)
                own, n = [], 0
        if own:
            yield lot(own)

    return rows.select("utt_id", *fields).mapInArrow(pack, f"utt_id {rows.schema['utt_id'].dataType.simpleString()}, rows binary, newest bigint")


def _at(rows: Rows, which) -> Rows:
    return {c: a[which] for c, a in rows.items()}


def _joined(parts: list[Rows]) -> Rows:
    return parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


class InOrder(StatefulProcessor):
    """Hands a key's rows on in order of their place (0, 1, 2, ...), however they arrive.

    A row whose predecessors are all handed on follows at once.  Others wait in list state until what is missing comes, or
    until the watermark passes their own event time: a predecessor is no younger, so it is too late by then.  A row whose
    place has been passed is late, one whose place is taken a repetition; both go to the side output.  Nothing depends on how
    a key's rows are cut into Arrow batches or micro-batches.  An event-time timer for each key releases waiting rows, and
    closes a key whose newest row is ``idle_ms`` behind the watermark (None: never).

    ``step(memory, rows)`` gives the new memory (a tuple) and output rows; ``late(rows)`` and ``close(memory)`` output rows.
    Rows are given as columns (``Rows``).  Input: what ``pack_by_key`` makes.
    """

    def __init__(self, place: str, fields: list[str], memory: str, fresh: tuple, output: list[str], step: Callable, late: Callable, close: Callable, idle_ms: int | None):
        self.place, self.fields, self.memory_kind, self.fresh, self.output = place, fields, memory, fresh, output
        self.step, self.late, self.close_key, self.idle_ms = step, late, close, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        # Waiting rows are one packed value, beside the memory while it is small: every state is a request of its own.  Larger
        # ones are list state, one value for each micro-batch, which are not read again until something follows.
        self.waiting = handle.getListState("waiting", "rows binary")
        self.memory = handle.getValueState("memory", f"{_OWN}, held binary, {self.memory_kind}")

    def _packed(self, rows: Rows) -> bytes:
        return packed(rows[c] for c in self.fields)

    def _unpacked(self, data: bytes) -> Rows:
        return dict(zip(self.fields, unpacked(data), strict=True))

    def _came(self, row: Row) -> Rows:
        """The rows of one lot; without event times of their own they have the micro-batch's."""
        columns = unpacked(row["rows"])
        if len(columns) < len(self.fields):
            columns.append(np.full(len(columns[0]), row["event_ms"], np.int64))
        return dict(zip(self.fields, columns, strict=True))

    def _waiting(self, held: bytes | None) -> list[Rows]:
        return [self._unpacked(held)] if held is not None else [self._unpacked(r[0]) for r in self.waiting.get()]

    def _keep(self, rows: Rows, listed: bool) -> bytes | None:
        """Makes ``rows`` the only ones that wait (``listed``: some are in list state now); what is to lie beside the memory."""
        data = self._packed(rows) if len(rows[self.place]) else b""
        if len(data) > INLINE:
            self.waiting.put([(data,)])
        elif listed:
            self.waiting.clear()
        return data if 0 < len(data) <= INLINE else None

    def _sorted(self, rows: Rows) -> Rows:
        places = rows[self.place]
        return rows if (places[1:] >= places[:-1]).all() else _at(rows, np.argsort(places, kind="stable"))

    def _held(self) -> tuple[int, int, int, int, bytes | None, tuple]:
        found = self.memory.get()
        return (0, -1, -1, -1, None, self.fresh) if found is None else (*found[:4], None if found[4] is None else bytes(found[4]), tuple(found[5:]))

    def _released(self, rows: Rows, next_: int, watermark: int) -> int:
        """How many of the sorted ``rows`` follow one another from ``next_``, or are as old as the watermark."""
        places, old = rows[self.place], np.flatnonzero(rows["event_ms"] <= watermark)
        n = int(old[-1]) + 1 if len(old) else 0
        start = int(places[n - 1]) + 1 if n else next_
        apart = np.flatnonzero(places[n:] != start + np.arange(len(places) - n))
        return n + int(apart[0]) if len(apart) else len(places)

    def _take(self, key: tuple, frame: Rows | None, watermark: int) -> Iterator[Row]:
        next_, lowest, newest, timer, held, memory = self._held()
        listed = lowest >= 0 and held is None
        out: list[tuple] = []
        if frame is not None:
            newest = max(newest, int(frame["event_ms"].max()))
            passed = frame[self.place] < next_
            if passed.any():
                out += self.late(_at(frame, passed))
                frame = _at(frame, ~passed)
            frame = self._sorted(frame)
        some = frame is not None and len(frame[self.place]) > 0
        first = int(frame[self.place][0]) if some else -1
        if some and first > next_ and int(frame["event_ms"].min()) > watermark and (lowest < 0 or watermark < timer):
            if listed:  # nothing can follow yet
                self.waiting.appendValue((self._packed(frame),))
            else:
                held = self._keep(_joined([*([] if held is None else self._waiting(held)), frame]), False)
            lowest = first if lowest < 0 else min(lowest, first)
        elif some or lowest >= 0:
            parts = [*(self._waiting(held) if lowest >= 0 else []), *([frame] if some else [])]
            rows = self._sorted(_joined(parts))
            places = rows[self.place]
            again = np.concatenate([[False], places[1:] == places[:-1]])
            if again.any():
                out += self.late(_at(rows, again))
                rows = _at(rows, ~again)
            n = self._released(rows, next_, watermark)
            if n:
                memory, found = self.step(memory, _at(rows, slice(n)))
                out += found
                next_ = int(rows[self.place][n - 1]) + 1
            rest = _at(rows, slice(n, None))
            held = self._keep(rest, listed)
            lowest = int(rest[self.place][0]) if len(rest[self.place]) else -1
        if lowest < 0 and self.idle_ms is not None and newest + self.idle_ms <= watermark:
            out += self.close_key(memory)
            self._timer(timer, -1)
            self.memory.clear()
        else:
            due = newest if lowest >= 0 else newest + self.idle_ms if self.idle_ms is not None else -1
            self.memory.update((next_, lowest, newest, self._timer(timer, due), held, *memory))
        for r in out:
            yield Row(**dict(zip(self.output, (*key, *r), strict=True)))

    def _timer(self, now: int, due: int) -> int:
        """Moves the key's only timer."""
        if now != due:
            if now >= 0:
                self.handle.deleteTimer(now)
            if due >= 0:
                self.handle.registerTimer(due)
        return due

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # A key's rows of a micro-batch are taken together: one round of state requests, however many tasks had some of them.
        yield from self._take(key, _joined([self._came(r) for r in rows]), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        next_, lowest, newest, _, held, memory = self._held()
        self.memory.update((next_, lowest, newest, -1, held, *memory))  # an expired timer is gone
        yield from self._take(key, None, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, place: str, fields: list[str], event: str | None, delay: str, schema: str, memory: str, fresh: tuple, step: Callable, late: Callable, close: Callable, idle_ms: int | None) -> DataFrame:
    """Runs a job over ``rows`` (utt_id, ``fields``) by utt_id, see ``InOrder``.

    ``event`` names a timestamp column of when a row was made or came in; by default it is the time of the micro-batch that
    reads it.  A row may come ``delay`` after its successors and still be put in order.  Rows behind the watermark are not
    dropped by Spark: the processor decides what is late.
    """
    spark = rows.sparkSession
    if spark.conf.get(STORE[0]) != STORE[1]:
        raise ValueError(f"set {STORE[0]} to {STORE[1]}: timers and list state need it")
    if event:
        lots = pack_by_key(rows.select("utt_id", *fields, F.unix_millis(event).alias("event_ms")), place, [*fields, "event_ms"])
        lots = lots.withColumn("__event", F.timestamp_millis("newest"))
    else:
        lots = pack_by_key(rows, place, fields).withColumn("__event", F.current_timestamp())
    # The newest row of all is the newest of a lot; and the watermarked column itself goes, else Spark would filter by it.
    timed = lots.withWatermark("__event", delay).select("utt_id", "rows", F.unix_millis("__event").alias("event_ms"))
    names = [c.split()[0] for c in schema.split(", ")]
    job = InOrder(place, [*fields, "event_ms"], memory, fresh, names, step, late, close, idle_ms)
    return timed.groupBy("utt_id").transformWithState(job, schema, "append", "eventTime")
