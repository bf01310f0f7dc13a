"""Streaming forms of voice-activity smoothing, pause detection and speech runs.

Rows of a recording may come in any order and any number of micro-batches; see ``ordered``.  Sessions that run the first
two need the RocksDB state store (``ordered.STORE``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from .ordered import Rows, in_order


def _kind(df: DataFrame) -> str:
    return df.schema["utt_id"].dataType.simpleString()


def stream_vad(flags: DataFrame, t_frame: int = 30, window: int = 10, on: float = 0.9, off: float = 0.1, idle_ms: int | None = 60_000, event: str | None = None, delay: str = "10 seconds") -> DataFrame:
    """utt_id, start_ms, end_ms, late: voiced segments as they close; input: utt_id, frame (from 0), is_speech.

    Memory of a recording: its last flags, whether it is on, where the open segment began, its last frame; and the frames
    that wait for earlier ones.  A recording whose newest frame is ``idle_ms`` behind the watermark is closed: an open segment
    then ends at its last frame.  With None nothing is closed.  A frame that comes after its place was passed, or again, is a
    row with ``late`` true and its own time.  ``event`` and ``delay`` as in ``ordered.in_order``.
    """

    def step(memory: tuple, rows: Rows) -> tuple[tuple, list[tuple]]:
        ring, active, start, _ = memory
        flags = np.concatenate([np.frombuffer(ring.encode(), np.uint8) == ord("1"), rows["is_speech"].astype(bool)])
        frames = rows["frame"]
        sums = np.concatenate([np.zeros(window, np.int64), np.cumsum(flags)])  # zeros: while fewer flags exist, the window is not full
        n = (sums[window:] - sums[:-window])[len(ring) :] if len(sums) > window else np.zeros(0, np.int64)
        high, low, out, at = np.flatnonzero(n >= on * window), np.flatnonzero(n <= off * window), [], 0
        while True:  # from one change to the next
            turns = low if active else high
            k = np.searchsorted(turns, at)
            if k == len(turns):
                break
            at = int(turns[k])
            if active:
                out.append((start * t_frame, int(frames[at]) * t_frame, False))
            else:
                start = int(frames[at])
            active, at = not active, at + 1
        return ("".join("1" if f else "0" for f in flags[-window:]), active, start, int(frames[-1])), out

    late = lambda rows: [(n * t_frame, n * t_frame, True) for n in rows["frame"].tolist()]
    close = lambda memory: [(memory[2] * t_frame, memory[3] * t_frame, False)] if memory[1] else []
    return in_order(
        flags.withColumn("frame", F.col("frame").cast("long")), "frame", ["frame", "is_speech"], event, delay, f"utt_id {_kind(flags)}, start_ms bigint, end_ms bigint, late boolean",
        "ring string, active boolean, start bigint, last bigint", ("", False, -1, -1), step, late, close, idle_ms,
    )


def open_segments(flags: DataFrame, t_frame: int = 30) -> DataFrame:
    """Batch: the segments that are still open at the end of the input, as a timeout would close them."""
    from ..operators.vad import smooth_vad, vad_segments

    last = flags.groupBy("utt_id").agg((F.max("frame") * t_frame).alias("__last"))
    smoothed = smooth_vad(flags)
    open_ = smoothed.groupBy("utt_id").agg(F.max_by("state", "frame").alias("__open"))
    return vad_segments(smoothed, t_frame).join(last, "utt_id").join(open_, "utt_id").filter("__open and end_ms = __last").drop("__last", "__open")


def stream_pauses(words: DataFrame, min_pause: float = 0.25, idle_ms: int | None = 60_000, event: str | None = None, delay: str = "10 seconds") -> DataFrame:
    """utt_id, location, start_time, end_time, late: a pause as soon as the word behind it, and all words before, have come.

    Input: utt_id, pos (from 0), clause_id, start_time, end_time.  Memory of an utterance: the last word's clause and end,
    and the words that wait for earlier ones.  A word that comes after its place was passed, or again, is a row with ``late``
    true in place of a pause.  ``idle_ms``: how far an utterance's newest word is behind the watermark when its state goes.
    ``event`` and ``delay`` as in ``ordered.in_order``: missing words hold later ones back until the watermark passes those.
    """

    def step(memory: tuple, rows: Rows) -> tuple[tuple, list[tuple]]:
        begun, clause, end = memory
        starts, ends, own = rows["start_time"], rows["end_time"], rows["clause_id"]
        before, clauses = np.r_[end, ends[:-1]], np.r_[clause, own[:-1]]
        gaps = starts - before >= min_pause
        gaps[0] &= begun
        out = [("CI" if own[k] == clauses[k] else "CE", float(before[k]), float(starts[k]), False) for k in np.flatnonzero(gaps).tolist()]
        return (True, int(own[-1]), float(ends[-1])), out

    late = lambda rows: [("", float(a), float(b), True) for a, b in zip(rows["start_time"].tolist(), rows["end_time"].tolist(), strict=True)]
    typed = words.withColumns({"pos": F.col("pos").cast("long"), "clause_id": F.col("clause_id").cast("long"), "start_time": F.col("start_time").cast("double"), "end_time": F.col("end_time").cast("double")})
    return in_order(
        typed, "pos", ["pos", "clause_id", "start_time", "end_time"], event, delay, f"utt_id {_kind(words)}, location string, start_time double, end_time double, late boolean",
        "begun boolean, clause bigint, end double", (False, -1, 0.0), step, late, lambda memory: [], idle_ms,
    )


def speech_runs(words: DataFrame, gap_ms: int = 250, watermark: str | None = None) -> DataFrame:
    """utt_id, start_ms, end_ms, n_words: runs of words closer than ``gap_ms``; times are integer milliseconds.

    A session reaches from a word's start to its end plus the gap.  Sessions that touch merge, hence the gap less one
    microsecond: words exactly ``gap_ms`` apart are two runs, as a pause of that length is one.

    A stream needs a ``watermark``: how far words of one recording may lie behind the newest word of any.  In append mode a
    run comes out once, when the watermark has passed its end; ``end_of_input`` brings out the last ones of an input that
    ends, and ``dropped_rows`` counts the words that came too late.
    """
    ts = F.timestamp_millis("start_time")
    length = F.concat(((F.col("end_time") - F.col("start_time")) * 1000 + gap_ms * 1000 - 1).cast("string"), F.lit(" microseconds"))
    rows = words.withColumn("ts", ts)
    if watermark:
        rows = rows.withWatermark("ts", watermark)
    runs = rows.groupBy("utt_id", F.session_window("ts", length).alias("s")).agg(F.min("start_time").alias("start_ms"), F.max("end_time").alias("end_ms"), F.count("*").alias("n_words"))
    return runs.drop("s")


def end_of_input(ms: int) -> tuple[int, int, int, int]:
    """(utt_id -1, pos, start_time, end_time): a word of no recording that moves the watermark to ``ms`` less its delay."""
    return -1, 0, ms, ms


def dropped_rows(query: StreamingQuery) -> int:
    """The rows that a query's stateful operators have dropped as late, over the progress that it keeps."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
