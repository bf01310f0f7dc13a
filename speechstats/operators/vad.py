"""Voice activity from frames: intensity gate, hangover smoothing, segments.  Frames are reduced before anything joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _frames() -> WindowSpec:
    return Window.partitionBy("utt_id").orderBy("frame")


def sounding_frames(frames: DataFrame, threshold: float = -25.0) -> DataFrame:
    """Frames at least as intense as the recording's loudest, plus ``threshold`` dB."""
    loudest = F.max("intensity").over(Window.partitionBy("utt_id"))
    return frames.withColumn("__max", loudest).filter(F.col("intensity") >= F.col("__max") + threshold).drop("__max")


def sounding_intervals(sounding: DataFrame, min_sound: float = 0.25, step: float = 0.03) -> DataFrame:
    """utt_id, first, last, start_time, end_time of runs of sounding frames that last ``min_sound``.

    The last run of a recording is dropped if it begins at frame 0.
    """
    runs = sounding.withColumn("g", F.col("frame") - F.row_number().over(_frames())).groupBy("utt_id", "g").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    whole = runs.withColumn("__final", F.max("first").over(Window.partitionBy("utt_id")))
    kept = whole.filter(((F.col("last") - F.col("first")) * step >= min_sound) & ~((F.col("first") == 0) & (F.col("__final") == 0)))
    return kept.select("utt_id", "first", "last", (F.col("first") * step).alias("start_time"), (F.col("last") * step).alias("end_time"))


def intensity_silences(frames: DataFrame, threshold: float = -25.0, min_sound: float = 0.25, min_silence: float = 0.25, step: float = 0.03) -> DataFrame:
    """utt_id, start_time, end_time: silences longer than ``min_silence`` between kept runs."""
    kept = sounding_intervals(sounding_frames(frames, threshold), min_sound, step)
    w = Window.partitionBy("utt_id").orderBy("start_time")
    gaps = kept.select("utt_id", F.col("end_time").alias("start_time"), F.lead("start_time").over(w).alias("end_time"))
    return gaps.filter(F.col("end_time") - F.col("start_time") > min_silence)


def _event(window: int, on: float, off: float) -> Column:
    """True where ``on`` of the last ``window`` flags are set, False where at most ``off`` are, else null."""
    n = F.sum(F.col("is_speech").cast("int")).over(_frames().rowsBetween(1 - window, 0))
    return F.when(n >= on * window, True).when(n <= off * window, False)


def smooth_vad(flags: DataFrame, window: int = 10, on: float = 0.9, off: float = 0.1) -> DataFrame:
    """Adds state: on once ``on`` of the last ``window`` flags are set, off once at most ``off`` are, else as before.

    The share is of the full window even while fewer frames exist.
    """
    # While off, a low sum changes nothing, and while on a high one does not: the last event is the state.
    marked = flags.withColumn("__event", _event(window, on, off))
    return marked.withColumn("state", F.coalesce(F.last("__event", ignorenulls=True).over(_frames()), F.lit(False))).drop("__event")


def smooth_segments(flags: DataFrame, window: int = 10, on: float = 0.9, off: float = 0.1, t_frame: int = 30) -> DataFrame:
    """``vad_segments`` of ``smooth_vad`` in one pass over the frames: only events and last frames go on.

    The state changes where an event differs from the one before it (off before the first).
    """
    last = F.lead("frame").over(_frames()).isNull()
    seen = flags.select("utt_id", "frame", _event(window, on, off).alias("__event"), last.alias("__last")).filter("__event is not null or __last")
    before = F.coalesce(F.last("__event", ignorenulls=True).over(_frames().rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    edges = seen.withColumn("__change", F.coalesce(F.col("__event") != before, F.lit(False))).filter("__change or __last")
    nxt = edges.select("utt_id", "frame", (F.col("__change") & F.col("__event")).alias("__on"), F.coalesce(F.lead("frame").over(_frames()), "frame").alias("__to"))
    return nxt.filter("__on").select("utt_id", (F.col("frame") * t_frame).alias("start_ms"), (F.col("__to") * t_frame).alias("end_ms"))


def vad_segments(smoothed: DataFrame, t_frame: int = 30) -> DataFrame:
    """utt_id, start_ms, end_ms: from the first frame that is on to the first that is off; an open one ends at the last frame."""
    change = F.coalesce(F.lag("state").over(_frames()) != F.col("state"), F.col("state"))
    # Changes and the last frame: the next such row ends a segment.
    last = F.lead("frame").over(_frames()).isNull()
    edges = smoothed.select("utt_id", "frame", "state", change.alias("__change"), last.alias("__last")).filter("__change or __last")
    nxt = edges.select("utt_id", "state", "__change", "frame", F.coalesce(F.lead("frame").over(_frames()), "frame").alias("__to"))
    return nxt.filter("state and __change").select("utt_id", (F.col("frame") * t_frame).alias("start_ms"), (F.col("__to") * t_frame).alias("end_ms"))


def pcm_frames(df: DataFrame, rate: int = 16000, t_frame: int = 30) -> DataFrame:
    """utt_id, frame, time_ms, data: 16-bit PCM bytes (column ``pcm``) in frames; the last one may be short."""
    if t_frame not in (10, 20, 30) or rate not in (8000, 16000, 32000, 48000):
        raise ValueError("t_frame must be 10, 20 or 30 ms and rate 8, 16, 32 or 48 kHz")
    stride = int(rate / 1000 * t_frame) * 2
    n = F.ceil(F.octet_length("pcm") / stride).cast("int")
    rows = df.filter(F.octet_length("pcm") > 0).select("utt_id", "pcm", F.explode(F.sequence(F.lit(0), n - 1)).alias("frame"))
    return rows.select("utt_id", "frame", (F.col("frame") * t_frame).alias("time_ms"), F.substr("pcm", F.col("frame") * stride + 1, F.lit(stride)).alias("data"))
