"""Pauses from timed words and silences, and the interval logic around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..schema import by_utt


def _by_start() -> WindowSpec:
    return Window.partitionBy("utt_id").orderBy("start_time")


def detect_pauses(tagged: DataFrame, min_pause: float = 0.25) -> DataFrame:
    """utt_id, seq, location, start_time, end_time: gaps of at least ``min_pause`` before a word.

    CI within a clause, CE between clauses; disfluent words count as words.  One window, no join.
    """
    before = tagged.select("utt_id", "pos", "clause_id", F.lag("end_time").over(by_utt()).alias("p_end"), F.lag("clause_id").over(by_utt()).alias("p_clause"), "start_time")
    found = before.filter(F.col("start_time") - F.col("p_end") >= min_pause)
    return found.select(
        "utt_id", (F.row_number().over(by_utt()) - 1).alias("seq"), F.when(F.col("clause_id") == F.col("p_clause"), "CI").otherwise("CE").alias("location"),
        F.col("p_end").alias("start_time"), F.col("start_time").alias("end_time"),
    )


def locate_pauses(silences: DataFrame, clauses: DataFrame) -> DataFrame:
    """Adds location to silences: CI if some clause holds the silence strictly inside it, else CE.

    Some clause does if and only if the latest end among the clauses that start before the silence is later than the
    silence's end.  So a running maximum settles it for clauses that follow, nest or cross one another, linear in both sides:
    one exchange on utt_id, and no pairs of silences and clauses.
    """
    nothing = F.lit(None)
    events = silences.select("utt_id", F.col("start_time").alias("t"), F.lit(0).alias("order"), "start_time", "end_time", nothing.cast(clauses.schema["end_time"].dataType).alias("c_end"))
    starts = clauses.select("utt_id", F.col("start_time").alias("t"), F.lit(1).alias("order"), nothing.cast(silences.schema["start_time"].dataType), nothing.cast(silences.schema["end_time"].dataType), F.col("end_time").alias("c_end"))
    # A clause that starts exactly with the silence does not hold it: it sorts behind it.
    w = Window.partitionBy("utt_id").orderBy("t", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = events.union(starts).withColumn("held", F.max("c_end").over(w)).filter(F.col("order") == 0)
    return seen.select("utt_id", F.when(F.col("end_time") < F.col("held"), "CI").otherwise("CE").alias("location"), "start_time", "end_time")


def silences(voiced: DataFrame) -> DataFrame:
    """utt_id, start_time, end_time: the gaps between consecutive voiced intervals."""
    nxt = voiced.select("utt_id", F.col("end_time").alias("start_time"), F.lead("start_time").over(_by_start()).alias("end_time"))
    return nxt.filter(F.col("end_time").isNotNull())


def voiced(silences: DataFrame, durations: DataFrame) -> DataFrame:
    """utt_id, start_time, end_time: what the silences leave of [0, duration] (durations: utt_id, duration).

    Empty intervals, where a silence begins the recording or ends it, are left out.
    """
    kind = silences.schema["start_time"].dataType
    ends = durations.select("utt_id", F.col("duration").cast(kind).alias("start_time"), F.col("duration").cast(kind).alias("end_time"))
    before = F.coalesce(F.lag("end_time").over(Window.partitionBy("utt_id").orderBy("start_time", "end_time")), F.lit(0).cast(kind))
    gaps = silences.select("utt_id", "start_time", "end_time").union(ends).select("utt_id", before.alias("a"), F.col("start_time").alias("b"))
    return gaps.filter("a < b").select("utt_id", F.col("a").alias("start_time"), F.col("b").alias("end_time"))


def sample_to_sec(voiced: DataFrame, rate: float) -> DataFrame:
    """Sample numbers to seconds."""
    return voiced.withColumns({c: F.col(c) / F.lit(float(rate)) for c in ("start_time", "end_time")})
