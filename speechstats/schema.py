"""Column names, windows and row checks that the operators share.

Tables: words(utt_id, pos, text, start_time, end_time); tagged words add disfluency, fluent_idx, sent_id, clause_id.
Order is never implied: every table has ``pos``.  Times are seconds (DOUBLE) or any other number, if thresholds match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def by_utt() -> WindowSpec:
    """The window of all word steps: Spark shares one exchange and one sort on utt_id among them."""
    return Window.partitionBy("utt_id").orderBy("pos")


def utt() -> WindowSpec:
    return Window.partitionBy("utt_id")


def rename_words(df: DataFrame, word_col: str = "word", start_time_col: str = "start_time", end_time_col: str = "end_time") -> DataFrame:
    """Maps a caller's column names to text, start_time and end_time."""
    return df.withColumnsRenamed({word_col: "text", start_time_col: "start_time", end_time_col: "end_time"})


def item_reason(text: Column, start: Column, end: Column, idx: Column | None = None) -> Column:
    """Why a timed item is not valid; null if it is."""
    out = (
        F.when(text.isNull(), "text missing")
        .when(text == "", "text empty")
        .when(start.isNull() | end.isNull(), "time missing")
        .when(start < 0, "start negative")
        .when(end < 0, "end negative")
        .when(end < start, "end before start")
    )
    return out if idx is None else out.when(idx < 0, "index negative")


def validate_items(df: DataFrame) -> DataFrame:
    """Adds reason (null for a valid row) and has_space, which only warns."""
    idx = F.col("pos") if "pos" in df.columns else None
    return df.withColumn("reason", item_reason(F.col("text"), F.col("start_time"), F.col("end_time"), idx)).withColumn("has_space", F.contains("text", F.lit(" ")))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with their reason."""
    checked = validate_items(df)
    return checked.filter("reason is null").drop("reason", "has_space"), checked.filter("reason is not null")


def duration(start: str = "start_time", end: str = "end_time") -> Column:
    return F.col(end) - F.col(start)
