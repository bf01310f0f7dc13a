"""Parameters of an utterance and the 19 fluency measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import syllables
from ..schema import by_utt

SUMS = ["n_word", "n_syl", "dur", "repetition", "self_repair", "false_start", "filled", "n_mc", "sum_mc", "n_ec", "sum_ec"]


def _word_sums(pruning: bool, keep: Sequence[str], syllable_col: str | None) -> list[Column]:
    spoken = F.col("disfluency").isNull() if pruning else F.lit(True)
    kind = lambda name: F.count(F.when(F.col("disfluency") == name, 1)).alias({"FILLER": "filled"}.get(name, name.lower()))
    syl = F.col(syllable_col) if syllable_col else syllables(F.col("text"))
    return [
        *(F.min(c).alias(c) for c in keep),
        F.count(F.when(spoken, 1)).alias("n_word"),
        F.coalesce(F.sum(F.when(spoken, syl)), F.lit(0)).alias("n_syl"),
        (F.max_by("end_time", "pos") - F.min_by("start_time", "pos")).alias("dur"),
        *map(kind, ("REPETITION", "SELF_REPAIR", "FALSE_START", "FILLER")),
    ]


def _pause_sums(location: Column, length: Column) -> list[Column]:
    """Of rows that are pauses where ``location`` is not null."""
    of = lambda loc, value: F.when(location == loc, value)
    return [f for loc, name in (("CI", "mc"), ("CE", "ec")) for f in (F.count(of(loc, 1)).alias(f"n_{name}"), F.coalesce(F.sum(of(loc, length)), F.lit(0)).alias(f"sum_{name}"))]


def fluency_params(tagged: DataFrame, pauses: DataFrame, pruning: bool = True, min_pause: float = 0.25, keep: Sequence[str] = (), syllable_col: str | None = None) -> DataFrame:
    """One row of sums for each utterance; ``keep`` names columns that are constant within one.

    Pauses count strictly over ``min_pause`` (an equal one is annotated, not counted).  ``pauses`` may come from anywhere, so
    words and pauses are aggregated apart and joined afterwards: nothing fans out.  For pauses between the words themselves
    ``params_of_words`` takes one pass.
    """
    words = tagged.groupBy("utt_id").agg(*_word_sums(pruning, keep, syllable_col))
    long = pauses.withColumn("__d", F.col("end_time") - F.col("start_time")).filter(F.col("__d") > min_pause)
    joined = words.join(long.groupBy("utt_id").agg(*_pause_sums(F.col("location"), F.col("__d"))), "utt_id", "left")
    return joined.select("utt_id", *keep, *(F.coalesce(c, F.lit(0)).alias(c) if c in ("n_mc", "sum_mc", "n_ec", "sum_ec") else F.col(c) for c in SUMS))


def params_of_words(tagged: DataFrame, pruning: bool = True, min_pause: float = 0.25, keep: Sequence[str] = (), syllable_col: str | None = None) -> DataFrame:
    """The same with the pauses that ``detect_pauses`` finds, in one aggregate over the words.

    A pause is a value of the word behind it (its length and location, from the words' own window), so words and pauses share
    one scan, one exchange on utt_id and one sort.
    """
    gap = F.col("start_time") - F.lag("end_time").over(by_utt())
    location = F.when(F.col("clause_id") == F.lag("clause_id").over(by_utt()), "CI").otherwise("CE")
    flagged = tagged.withColumn("__gap", gap).withColumn("__location", F.when(F.col("__gap") > min_pause, location))
    return flagged.groupBy("utt_id").agg(*_word_sums(pruning, keep, syllable_col), *_pause_sums(F.col("__location"), F.col("__gap"))).select("utt_id", *keep, *SUMS)


def merge_params(params: DataFrame, *keys: str) -> DataFrame:
    """Sums of all parameters for each value of ``keys``: ratios of sums follow, not means of ratios."""
    return params.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in SUMS))


def rollup_params(params: DataFrame, *keys: str) -> DataFrame:
    """The same for every level from all keys to the grand total; ``level`` counts the keys that are summed away."""
    return params.rollup(*keys).agg(*(F.sum(c).alias(c) for c in SUMS), F.grouping_id().alias("level"))


def safe_div(x: Column, y: Column) -> Column:
    """x / y, null where y is 0."""
    return F.try_divide(x.cast("double"), y.cast("double"))


def _measures() -> dict[str, Column]:
    c = F.col
    pauses, silence = c("n_mc") + c("n_ec"), c("sum_mc") + c("sum_ec")
    repairs, spoken = c("repetition") + c("self_repair") + c("false_start"), c("dur") - silence
    mean = lambda total, n, none: F.when(none == 0, F.lit(0.0)).otherwise(safe_div(total, n))
    return {
        "speech_rate": safe_div(c("n_syl"), c("dur")),
        "mid_clause_pause_ratio": safe_div(c("n_mc"), c("n_syl")),
        "end_clause_pause_ratio": safe_div(c("n_ec"), c("n_syl")),
        "mid_clause_p_dur": mean(c("sum_mc"), c("n_mc"), c("n_mc")),
        "end_clause_p_dur": mean(c("sum_ec"), c("n_ec"), c("n_ec")),
        "filled_pause_ratio": safe_div(c("filled"), c("n_syl")),
        "dysfluency_ratio": safe_div(repairs, c("n_syl")),
        "dysfluency_rate": safe_div(repairs, c("dur")),
        "repetition_ratio": safe_div(c("repetition"), c("n_syl")),
        "self_repair_ratio": safe_div(c("self_repair"), c("n_syl")),
        "false_start_ratio": safe_div(c("false_start"), c("n_syl")),
        "repair_false_ratio": safe_div(c("self_repair") + c("false_start"), c("n_syl")),
        "articulation_rate": safe_div(c("n_syl"), spoken),
        "phonation_time_rate": safe_div(spoken, c("dur")),
        "mean_length_of_run": safe_div(c("n_syl"), pauses + 1),
        "articulation_rate_word": safe_div(c("n_word"), spoken),
        "speech_rate_word": safe_div(c("n_word"), c("dur")),
        "mean_length_of_run_word": safe_div(c("n_word"), pauses + 1),
        "mean_pause_duration": mean(silence, pauses, silence),
    }


# The measures and their order.
MEASURES = [
    "speech_rate", "mid_clause_pause_ratio", "end_clause_pause_ratio", "mid_clause_p_dur", "end_clause_p_dur", "filled_pause_ratio", "dysfluency_ratio", "dysfluency_rate", "repetition_ratio", "self_repair_ratio", "false_start_ratio", "repair_false_ratio", "articulation_rate", "phonation_time_rate", "mean_length_of_run", "articulation_rate_word", "speech_rate_word", "mean_length_of_run_word", "mean_pause_duration",
]


def fluency_measures(params: DataFrame, features: Sequence[str] | None = None, keep: Sequence[str] = ("utt_id",)) -> DataFrame:
    """``keep`` and the chosen measures (all by default) in the order of ``MEASURES``."""
    own = _measures()
    if features is not None and (unknown := set(features) - set(own)):
        raise ValueError(f"unknown measures: {sorted(unknown)}")
    return params.select(*keep, *(own[m].alias(m) for m in MEASURES if features is None or m in features))


def extract(tagged: DataFrame, pruning: bool = True, min_pause: float = 0.25, keep: Sequence[str] = ()) -> DataFrame:
    """Tagged words to measures, one row for each utterance."""
    return fluency_measures(params_of_words(tagged, pruning, min_pause, keep), keep=("utt_id", *keep))
