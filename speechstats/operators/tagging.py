"""Marks on timed words: fillers, fluent index, sentence ends, self-repairs, model tags."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..schema import BEFORE, by_utt, SO_FAR, utt

# The words that count as fillers.
FILLERS = ["uh", "ah", "um", "mm", "hmm", "oh", "mm-hmm", "mmhmm", "er", "mhm", "uh-huh", "uhhuh", "erm", "huh", "uhu"]
# The kinds of a disfluent word.
KINDS = ["REPETITION", "SELF_REPAIR", "FILLER", "FALSE_START", "OTHER"]


def mark_fillers(words: DataFrame) -> DataFrame:
    """Sets disfluency to FILLER on fillers; other marks stay."""
    own = F.col("disfluency") if "disfluency" in words.columns else F.lit(None).cast("string")
    return words.withColumn("disfluency", F.when(F.lower("text").isin(FILLERS), "FILLER").otherwise(own))


def with_fluent_idx(tagged: DataFrame) -> DataFrame:
    """Numbers the fluent words of an utterance 0, 1, ...; null on disfluent ones."""
    count = F.count(F.when(F.col("disfluency").isNull(), 1)).over(by_utt().rowsBetween(*SO_FAR)) - 1
    return tagged.withColumn("fluent_idx", F.when(F.col("disfluency").isNull(), count))


def first_subword(offsets: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """The first piece of each word: its offset starts at 0 and does not end there."""
    return offsets.filter((F.col(start) == 0) & (F.col(end) != 0))


def argmax_tags(df: DataFrame, names: Sequence[str], logits: str = "logits") -> DataFrame:
    """Adds tag: the name at the first largest logit."""
    best = F.array_position(logits, F.array_max(logits)) - 1
    return df.withColumn("tag", F.get(F.array(*map(F.lit, names)), best.cast("int")))


def tag_sequences(tagged: DataFrame, make_predict: Callable[[], Callable[[list[list[str]]], list[list[str]]]], by: Sequence[str] = ("utt_id", "sent_id"), missing: str = "O") -> DataFrame:
    """Tags each sequence of words (a sentence, or an utterance) with a user model: ``by``, pos, tag.

    ``make_predict`` runs once in each Python worker and gives a function from lists of words to lists of tags.  Where
    the model cuts a sequence off, the words behind the cut get ``missing``.
    """
    keys = list(by)
    rows = tagged.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("w"))
    rows = rows.select(*keys, F.col("w.pos").alias("pos"), F.col("w.text").alias("text"))
    schema = ", ".join(f"`{k}` {tagged.schema[k].dataType.simpleString()}" for k in keys) + ", pos array<int>, tag array<string>"

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_predict()
        for frame in frames:
            texts = [list(x) for x in frame["text"]]
            found = [list(t)[: len(x)] + [missing] * (len(x) - len(t)) for x, t in zip(texts, model(texts), strict=True)]
            yield frame[[*keys, "pos"]].assign(tag=found)

    out = rows.withColumn("pos", F.col("pos").cast("array<int>")).mapInPandas(predict, schema)
    return out.select(*keys, F.explode(F.arrays_zip("pos", "tag")).alias("z")).select(*keys, "z.pos", "z.tag")


def assign_sentences(tagged: DataFrame, end: str | Column = "is_end") -> DataFrame:
    """Adds sent_id: a true ``end`` on a fluent word ends a sentence after it.

    The utterance's last fluent word never ends one, and disfluent words behind an end belong to the next sentence.
    """
    flag = F.col(end) if isinstance(end, str) else end
    last = F.max(F.when(F.col("disfluency").isNull(), F.col("pos"))).over(utt())
    ends = F.col("disfluency").isNull() & F.coalesce(flag, F.lit(False)) & (F.col("pos") < F.col("__last"))
    marked = tagged.withColumn("__last", last).withColumn("__end", ends.cast("long"))
    return marked.withColumn("sent_id", F.coalesce(F.sum("__end").over(by_utt().rowsBetween(*BEFORE)), F.lit(0))).drop("__last", "__end")


def _sent() -> WindowSpec:
    return Window.partitionBy("utt_id", "sent_id").orderBy("pos")


def _span() -> WindowSpec:
    return Window.partitionBy("utt_id", "sent_id", "__span")


def _opened(tagged: DataFrame) -> DataFrame:
    """Adds __span and __opens: where the span's first reparandum word stands (null without one)."""
    spans = tagged.withColumn("__span", F.count(F.when(F.col("tag") == "O", 1)).over(_sent().rowsBetween(*SO_FAR)))
    return spans.withColumn("__opens", F.min(F.when(~F.col("tag").isin("O", "C"), F.col("pos"))).over(_span()))


def _joined(condition: Column, over: WindowSpec | None = None) -> Column:
    own = F.collect_list(F.when(condition, F.struct("pos", "text")))
    return F.array_join(F.transform(F.array_sort(own if over is None else own.over(over)), lambda x: x["text"]), "")


def _reparandum() -> Column:
    return ~F.col("tag").isin("O", "C")


def _correction() -> Column:
    return (F.col("tag") == "C") & (F.col("pos") > F.col("__opens"))


def repair_spans(tagged: DataFrame) -> DataFrame:
    """utt_id, sent_id, span_id, first_pos, reparandum, correction: the spans of ``tag`` on fluent words.

    A span opens at the first tag other than O and C, goes on over both kinds and ends at O or with the sentence.
    """
    spans = _opened(tagged.filter(F.col("tag").isNotNull())).filter(F.col("__opens").isNotNull())
    return spans.groupBy("utt_id", "sent_id", F.col("__span").alias("span_id")).agg(F.min("__opens").alias("first_pos"), _joined(_reparandum()).alias("reparandum"), _joined(_correction()).alias("correction"))


def classify_repairs(spans: DataFrame) -> DataFrame:
    """Adds kind: a reparandum that its correction repeats is a REPETITION, any other a SELF_REPAIR."""
    return spans.withColumn("kind", F.when(F.col("reparandum") == F.col("correction"), "REPETITION").otherwise("SELF_REPAIR"))


def mark_repairs(tagged: DataFrame) -> DataFrame:
    """Sets disfluency on every reparandum word; all windows lie within utt_id, so one exchange serves them.  Other columns stay as they are.

    A span's words are collected once, and their texts are joined where a word needs its kind.
    """
    spans = tagged.withColumn("__span", F.count(F.when(F.col("tag") == "O", 1)).over(_sent().rowsBetween(*SO_FAR)))
    own = F.when(F.col("tag") != "O", F.struct("pos", "text", (F.col("tag") == "C").alias("c")))
    spans = spans.withColumn("__words", F.collect_list(own).over(_span()))
    text = lambda words: F.array_join(F.transform(words, lambda x: x["text"]), "")
    words = F.array_sort("__words")
    reparandum = F.filter(words, lambda x: ~x["c"])
    opens = F.get(reparandum, F.lit(0))["pos"]
    correction = F.filter(words, lambda x: x["c"] & (x["pos"] > opens))
    kind = F.when(text(reparandum) == text(correction), "REPETITION").otherwise("SELF_REPAIR")
    marked = F.when(F.col("disfluency").isNull() & F.col("tag").isNotNull() & _reparandum(), kind).otherwise(F.col("disfluency"))
    return spans.withColumn("disfluency", marked).drop("__span", "__words")


def fluent(tagged: DataFrame) -> DataFrame:
    """The pruned view: fluent words only."""
    return tagged.filter(F.col("disfluency").isNull())


def annotate(tagged: DataFrame, marks: DataFrame) -> DataFrame:
    """Makes the words that ``marks`` (utt_id, clause_id, fluent_idx, kind) names disfluent and renumbers the others."""
    joined = tagged.join(marks, ["utt_id", "clause_id", "fluent_idx"], "left").withColumn("disfluency", F.coalesce("disfluency", "kind")).drop("kind")
    return with_fluent_idx(joined)
