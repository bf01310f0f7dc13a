"""Token arrays, frame labels and the way from spans of frames to word times."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import by_utt, SO_FAR


def tokenize_words(df: DataFrame, key: str = "utt_id") -> DataFrame:
    """key, pos, text: white-space words."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return df.select(key, F.posexplode(words).alias("pos", "text"))


def _map(names: Mapping) -> Column:
    return F.create_map(*(F.lit(x) for pair in names.items() for x in pair))


def char_token_ids(text: Column, vocab: Mapping[str, int], unk: int) -> Column:
    """The id of every character, ``unk`` for those not in ``vocab``."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.coalesce(F.try_element_at(_map(vocab), c), F.lit(unk)))


def unknown_chars(text: Column, vocab: Mapping[str, int]) -> Column:
    """Strict mode: the characters that have no id, each once, in order."""
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.filter(chars, lambda c: ~F.array_contains(F.array(*map(F.lit, vocab)), c))


def pronounce(words: DataFrame, lexicon: DataFrame, unk: str = "<unk>") -> DataFrame:
    """Adds phones (first pronunciation in lexicon order) and variants (all, without stress, each once).

    ``lexicon``: word, order, phones array<string>.
    """
    plain = lexicon.select("word", "order", F.transform("phones", lambda p: F.regexp_replace(p, r"\d", "")).alias("phones"))
    per_word = plain.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("order", "phones"))).alias("v"))
    variants = per_word.select(F.col("word").alias("text"), F.array_distinct(F.col("v.phones")).alias("variants"))
    joined = words.join(variants, "text", "left").withColumn("variants", F.coalesce("variants", F.array(F.array(F.lit(unk)))))
    return joined.withColumn("phones", F.get("variants", F.lit(0)))


def decode_ids(ids: Column, vocab: Mapping[str, int], unk: str = "<unk>") -> Column:
    return F.transform(ids, lambda i: F.coalesce(F.try_element_at(_map({v: k for k, v in vocab.items()}), i), F.lit(unk)))


def group_pieces(pieces: DataFrame, start: str = "▁") -> DataFrame:
    """utt_id, word_no, text: sub-word pieces to words; pieces before the first start are dropped."""
    n = F.sum(F.startswith(F.col("text"), F.lit(start)).cast("long")).over(by_utt())
    numbered = pieces.withColumn("word_no", n).filter("word_no > 0")
    joined = numbered.groupBy("utt_id", "word_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda p: p["text"]), "").alias("text"))
    return joined.withColumn("text", F.replace("text", F.lit(start), F.lit("")))


def split_multiword(words: DataFrame) -> DataFrame:
    """Splits tokens of several words; each part gets an equal share of the time; pos is numbered anew."""
    parts = words.select("utt_id", "pos", "start_time", "end_time", F.split("text", " ").alias("p")).withColumn("n", F.size("p"))
    rows = parts.select("utt_id", F.col("pos").alias("old"), "start_time", "end_time", "n", F.posexplode("p").alias("k", "text"))
    share = (F.col("end_time") - F.col("start_time")) / F.col("n")
    order = Window.partitionBy("utt_id").orderBy("old", "k")
    return rows.select("utt_id", (F.row_number().over(order) - 1).alias("pos"), "text", (F.col("start_time") + share * F.col("k")).alias("start_time"), (F.col("start_time") + share * (F.col("k") + 1)).alias("end_time"))


def glue_connectors(words: DataFrame, connectors: str = "-:") -> DataFrame:
    """Words that begin with a connector join the word before them (chains too) and extend its end."""
    begins = ~F.substring("text", 1, 1).isin(list(connectors))
    grouped = words.withColumn("g", F.sum(begins.cast("long")).over(by_utt()))
    glued = grouped.groupBy("utt_id", "g").agg(
        F.min("pos").alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda w: w["text"]), "").alias("text"),
        F.min_by("start_time", "pos").alias("start_time"), F.max_by("end_time", "pos").alias("end_time"),
    )
    return glued.drop("g").withColumn("pos", F.row_number().over(by_utt()) - 1)


def alignment_mismatch(texts: DataFrame, aligned: DataFrame) -> DataFrame:
    """utt_id, n_text, n_aligned where the numbers of words differ."""
    a = texts.select("utt_id", F.size(F.filter(F.split("text", " "), lambda w: w != "")).cast("long").alias("n_text"))
    b = aligned.groupBy("utt_id").agg(F.count("*").alias("n_aligned"))
    both = a.join(b, "utt_id", "full_outer")
    return both.select("utt_id", F.coalesce("n_text", F.lit(0)).alias("n_text"), F.coalesce("n_aligned", F.lit(0)).alias("n_aligned")).filter("n_text <> n_aligned")


def merge_spans(frames: DataFrame, blank: int = 0) -> DataFrame:
    """utt_id, span, label, start, end (exclusive), score: runs of one label, without the blank's.

    Frames without a ``score`` are passed once, and only those where a run begins, and the last ones, go on.
    """
    w = Window.partitionBy("utt_id").orderBy("frame")
    change = F.coalesce(F.lag("label").over(w) != F.col("label"), F.lit(True))
    if "score" not in frames.columns:
        after = F.coalesce(F.lag("frame").over(w), F.col("frame")) + 1  # the end of the run before
        seen = frames.select("utt_id", "frame", "label", change.alias("__new"), after.alias("__after"), F.lead("frame").over(w).isNull().alias("__last")).filter("__new or __last")
        end = F.coalesce(F.lead(F.when(F.col("__new"), F.col("__after")).otherwise(F.col("frame") + 1)).over(w), F.col("frame") + 1)
        own = seen.withColumn("end", end).filter(F.col("__new") & (F.col("label") != blank))
        return own.select("utt_id", (F.row_number().over(w) - 1).alias("span"), "label", F.col("frame").alias("start"), "end")
    change = change.cast("long")
    runs = frames.withColumn("__new", change).withColumn("__run", F.sum("__new").over(w))
    spans = runs.filter(F.col("label") != blank).groupBy("utt_id", "__run").agg(F.first("label").alias("label"), F.min("frame").alias("start"), (F.max("frame") + 1).alias("end"), F.avg("score").alias("score"))
    return spans.select("utt_id", (F.row_number().over(Window.partitionBy("utt_id").orderBy("start")) - 1).alias("span"), "label", "start", "end", "score")


def greedy_decode(frames: DataFrame, names: list[str], blank: int = 0) -> DataFrame:
    """utt_id, text: the best label of each frame (``values`` array), repeats merged, blanks dropped."""
    best = (F.array_position("values", F.array_max("values")) - 1).cast("int")
    spans = merge_spans(frames.select("utt_id", "frame", best.alias("label"), F.array_max("values").cast("double").alias("score")), blank)
    order = F.array_sort(F.collect_list(F.struct("span", "label")))
    joined = spans.groupBy("utt_id").agg(order.alias("s"))
    return joined.select("utt_id", F.array_join(F.transform("s", lambda x: F.get(F.array(*map(F.lit, names)), x["label"])), "").alias("text"))


def frame_to_sec(frame: Column, ratio: float | Column, rate: float) -> Column:
    ratio = F.lit(float(ratio)) if isinstance(ratio, (int, float)) else ratio
    return F.floor(frame * ratio) / F.lit(float(rate))


def word_times(spans: DataFrame, words: DataFrame) -> DataFrame:
    """utt_id, pos, text, start, end: word i takes the next ``length(text)`` spans.  Spans are numbered in order of time.

    Words stand before their first span in one order by utterance, and a place without a word behind the last one: what follows
    a word there is its first span, and what precedes the next place its last.  Linear in both sides, one pass over the spans,
    and no join, whose side of spans might be sent to every task because the tables that it is made of are small.
    """
    upto = F.sum(F.length("text")).over(by_utt())
    own = words.filter("text <> ''").withColumn("__upto", upto).withColumn("__last", F.lead("pos").over(by_utt()).isNull())
    own = own.select("utt_id", F.col("__upto").cast("long").alias("__upto"), F.struct((F.col("__upto") - F.length("text")).cast("long").alias("span"), "pos", "text").alias("__w"), "__last")
    behind = F.struct(F.col("__upto").alias("span"), *(F.lit(None).cast(words.schema[c].dataType).alias(c) for c in ("pos", "text")))
    own = own.select("utt_id", F.explode(F.when(F.col("__last"), F.array("__w", behind)).otherwise(F.array("__w"))).alias("__w")).select("utt_id", "__w.span", "__w.pos", "__w.text")
    nothing = lambda df, *names: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names]
    places = own.select("utt_id", "span", F.lit(0).alias("order"), "pos", "text", *nothing(spans, "start", "end"))
    places = places.union(spans.select("utt_id", F.col("span").cast("long"), F.lit(1), *nothing(own, "pos", "text"), "start", "end"))
    order = Window.partitionBy("utt_id").orderBy("span", "order")
    near = places.withColumns({"start": F.when(F.col("order") == 0, F.lead("start").over(order)), "end": F.lag("end").over(order)}).filter("order = 0")
    taken = near.withColumn("end", F.lead("end").over(order)).filter("start is not null and pos is not null")
    return taken.select("utt_id", "pos", "text", "start", "end")


def span_confidence(spans: DataFrame, *keys: str) -> DataFrame:
    """Mean score of the spans of ``keys``, weighted by length."""
    n = F.col("end") - F.col("start")
    return spans.groupBy(*keys).agg((F.sum(F.col("score") * n) / F.sum(n)).alias("confidence"))
