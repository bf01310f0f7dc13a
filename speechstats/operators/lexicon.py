"""Word properties from a dictionary, joined so that frequent words do not meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import syllables

#: A dictionary up to this size is sent to every task; a larger one is hashed, but for words over this share of all rows.
SENT_BYTES, FREQUENT = 64 << 20, 1 / 1000


def stress_counts(lexicon: DataFrame) -> DataFrame:
    """word, n: the stressed or unstressed vowels (phones that end in a digit) of each word's first pronunciation.

    ``lexicon``: word, order, phones array<string>.  A word whose first pronunciation is null or has no such phone is left out.
    """
    first = lexicon.filter("word is not null").groupBy("word").agg(F.min(F.struct("order", "phones")).alias("f"))
    return first.select("word", F.size(F.filter("f.phones", lambda p: p.rlike("[0-9]$"))).cast("long").alias("n")).filter("n > 0")


def look_up(words: DataFrame, dictionary: DataFrame, column: str = "text", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``words`` with the columns of ``dictionary`` (word, unique, and others), null where it lacks the word.

    Words are far from evenly frequent, so a hash join would put all rows of the commonest into one task.  The dictionary's
    size is measured first: a small one is broadcast.  Of a larger one only the frequent words are (a thousand at most, as
    each has over a thousandth of the rows); the other words are hashed, and none of them is hot.
    """
    rest = [c for c in dictionary.columns if c != "word"]
    text = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in dictionary.columns), F.lit(16))
    if (dictionary.agg(F.sum(text)).first()[0] or 0) <= sent_bytes:
        return words.join(F.broadcast(dictionary.withColumnRenamed("word", column)), column, "left").select(*words.columns, *rest)
    counts = words.groupBy(F.col(column).alias("word")).agg(F.count("*").alias("__n")).filter("word is not null")
    total = counts.agg(F.sum("__n")).first()[0] or 0
    frequent = F.broadcast(counts.filter(F.col("__n") > total * FREQUENT).join(dictionary, "word", "left").select(F.col("word").alias(column), F.lit(True).alias("__frequent"), *(F.col(c).alias(f"__{c}") for c in rest)))
    split = words.join(frequent, column, "left")
    hot = split.filter("__frequent").select(*words.columns, *(F.col(f"__{c}").alias(c) for c in rest))
    cold = split.filter(F.col("__frequent").isNull()).select(*words.columns)
    return hot.unionByName(cold.join(dictionary.withColumnRenamed("word", column), column, "left").select(*words.columns, *rest))


def with_syllables(words: DataFrame, lexicon: DataFrame, column: str = "text", name: str = "syl", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Adds the syllables of each word: by the lexicon's stress digits, or where it lacks the word by the rule.

    Words are looked up in lower case.  A null word has null syllables.
    """
    keyed = words.withColumn("__key", F.lower(column))
    counted = look_up(keyed, stress_counts(lexicon.withColumn("word", F.lower("word"))).withColumnRenamed("n", "__syl"), "__key", sent_bytes)
    rule: Column = syllables(F.col(column))
    return counted.withColumn(name, F.when(F.col(column).isNotNull(), F.coalesce("__syl", rule))).select(*words.columns, name)
