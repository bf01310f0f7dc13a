"""Functions that take a text apart once give what their rules give one after another over the whole text."""

import random

from pyspark.sql import functions as F

from speechstats.functions import text as x


def texts(alphabet, n, most, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(t,) for t in rows], "text string").repartition(4)


def differing(df, one, other):
    return [tuple(r) for r in df.select("text", one(F.col("text")).alias("a"), other(F.col("text")).alias("b")).filter("not a <=> b").limit(3).collect()]


def test_numbers(spark):
    alphabet = [*"0123456789", "1", "2000", "2004", "1900", "$", "$", "£", ".", ",", "st", "nd", "rd", "th", "s", " ", " ", "a", "\u0001", "é", "12345678901234567890"]
    rows = [*texts(alphabet, 3000, 12, 1), None, "", "$", "£.", "$$5", "5$6", "£$5", "1stone 1st2nd", "$5st £5th 1.5nd", "a" * 3000 + "7" * 30 + "." * 2000, "\u00011\u0001"]
    assert differing(frame(spark, rows), x.expand_numbers, x._in_steps) == []


def test_abbreviations(spark):
    alphabet = [*(short for short, _ in x.ABBREVIATIONS), *(short.upper() for short, _ in x.ABBREVIATIONS), ".", ".", ".", ".", " ", "x", "_", "\u0001", "é"]
    rows = [*texts(alphabet, 3000, 10, 2), None, "", "dr.co.", "co.dr.", "st.mr.st.", "xdr.co. mrs..mr."]
    assert differing(frame(spark, rows), x.expand_abbreviations, x._abbreviations_in_order) == []


def test_white_space_and_folding(spark):
    rows = [*texts([" ", " ", "\t", "\n", "\r", "\x0b", "\x0c", "a", "\xa0", "ß", "é", "…", "漢", "Æ"], 2000, 14, 3), None, ""]

    def folded(t):
        out = F.translate(t, x.FOLD_FROM, x.FOLD_TO)
        for old, new in x.FOLD_LONG:
            out = F.replace(out, F.lit(old), F.lit(new))
        return F.regexp_replace(out, r"[^\x00-\x7F]", "")

    df = frame(spark, rows)
    assert differing(df, x.collapse_whitespace, lambda t: F.regexp_replace(t, r"\s+", " ")) == []
    assert differing(df, x.fold_ascii, folded) == []
