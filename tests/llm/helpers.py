import os
import random

DIRS = [d for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01") if os.path.isdir(d)]
SMALL = "/root/testdata/sf0.001"


def documents(spark, rows, extra=True):
    """A documents frame from (doc_id, text) pairs, with a column whose name may clash."""
    full = [(i, t, "en", "src", len(t or ""), "x") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, word string")


def words(seed, n, vocabulary=5000):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))
