"""Clauses: splitting, lookup, intervals, texts, and clause boundaries from dependency edges."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BEFORE, by_utt, utt
from ..scratch import by_recording, stored

# Relations that mark a subordinate clause.
SUBORDINATE = ["csubj", "csubj:pass", "ccomp", "xcomp", "advcl", "acl", "acl:relcl"]


_NO_HEAD = -(1 << 62)


def split_clauses(tagged: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Splits clauses after the fluent words in ``boundaries`` (utt_id, fluent_idx); clause ids stay dense.

    Old and new boundaries are one flag, so a boundary at a clause's end, or in a clause of one word, changes nothing.
    Disfluent words behind a boundary go to the next clause.
    """
    cuts = boundaries.select("utt_id", "fluent_idx").distinct().withColumn("__cut", F.lit(1))
    joined = tagged.join(cuts, ["utt_id", "fluent_idx"], "left")
    ends = F.coalesce(F.col("__cut"), F.lit(0)).cast("boolean") | (F.lead("clause_id").over(by_utt()) != F.col("clause_id"))
    flagged = joined.withColumn("__end", F.coalesce(ends, F.lit(False)).cast("long"))
    return flagged.withColumn("clause_id", F.coalesce(F.sum("__end").over(by_utt().rowsBetween(*BEFORE)), F.lit(0))).drop("__cut", "__end")


def clause_of(tagged: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds clause_id to rows of (utt_id, fluent_idx); null where there is no such word."""
    return wanted.join(tagged.filter("fluent_idx is not null").select("utt_id", "fluent_idx", "clause_id"), ["utt_id", "fluent_idx"], "left")


def _nearest(token: list[int], head: list[int], marked: list[bool]) -> list[int | None]:
    parent, own = dict(zip(token, head, strict=True)), dict(zip(token, marked, strict=True))
    found: dict[int, int | None] = {}
    for t in token:
        path, at = {}, t
        while at not in found and at not in path and not own[at] and parent[at] in own and parent[at] != at:
            path[at] = True
            at = parent[at]
        owner = None if at in path else found.get(at, at)  # back on the path: a circle of heads, which no clause holds
        for x in [*path, at]:
            found[x] = owner
    return [found[t] for t in token]


def _queue(token: list[int], head: list[int], marked: list[bool]) -> list[int]:
    """Marks in ascending order against a queue of trees: a tree that lacks the current mark leaves the queue for good."""
    below: dict[int, list[int]] = {}
    for t, h in zip(token, head, strict=True):
        below.setdefault(h, []).append(t)
    owner = {t: 0 for t in token}  # number of the tree that holds the token
    marks = sorted(t for t, m in zip(token, marked, strict=True) if m)
    root = {0: next((t for t, h in zip(token, head, strict=True) if h not in set(token)), token[0])}
    waiting, trees = [0], 1
    mark = marks.pop(0) if marks else None
    while waiting and mark is not None:
        tree = waiting.pop(0)
        if owner[mark] != tree:
            continue
        part, stack = {}, [mark]  # each token once, also where heads run in a circle
        while stack:
            t = stack.pop()
            if owner[t] == tree and t not in part:
                part[t] = True
                stack += below.get(t, [])
        if root[tree] == mark:  # the whole tree: nothing is left to cut off
            part = {}
        for t in part:
            owner[t] = trees
        root[trees] = mark
        waiting += [tree, trees]
        trees += 1
        mark = marks.pop(0) if marks else None
    return [root[owner[t]] for t in token]


def clause_owner(dep: DataFrame, marks: Sequence[str] = tuple(SUBORDINATE), mode: str = "nearest") -> DataFrame:
    """Adds owner to edges: the token at the top of the clause that the token belongs to.

    ``nearest``: the nearest marked token at or above it, else the root.  ``queue``: the order-dependent rule.
    A token whose head is null, itself or has no row is a root.  Where heads run in a circle without a mark, the tokens on it and below
    it have no owner (null) under ``nearest``.  Sentences are short, so each one's edges are collected, pass a batch UDF as three arrays, and are exploded with all
    their columns: one exchange and no join.
    """
    if mode not in ("nearest", "queue"):
        raise ValueError(f"unknown mode: {mode}")
    find, subordinate = (_nearest if mode == "nearest" else _queue), list(marks)

    @F.pandas_udf("array<bigint>")
    def own(token: pd.Series, head: pd.Series, marked: pd.Series) -> pd.Series:
        return pd.Series([find(t.tolist(), h.tolist(), m.tolist()) for t, h, m in zip(token, head, marked, strict=True)])

    rest = [c for c in dep.columns if c not in ("utt_id", "sent_id")]
    edges = dep.groupBy("utt_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("token_id", *[c for c in rest if c != "token_id"]))).alias("__e"))
    owner = own(F.col("__e.token_id").cast("array<bigint>"), F.transform("__e", lambda e: F.coalesce(e["head"].cast("long"), F.lit(_NO_HEAD))), F.transform("__e", lambda e: F.coalesce(e["deprel"].isin(subordinate), F.lit(False))))
    z = edges.withColumn("__o", owner).select("utt_id", "sent_id", F.explode(F.arrays_zip("__e", "__o")).alias("__z"))
    return z.select(*(F.col(c) if c in ("utt_id", "sent_id") else F.col(f"__z.__e.{c}").alias(c) for c in dep.columns), F.col("__z.__o").alias("owner"))


def clause_owner_by_joins(dep: DataFrame, marks: Sequence[str] = tuple(SUBORDINATE)) -> DataFrame:
    """The ``nearest`` rule by pointer doubling, for trees too large for one row; same results, circles of heads included.

    Self-joins go on until no owner changes, so a tree of depth n takes about log2(n) of them; every round is written to the
    shared folder.  Rounds carry ids alone, and only tokens whose owner still moves; the other columns join once, at the end.
    There are no more rounds than the largest tree's token count has bits: what still moves then is on or below a circle.
    """
    keys = ["utt_id", "sent_id"]
    token = F.col("token_id").cast("long")
    heads = dep.select(*keys, token.alias("__head")).distinct().withColumn("__known", F.lit(True))
    known = dep.select(*keys, "token_id", "head", "deprel", F.col("head").cast("long").alias("__head")).join(heads, [*keys, "__head"], "left")
    root = F.coalesce(F.col("deprel").isin(list(marks)), F.lit(False)) | F.col("__known").isNull() | (F.col("token_id") == F.col("head"))
    with by_recording(dep.sparkSession):
        start = known.select(*keys, token.alias("token"), F.when(root, token).otherwise(F.col("__head")).alias("owner"), root.alias("owns"))
        now = stored(start.withColumn("moves", ~F.col("owns")), "owners")
    # A token owns if it is at the top of its clause.  On a circle of heads a pointer may come back to its own token, which owns nothing.
    largest = now.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    settled, moving = [now.filter("not moves")], now.filter("moves")
    for _ in range(int(largest).bit_length() + 1):
        if moving.isEmpty():
            break
        every = functools.reduce(DataFrame.union, [*settled, moving])
        nxt = every.select(*keys, F.col("token").alias("owner"), F.col("owner").alias("__next"), (F.col("owns") & (F.col("token") == F.col("owner"))).alias("__top"))
        step = moving.drop("owns", "moves").join(nxt.hint("merge"), [*keys, "owner"])
        step = stored(step.select(*keys, "token", F.col("__next").alias("owner"), F.col("__top").alias("owns"), (F.col("__next") != F.col("owner")).alias("moves")), "owners")
        settled.append(step.filter("not moves"))
        moving = step.filter("moves")
    found = functools.reduce(DataFrame.union, settled).filter("owns").select(*keys, F.col("token").alias("__token"), "owner")
    same = [dep[k] == found[k] for k in keys] + [dep["token_id"].cast("long") == found["__token"]]
    return dep.join(found.hint("merge"), functools.reduce(lambda x, y: x & y, same), "left").select(*(dep[c] for c in dep.columns), found["owner"])


def clause_boundaries(owned: DataFrame) -> DataFrame:
    """utt_id, fluent_idx: a boundary after each of these words.

    ``owned``: utt_id, sent_id, owner, fluent_idx (null for punctuation).  Of a sentence with two clauses at least, the
    words before each clause's first and each clause's last, less the smallest and the largest of these.  Rows are put
    together by ``utt_id`` once, for the clauses, the sentences and the distinct words alike.
    """
    spans = owned.filter("fluent_idx is not null").select("utt_id", "sent_id", "owner", "fluent_idx").repartition("utt_id").groupBy("utt_id", "sent_id", "owner").agg(F.min("fluent_idx").alias("a"), F.max("fluent_idx").alias("b"))
    sent = Window.partitionBy("utt_id", "sent_id")
    ends = spans.withColumn("n", F.count("*").over(sent)).filter("n > 1").select("utt_id", "sent_id", F.explode(F.array(F.col("a") - 1, F.col("b"))).alias("fluent_idx")).distinct()
    inner = ends.withColumn("lo", F.min("fluent_idx").over(sent)).withColumn("hi", F.max("fluent_idx").over(sent)).filter("fluent_idx > lo and fluent_idx < hi")
    return inner.select("utt_id", "fluent_idx").distinct()


def token_word_index(tokens: DataFrame) -> DataFrame:
    """Adds word_idx to parser tokens (utt_id, sent_id, token_id, start_char, end_char, deprel).

    Tokens that touch share a word; punctuation has none, and one that begins a sentence is not counted; a sentence
    that is a full stop alone is passed over.
    """
    order = Window.partitionBy("utt_id").orderBy("sent_id", "token_id")
    sent = Window.partitionBy("utt_id", "sent_id")
    alone = (F.count("*").over(sent) == 1) & (F.col("text") == ".") if "text" in tokens.columns else F.lit(False)
    t = tokens.withColumn("__alone", alone)
    end = F.last(F.when(~F.col("__alone"), F.col("end_char")), ignorenulls=True).over(order.rowsBetween(*BEFORE))
    t = t.withColumn("__new", (~F.col("__alone") & ~F.coalesce(F.col("start_char") == end, F.lit(False))).cast("long"))
    punct = F.col("deprel") == "punct"
    first = F.col("token_id") == F.min("token_id").over(sent)
    t = t.withColumn("__less", (punct & first & ~F.col("__alone")).cast("long"))
    index = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.coalesce(F.sum("__less").over(order.rowsBetween(*BEFORE)), F.lit(0)) - 1
    return t.withColumn("word_idx", F.when(~punct & ~F.col("__alone"), index)).drop("__alone", "__new", "__less")


def parser_text(tagged: DataFrame) -> DataFrame:
    """utt_id, text: fluent words by sentence, each sentence followed by ``". "``."""
    words = F.array_sort(F.collect_list(F.when(F.col("disfluency").isNull(), F.struct("pos", "text"))))
    sents = tagged.groupBy("utt_id", "sent_id").agg(F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("sent_id", "s")))
    return sents.groupBy("utt_id").agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["s"], F.lit(". "))), "").alias("text"))


def clause_intervals(tagged: DataFrame) -> DataFrame:
    """utt_id, clause_id, start_time, end_time, n_words: disfluent words included."""
    return tagged.groupBy("utt_id", "clause_id").agg(F.min_by("start_time", "pos").alias("start_time"), F.max_by("end_time", "pos").alias("end_time"), F.count("*").alias("n_words"))


def utterance_intervals(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("utt_id").agg(F.min_by("start_time", "pos").alias("start_time"), F.max_by("end_time", "pos").alias("end_time"))


def shorten(tagged: DataFrame, t: float) -> DataFrame:
    """Keeps the words before the first one that starts at ``t`` or later."""
    first = F.min(F.when(F.col("start_time") >= t, F.col("pos"))).over(utt())
    return tagged.withColumn("__first", first).filter("__first is null or pos < __first").drop("__first")


def clause_texts(tagged: DataFrame) -> DataFrame:
    """utt_id, clause_id, text_full, text_fluent."""
    word = F.struct("pos", "text")
    full, own = F.array_sort(F.collect_list(word)), F.array_sort(F.collect_list(F.when(F.col("disfluency").isNull(), word)))
    join = lambda a: F.array_join(F.transform(a, lambda w: w["text"]), " ")
    return tagged.groupBy("utt_id", "clause_id").agg(join(full).alias("text_full"), join(own).alias("text_fluent"))


def utterance_texts(tagged: DataFrame, between: str = " ") -> DataFrame:
    """utt_id, text_full, text_fluent: clause texts joined; a clause without fluent words adds an empty text."""
    order = F.array_sort(F.collect_list(F.struct("clause_id", "text_full", "text_fluent")))
    rows = clause_texts(tagged).groupBy("utt_id").agg(order.alias("c"))
    return rows.select("utt_id", F.array_join("c.text_full", between).alias("text_full"), F.array_join("c.text_fluent", between).alias("text_fluent"))
