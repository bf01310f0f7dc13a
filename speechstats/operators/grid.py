"""Annotation tiers of an utterance and their text forms.  tiers(utt_id, tier, kind, seq, xmin, xmax, mark)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import by_utt
from .clauses import clause_texts, utterance_texts

# Tiers in the order of a grid, and their kinds.
TIERS = [("transcript", "interval"), ("pause", "interval"), ("filler", "point"), ("disflu", "point"), ("rep", "point"), ("self", "point"), ("false", "point")]


def _xmax(tagged: DataFrame, pauses: DataFrame) -> DataFrame:
    """utt_id, x: the end of the last word or pause."""
    ends = tagged.groupBy("utt_id").agg(F.max_by("end_time", "pos").alias("x"))
    last = pauses.groupBy("utt_id").agg(F.max_by("end_time", "seq").alias("p"))
    return ends.join(last, "utt_id", "left").select("utt_id", F.greatest("x", F.coalesce("p", "x")).alias("x"))


def _filled(items: DataFrame, gap, ends: DataFrame, tier: str) -> DataFrame:
    """Items (utt_id, n, a, b, mark) with empty intervals in the gaps where ``gap`` holds, and at the end."""
    w = Window.partitionBy("utt_id").orderBy("n")
    zero = F.lit(0).cast(items.schema["a"].dataType)
    before = items.withColumn("before", F.coalesce(F.lag("b").over(w), zero))
    own = F.struct(F.col("a").alias("a"), F.col("b").alias("b"), F.col("mark").alias("mark"))
    empty = F.struct(F.col("before").alias("a"), F.col("a").alias("b"), F.lit("").alias("mark"))
    rows = before.select("utt_id", "n", F.posexplode(F.when(gap, F.array(empty, own)).otherwise(F.array(own))).alias("k", "i")).select("utt_id", "n", "k", "i.*")
    tails = ends.join(items.groupBy("utt_id").agg(F.max_by("b", "n").alias("e")), "utt_id", "left").withColumn("e", F.coalesce("e", zero)).filter("e < x")
    all_ = rows.union(tails.select("utt_id", F.lit(1 << 40), F.lit(0), F.col("e"), F.col("x"), F.lit("")))
    seq = F.row_number().over(Window.partitionBy("utt_id").orderBy("n", "k")) - 1
    return all_.select("utt_id", F.lit(tier).alias("tier"), F.lit("interval").alias("kind"), seq.alias("seq"), F.col("a").alias("xmin"), F.col("b").alias("xmax"), "mark")


def transcript_tier(tagged: DataFrame, pauses: DataFrame) -> DataFrame:
    """Fluent clause texts; a gap before a clause is filled if it is a gap and not within rounding of none."""
    texts = clause_texts(tagged)
    spans = tagged.groupBy("utt_id", "clause_id").agg(F.min_by("start_time", "pos").alias("a"), F.max_by("end_time", "pos").alias("b"))
    items = spans.join(texts, ["utt_id", "clause_id"]).select("utt_id", F.col("clause_id").cast("long").alias("n"), "a", "b", F.col("text_fluent").alias("mark"))
    close = F.abs(F.col("before") - F.col("a")) <= 1e-9 * F.greatest(F.abs("before"), F.abs("a"))
    return _filled(items, ~close & (F.col("a") > F.col("before")), _xmax(tagged, pauses), "transcript")


def pause_tier(tagged: DataFrame, pauses: DataFrame) -> DataFrame:
    """Pause locations; a gap is filled wherever the last end and the next start differ."""
    items = pauses.select("utt_id", F.col("seq").cast("long").alias("n"), F.col("start_time").alias("a"), F.col("end_time").alias("b"), F.col("location").alias("mark"))
    return _filled(items, F.col("before") != F.col("a"), _xmax(tagged, pauses), "pause")


def point_tiers(tagged: DataFrame) -> DataFrame:
    """Disfluent words as points: fillers in a tier of their own, others in ``disflu`` and in their kind's tier."""
    kind = F.col("disfluency")
    tiers = (
        F.when(kind == "FILLER", F.array(F.lit("filler")))
        .when(kind == "REPETITION", F.array(F.lit("disflu"), F.lit("rep")))
        .when(kind == "SELF_REPAIR", F.array(F.lit("disflu"), F.lit("self")))
        .when(kind == "FALSE_START", F.array(F.lit("disflu"), F.lit("false")))
        .otherwise(F.array(F.lit("disflu")))
    )
    rows = tagged.filter(kind.isNotNull()).select("utt_id", "pos", "start_time", "text", F.explode(tiers).alias("tier"))
    seq = F.row_number().over(Window.partitionBy("utt_id", "tier").orderBy("pos")) - 1
    return rows.select("utt_id", "tier", F.lit("point").alias("kind"), seq.alias("seq"), F.col("start_time").alias("xmin"), F.col("start_time").alias("xmax"), F.col("text").alias("mark"))


def to_grid(tagged: DataFrame, pauses: DataFrame) -> DataFrame:
    """All seven tiers."""
    return transcript_tier(tagged, pauses).unionByName(pause_tier(tagged, pauses)).unionByName(point_tiers(tagged))


def _arrays(tagged: DataFrame, min_pause: float) -> DataFrame:
    """utt_id, x (the grid's end) and an array of (a, b, mark) for each tier, in order.

    Words carry the pause before them as a value, are collected by clause and the clauses by utterance: all on one hash
    exchange on utt_id.  A row holds one utterance.
    """
    end, clause = F.lag("end_time").over(by_utt()), F.lag("clause_id").over(by_utt())
    w = tagged.withColumns({"__end": end, "__same": F.col("clause_id") == clause})
    item = lambda a, b, mark: F.struct("pos", F.col(a).alias("a"), F.col(b).alias("b"), mark.alias("mark"))
    pause = F.when(F.col("start_time") - F.col("__end") >= min_pause, item("__end", "start_time", F.when(F.col("__same"), "CI").otherwise("CE")))
    point = F.when(F.col("disfluency").isNotNull(), F.struct("pos", F.col("start_time").alias("a"), F.col("start_time").alias("b"), F.col("text").alias("mark"), F.col("disfluency").alias("kind")))
    spoken = F.array_sort(F.collect_list(F.when(F.col("disfluency").isNull(), F.struct("pos", "text"))))
    clauses = w.groupBy("utt_id", "clause_id").agg(
        F.min_by("start_time", "pos").alias("a"), F.max_by("end_time", "pos").alias("b"), F.array_join(F.transform(spoken, lambda x: x["text"]), " ").alias("mark"),
        F.collect_list(pause).alias("pauses"), F.collect_list(point).alias("points"), F.max(F.struct("pos", "end_time")).alias("last"),
    )
    whole = clauses.groupBy("utt_id").agg(
        F.array_sort(F.collect_list(F.struct("clause_id", "a", "b", "mark"))).alias("clauses"), F.array_sort(F.flatten(F.collect_list("pauses"))).alias("pauses"),
        F.array_sort(F.flatten(F.collect_list("points"))).alias("points"), F.max("last").alias("last"),
    )
    last = F.get("pauses", F.size("pauses") - 1)["b"]
    ended = whole.withColumn("x", F.greatest("last.end_time", F.coalesce(last, "last.end_time")))
    zero, x = F.lit(0).cast(tagged.schema["start_time"].dataType), F.col("x")
    close = lambda before, a: F.abs(before - a) <= 1e-9 * F.greatest(F.abs(before), F.abs(a))
    kinds = {"filler": ["FILLER"], "rep": ["REPETITION"], "self": ["SELF_REPAIR"], "false": ["FALSE_START"]}
    own = {tier: F.filter("points", _is(F.array(*map(F.lit, names)))) for tier, names in kinds.items()} | {"disflu": F.filter("points", lambda q: q["kind"] != "FILLER")}
    own |= {"transcript": _tiled(F.col("clauses"), lambda before, a: ~close(before, a) & (a > before), x, zero), "pause": _tiled(F.col("pauses"), lambda before, a: before != a, x, zero)}
    return ended.select("utt_id", "x", *(own[t].alias(t) for t, _ in TIERS))


def _is(names: Column) -> Callable[[Column], Column]:
    return lambda q: F.array_contains(names, q["kind"])


def _tiled(items: Column, gap: Callable[[Column, Column], Column], x: Column, zero: Column) -> Column:
    """Items with empty intervals in the gaps before them and up to ``x``."""
    span = lambda a, b, mark: F.struct(a.alias("a"), b.alias("b"), mark.alias("mark"))
    before = lambda i: F.coalesce(F.get(items, i - 1)["b"], zero)
    own = lambda it: span(it["a"], it["b"], it["mark"])
    filled = F.flatten(F.transform(items, lambda it, i: F.when(gap(before(i), it["a"]), F.array(span(before(i), it["a"], F.lit("")), own(it))).otherwise(F.array(own(it)))))
    end = before(F.size(items))
    return F.when(end < x, F.concat(filled, F.array(span(end, x, F.lit(""))))).otherwise(filled)


def grid(tagged: DataFrame, min_pause: float = 0.25) -> DataFrame:
    """All seven tiers with the pauses between the words themselves: what ``to_grid`` gives with ``detect_pauses``, in one pass."""
    row = lambda tier, kind: F.transform(tier, lambda it, i: F.struct(F.lit(tier).alias("tier"), F.lit(kind).alias("kind"), i.alias("seq"), it["a"].alias("xmin"), it["b"].alias("xmax"), it["mark"].alias("mark")))
    return _arrays(tagged, min_pause).select("utt_id", F.explode(F.concat(*(row(t, k) for t, k in TIERS))).alias("t")).select("utt_id", "t.*")


def textgrid(tagged: DataFrame, min_pause: float = 0.25) -> DataFrame:
    """utt_id, text: the long text form of ``grid``, in the same pass."""
    tier = lambda name, kind: F.array_join(F.transform(name, lambda it, i: _item(kind, i + 1, it["a"], it["b"], it["mark"])), "")
    parts = [F.concat(_tier_head(F.lit(no), F.lit(t), F.lit(k), F.col("x"), F.size(t)), tier(t, k)) for no, (t, k) in enumerate(TIERS, 1)]
    return _arrays(tagged, min_pause).select("utt_id", F.concat(_top(F.col("x")), *parts).alias("text"))


def _number(value: Column) -> Column:
    return value.cast("double").cast("string")


def _item(kind: str, n: Column, a: Column, b: Column, mark: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(mark, F.lit('"'), F.lit('""')), F.lit('"'))
    if kind == "interval":
        return F.concat(F.lit("        intervals ["), n.cast("string"), F.lit("]:\n            xmin = "), _number(a), F.lit("\n            xmax = "), _number(b), F.lit("\n            text = "), quoted, F.lit("\n"))
    return F.concat(F.lit("        points ["), n.cast("string"), F.lit("]:\n            number = "), _number(a), F.lit("\n            mark = "), quoted, F.lit("\n"))


def _tier_head(no: Column, name: Column, kind: Column, x: Column, n: Column) -> Column:
    interval = kind == "interval"
    return F.concat(
        F.lit("    item ["), no.cast("string"), F.lit(']:\n        class = "'), F.when(interval, "IntervalTier").otherwise("TextTier"), F.lit('"\n        name = "'), name, F.lit('"\n        xmin = 0.0\n        xmax = '), _number(x),
        F.lit("\n        "), F.when(interval, "intervals").otherwise("points"), F.lit(": size = "), n.cast("string"), F.lit("\n"),
    )


def _top(x: Column) -> Column:
    return F.concat(F.lit('File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0.0\nxmax = '), _number(x), F.lit(f"\ntiers? <exists>\nsize = {len(TIERS)}\nitem []:\n"))


def render_textgrid(tiers: DataFrame, utterances: DataFrame) -> DataFrame:
    """utt_id, text: the long text form of every utterance's grid; tiers without items are written empty.

    ``utterances``: utt_id, x (the grid's end).  Points are written as text points: ``number`` and ``mark``.
    """
    of = lambda kind: _item(kind, F.col("seq") + 1, F.col("xmin"), F.col("xmax"), F.col("mark"))
    items = tiers.withColumn("item", F.when(F.col("kind") == "interval", of("interval")).otherwise(of("point")))
    bodies = items.groupBy("utt_id", "tier").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("seq", "item"))).alias("i"))
    bodies = bodies.select("utt_id", "tier", "n", F.array_join("i.item", "").alias("body"))
    names = F.explode(F.array(*(F.struct(F.lit(k).alias("no"), F.lit(t).alias("tier"), F.lit(kind).alias("kind")) for k, (t, kind) in enumerate(TIERS, 1))))
    full = utterances.select("utt_id", "x", names.alias("t")).select("utt_id", "x", "t.*").join(bodies, ["utt_id", "tier"], "left")
    head = F.concat(_tier_head(F.col("no"), F.col("tier"), F.col("kind"), F.col("x"), F.coalesce("n", F.lit(0))), F.coalesce("body", F.lit("")))
    whole = full.withColumn("part", head).groupBy("utt_id").agg(F.first("x").alias("x"), F.array_sort(F.collect_list(F.struct("no", "part"))).alias("p"))
    return whole.select("utt_id", F.concat(_top(F.col("x")), F.array_join("p.part", "")).alias("text"))


def annotated_text(tagged: DataFrame) -> DataFrame:
    """utt_id, text: two lines, all words and fluent words, clauses separated by `` :: ``."""
    t = utterance_texts(tagged, " :: ")
    return t.select("utt_id", F.concat(F.lit("text_without_pruning: "), "text_full", F.lit("\ntext_with_pruning: "), "text_fluent").alias("text"))


def grid_ends(tagged: DataFrame, pauses: DataFrame) -> DataFrame:
    return _xmax(tagged, pauses)
