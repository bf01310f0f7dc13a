"""Queries over the derived speech tables: tagging, pauses, measures.  Times are integer milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import lexicon as x
from ..operators import measures as m
from ..operators import pauses as p
from ..operators import tagging as t
from . import fixtures as fx
from .fixtures import FX
from .base import query

GAP = 250


def marked(spark: SparkSession, d: str) -> DataFrame:
    """Words with fillers, sentences (as clauses), repairs and fluent index; one exchange on utt_id."""
    w = t.with_fluent_idx(t.mark_fillers(fx.tags(spark, d)))
    w = t.assign_sentences(w, "eos").drop("fluent_idx")
    return t.with_fluent_idx(t.mark_repairs(w).withColumn("clause_id", F.col("sent_id"))).drop("tag", "eos")


@query("d1_mark_fillers", FX + "SELECT utt_id, pos, text, d0 AS disfluency FROM fx_fl")
def _(spark, d):
    return t.mark_fillers(fx.words(spark, d)).select("utt_id", "pos", "text", "disfluency")


@query("d2_fluent_idx", FX + "SELECT utt_id, pos, disfluency, coalesce(fluent_idx, -1) AS fluent_idx FROM fx_full")
def _(spark, d):
    return marked(spark, d).select("utt_id", "pos", "disfluency", F.coalesce("fluent_idx", F.lit(-1)).alias("fluent_idx"))


@query("d3_first_subword", FX + "SELECT utt_id, pos, (utt_id + pos) % 3 AS start, length(text) % 4 AS \"end\" FROM fx_words WHERE (utt_id + pos) % 3 = 0 AND length(text) % 4 <> 0")
def _(spark, d):
    w = fx.words(spark, d).select("utt_id", "pos", ((F.col("utt_id") + F.col("pos")) % 3).alias("start"), (F.length("text") % 4).alias("end"))
    return t.first_subword(w)


@query("d4_argmax_tags", FX + "SELECT utt_id, pos, CASE WHEN a >= b AND a >= c THEN 'O' WHEN b >= c THEN 'IE' ELSE 'C' END AS tag FROM (SELECT utt_id, pos, (utt_id * 7 + pos) % 5 AS a, (pos * 3) % 5 AS b, length(text) % 5 AS c FROM fx_words)")
def _(spark, d):
    w = fx.words(spark, d).withColumn("logits", F.array((F.col("utt_id") * 7 + F.col("pos")) % 5, (F.col("pos") * 3) % 5, F.length("text") % 5))
    return t.argmax_tags(w, ["O", "IE", "C"]).select("utt_id", "pos", "tag")


@query("d5_tag_sequences", FX + ", q AS (SELECT *, row_number() OVER (PARTITION BY utt_id, sent_id ORDER BY pos) AS k FROM fx_full) SELECT utt_id, sent_id, pos, CASE WHEN k > 40 THEN 'O' WHEN length(text) > 4 THEN 'I' ELSE 'O' END AS tag FROM q")
def _(spark, d):
    """A deterministic stand-in for a model that cuts sequences off behind 40 words."""
    return t.tag_sequences(marked(spark, d), lambda: lambda texts: [["I" if len(w) > 4 else "O" for w in x[:40]] for x in texts])


@query("d6_sentences", FX + "SELECT utt_id, pos, sent_id FROM fx_se")
def _(spark, d):
    return t.assign_sentences(t.mark_fillers(fx.words(spark, d)), "eos").select("utt_id", "pos", "sent_id")


@query("d7_repair_spans", FX + "SELECT utt_id, sent_id, span_id, first_pos, reparandum, correction FROM fx_spans")
def _(spark, d):
    return t.repair_spans(t.assign_sentences(t.mark_fillers(fx.tags(spark, d)), "eos"))


@query("d8_classify_repairs", FX + "SELECT utt_id, pos, text, disfluency FROM fx_marked WHERE disfluency IN ('REPETITION', 'SELF_REPAIR')")
def _(spark, d):
    return marked(spark, d).filter(F.col("disfluency").isin("REPETITION", "SELF_REPAIR")).select("utt_id", "pos", "text", "disfluency")


@query("d8_classify_spans", FX + "SELECT utt_id, sent_id, span_id, CASE WHEN reparandum = correction THEN 'REPETITION' ELSE 'SELF_REPAIR' END AS kind FROM fx_spans")
def _(spark, d):
    return t.classify_repairs(t.repair_spans(t.assign_sentences(t.mark_fillers(fx.tags(spark, d)), "eos"))).select("utt_id", "sent_id", "span_id", "kind")


@query("d9_fluent_view", FX + "SELECT utt_id, pos, text, fluent_idx FROM fx_full WHERE disfluency IS NULL")
def _(spark, d):
    return t.fluent(marked(spark, d)).select("utt_id", "pos", "text", "fluent_idx")


@query("d19_annotate", FX + """, marks AS (SELECT utt_id, clause_id, fluent_idx, 'OTHER' AS kind FROM fx_full WHERE fluent_idx % 7 = 3),
j AS (SELECT f.*, coalesce(f.disfluency, m.kind) AS dis FROM fx_full f LEFT JOIN marks m USING (utt_id, clause_id, fluent_idx))
SELECT utt_id, pos, dis AS disfluency, CASE WHEN dis IS NULL THEN count(*) FILTER (dis IS NULL) OVER (PARTITION BY utt_id ORDER BY pos) - 1 ELSE -1 END AS fluent_idx FROM j""")
def _(spark, d):
    w = marked(spark, d)
    marks = w.filter("fluent_idx % 7 = 3").select("utt_id", "clause_id", "fluent_idx", F.lit("OTHER").alias("kind"))
    return t.annotate(w, marks).select("utt_id", "pos", "disfluency", F.coalesce("fluent_idx", F.lit(-1)).alias("fluent_idx"))


@query("e1_detect_pauses", FX + "SELECT utt_id, seq, location, start_time, end_time FROM fx_pauses")
def _(spark, d):
    return p.detect_pauses(marked(spark, d), GAP)


_CLAUSES = "cl AS (SELECT utt_id, clause_id, arg_min(start_time, pos) AS c_start, arg_max(end_time, pos) AS c_end FROM fx_full GROUP BY utt_id, clause_id), si AS (SELECT utt_id, start_time + CASE WHEN seq % 5 = 0 THEN -40 ELSE 0 END AS start_time, end_time + CASE WHEN seq % 3 = 0 THEN 30 ELSE 0 END AS end_time FROM fx_pauses)"
_LOCATE = FX + f", {_CLAUSES} SELECT utt_id, start_time, end_time, CASE WHEN EXISTS (SELECT 1 FROM cl WHERE cl.utt_id = si.utt_id AND c_start < si.start_time AND si.end_time < c_end) THEN 'CI' ELSE 'CE' END AS location FROM si"


def _silences_and_clauses(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    w = marked(spark, d)
    found = p.detect_pauses(w, GAP)
    si = found.select("utt_id", (F.col("start_time") + F.when(F.col("seq") % 5 == 0, -40).otherwise(0)).alias("start_time"), (F.col("end_time") + F.when(F.col("seq") % 3 == 0, 30).otherwise(0)).alias("end_time"))
    return si, w.groupBy("utt_id", "clause_id").agg(F.min_by("start_time", "pos").alias("start_time"), F.max_by("end_time", "pos").alias("end_time"))


@query("e2_locate_pauses", _LOCATE)
def _(spark, d):
    return p.locate_pauses(*_silences_and_clauses(spark, d))


@query("e2_locate_pauses_range_join", _LOCATE)
def _(spark, d):
    """The rows that a range join gives, by the same pass."""
    return p.locate_pauses(*_silences_and_clauses(spark, d))


_CROSSING = _CLAUSES + """, ov AS (SELECT utt_id, clause_id, c_start, c_end FROM cl UNION ALL SELECT a.utt_id, a.clause_id, a.c_start + 100, b.c_end - 100 FROM cl a JOIN cl b ON b.utt_id = a.utt_id AND b.clause_id = a.clause_id + 1
 UNION ALL SELECT a.utt_id, a.clause_id, a.c_start, b.c_end FROM cl a JOIN cl b ON b.utt_id = a.utt_id AND b.clause_id = a.clause_id + 3 WHERE a.clause_id % 5 = 1)"""


@query("e2_locate_pauses_overlapping", FX + f", {_CROSSING} SELECT utt_id, start_time, end_time, CASE WHEN EXISTS (SELECT 1 FROM ov WHERE ov.utt_id = si.utt_id AND c_start < si.start_time AND si.end_time < c_end) THEN 'CI' ELSE 'CE' END AS location FROM si")
def _(spark, d):
    """Clauses that cross their neighbours, and clauses around clauses."""
    si, cl = _silences_and_clauses(spark, d)
    by = Window.partitionBy("utt_id").orderBy("clause_id")
    ends = cl.select("utt_id", "clause_id", "start_time", "end_time", F.lead("end_time", 1).over(by).alias("e1"), F.lead("end_time", 3).over(by).alias("e3"))
    crossing = ends.filter("e1 is not null").select("utt_id", F.col("start_time") + 100, F.col("e1") - 100)
    around = ends.filter("e3 is not null and clause_id % 5 = 1").select("utt_id", "start_time", "e3")
    return p.locate_pauses(si, cl.select("utt_id", "start_time", "end_time").union(crossing).union(around))


@query("e3_silences", FX + "SELECT * FROM (SELECT utt_id, end_time AS start_time, lead(start_time) OVER (PARTITION BY utt_id ORDER BY start_time) AS end_time FROM fx_words) WHERE end_time IS NOT NULL")
def _(spark, d):
    return p.silences(fx.words(spark, d))


@query("e4_voiced", FX + """, du AS (SELECT utt_id, max(end_time) + 500 AS duration FROM fx_words GROUP BY utt_id),
ev AS (SELECT utt_id, start_time, end_time FROM fx_pauses UNION ALL SELECT utt_id, duration, duration FROM du)
SELECT utt_id, a AS start_time, b AS end_time FROM (SELECT utt_id, coalesce(lag(end_time) OVER (PARTITION BY utt_id ORDER BY start_time), 0) AS a, start_time AS b FROM ev) WHERE a < b""")
def _(spark, d):
    w = marked(spark, d)
    return p.voiced(p.detect_pauses(w, GAP), w.groupBy("utt_id").agg((F.max("end_time") + 500).alias("duration")))


@query("e10_sample_to_sec", FX + "SELECT utt_id, round((start_time * 16) / 16000.0::double, 6) AS start_time, round((end_time * 16) / 16000.0::double, 6) AS end_time FROM fx_words")
def _(spark, d):
    w = fx.words(spark, d).select("utt_id", (F.col("start_time") * 16).alias("start_time"), (F.col("end_time") * 16).alias("end_time"))
    return p.sample_to_sec(w, 16000).select("utt_id", F.round("start_time", 6).alias("start_time"), F.round("end_time", 6).alias("end_time"))


@query("f1_syllables", FX + "SELECT utt_id, pos, text, syl::bigint AS syl FROM fx_syl")
def _(spark, d):
    return fx.words(spark, d).select("utt_id", "pos", "text", m.syllables(F.col("text")).alias("syl"))


#: A third of the words, with two pronunciations: as many vowels as letters modulo 4 (none: not in the lexicon), and one more.
_LEXICON = """lx AS (SELECT DISTINCT text AS word, length(text) % 4 AS n FROM fx_words WHERE length(text) % 3 <> 1 AND length(text) % 4 > 0),
ls AS (SELECT f.*, coalesce(lx.n, f.syl)::bigint AS own FROM fx_syl f LEFT JOIN lx ON lx.word = f.text)"""


def _lexicon(spark: SparkSession, d: str) -> DataFrame:
    words = fx.words(spark, d).select("text").distinct().filter("length(text) % 3 <> 1")
    vowels = lambda n: F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("AH"), (k % 3).cast("string")))
    first = F.concat(F.array(F.lit("S")), F.when(F.length("text") % 4 > 0, vowels(F.length("text") % 4)).otherwise(F.array().cast("array<string>")), F.array(F.lit("T")))
    return words.select("text", F.explode(F.array(F.struct(F.lit(1).alias("order"), vowels(F.lit(4)).alias("phones")), F.struct(F.lit(0).alias("order"), first.alias("phones")))).alias("e")).select(F.when(F.col("text").rlike("^[a-z]+$"), F.upper("text")).otherwise(F.col("text")).alias("word"), "e.order", "e.phones")


@query("f1_lexicon_syllables", FX + f", {_LEXICON} SELECT utt_id, pos, text, own AS syl FROM ls")
def _(spark, d):
    return x.with_syllables(fx.words(spark, d).select("utt_id", "pos", "text"), _lexicon(spark, d))


@query("f2_params_by_lexicon", FX + f", {_LEXICON} SELECT utt_id, count(*) FILTER (disfluency IS NULL) AS n_word, coalesce(sum(own) FILTER (disfluency IS NULL), 0)::bigint AS n_syl FROM ls GROUP BY utt_id")
def _(spark, d):
    w = x.with_syllables(marked(spark, d), _lexicon(spark, d))
    return m.params_of_words(w, min_pause=GAP, syllable_col="syl").select("utt_id", "n_word", "n_syl")


_NAMES = ", ".join(m.SUMS)


def params(spark: SparkSession, d: str) -> DataFrame:
    return m.params_of_words(marked(spark, d), min_pause=GAP, keep=("conv_id", "speaker"))


@query("f2_params", FX + f"SELECT utt_id, {_NAMES} FROM fx_params")
def _(spark, d):
    return params(spark, d).select("utt_id", *m.SUMS)


@query("f2_params_unpruned", FX + "SELECT utt_id, count(*) AS n_word, sum(syl)::bigint AS n_syl FROM fx_syl GROUP BY utt_id")
def _(spark, d):
    w = marked(spark, d)
    return m.fluency_params(w, p.detect_pauses(w, GAP), pruning=False, min_pause=GAP).select("utt_id", "n_word", "n_syl")


_TOTALS = ", ".join(f"sum({c})::bigint AS {c}" for c in m.SUMS)


@query("f3_merge_params", FX + f"SELECT speaker, {_TOTALS} FROM fx_params GROUP BY speaker")
def _(spark, d):
    return m.merge_params(params(spark, d), "speaker")


@query("f3_rollup_params", FX + f"SELECT coalesce(speaker, 'all') AS speaker, coalesce(conv_id, -1) AS conv_id, {_TOTALS}, grouping(speaker, conv_id)::bigint AS level FROM fx_params GROUP BY ROLLUP (speaker, conv_id)")
def _(spark, d):
    out = m.rollup_params(params(spark, d), "speaker", "conv_id")
    return out.withColumn("speaker", F.coalesce("speaker", F.lit("all"))).withColumn("conv_id", F.coalesce("conv_id", F.lit(-1)))


def _ratio(x: str, y: str) -> str:
    return f"CASE WHEN {y} = 0 THEN NULL ELSE ({x})::double / ({y}) END"


_REP, _P, _S = "(repetition + self_repair + false_start)", "(n_mc + n_ec)", "(sum_mc + sum_ec)"
MEASURE_SQL = {
    "speech_rate": _ratio("n_syl", "dur"), "mid_clause_pause_ratio": _ratio("n_mc", "n_syl"), "end_clause_pause_ratio": _ratio("n_ec", "n_syl"),
    "mid_clause_p_dur": f"coalesce({_ratio('sum_mc', 'n_mc')}, 0)", "end_clause_p_dur": f"coalesce({_ratio('sum_ec', 'n_ec')}, 0)",
    "filled_pause_ratio": _ratio("filled", "n_syl"), "dysfluency_ratio": _ratio(_REP, "n_syl"), "dysfluency_rate": _ratio(_REP, "dur"),
    "repetition_ratio": _ratio("repetition", "n_syl"), "self_repair_ratio": _ratio("self_repair", "n_syl"), "false_start_ratio": _ratio("false_start", "n_syl"),
    "repair_false_ratio": _ratio("self_repair + false_start", "n_syl"), "articulation_rate": _ratio("n_syl", f"(dur - {_S})"), "phonation_time_rate": _ratio(f"dur - {_S}", "dur"),
    "mean_length_of_run": _ratio("n_syl", f"({_P} + 1)"), "articulation_rate_word": _ratio("n_word", f"(dur - {_S})"), "speech_rate_word": _ratio("n_word", "dur"),
    "mean_length_of_run_word": _ratio("n_word", f"({_P} + 1)"), "mean_pause_duration": f"CASE WHEN {_S} = 0 THEN 0 ELSE {_ratio(_S, _P)} END",
}


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if c in m.MEASURES else F.col(c) for c in df.columns))


_ALL = ", ".join(f"round({x}, 6) AS {name}" for name, x in MEASURE_SQL.items())


@query("g_measures", FX + f"SELECT utt_id, {_ALL} FROM fx_params")
def _(spark, d):
    """All 19 measures of every utterance, from tagged words: the flagship query."""
    return _rounded(m.fluency_measures(params(spark, d)))


@query("f6_extract", FX + f"SELECT utt_id, speaker, {_ALL} FROM fx_params")
def _(spark, d):
    return _rounded(m.extract(marked(spark, d), min_pause=GAP, keep=("speaker",)))


@query("f4_feature_switch", FX + f"SELECT utt_id, round({MEASURE_SQL['speech_rate']}, 6) AS speech_rate, round({MEASURE_SQL['mean_pause_duration']}, 6) AS mean_pause_duration FROM fx_params")
def _(spark, d):
    return _rounded(m.fluency_measures(params(spark, d), ["mean_pause_duration", "speech_rate"]))


@query("w3_speaker_measures", FX + f"SELECT speaker, {_ALL} FROM (SELECT speaker, {_TOTALS} FROM fx_params GROUP BY speaker)")
def _(spark, d):
    return _rounded(m.fluency_measures(m.merge_params(params(spark, d), "speaker"), keep=("speaker",)))


def _measure_query(name: str, number: int) -> None:
    @query(f"g{number}_{name}", FX + f"SELECT utt_id, round({MEASURE_SQL[name]}, 6) AS {name} FROM fx_params")
    def _(spark, d):
        return _rounded(m.fluency_measures(params(spark, d), [name]))


for _k, _name in enumerate(m.MEASURES, 1):
    _measure_query(_name, _k)


@query("f5_safe_div", FX + "SELECT utt_id, round(CASE WHEN n_mc = 0 THEN NULL ELSE n_word::double / n_mc END, 6) AS value FROM fx_params")
def _(spark, d):
    return params(spark, d).select("utt_id", F.round(m.safe_div(F.col("n_word"), F.col("n_mc")), 6).alias("value"))
