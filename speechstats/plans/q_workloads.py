"""Whole workloads: from frames to measures by both routes, the result file, and streams over everything available."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clauses as c
from ..operators import measures as m
from ..operators import pauses as p
from ..operators import tokens as k
from ..operators import vad as v
from ..scratch import by_recording, scratch_path, stored
from ..sources import io
from ..streaming import jobs
from ..streaming.ordered import NARROW, STORE
from . import fixtures as fx
from .base import query
from .fixtures import FX
from .q_speech import _ALL, GAP, MEASURE_SQL, _rounded, marked
from .q_structure import _OWNER, _SMOOTH, _TIMES

#: Milliseconds of a frame, and the pause that counts among words timed by frames.
STEP, SHORT = 15, 30


def _sums(rows: str, inside: str, outside: str, d: str) -> str:
    return f"pp AS (SELECT utt_id, count(*) FILTER ({inside}) AS n_mc, coalesce(sum({d}) FILTER ({inside}), 0)::bigint AS sum_mc, count(*) FILTER ({outside}) AS n_ec, coalesce(sum({d}) FILTER ({outside}), 0)::bigint AS sum_ec FROM {rows} GROUP BY utt_id)"


_PA = "coalesce(n_mc, 0) AS n_mc, coalesce(sum_mc, 0) AS sum_mc, coalesce(n_ec, 0) AS n_ec, coalesce(sum_ec, 0) AS sum_ec"
_W1 = FX + _TIMES + _OWNER + f""", fw AS (SELECT f.* EXCLUDE (start_time, end_time), wt.start * {STEP} AS start_time, wt."end" * {STEP} AS end_time FROM fx_full f JOIN wt USING (utt_id, pos)),
ofl AS (SELECT ow.utt_id, ow.sent_id, ow.owner, f.fluent_idx FROM ow JOIN fx_dep d ON d.utt_id = ow.utt_id AND d.sent_id = ow.sent_id AND d.token_id = ow.token_id JOIN fx_full f ON f.utt_id = d.utt_id AND f.pos = d.pos WHERE f.fluent_idx IS NOT NULL),
cs AS (SELECT utt_id, sent_id, owner, min(fluent_idx) AS a, max(fluent_idx) AS b FROM ofl GROUP BY ALL),
en AS (SELECT DISTINCT utt_id, sent_id, unnest([a - 1, b]) AS i FROM cs WHERE (utt_id, sent_id) IN (SELECT (utt_id, sent_id) FROM cs GROUP BY utt_id, sent_id HAVING count(*) > 1)),
bd AS (SELECT DISTINCT utt_id, i AS fluent_idx FROM (SELECT *, min(i) OVER w AS lo, max(i) OVER w AS hi FROM en WINDOW w AS (PARTITION BY utt_id, sent_id)) WHERE i > lo AND i < hi),
cu AS (SELECT fw.*, bd.fluent_idx IS NOT NULL OR coalesce(lead(clause_id) OVER (PARTITION BY fw.utt_id ORDER BY pos) <> clause_id, false) AS ends FROM fw LEFT JOIN bd ON bd.utt_id = fw.utt_id AND bd.fluent_idx = fw.fluent_idx),
sc AS (SELECT *, coalesce(sum(ends::int) OVER (PARTITION BY utt_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cl FROM cu),
ga AS (SELECT utt_id, cl, start_time - lag(end_time) OVER w AS gap, lag(cl) OVER w AS before FROM sc WINDOW w AS (PARTITION BY utt_id ORDER BY pos)),
{_sums(f"(SELECT * FROM ga WHERE gap > {SHORT})", "cl = before", "cl <> before", "gap")},
du AS (SELECT utt_id, arg_max(end_time, pos) - arg_min(start_time, pos) AS dur FROM sc GROUP BY utt_id),
pa AS (SELECT w.* REPLACE (du.dur AS dur), {_PA} FROM fx_wp w JOIN du USING (utt_id) LEFT JOIN pp USING (utt_id)) SELECT utt_id, {_ALL} FROM pa"""


def recordings_to_measures(spark, d):
    """Frames to spans to word times; marked words; clauses from dependency edges; pauses; measures."""
    times = k.word_times(k.merge_spans(fx.frames(spark, d).drop("score")), fx.words(spark, d)).select("utt_id", "pos", (F.col("start") * STEP).alias("start_time"), (F.col("end") * STEP).alias("end_time"))
    # Edges and measures both need the timed words: frames are passed for them once.
    spoken = stored(marked(spark, d).select("utt_id", "pos", "text", "clause_id", "disfluency", "fluent_idx").join(times, ["utt_id", "pos"]), "spoken")
    edges = fx.dependencies(spark, d).join(spoken.select("utt_id", "pos", "fluent_idx"), ["utt_id", "pos"])
    split = c.split_clauses(spoken, c.clause_boundaries(c.clause_owner(edges)))
    return _rounded(m.extract(split, min_pause=SHORT))


@query("w1_recordings_to_measures", _W1)
def _(spark, d):
    """The whole way from recordings to measures on one partitioning."""
    with by_recording(spark, fx.tasks(spark, d)):
        return stored(recordings_to_measures(spark, d), "measures")


_SEGMENTS = _SMOOTH + """, ed AS (SELECT *, coalesce(lag(state) OVER w, false) <> state AS change, max(frame) OVER (PARTITION BY utt_id) AS fin FROM sm WINDOW w AS (PARTITION BY utt_id ORDER BY frame)),
nx AS (SELECT *, lead(frame) OVER (PARTITION BY utt_id ORDER BY frame) AS upto FROM ed WHERE change)"""
_W2 = FX + _SEGMENTS + f""", sg AS (SELECT utt_id, frame * 30 AS a, coalesce(upto, fin) * 30 AS b FROM nx WHERE state),
si AS (SELECT * FROM (SELECT utt_id, b AS start_time, lead(a) OVER (PARTITION BY utt_id ORDER BY a) AS end_time FROM sg) WHERE end_time IS NOT NULL),
cl AS (SELECT utt_id, clause_id, arg_min(start_time, pos) AS c_start, arg_max(end_time, pos) AS c_end FROM fx_full GROUP BY utt_id, clause_id),
lo AS (SELECT utt_id, end_time - start_time AS d, EXISTS (SELECT 1 FROM cl WHERE cl.utt_id = si.utt_id AND c_start < si.start_time AND si.end_time < c_end) AS inside FROM si),
{_sums(f"(SELECT * FROM lo WHERE d > {GAP})", "inside", "NOT inside", "d")},
pa AS (SELECT w.*, {_PA} FROM fx_wp w LEFT JOIN pp USING (utt_id)) SELECT utt_id, {_ALL} FROM pa"""


@query("w2_silences_to_measures", _W2)
def _(spark, d):
    """Voice activity to segments to silences, located among clauses; measures from these pauses."""
    # Frames, clauses and sums of words all need the marked words: these are made once.
    w = stored(marked(spark, d).select("utt_id", "pos", "text", "clause_id", "disfluency", "start_time", "end_time"), "words")
    segments = v.smooth_segments(fx.frames(spark, d, w)).select("utt_id", F.col("start_ms").alias("start_time"), F.col("end_ms").alias("end_time"))
    located = p.locate_pauses(p.silences(segments), c.clause_intervals(w))
    return _rounded(m.fluency_measures(m.fluency_params(w, located, min_pause=GAP)))


_NAMES = {"mid_clause_p_dur": "mid_clause_p-dur", "end_clause_p_dur": "end_clause_p-dur"}
_CSV = ", ".join(f'round({x}, 6) AS "{_NAMES.get(name, name)}"' for name, x in MEASURE_SQL.items())


@query("a15_measures_file", FX + f"SELECT utt_id AS filename, {_CSV} FROM fx_params")
def _(spark, d):
    """Written as CSV and read back."""
    w, path = marked(spark, d), scratch_path(spark, "measures")
    io.write_measures(_rounded(m.extract(w, min_pause=GAP)), path)
    back = spark.read.option("header", True).csv(path)
    return back.select(F.col("filename").cast("long").alias("filename"), *(F.col(f"`{x}`").cast("double").alias(x) for x in back.columns if x != "filename"))


def _streamed(rows: DataFrame, place: str, job: Callable[[DataFrame], DataFrame], name: str, last: tuple | None = None) -> DataFrame:
    """Writes ``rows`` in an order that tears recordings apart, streams them in about three micro-batches through ``job``
    into a table, and reads that.  ``last`` is a row that follows all others.

    Files are read in the order they were written: first a third of the places of every recording, then another, then the
    rest.  Each third is a pass over ``rows``, which are not shuffled for it; give rows that are cheap to read.
    """
    spark = rows.sparkSession
    source, sink, log = (scratch_path(spark, f"{name}-{x}") for x in ("in", "out", "log"))
    for third in range(3):
        rows.filter(F.pmod(F.xxhash64(place), F.lit(3)) == third).write.mode("append").parquet(source)
    each = max(1, -(-len(spark.read.schema(rows.schema).parquet(source).inputFiles()) // 3))
    if last is not None:
        spark.createDataFrame([last], rows.schema).write.mode("append").parquet(source)
    own = dict([STORE]) | NARROW
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        out = job(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(source))
        out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(out.schema).parquet(sink)


@query("t1_stream_vad", FX + _SEGMENTS + " SELECT 'u' || utt_id AS utt_id, frame * 30 AS start_ms, upto * 30 AS end_ms FROM nx WHERE state AND upto IS NOT NULL")
def _(spark, d):
    """Segments that close within the stream; ids are strings."""
    ends = stored(fx.words(spark, d).groupBy("utt_id").agg(F.max("end_time").alias("end_time")), "ends")
    flags = fx.frames(spark, d, ends).select(F.concat(F.lit("u"), "utt_id").alias("utt_id"), F.col("frame").cast("long").alias("frame"), "is_speech")
    return _streamed(flags, "frame", lambda s: jobs.stream_vad(s, idle_ms=None), "vad").filter("not late").drop("late")


@query("t2_stream_pauses", FX + "SELECT 'u' || utt_id AS utt_id, location, start_time::double AS start_time, end_time::double AS end_time, false AS late FROM fx_pauses")
def _(spark, d):
    words = marked(spark, d).select(F.concat(F.lit("u"), "utt_id").alias("utt_id"), F.col("pos").cast("long").alias("pos"), "clause_id", F.col("start_time").cast("double").alias("start_time"), F.col("end_time").cast("double").alias("end_time"))
    return _streamed(stored(words, "words"), "pos", lambda s: jobs.stream_pauses(s, GAP, None), "pauses")


@query("t3_stream_runs", FX + """, st AS (SELECT *, sum(CASE WHEN start_time - before < 250 THEN 0 ELSE 1 END) OVER (PARTITION BY utt_id ORDER BY pos) AS run FROM (SELECT *, lag(end_time) OVER (PARTITION BY utt_id ORDER BY pos) AS before FROM fx_words))
SELECT utt_id, min(start_time) AS start_ms, max(end_time) AS end_ms, count(*) AS n_words FROM st GROUP BY utt_id, run""")
def _(spark, d):
    """Runs in append mode, with the last ones brought out by a word that follows all."""
    words = stored(fx.words(spark, d).select("utt_id", F.col("pos").cast("long").alias("pos"), "start_time", "end_time"), "words")
    ms = words.agg(F.max("end_time")).first()[0] or 0
    return _streamed(words, "pos", lambda s: jobs.speech_runs(s, GAP, f"{ms} milliseconds"), "runs", jobs.end_of_input(3 * ms)).filter("utt_id >= 0")
