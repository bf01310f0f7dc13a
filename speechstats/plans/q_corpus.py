"""Queries over grids, corpora, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as c
from ..operators import grid as g
from ..operators import pauses as p
from ..scratch import scratch_path
from ..sources import io
from ..streaming import jobs
from . import fixtures as fx
from .fixtures import FX
from .q_speech import GAP, marked
from .base import query

_TIERS = """, xm AS (SELECT utt_id, greatest(e, coalesce(pe, e)) AS x FROM (SELECT utt_id, arg_max(end_time, pos) AS e FROM fx_full GROUP BY utt_id) LEFT JOIN (SELECT utt_id, arg_max(end_time, seq) AS pe FROM fx_pauses GROUP BY utt_id) USING (utt_id)),
ct AS (SELECT utt_id, clause_id AS n, arg_min(start_time, pos) AS a, arg_max(end_time, pos) AS b, coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (disfluency IS NULL), '') AS mark FROM fx_full GROUP BY utt_id, clause_id),
cb AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY utt_id ORDER BY n), 0) AS before FROM ct),
t1 AS (SELECT utt_id, n, 1 AS k, a, b, mark FROM cb UNION ALL SELECT utt_id, n, 0, before, a, '' FROM cb WHERE a > before
 UNION ALL SELECT xm.utt_id, 1000000000, 0, e, x, '' FROM xm JOIN (SELECT utt_id, arg_max(b, n) AS e FROM ct GROUP BY utt_id) USING (utt_id) WHERE e < x),
tt AS (SELECT utt_id, 'transcript' AS tier, 'interval' AS kind, row_number() OVER (PARTITION BY utt_id ORDER BY n, k) - 1 AS seq, a AS xmin, b AS xmax, mark FROM t1),
pb AS (SELECT *, coalesce(lag(end_time) OVER (PARTITION BY utt_id ORDER BY seq), 0) AS before FROM fx_pauses),
p1 AS (SELECT utt_id, seq AS n, 1 AS k, start_time AS a, end_time AS b, location AS mark FROM pb UNION ALL SELECT utt_id, seq, 0, before, start_time, '' FROM pb WHERE before <> start_time
 UNION ALL SELECT xm.utt_id, 1000000000, 0, coalesce(e, 0), x, '' FROM xm LEFT JOIN (SELECT utt_id, arg_max(end_time, seq) AS e FROM fx_pauses GROUP BY utt_id) USING (utt_id) WHERE coalesce(e, 0) < x),
pt AS (SELECT utt_id, 'pause' AS tier, 'interval' AS kind, row_number() OVER (PARTITION BY utt_id ORDER BY n, k) - 1 AS seq, a AS xmin, b AS xmax, mark FROM p1),
po AS (SELECT utt_id, pos, start_time, text, unnest(CASE disfluency WHEN 'FILLER' THEN ['filler'] WHEN 'REPETITION' THEN ['disflu', 'rep'] WHEN 'SELF_REPAIR' THEN ['disflu', 'self'] ELSE ['disflu'] END) AS tier FROM fx_full WHERE disfluency IS NOT NULL),
dt AS (SELECT utt_id, tier, 'point' AS kind, row_number() OVER (PARTITION BY utt_id, tier ORDER BY pos) - 1 AS seq, start_time AS xmin, start_time AS xmax, text AS mark FROM po)"""


def _both(spark, d):
    w = marked(spark, d)
    return w, p.detect_pauses(w, GAP)


@query("e11_transcript_tier", FX + _TIERS + " SELECT * FROM tt")
def _(spark, d):
    return g.transcript_tier(*_both(spark, d))


@query("e12_pause_tier", FX + _TIERS + " SELECT * FROM pt")
def _(spark, d):
    return g.pause_tier(*_both(spark, d))


@query("e13_point_tiers", FX + _TIERS + " SELECT * FROM dt")
def _(spark, d):
    return g.point_tiers(marked(spark, d))


@query("e14_grid", FX + _TIERS + " SELECT * FROM tt UNION ALL SELECT * FROM pt UNION ALL SELECT * FROM dt")
def _(spark, d):
    return g.grid(marked(spark, d), GAP)


@query("a13_annotated_text", FX + """, ct AS (SELECT utt_id, clause_id, string_agg(text, ' ' ORDER BY pos) AS a, coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (disfluency IS NULL), '') AS b FROM fx_full GROUP BY utt_id, clause_id)
SELECT utt_id, 'text_without_pruning: ' || string_agg(a, ' :: ' ORDER BY clause_id) || chr(10) || 'text_with_pruning: ' || string_agg(b, ' :: ' ORDER BY clause_id) AS text FROM ct GROUP BY utt_id""")
def _(spark, d):
    return g.annotated_text(marked(spark, d))


_ITEMS = """, al AS (SELECT * FROM tt UNION ALL SELECT * FROM pt UNION ALL SELECT * FROM dt),
ai AS (SELECT utt_id, tier, seq, CASE kind WHEN 'interval' THEN concat('        intervals [', seq + 1, ']:', chr(10), '            xmin = ', xmin::DOUBLE, chr(10), '            xmax = ', xmax::DOUBLE, chr(10), '            text = ')
 ELSE concat('        points [', seq + 1, ']:', chr(10), '            number = ', xmin::DOUBLE, chr(10), '            mark = ') END || '"' || replace(mark, '"', '""') || '"' || chr(10) AS item FROM al),
ab AS (SELECT utt_id, tier, count(*) AS n, string_agg(item, '' ORDER BY seq) AS body FROM ai GROUP BY utt_id, tier),
an(no, tier, class, size) AS (VALUES (1, 'transcript', 'IntervalTier', 'intervals'), (2, 'pause', 'IntervalTier', 'intervals'), (3, 'filler', 'TextTier', 'points'), (4, 'disflu', 'TextTier', 'points'),
 (5, 'rep', 'TextTier', 'points'), (6, 'self', 'TextTier', 'points'), (7, 'false', 'TextTier', 'points')),
ap AS (SELECT xm.utt_id, x, no, concat('    item [', no, ']:', chr(10), '        class = "', class, '"', chr(10), '        name = "', an.tier, '"', chr(10), '        xmin = 0.0', chr(10), '        xmax = ', x::DOUBLE, chr(10),
 '        ', size, ': size = ', coalesce(n, 0), chr(10), coalesce(body, '')) AS part FROM xm CROSS JOIN an LEFT JOIN ab ON ab.utt_id = xm.utt_id AND ab.tier = an.tier)
SELECT utt_id, concat('File type = "ooTextFile"', chr(10), 'Object class = "TextGrid"', chr(10), chr(10), 'xmin = 0.0', chr(10), 'xmax = ', x::DOUBLE, chr(10), 'tiers? <exists>', chr(10), 'size = 7', chr(10), 'item []:', chr(10)) || string_agg(part, '' ORDER BY no) AS text
FROM ap GROUP BY utt_id, x"""


@query("a14_textgrid", FX + _TIERS + _ITEMS)
def _(spark, d):
    return g.textgrid(marked(spark, d), GAP)


_PATHS = """, pa AS (SELECT page_id, regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '/$', '') || CASE page_id % 3 WHEN 0 THEN '.wav' WHEN 1 THEN '.txt' ELSE '' END AS path FROM pages),
st AS (SELECT page_id AS pos, path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem, CASE WHEN lower(path) LIKE '%.wav' THEN 'audio' WHEN lower(path) LIKE '%.txt' THEN 'text' ELSE 'other' END AS kind FROM pa)"""
_P = "WITH x AS (SELECT 1)" + _PATHS


def _paths(spark, d):
    base = F.regexp_replace(F.regexp_extract("url", "^([^?#]*)", 1), "/$", "")
    suffix = F.when(F.col("page_id") % 3 == 0, ".wav").when(F.col("page_id") % 3 == 1, ".txt").otherwise("")
    return io.with_stem(fx.table(spark, d, "pages").select(F.col("page_id").alias("pos"), F.concat(base, suffix).alias("path")))


@query("a2_with_stem", _P + " SELECT * FROM st")
def _(spark, d):
    return _paths(spark, d)


@query("a3_pair_by_stem", _P + " SELECT a.stem, a.path, t.path AS text_path FROM st a JOIN (SELECT stem, arg_min(path, pos) AS path FROM st WHERE kind = 'text' GROUP BY stem) t USING (stem) WHERE a.kind = 'audio'")
def _(spark, d):
    s = _paths(spark, d)
    return io.pair_by_stem(s.filter("kind = 'audio'").select("stem", "path"), s.filter("kind = 'text'"))


@query("a4_pairing_report", _P + " SELECT * FROM (SELECT stem, count(*) FILTER (kind = 'audio') AS n_audio, count(*) FILTER (kind = 'text') AS n_text FROM st WHERE kind <> 'other' GROUP BY stem) WHERE n_audio <> n_text")
def _(spark, d):
    s = _paths(spark, d)
    return io.pairing_report(s.filter("kind = 'audio'"), s.filter("kind = 'text'"))


@query("a5_missing_media", _P + " SELECT pos, stem FROM st WHERE kind = 'text' AND stem NOT IN (SELECT stem FROM st WHERE kind = 'audio')")
def _(spark, d):
    s = _paths(spark, d)
    return io.missing_media(s.filter("kind = 'text'"), s.filter("kind = 'audio'").select("stem")).select("pos", "stem")


@query("a6_explode_transcript", FX + """, el AS (SELECT utt_id, pos * 2 AS pos, 'text' AS type, text, start_time / 1000.0::double AS start_time, end_time / 1000.0::double AS end_time FROM fx_words
UNION ALL SELECT utt_id, pos * 2 + 1, 'punct', CASE WHEN pos = max(pos) OVER (PARTITION BY utt_id) THEN '.' ELSE ' ' END, -1, -1 FROM fx_words)
SELECT utt_id, pos, type, text, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time FROM el""")
def _(spark, d):
    """Through the JSON form and back."""
    w = fx.words(spark, d).select("utt_id", "pos", "text", (F.col("start_time") / F.lit(1000.0)).alias("start_time"), (F.col("end_time") / F.lit(1000.0)).alias("end_time"))
    e = io.explode_transcript(io.to_transcript_json(w))
    return e.select("utt_id", "pos", "type", "text", *(F.coalesce(F.round(x, 6), F.lit(-1.0)).alias(x) for x in ("start_time", "end_time")))


_ELEMENT = """'{"type":"text","value":' || to_json(text) || ',"ts":' || start_time::double || ',"end_ts":' || end_time::double || ',"confidence":1.0},{"type":"punct","value":"' || CASE WHEN pos = fin THEN '.' ELSE ' ' END || '"}'"""


@query("a7_transcript_json", FX + f"""SELECT utt_id, '{{"monologues":[{{"speaker":0,"elements":[' || string_agg({_ELEMENT}, ',' ORDER BY pos) || ']}}]}}' AS json
FROM (SELECT *, max(pos) OVER (PARTITION BY utt_id) AS fin FROM fx_words) GROUP BY utt_id""")
def _(spark, d):
    return io.to_transcript_json(fx.words(spark, d))


def _asr(spark, d):
    w = fx.words(spark, d)
    part = lambda c: F.struct(F.floor(F.col(c) / 1000).alias("seconds"), (F.col(c) % 1000 * 1000).alias("micros"))
    word = F.struct("pos", F.struct(F.concat("text", F.when(F.col("eos"), ".").otherwise("")).alias("word"), part("start_time").alias("startTime"), part("end_time").alias("endTime")).alias("w"))
    rows = w.groupBy("utt_id", F.floor(F.col("pos") / 20).alias("r")).agg(F.array_sort(F.collect_list(word)).alias("w"))
    first = F.struct(F.array_join(F.transform("w", lambda x: x["w"]["word"]), " ").alias("transcript"), F.col("w.w").alias("words"))
    other = F.struct(F.lit("other").alias("transcript"), F.slice("w.w", 1, 0).alias("words"))
    results = rows.groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("r", F.array(first, other).alias("alternatives")))).alias("x"))
    return results.select("utt_id", F.to_json(F.struct(F.transform("x", lambda r: F.struct(r["alternatives"].alias("alternatives"))).alias("results"))).alias("json"))


@query("a8_flatten_asr", FX + "SELECT utt_id, string_agg(text || CASE WHEN eos THEN '.' ELSE '' END, ' ' ORDER BY pos) AS transcript FROM fx_words GROUP BY utt_id")
def _(spark, d):
    return io.flatten_asr(_asr(spark, d))[0]


@query("a9_asr_words", FX + "SELECT utt_id, pos, text, round(start_time / 1000.0::double, 6) AS start_time, round(end_time / 1000.0::double, 6) AS end_time FROM fx_words")
def _(spark, d):
    out = io.asr_word_cols(io.flatten_asr(_asr(spark, d))[1])
    return out.select("utt_id", "pos", "text", F.round("start_time", 6).alias("start_time"), F.round("end_time", 6).alias("end_time"))


@query("a1_read_transcripts", "SELECT conv_id || '_' || turn AS stem, regexp_extract(coalesce(text, ''), '^([^\\r\\n]*)', 1) AS text FROM conversations")
def _(spark, d):
    """Written as bundled files and read back."""
    path = scratch_path(spark, "transcripts")
    turns = fx.table(spark, d, "conversations")
    io.write_text_by_stem(turns.select(F.concat_ws("_", "conv_id", "turn").alias("stem"), "text"), path, "stem")
    return io.read_transcripts(spark, path, ".txt").select("stem", "text")


_AT = "turn * 61500"
_CLOCK = "printf('%02d:%02d:%02d.%02d', ({0}) // 3600000, ({0}) // 60000 % 60, ({0}) // 1000 % 60, ({0}) % 1000 // 10)"


def _turns(spark, d):
    clock = lambda ms: F.format_string("%02d:%02d:%02d.%02d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, F.floor(ms % 1000 / 10))
    start = F.col("turn") * 61500
    return fx.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("stem"), F.col("turn").alias("pos"), F.col("role").alias("speaker"), clock(start).alias("start_time"), clock(start + F.length("text") * 10).alias("end_time"))


@query("a10_read_turns", f"""SELECT conv_id::varchar AS stem, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::int AS pos, role AS speaker, {_CLOCK.format(_AT)} AS start_time,
{_CLOCK.format(_AT + " + length(text) * 10")} AS end_time FROM conversations""")
def _(spark, d):
    """A turn table for each conversation, written as bundled files and read back."""
    path, cells = scratch_path(spark, "turns"), ["speaker", "start_time", "end_time"]
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", *cells))), lambda t: F.concat_ws("\t", *(t[c] for c in cells)))
    tables = _turns(spark, d).groupBy("stem").agg(F.concat_ws("\n", F.lit("\t".join(cells)), lines).alias("text"))
    io.write_text_by_stem(tables, path, "stem", ".tsv")
    return io.read_turns(spark, path)


@query("a11_segment_manifest", """SELECT stem, idx, stem || '_' || idx || '.wav' AS name, speaker, start_ms, end_ms FROM (
SELECT conv_id::varchar AS stem, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role AS speaker, turn * 61500 AS start_ms, turn * 61500 + length(text) * 10 AS end_ms FROM conversations WHERE role <> 'system')""")
def _(spark, d):
    return io.segment_manifest(_turns(spark, d))


@query("a12_utterance_lengths", "SELECT doc_id::varchar AS utt_id, length(text)::int AS length FROM documents")
def _(spark, d):
    docs = fx.table(spark, d, "documents")
    lines = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(" "), "text").alias("value"))
    return c.utterance_lengths(lines, docs.select(F.col("doc_id").cast("string").alias("utt_id")))


_E = "2.718281828459045"
_LOG = f"CASE WHEN y > {_E} THEN CASE WHEN ln(y) > {_E} THEN ln(y) ELSE ln(y) / {_E} END ELSE y / {_E} END"


@query("p1_piecewise_log", f"SELECT vec_id, dim, round({_LOG}, 6) AS value FROM (SELECT vec_id, unnest(embedding)::double * 100 AS y, generate_subscripts(embedding, 1)::int - 1 AS dim FROM embeddings)")
def _(spark, d):
    e = fx.table(spark, d, "embeddings").select("vec_id", F.posexplode(c.piecewise_log(F.col("embedding"), 100.0)).alias("dim", "value"))
    return e.withColumn("value", F.round("value", 6))


_STATS = "WITH l AS (SELECT vec_id, unnest(embedding)::double AS x, generate_subscripts(embedding, 1)::int - 1 AS dim FROM embeddings), s AS (SELECT dim, avg(x) AS mean, 1 / stddev_pop(x) AS invstddev FROM l GROUP BY dim)"


@query("p2_normalize", _STATS + " SELECT vec_id, dim, round((x - mean) * invstddev, 5) AS value FROM l JOIN s USING (dim)")
def _(spark, d):
    e = fx.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("values"))
    out = c.normalize(e, c.stats_row(c.global_stats(e))).select("vec_id", F.posexplode("values").alias("dim", "value"))
    return out.withColumn("value", F.round("value", 5))


@query("p3_global_stats", _STATS + " SELECT dim, round(mean, 6) AS mean, round(invstddev, 5) AS invstddev FROM s")
def _(spark, d):
    out = c.global_stats(fx.table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("values")))
    return out.select("dim", F.round("mean", 6).alias("mean"), F.round("invstddev", 5).alias("invstddev"))


@query("p4_label_priors", _STATS + " SELECT dim AS label, round(ln(sum(exp(x))) - ln(count(*)), 6) AS log_prior FROM l GROUP BY dim")
def _(spark, d):
    return c.label_priors(fx.table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("log_probs"))).withColumn("log_prior", F.round("log_prior", 6))


_BUCKETS = "WITH RECURSIVE m AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi, greatest(50000, max(n_chars)) AS budget FROM documents), b AS (SELECT source AS split, doc_id AS pos, n_chars AS length, budget, ((n_chars - lo) * 7 + (hi - lo) - 1) // (hi - lo) AS bucket FROM documents, m)"


def _buckets(spark, d):
    docs = fx.table(spark, d, "documents").select(F.col("source").alias("split"), F.col("doc_id").alias("pos"), F.col("n_chars").alias("length"))
    return c.length_buckets(docs, 8)


@query("p5_length_buckets", _BUCKETS + " SELECT split, pos, length, bucket FROM b")
def _(spark, d):
    return _buckets(spark, d)


@query("p6_bucket_order", _BUCKETS + " SELECT pos, bucket, length FROM b ORDER BY bucket, length DESC, pos")
def _(spark, d):
    return c.bucket_order(_buckets(spark, d)).select("pos", "bucket", "length")


def _pack_sql(part: str) -> str:
    return f""", o AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY bucket, length DESC, pos) AS k FROM b),
pk AS (SELECT split, bucket, pos, length, k, 0::bigint AS batch, length AS tokens, 1 AS n FROM o WHERE k = 1
UNION ALL SELECT o.split, o.bucket, o.pos, o.length, o.k, CASE WHEN pk.tokens + o.length > budget OR pk.n = 16 THEN pk.batch + 1 ELSE pk.batch END,
 CASE WHEN pk.tokens + o.length > budget OR pk.n = 16 THEN o.length ELSE pk.tokens + o.length END, CASE WHEN pk.tokens + o.length > budget OR pk.n = 16 THEN 1 ELSE pk.n + 1 END
 FROM pk JOIN o ON o.k = pk.k + 1 AND {" AND ".join(f"o.{x} = pk.{x}" for x in part.split(", "))})
SELECT split, pos, bucket, length, batch FROM pk"""


def _budget(spark, d):
    """50,000 tokens, or the longest document's if it has more."""
    return max(50000, fx.table(spark, d, "documents").agg(F.max("n_chars")).first()[0] or 0)


@query("p7_pack_batches", _BUCKETS + _pack_sql("split, bucket"))
def _(spark, d):
    return c.pack_batches(_buckets(spark, d), _budget(spark, d), 16)


@query("p7_pack_batches_exact", _BUCKETS + _pack_sql("split"))
def _(spark, d):
    return c.pack_batches(_buckets(spark, d), _budget(spark, d), 16, exact=True)


@query("p8_union_splits", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'train' WHEN lang = 'fr' THEN 'dev' ELSE 'test' END AS split FROM documents")
def _(spark, d):
    docs = fx.table(spark, d, "documents")
    return c.union_splits(train=docs.filter("lang = 'en'"), dev=docs.filter("lang = 'fr'"), test=docs.filter("lang not in ('en', 'fr')")).select("doc_id", "split")


@query("t3_speech_runs", FX + """, gp AS (SELECT *, CASE WHEN start_time - lag(end_time) OVER w >= 250 OR lag(end_time) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM fx_words WINDOW w AS (PARTITION BY utt_id ORDER BY pos)),
ru AS (SELECT *, sum(new) OVER (PARTITION BY utt_id ORDER BY pos) AS run FROM gp) SELECT utt_id, min(start_time) AS start_ms, max(end_time) AS end_ms, count(*) AS n_words FROM ru GROUP BY utt_id, run""")
def _(spark, d):
    return jobs.speech_runs(fx.words(spark, d))
