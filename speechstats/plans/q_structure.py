"""Queries over clauses, tokens and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clauses as c
from ..operators import tagging as t
from ..operators import tokens as k
from ..operators import vad as v
from . import fixtures as fx
from .fixtures import FX
from .q_speech import marked
from .base import query

_SPLIT = """, cut AS (SELECT *, (fluent_idx IS NOT NULL AND fluent_idx % 5 = 2) OR coalesce(lead(clause_id) OVER (PARTITION BY utt_id ORDER BY pos) <> clause_id, false) AS ends FROM fx_full),
sp AS (SELECT utt_id, pos, fluent_idx, coalesce(sum(ends::int) OVER (PARTITION BY utt_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS clause_id FROM cut)"""


def _split(spark, d):
    w = marked(spark, d)
    return c.split_clauses(w, w.filter("fluent_idx % 5 = 2").select("utt_id", "fluent_idx"))


@query("d10_split_clauses", FX + _SPLIT + " SELECT utt_id, pos, clause_id FROM sp")
def _(spark, d):
    return _split(spark, d).select("utt_id", "pos", "clause_id")


@query("d11_clause_of", FX + _SPLIT + " SELECT utt_id, fluent_idx, clause_id FROM sp WHERE fluent_idx IS NOT NULL")
def _(spark, d):
    w = _split(spark, d)
    return c.clause_of(w, w.filter("fluent_idx is not null").select("utt_id", "fluent_idx")).select("utt_id", "fluent_idx", "clause_id")


_OWNER = """, up AS (SELECT utt_id, sent_id, token_id, token_id AS cur, head, deprel FROM fx_dep
UNION ALL SELECT u.utt_id, u.sent_id, u.token_id, p.token_id, p.head, p.deprel FROM up u JOIN fx_dep p ON p.utt_id = u.utt_id AND p.sent_id = u.sent_id AND p.token_id = u.head
 WHERE NOT (u.deprel IN ('advcl','ccomp','acl:relcl') OR u.head = 0)),
ow AS (SELECT utt_id, sent_id, token_id, cur AS owner FROM up WHERE deprel IN ('advcl','ccomp','acl:relcl') OR head = 0)"""


@query("d12_clause_owner", FX + _OWNER + " SELECT utt_id, sent_id, token_id, owner FROM ow")
def _(spark, d):
    return c.clause_owner(fx.dependencies(spark, d)).select("utt_id", "sent_id", "token_id", "owner")


@query("d12_clause_owner_by_joins", FX + _OWNER + " SELECT utt_id, sent_id, token_id, owner FROM ow")
def _(spark, d):
    return c.clause_owner_by_joins(fx.dependencies(spark, d)).select("utt_id", "sent_id", "token_id", "owner")


#: The queue, step by step: q holds trees, own the tree of each token, tops each tree's topmost token, k the mark's number.
_QUEUE = """, ad AS (SELECT utt_id, sent_id, token_id AS t, token_id AS a, head FROM fx_dep UNION ALL SELECT ad.utt_id, ad.sent_id, ad.t, p.token_id, p.head FROM ad JOIN fx_dep p ON p.utt_id = ad.utt_id AND p.sent_id = ad.sent_id AND p.token_id = ad.head),
ab AS (SELECT utt_id, sent_id, list(over_ ORDER BY t) AS above, list(t ORDER BY t) AS toks FROM (SELECT utt_id, sent_id, t, list(a) AS over_ FROM ad GROUP BY ALL) GROUP BY ALL),
mk AS (SELECT utt_id, sent_id, coalesce(list(token_id ORDER BY token_id) FILTER (deprel IN ('csubj','csubj:pass','ccomp','xcomp','advcl','acl','acl:relcl')), []) AS marks, arg_min(token_id, head) AS root FROM fx_dep GROUP BY ALL),
qu AS (SELECT utt_id, sent_id, 0 AS step, [0]::bigint[] AS q, list_transform(toks, lambda t: 0)::bigint[] AS own, [root]::bigint[] AS tops, 1 AS k FROM ab JOIN mk USING (utt_id, sent_id)
UNION ALL SELECT qu.utt_id, qu.sent_id, step + 1,
 CASE WHEN own[marks[k]] = q[1] THEN q[2:] || [q[1], len(tops)::bigint] ELSE q[2:] END,
 CASE WHEN own[marks[k]] = q[1] AND tops[q[1] + 1] <> marks[k] THEN list_transform(own, lambda o, i: CASE WHEN o = q[1] AND list_contains(above[i], marks[k]) THEN len(tops)::bigint ELSE o END) ELSE own END,
 CASE WHEN own[marks[k]] = q[1] THEN tops || [marks[k]::bigint] ELSE tops END,
 CASE WHEN own[marks[k]] = q[1] THEN k + 1 ELSE k END
 FROM qu JOIN ab USING (utt_id, sent_id) JOIN mk USING (utt_id, sent_id) WHERE len(q) > 0 AND k <= len(marks)),
qe AS (SELECT utt_id, sent_id, arg_max(own, step) AS own, arg_max(tops, step) AS tops FROM qu GROUP BY ALL)
SELECT utt_id, sent_id, t AS token_id, tops[own[i] + 1] AS owner FROM (SELECT utt_id, sent_id, unnest(toks) AS t, generate_subscripts(toks, 1) AS i, own, tops FROM qe JOIN ab USING (utt_id, sent_id))"""


@query("d13_clause_owner_queue", FX + _QUEUE)
def _(spark, d):
    return c.clause_owner(fx.dependencies(spark, d), mode="queue").select("utt_id", "sent_id", "token_id", "owner")


@query("d14_token_word_index", FX + """, tk AS (SELECT utt_id, sent_id, token_id, start_time // 100 * 100 AS start_char, CASE WHEN pos % 4 = 1 THEN lead(start_time // 100 * 100) OVER (PARTITION BY utt_id ORDER BY pos) ELSE start_time // 100 * 100 + 50 END AS end_char, CASE WHEN text = 'the' OR pos % 9 = 0 THEN 'punct' ELSE 'dep' END AS deprel
 FROM fx_words JOIN fx_dep USING (utt_id, pos)),
st AS (SELECT *, CASE WHEN start_char = lag(end_char) OVER w THEN 0 ELSE 1 END AS new, (deprel = 'punct' AND token_id = 1)::int AS less FROM tk WINDOW w AS (PARTITION BY utt_id ORDER BY sent_id, token_id))
SELECT utt_id, sent_id, token_id, CASE WHEN deprel = 'punct' THEN -1 ELSE sum(new) OVER w - coalesce(sum(less) OVER (PARTITION BY utt_id ORDER BY sent_id, token_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 END::bigint AS word_idx FROM st WINDOW w AS (PARTITION BY utt_id ORDER BY sent_id, token_id)""")
def _(spark, d):
    from ..schema import by_utt

    w = fx.words(spark, d).join(fx.dependencies(spark, d).drop("deprel"), ["utt_id", "pos"])
    start = F.floor(F.col("start_time") / 100) * 100
    tk = w.withColumn("start_char", start).withColumn("end_char", F.when(F.col("pos") % 4 == 1, F.lead("start_char").over(by_utt())).otherwise(F.col("start_char") + 50))
    tk = tk.withColumn("deprel", F.when((F.col("text") == "the") | (F.col("pos") % 9 == 0), "punct").otherwise("dep"))
    return c.token_word_index(tk).select("utt_id", "sent_id", "token_id", F.coalesce("word_idx", F.lit(-1)).alias("word_idx"))


@query("d15_clause_boundaries", FX + _OWNER + """, cs AS (SELECT utt_id, sent_id, owner, min(pos) AS a, max(pos) AS b FROM ow JOIN fx_dep USING (utt_id, sent_id, token_id) GROUP BY ALL),
en AS (SELECT DISTINCT utt_id, sent_id, unnest([a - 1, b]) AS i FROM cs WHERE (utt_id, sent_id) IN (SELECT (utt_id, sent_id) FROM cs GROUP BY utt_id, sent_id HAVING count(*) > 1))
SELECT DISTINCT utt_id, i AS fluent_idx FROM (SELECT *, min(i) OVER w AS lo, max(i) OVER w AS hi FROM en WINDOW w AS (PARTITION BY utt_id, sent_id)) WHERE i > lo AND i < hi""")
def _(spark, d):
    return c.clause_boundaries(c.clause_owner(fx.dependencies(spark, d)).withColumn("fluent_idx", F.col("pos")))


@query("d16_parser_text", FX + "SELECT utt_id, string_agg(s || '. ', '' ORDER BY sent_id) AS text FROM (SELECT utt_id, sent_id, coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (disfluency IS NULL), '') AS s FROM fx_full GROUP BY ALL) GROUP BY utt_id")
def _(spark, d):
    return c.parser_text(marked(spark, d))


@query("d17_clause_intervals", FX + "SELECT utt_id, clause_id, arg_min(start_time, pos) AS start_time, arg_max(end_time, pos) AS end_time, count(*) AS n_words FROM fx_full GROUP BY utt_id, clause_id")
def _(spark, d):
    return c.clause_intervals(marked(spark, d))


@query("d17_utterance_intervals", FX + "SELECT utt_id, min(start_time) AS start_time, max(end_time) AS end_time FROM fx_full GROUP BY utt_id")
def _(spark, d):
    return c.utterance_intervals(marked(spark, d))


@query("d18_shorten", FX + "SELECT utt_id, pos, clause_id, text FROM fx_full WHERE start_time < 9000")
def _(spark, d):
    return c.shorten(marked(spark, d), 9000).select("utt_id", "pos", "clause_id", "text")


@query("d20_clause_texts", FX + "SELECT utt_id, clause_id, string_agg(text, ' ' ORDER BY pos) AS text_full, coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (disfluency IS NULL), '') AS text_fluent FROM fx_full GROUP BY utt_id, clause_id")
def _(spark, d):
    return c.clause_texts(marked(spark, d))


@query("d20_utterance_texts", FX + """, ct AS (SELECT utt_id, clause_id, string_agg(text, ' ' ORDER BY pos) AS a, coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (disfluency IS NULL), '') AS b FROM fx_full GROUP BY utt_id, clause_id)
SELECT utt_id, string_agg(a, ' ' ORDER BY clause_id) AS text_full, string_agg(b, ' ' ORDER BY clause_id) AS text_fluent FROM ct GROUP BY utt_id""")
def _(spark, d):
    return c.utterance_texts(marked(spark, d))


@query("c1_tokenize", "SELECT doc_id, generate_subscripts(w, 1)::int - 1 AS pos, unnest(w) AS text FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents)")
def _(spark, d):
    return k.tokenize_words(fx.table(spark, d, "documents"), "doc_id")


VOCAB = {ch: i for i, ch in enumerate("abcdefghijklmnopqrstuvwxyz'", 1)}
_VOCAB = "map {" + ", ".join("'" + ch.replace("'", "''") + f"': {i}" for ch, i in VOCAB.items()) + "}"


@query("c2_char_ids", FX + f"SELECT utt_id, pos, array_to_string(list_transform(string_split(text, ''), lambda x: coalesce(({_VOCAB})[x], 0)), ' ') AS ids FROM fx_words")
def _(spark, d):
    return fx.words(spark, d).select("utt_id", "pos", F.array_join(k.char_token_ids(F.col("text"), VOCAB, 0).cast("array<string>"), " ").alias("ids"))


@query("c2_unknown_chars", FX + "SELECT utt_id, pos FROM fx_words WHERE regexp_matches(text, '[^a-z'']')")
def _(spark, d):
    return fx.words(spark, d).filter(F.size(k.unknown_chars(F.col("text"), VOCAB)) > 0).select("utt_id", "pos")


_LEX = "lx AS (SELECT text AS word, min(pos)::int AS o FROM fx_words WHERE length(text) < 6 AND regexp_matches(text, '^[a-z]+$') GROUP BY text)"


@query("c3_pronounce", FX + f", {_LEX} SELECT utt_id, pos, CASE WHEN o IS NULL THEN '<unk>' ELSE upper(text) || ' X' END AS phones, CASE WHEN o % 2 = 0 THEN 2 ELSE 1 END AS n FROM fx_words LEFT JOIN lx ON lx.word = fx_words.text")
def _(spark, d):
    w = fx.words(spark, d)
    base = w.filter((F.length("text") < 6) & F.col("text").rlike("^[a-z]+$")).groupBy("text").agg(F.min("pos").alias("o"))
    first = base.select(F.col("text").alias("word"), F.lit(0).alias("order"), F.array(F.concat(F.upper("text"), F.lit("1")), F.lit("X0")).alias("phones"))
    same = base.select(F.col("text").alias("word"), F.lit(1).alias("order"), F.array(F.concat(F.upper("text"), F.lit("2")), F.lit("X")).alias("phones"))
    other = base.filter("o % 2 = 0").select(F.col("text").alias("word"), F.lit(2).alias("order"), F.array(F.lit("Y")).alias("phones"))
    out = k.pronounce(w, first.union(same).union(other))
    return out.select("utt_id", "pos", F.array_join("phones", " ").alias("phones"), F.size("variants").alias("n"))


@query("c4_decode_ids", FX + "SELECT utt_id, pos, regexp_replace(text, '[^a-z'']', '?', 'g') AS text FROM fx_words")
def _(spark, d):
    ids = k.char_token_ids(F.col("text"), VOCAB, 0)
    return fx.words(spark, d).select("utt_id", "pos", F.array_join(k.decode_ids(ids, VOCAB, "?"), "").alias("text"))


@query("c5_group_pieces", FX + """, pc AS (SELECT utt_id, pos, CASE WHEN pos % 3 = 1 THEN chr(9601) || text ELSE text END AS text FROM fx_words), gr AS (SELECT *, count(*) FILTER (pos % 3 = 1) OVER (PARTITION BY utt_id ORDER BY pos) AS word_no FROM pc)
SELECT utt_id, word_no, replace(string_agg(text, '' ORDER BY pos), chr(9601), '') AS text FROM gr WHERE word_no > 0 GROUP BY utt_id, word_no""")
def _(spark, d):
    return k.group_pieces(fx.words(spark, d).withColumn("text", F.when(F.col("pos") % 3 == 1, F.concat(F.lit("▁"), F.col("text"))).otherwise(F.col("text"))))


@query("c6_split_multiword", FX + """, mw AS (SELECT utt_id, pos, CASE WHEN pos % 4 = 0 THEN text || ' x ' || text ELSE text END AS text, start_time, end_time FROM fx_words),
ex AS (SELECT utt_id, pos, start_time, (end_time - start_time)::double / len(string_split(text, ' ')) AS share, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS k FROM mw)
SELECT utt_id, row_number() OVER (PARTITION BY utt_id ORDER BY pos, k) - 1 AS pos, text, round(start_time + share * k, 6) AS start_time, round(start_time + share * (k + 1), 6) AS end_time FROM ex""")
def _(spark, d):
    out = k.split_multiword(fx.words(spark, d).withColumn("text", F.when(F.col("pos") % 4 == 0, F.concat("text", F.lit(" x "), "text")).otherwise(F.col("text"))))
    return out.select("utt_id", "pos", "text", F.round("start_time", 6).alias("start_time"), F.round("end_time", 6).alias("end_time"))


@query("c7_glue_connectors", FX + """, cn AS (SELECT utt_id, pos, CASE WHEN pos % 5 IN (2, 3) THEN '-' || text WHEN pos % 7 = 1 THEN ':' || text ELSE text END AS text, start_time, end_time FROM fx_words),
gr AS (SELECT *, count(*) FILTER (text[1] NOT IN ('-', ':')) OVER (PARTITION BY utt_id ORDER BY pos) AS g FROM cn)
SELECT utt_id, row_number() OVER (PARTITION BY utt_id ORDER BY min(pos)) - 1 AS pos, string_agg(text, '' ORDER BY pos) AS text, arg_min(start_time, pos) AS start_time, arg_max(end_time, pos) AS end_time FROM gr GROUP BY utt_id, g""")
def _(spark, d):
    text = F.when((F.col("pos") % 5).isin(2, 3), F.concat(F.lit("-"), "text")).when(F.col("pos") % 7 == 1, F.concat(F.lit(":"), "text")).otherwise(F.col("text"))
    return k.glue_connectors(fx.words(spark, d).withColumn("text", text))


@query("c8_alignment_mismatch", FX + "SELECT * FROM (SELECT utt_id, len(string_split_regex(trim(text), '\\s+'))::bigint AS n_text, (SELECT count(*) FROM fx_words w WHERE w.utt_id = u.utt_id AND w.pos % 50 <> 49) AS n_aligned FROM fx_u u) WHERE n_text <> n_aligned")
def _(spark, d):
    u = fx.table(spark, d, "conversations").filter("role <> 'system'").select((F.col("conv_id") * 100 + F.col("turn")).alias("utt_id"), F.regexp_replace(F.trim("text"), r"\s+", " ").alias("text"))
    return k.alignment_mismatch(u, fx.words(spark, d).filter("pos % 50 <> 49"))


_SPANS = """, ch AS (SELECT *, CASE WHEN lag(label) OVER w = label THEN 0 ELSE 1 END AS new FROM fx_frames WINDOW w AS (PARTITION BY utt_id ORDER BY frame)),
rn AS (SELECT *, sum(new) OVER (PARTITION BY utt_id ORDER BY frame) AS run FROM ch),
fs AS (SELECT utt_id, any_value(label) AS label, min(frame) AS start, max(frame) + 1 AS "end", avg(score) AS score FROM rn WHERE label <> 0 GROUP BY utt_id, run),
spn AS (SELECT utt_id, row_number() OVER (PARTITION BY utt_id ORDER BY start) - 1 AS span, label, start, "end", score FROM fs)"""


@query("c9_merge_spans", FX + _SPANS + ' SELECT utt_id, span, label, start, "end", round(score, 6) AS score FROM spn')
def _(spark, d):
    return k.merge_spans(fx.frames(spark, d)).withColumn("score", F.round("score", 6))


@query("c10_greedy_decode", FX + _SPANS + " SELECT utt_id, string_agg('_abcdef'[label + 1], '' ORDER BY span) AS text FROM spn GROUP BY utt_id")
def _(spark, d):
    values = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.when(i == F.col("label"), 5.0).otherwise(i.cast("double") / 10))
    return k.greedy_decode(fx.frames(spark, d).withColumn("values", values), list("_abcdef"))


_TIMES = _SPANS + """, wl AS (SELECT utt_id, pos, text, sum(length(text)) OVER (PARTITION BY utt_id ORDER BY pos) - length(text) AS lo, sum(length(text)) OVER (PARTITION BY utt_id ORDER BY pos) AS hi FROM fx_words),
wt AS (SELECT w.utt_id, pos, text, min(start) AS start, max("end") AS "end", sum(score * ("end" - start)) / sum("end" - start) AS confidence FROM wl w JOIN spn s ON s.utt_id = w.utt_id AND s.span >= lo AND s.span < hi GROUP BY ALL)"""


@query("c11_word_times", FX + _TIMES + ' SELECT utt_id, pos, text, start, "end" FROM wt')
def _(spark, d):
    return k.word_times(k.merge_spans(fx.frames(spark, d).drop("score")), fx.words(spark, d))


@query("c12_frame_to_sec", FX + "SELECT utt_id, frame, floor(frame * 320.5) / 16000.0::double AS sec FROM fx_frames")
def _(spark, d):
    return fx.frames(spark, d).select("utt_id", "frame", k.frame_to_sec(F.col("frame"), 320.5, 16000).alias("sec"))


@query("c13_span_confidence", FX + _SPANS + ' SELECT utt_id, label, round(sum(score * ("end" - start)) / sum("end" - start), 6) AS confidence FROM spn GROUP BY utt_id, label')
def _(spark, d):
    return k.span_confidence(k.merge_spans(fx.frames(spark, d)), "utt_id", "label").withColumn("confidence", F.round("confidence", 6))


@query("e5_sounding_frames", FX + "SELECT utt_id, frame FROM (SELECT *, max(intensity) OVER (PARTITION BY utt_id) AS m FROM fx_frames) WHERE intensity >= m - 25")
def _(spark, d):
    return v.sounding_frames(fx.frames(spark, d)).select("utt_id", "frame")


_SOUND = """, sf AS (SELECT utt_id, frame, frame - row_number() OVER (PARTITION BY utt_id ORDER BY frame) AS g FROM (SELECT *, max(intensity) OVER (PARTITION BY utt_id) AS m FROM fx_frames) WHERE intensity >= m - 25),
ru AS (SELECT utt_id, min(frame) AS first, max(frame) AS last FROM sf GROUP BY utt_id, g), fl AS (SELECT *, max(first) OVER (PARTITION BY utt_id) AS fin FROM ru),
ke AS (SELECT utt_id, first, last FROM fl WHERE (last - first) * 30 >= 250 AND NOT (first = 0 AND fin = 0))"""


@query("e6_sounding_intervals", FX + _SOUND + " SELECT utt_id, first, last, first * 30 AS start_time, last * 30 AS end_time FROM ke")
def _(spark, d):
    return v.sounding_intervals(v.sounding_frames(fx.frames(spark, d)), 250, 30)


@query("e7_intensity_silences", FX + _SOUND + ", nx AS (SELECT utt_id, last * 30 AS start_time, lead(first * 30) OVER (PARTITION BY utt_id ORDER BY first) AS end_time FROM ke) SELECT * FROM nx WHERE end_time - start_time > 250")
def _(spark, d):
    return v.intensity_silences(fx.frames(spark, d), min_sound=250, min_silence=250, step=30)


_SMOOTH = """, nf AS (SELECT *, sum(is_speech::int) OVER (PARTITION BY utt_id ORDER BY frame ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS n FROM fx_frames),
evt AS (SELECT *, CASE WHEN n >= 9 THEN true WHEN n <= 1 THEN false END AS e FROM nf),
sm AS (SELECT utt_id, frame, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY utt_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS state FROM evt)"""


@query("e8_smooth_vad", FX + _SMOOTH + " SELECT utt_id, frame, state FROM sm")
def _(spark, d):
    return v.smooth_vad(fx.frames(spark, d)).select("utt_id", "frame", "state")


@query("e9_vad_segments", FX + _SMOOTH + """, ed AS (SELECT *, coalesce(lag(state) OVER w, false) <> state AS change, max(frame) OVER (PARTITION BY utt_id) AS fin FROM sm WINDOW w AS (PARTITION BY utt_id ORDER BY frame)),
nx AS (SELECT *, lead(frame) OVER (PARTITION BY utt_id ORDER BY frame) AS upto FROM ed WHERE change) SELECT utt_id, frame * 30 AS start_ms, coalesce(upto, fin) * 30 AS end_ms FROM nx WHERE state""")
def _(spark, d):
    return v.vad_segments(v.smooth_vad(fx.frames(spark, d)))


@query("e15_pcm_frames", "SELECT doc_id AS utt_id, f::int AS frame, (f * 10)::int AS time_ms, least(160, strlen(text) - 160 * f)::int AS n_bytes, substr(hex(encode(text)), (320 * f + 1)::bigint, 320) AS bytes FROM (SELECT doc_id, text, unnest(range(0, (strlen(text) + 159) // 160)) AS f FROM documents)")
def _(spark, d):
    """Texts as if they were audio bytes; the frames' contents are tested against slices."""
    pcm = fx.table(spark, d, "documents").select(F.col("doc_id").alias("utt_id"), F.encode("text", "UTF-8").alias("pcm"))
    return v.pcm_frames(pcm, 8000, 10).select("utt_id", "frame", "time_ms", F.octet_length("data").alias("n_bytes"), F.hex("data").alias("bytes"))
