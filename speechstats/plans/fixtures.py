"""Speech-like tables derived from the given ones, in Spark and (as ``FX``) in DuckDB SQL: see FIXTURES.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tagging import FILLERS
from ..ranks import by_size, tasks_for
from ..schema import BEFORE, by_utt

#: Characters of text for each task: some 45,000 words and 1.2 million frames, whose sorts stay in memory.
TASK_CHARS = 1 << 18
#: Milliseconds of speech for each task, where frames are made of written words: the same 1.2 million frames.
TASK_MS = 18_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role <> 'system'")


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """The number of tasks that ``words`` deals texts to."""
    return tasks_for(_spoken(spark, sf_dir), F.length("text"), TASK_CHARS)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """utt_id, conv_id, speaker, pos, text, eos, start_time, end_time (integer milliseconds)."""
    u = _spoken(spark, sf_dir).select((F.col("conv_id") * 100 + F.col("turn")).alias("utt_id"), "conv_id", F.col("role").alias("speaker"), "text")
    # Whole texts are put together by utterance, before words and frames multiply them: every window finds its rows in place.
    u = by_size(u, "utt_id", F.length("text"), TASK_CHARS)
    t = u.select("utt_id", "conv_id", "speaker", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("p", "tok"))
    n = t.withColumn("text", F.lower(F.regexp_replace("tok", "[.,?!]", ""))).filter("text <> ''")
    by_p = Window.partitionBy("utt_id").orderBy("p")
    k = n.withColumn("pos", F.row_number().over(by_p) - 1).withColumn("eos", F.col("tok").rlike("[.?!]$"))
    g = k.withColumn("dur", 60 * F.length("text") + 80).withColumn("gap", F.when((F.col("pos") > 0) & ((F.col("utt_id") * 31 + F.col("pos") * 17) % 7 == 0), 150 + 50 * ((F.col("utt_id") + F.col("pos")) % 9)).otherwise(0))
    end = F.sum(F.col("dur") + F.col("gap")).over(by_p)
    return g.select("utt_id", "conv_id", "speaker", "pos", "text", "eos", (end - F.col("dur")).alias("start_time"), end.alias("end_time"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with ``tag``: IE, C or O on all but fillers (null there)."""
    w = words(spark, sf_dir).withColumn("filler", F.col("text").isin(FILLERS))
    # Neighbours among the words that are no fillers.
    before = F.last(F.when(~F.col("filler"), F.col("text")), ignorenulls=True).over(by_utt().rowsBetween(*BEFORE))
    # A frame up to the end would be passed again for each word.
    after = F.expr("lead(if(filler, null, text)) ignore nulls over (partition by utt_id order by pos)")
    tag = F.when(F.col("text") == F.col("nt"), "IE").when(F.col("text") == F.col("pt"), "C").when((F.col("utt_id") * 13 + F.col("pos") * 7) % 29 == 0, "IE").otherwise("O")
    return w.withColumn("pt", before).withColumn("nt", after).withColumn("tag", F.when(~F.col("filler"), tag)).drop("filler", "pt", "nt")


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """utt_id, sent_id, token_id, head, deprel, pos."""
    s = words(spark, sf_dir).withColumn("sent_id", F.coalesce(F.sum(F.col("eos").cast("long")).over(by_utt().rowsBetween(*BEFORE)), F.lit(0)))
    k = s.withColumn("k", F.row_number().over(Window.partitionBy("utt_id", "sent_id").orderBy("pos")) - 1)
    mark = (F.col("utt_id") * 7 + F.col("pos") * 5) % 11
    return k.select(
        "utt_id", "sent_id", (F.col("k") + 1).alias("token_id"),
        F.when(F.col("k") == 0, 0).otherwise(F.col("k") - F.col("k").bitwiseAND(-F.col("k")) + 1).alias("head"),
        F.when(F.col("k") == 0, "root").when(mark == 0, "advcl").when(mark == 1, "ccomp").when(mark == 2, "acl:relcl").otherwise("dep").alias("deprel"), "pos",
    )


def frames(spark: SparkSession, sf_dir: str, timed: DataFrame | None = None) -> DataFrame:
    """utt_id, frame, is_speech, intensity, label, score: frames of every utterance, two for each 30 ms of it and eight more.

    ``timed``: the words, where they are written already.
    """
    u = (words(spark, sf_dir) if timed is None else timed).groupBy("utt_id").agg(F.max("end_time").alias("ms"))
    if timed is not None:
        u = by_size(u, "utt_id", F.col("ms"), TASK_MS)
    # Frames are made in the order that every window on them asks for, so sorting them is one pass.
    u = u.sortWithinPartitions("utt_id")
    f = u.select("utt_id", F.explode(F.sequence(F.lit(0), (F.floor(F.col("ms") / 15) + 7).cast("int"))).alias("frame"))
    wave = (F.col("utt_id") * 31 + F.floor(F.col("frame") / 15) * 17) % 5
    return f.select(
        "utt_id", "frame", (~wave.isin(0, 1) != (F.col("frame") % 13 == 0)).alias("is_speech"), (40 + 12 * wave - F.col("frame") % 3).cast("double").alias("intensity"),
        ((F.col("utt_id") + F.floor(F.col("frame") / 3) * 5) % 7).alias("label"), (((F.col("frame") * 37) % 100).cast("double") / 100).alias("score"),
    )


_SET = ", ".join(f"'{x}'" for x in FILLERS)
#: Start of a DuckDB statement: the same tables as CTEs.
FX = rf"""WITH RECURSIVE
fx_u AS (SELECT conv_id*100+turn AS utt_id, conv_id, role AS speaker, text FROM conversations WHERE role<>'system'),
fx_t AS (SELECT utt_id, conv_id, speaker, unnest(string_split_regex(trim(text),'\s+')) tok, generate_subscripts(string_split_regex(trim(text),'\s+'),1)-1 AS p FROM fx_u),
fx_n AS (SELECT *, lower(regexp_replace(tok,'[.,?!]','','g')) w FROM fx_t),
fx_k AS (SELECT utt_id, conv_id, speaker, row_number() over(partition by utt_id order by p)-1 AS pos, w AS text, regexp_matches(tok,'[.?!]$') AS eos FROM fx_n WHERE w<>''),
fx_g AS (SELECT *, 60*length(text)+80 AS dur_ms, CASE WHEN pos>0 AND (utt_id*31+pos*17)%7=0 THEN 150+50*((utt_id+pos)%9) ELSE 0 END AS gap_ms FROM fx_k),
fx_words AS (SELECT utt_id,conv_id,speaker,pos,text,eos,
 cast(sum(dur_ms+gap_ms) over (partition by utt_id order by pos) - dur_ms as bigint) AS start_time,
 cast(sum(dur_ms+gap_ms) over (partition by utt_id order by pos) as bigint) AS end_time FROM fx_g),
fx_f AS (SELECT *, text IN ({_SET}) AS is_filler FROM fx_words),
fx_s AS (SELECT utt_id,pos,text, lead(text) over w nt, lag(text) over w pt FROM fx_f WHERE NOT is_filler WINDOW w AS (PARTITION BY utt_id ORDER BY pos)),
fx_tags AS (SELECT utt_id,pos, CASE WHEN text=nt THEN 'IE' WHEN text=pt THEN 'C' WHEN (utt_id*13+pos*7)%29=0 THEN 'IE' ELSE 'O' END tag FROM fx_s),
fx_tagged AS (SELECT w.*, t.tag FROM fx_words w LEFT JOIN fx_tags t USING (utt_id, pos)),
fx_ds AS (SELECT *, coalesce(sum(eos::int) over (partition by utt_id order by pos rows between unbounded preceding and 1 preceding),0)::bigint sent_id FROM fx_words),
fx_dk AS (SELECT *, row_number() over (partition by utt_id,sent_id order by pos)-1 k FROM fx_ds),
fx_dep AS (SELECT utt_id, sent_id, k+1 token_id, CASE WHEN k=0 THEN 0 ELSE k-(k & -k)+1 END head,
 CASE WHEN k=0 THEN 'root' WHEN (utt_id*7+pos*5)%11=0 THEN 'advcl' WHEN (utt_id*7+pos*5)%11=1 THEN 'ccomp' WHEN (utt_id*7+pos*5)%11=2 THEN 'acl:relcl' ELSE 'dep' END deprel, pos FROM fx_dk),
fx_frames AS (SELECT utt_id, f AS frame, ((((utt_id*31+(f//15)*17)%5) NOT IN (0,1)) <> (f%13=0)) AS is_speech,
 cast(40+12*((utt_id*31+(f//15)*17)%5)-(f%3) as double) AS intensity, (utt_id+(f//3)*5)%7 AS label, cast((f*37)%100 as double)/100 AS score
 FROM (SELECT utt_id, unnest(range(0, max(end_time)//15+8)) AS f FROM fx_words GROUP BY utt_id) r),
-- marked words: fillers, reparanda, sentences
fx_fl AS (SELECT *, CASE WHEN text IN ({_SET}) THEN 'FILLER' END AS d0 FROM fx_tagged),
fx_i0 AS (SELECT *, CASE WHEN d0 IS NULL THEN count(*) FILTER (d0 IS NULL) OVER (PARTITION BY utt_id ORDER BY pos) - 1 END AS f0, max(CASE WHEN d0 IS NULL THEN pos END) OVER (PARTITION BY utt_id) AS last_pos FROM fx_fl),
fx_se AS (SELECT *, coalesce(sum((d0 IS NULL AND eos AND pos < last_pos)::int) OVER (PARTITION BY utt_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS sent_id FROM fx_i0),
fx_sp AS (SELECT *, count(*) FILTER (tag = 'O') OVER (PARTITION BY utt_id, sent_id ORDER BY pos)::bigint AS span_id FROM fx_se),
fx_so AS (SELECT *, min(CASE WHEN tag NOT IN ('O','C') THEN pos END) OVER (PARTITION BY utt_id, sent_id, span_id) AS opens FROM fx_sp),
fx_spans AS (SELECT utt_id, sent_id, span_id, min(opens) AS first_pos, string_agg(text, '' ORDER BY pos) FILTER (tag NOT IN ('O','C')) AS reparandum,
 coalesce(string_agg(text, '' ORDER BY pos) FILTER (tag = 'C' AND pos > opens), '') AS correction FROM fx_so WHERE tag IS NOT NULL AND opens IS NOT NULL GROUP BY ALL),
fx_marked AS (SELECT o.utt_id, o.conv_id, o.speaker, o.pos, o.text, o.start_time, o.end_time, o.sent_id, o.sent_id AS clause_id,
 CASE WHEN d0 IS NOT NULL THEN d0 WHEN o.tag NOT IN ('O','C') THEN CASE WHEN s.reparandum = s.correction THEN 'REPETITION' ELSE 'SELF_REPAIR' END END AS disfluency
 FROM fx_so o LEFT JOIN fx_spans s USING (utt_id, sent_id, span_id)),
fx_full AS (SELECT *, CASE WHEN disfluency IS NULL THEN count(*) FILTER (disfluency IS NULL) OVER (PARTITION BY utt_id ORDER BY pos) - 1 END AS fluent_idx FROM fx_marked),
fx_gaps AS (SELECT *, start_time - lag(end_time) OVER (PARTITION BY utt_id ORDER BY pos) AS gap, lag(end_time) OVER (PARTITION BY utt_id ORDER BY pos) AS gap_start, lag(clause_id) OVER (PARTITION BY utt_id ORDER BY pos) AS before FROM fx_full),
fx_pauses AS (SELECT utt_id, row_number() OVER (PARTITION BY utt_id ORDER BY pos) - 1 AS seq, CASE WHEN clause_id = before THEN 'CI' ELSE 'CE' END AS location, gap_start AS start_time, start_time AS end_time FROM fx_gaps WHERE gap >= 250),
fx_syl AS (SELECT *, greatest(1, len(regexp_extract_all(lower(text), '[aeiouy]+')) - CASE WHEN regexp_matches(lower(text), '[^aeiouyl]e$') AND len(regexp_extract_all(lower(text), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) AS syl FROM fx_full),
fx_wp AS (SELECT utt_id, min(conv_id) AS conv_id, min(speaker) AS speaker, count(*) FILTER (disfluency IS NULL) AS n_word, coalesce(sum(syl) FILTER (disfluency IS NULL), 0)::bigint AS n_syl, arg_max(end_time, pos) - arg_min(start_time, pos) AS dur,
 count(*) FILTER (disfluency = 'REPETITION') AS repetition, count(*) FILTER (disfluency = 'SELF_REPAIR') AS self_repair, count(*) FILTER (disfluency = 'FALSE_START') AS false_start, count(*) FILTER (disfluency = 'FILLER') AS filled FROM fx_syl GROUP BY utt_id),
fx_pp AS (SELECT utt_id, count(*) FILTER (location = 'CI') AS n_mc, coalesce(sum(end_time - start_time) FILTER (location = 'CI'), 0)::bigint AS sum_mc, count(*) FILTER (location = 'CE') AS n_ec, coalesce(sum(end_time - start_time) FILTER (location = 'CE'), 0)::bigint AS sum_ec
 FROM fx_pauses WHERE end_time - start_time > 250 GROUP BY utt_id),
fx_params AS (SELECT w.*, coalesce(n_mc, 0) AS n_mc, coalesce(sum_mc, 0) AS sum_mc, coalesce(n_ec, 0) AS n_ec, coalesce(sum_ec, 0) AS sum_ec FROM fx_wp w LEFT JOIN fx_pp p USING (utt_id))
"""
