"""Reading and writing: transcripts, media pairing, transcript JSON, recogniser responses, turn tables, result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.measures import MEASURES
from .files import NAME, register

ELEMENTS = "struct<monologues:array<struct<speaker:int,elements:array<struct<type:string,value:string,ts:double,end_ts:double,confidence:double>>>>>"
ASR = "struct<results:array<struct<alternatives:array<struct<transcript:string,words:array<struct<word:string,startTime:struct<seconds:bigint,micros:bigint>,endTime:struct<seconds:bigint,micros:bigint>>>>>>>>"


def file_stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")


def with_stem(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Adds stem and kind (audio for .wav, text for .txt, else other)."""
    p = F.lower(path_col)
    return df.withColumn("stem", file_stem(F.col(path_col))).withColumn("kind", F.when(p.endswith(".wav"), "audio").when(p.endswith(".txt"), "text").otherwise("other"))


def read_transcripts(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """path, stem, text: one recording for each file, its first line; an empty file is an empty text."""
    files = register(spark).read.format(NAME).option("suffix", suffix).load(path)
    return files.withColumn("text", F.regexp_extract("text", r"^([^\r\n]*)", 1))


def pair_by_stem(audio: DataFrame, texts: DataFrame) -> DataFrame:
    """Each audio with the first transcript (by pos) of its stem; audio without one is dropped."""
    return audio.join(texts.groupBy("stem").agg(F.min(F.struct("pos", "path")).path.alias("text_path")), "stem")


def pairing_report(audio: DataFrame, texts: DataFrame) -> DataFrame:
    """stem, n_audio, n_text of the stems that are not as often on both sides; empty if the pairing is complete."""
    a, t = audio.groupBy("stem").agg(F.count("*").alias("n_audio")), texts.groupBy("stem").agg(F.count("*").alias("n_text"))
    both = a.join(t, "stem", "full_outer").select("stem", F.coalesce("n_audio", F.lit(0)).alias("n_audio"), F.coalesce("n_text", F.lit(0)).alias("n_text"))
    return both.filter("n_audio <> n_text")


def missing_media(tables: DataFrame, media: DataFrame) -> DataFrame:
    """Rows of a transcript table whose stem has no media file."""
    return tables.join(media, "stem", "left_anti")


def explode_transcript(df: DataFrame, column: str = "json", key: str = "utt_id") -> DataFrame:
    """key, pos, type, text, start_time, end_time, confidence: a transcript's elements in order."""
    t = df.select(key, F.from_json(column, ELEMENTS).alias("t"))
    m = t.select(key, F.posexplode("t.monologues").alias("m", "mono"))
    e = m.select(key, "m", F.posexplode("mono.elements").alias("k", "e"))
    pos = F.row_number().over(Window.partitionBy(key).orderBy("m", "k")) - 1
    return e.select(key, pos.alias("pos"), "e.type", F.col("e.value").alias("text"), F.col("e.ts").alias("start_time"), F.col("e.end_ts").alias("end_time"), "e.confidence")


def to_transcript_json(words: DataFrame) -> DataFrame:
    """utt_id, json: each word followed by a blank as punctuation, the last by a full stop; empty words are skipped."""
    order = F.array_sort(F.collect_list(F.struct("pos", "text", F.col("start_time").cast("double").alias("a"), F.col("end_time").cast("double").alias("b"))))
    rows = words.filter("text <> ''").groupBy("utt_id").agg(order.alias("w"))
    none = F.lit(None).cast("double")
    element = lambda kind, value, a, b, c: F.struct(F.lit(kind).alias("type"), value.alias("value"), a.alias("ts"), b.alias("end_ts"), c.alias("confidence"))
    pairs = F.transform(
        "w",
        lambda x, i: F.array(element("text", x["text"], x["a"], x["b"], F.lit(1.0)), element("punct", F.when(i == F.size("w") - 1, ".").otherwise(" "), none, none, none)),
    )
    mono = F.array(F.struct(F.lit(0).alias("speaker"), F.flatten(pairs).alias("elements")))
    return rows.select("utt_id", F.to_json(F.struct(mono.alias("monologues"))).alias("json"))


def flatten_asr(df: DataFrame, column: str = "json", key: str = "utt_id") -> tuple[DataFrame, DataFrame]:
    """(key, transcript) and (key, pos, word, startTime, endTime): the first alternative of every result."""
    parsed = df.select(key, F.from_json(column, ASR).alias("r"))
    first = F.transform("r.results", lambda r: F.get(r["alternatives"], F.lit(0)))
    texts = parsed.select(key, F.array_join(F.transform(first, lambda a: a["transcript"]), " ").alias("transcript"))
    words = parsed.select(key, F.posexplode(F.flatten(F.transform(first, lambda a: a["words"]))).alias("pos", "w"))
    return texts, words.select(key, "pos", "w.*")


def asr_word_cols(words: DataFrame) -> DataFrame:
    """Recogniser words as timed words: seconds and microseconds together, one full stop at the end dropped."""
    sec = lambda c: F.col(f"{c}.seconds") + F.col(f"{c}.micros") * F.lit(1e-6)
    rest = [c for c in words.columns if c not in ("word", "startTime", "endTime")]
    return words.select(*rest, F.regexp_replace("word", r"\.$", "").alias("text"), sec("startTime").alias("start_time"), sec("endTime").alias("end_time"))


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """stem, speaker, start_time, end_time (clock strings) and pos of tab-separated turn tables.

    Order within a file is its line order: files are read whole, so it does not depend on how they are cut.
    """
    files = register(spark).read.format(NAME).load(path).select("stem", F.split(F.rtrim(F.replace("text", F.lit("\r"), F.lit(""))), "\n").alias("lines"))
    names = F.split(F.get("lines", F.lit(0)), "\t")
    rows = files.select("stem", names.alias("names"), F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("pos", "line")).filter("line <> ''")
    cell = lambda c: F.get(F.split("line", "\t"), (F.array_position("names", F.lit(c)) - 1).cast("int")).alias(c)
    return rows.select("stem", "pos", cell("speaker"), cell("start_time"), cell("end_time"))


def segment_manifest(turns: DataFrame) -> DataFrame:
    """stem, idx, name, speaker, start_ms, end_ms: turns of people, numbered after ``system`` turns are dropped."""
    from ..functions.text import clock_to_ms

    kept = turns.filter("speaker <> 'system'").withColumn("idx", F.row_number().over(Window.partitionBy("stem").orderBy("pos")) - 1)
    name = F.concat("stem", F.lit("_"), F.col("idx").cast("string"), F.lit(".wav"))
    return kept.select("stem", "idx", name.alias("name"), "speaker", clock_to_ms(F.col("start_time")).alias("start_ms"), clock_to_ms(F.col("end_time")).alias("end_ms"))


def write_text_by_stem(df: DataFrame, path: str, stem: str = "utt_id", suffix: str = ".txt", loose: bool = False) -> None:
    """Each recording's text as a member of a bundle, or (``loose``) as a file of its own; replaces what is there."""
    register(df.sparkSession)
    rows = df.select(F.col(stem).cast("string").alias("stem"), "text")
    rows.write.format(NAME).option("suffix", suffix).option("loose", str(loose)).mode("overwrite").save(path)


def write_measures(df: DataFrame, path: str, name: str = "utt_id") -> None:
    """CSV with a header, filename first; missing values are written empty, two names with a hyphen."""
    hyphen = {"mid_clause_p_dur": "mid_clause_p-dur", "end_clause_p_dur": "end_clause_p-dur"}
    df.select(F.col(name).alias("filename"), *(F.col(m).alias(hyphen.get(m, m)) for m in MEASURES if m in df.columns)).write.option("header", True).csv(path)
