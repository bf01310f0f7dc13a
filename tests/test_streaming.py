"""Streams give what the batch forms give."""

import datetime
import glob
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechstats.operators import pauses, vad
from speechstats.plans import fixtures as fx
from speechstats.plans import q_workloads
from speechstats.plans.q_speech import GAP, marked
from speechstats.streaming import jobs, ordered
from speechstats.streaming.ordered import STORE

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture
def store(spark):
    """Small Arrow batches and the state store that the jobs need."""
    old = {k: spark.conf.get(k) for k in (STORE[0], "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set(*STORE)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def run(spark, parts, schema, path, job, mode="append"):
    """Streams lists of rows, one micro-batch each and in this order, through ``job`` into a table."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{k}")
        for f in glob.glob(f"{path}/{k}/part*"):
            os.utime(f, (1000 + k, 1000 + k))
    source = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    query = job(source).writeStream.format("memory").queryName("t" + os.path.basename(path).replace("-", "_")).outputMode(mode).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(p.numInputRows for p in query.recentProgress) == sum(map(len, parts))
    return query, spark.table("t" + os.path.basename(path).replace("-", "_"))


def dealt(rows, n, seed=1):
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    return [rows[k::n] for k in range(n)]


WORD = "utt_id long, pos long, clause_id long, start_time double, end_time double"


def test_pauses_of_shuffled_words_over_batches(spark, store, tmp_path):
    """25,000 words of one utterance and some of others, in three micro-batches of many Arrow batches."""
    rows = [(1, k, k // 50, k * 1.0, k + 0.5 + 0.3 * (k % 3 == 0)) for k in range(25_000)] + [(u, k, k // 7, k * 0.5, k * 0.5 + 0.2 + 0.1 * (k % 2)) for u in range(2, 30) for k in range(40)]
    _, got = run(spark, dealt(rows, 3), WORD, str(tmp_path / "shuffled"), lambda s: jobs.stream_pauses(s, idle_ms=None))
    expect = pauses.detect_pauses(spark.createDataFrame(rows, WORD)).select("utt_id", "location", "start_time", "end_time")
    assert got.filter("late").count() == 0
    assert sorted(map(tuple, got.drop("late").collect())) == sorted(map(tuple, expect.collect())) and got.count() > 16_000


def test_pauses(spark, store, tmp_path):
    w = marked(spark, D).select("utt_id", F.col("pos").cast("long").alias("pos"), F.col("clause_id").cast("long").alias("clause_id"), F.col("start_time").cast("double").alias("start_time"), F.col("end_time").cast("double").alias("end_time"))
    _, got = run(spark, dealt(map(tuple, w.collect()), 2), WORD, str(tmp_path / "pauses"), lambda s: jobs.stream_pauses(s, GAP, 3_600_000))
    expect = pauses.detect_pauses(w, GAP).select("utt_id", "location", "start_time", "end_time")
    assert got.filter("late").count() == 0
    assert sorted(map(tuple, got.drop("late").collect())) == sorted(map(tuple, expect.collect())) and got.count() > 50


def at(second):
    return datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=second)


TIMED = WORD + ", made timestamp"


def test_the_watermark_releases_words_and_late_ones_are_marked(spark, store, tmp_path):
    word = lambda u, k, when: (u, k, 0, k * 1.0, k + 0.5, at(when))
    parts = [
        [word(1, 80, 100), word(1, 81, 101), word(1, 0, 1)],  # 1 to 79 are missing: 80 and 81 wait
        [word(2, 0, 400)],  # the watermark goes to 390 behind this batch
        [word(2, 2, 402)],  # the timer gives 1 to 79 up
        [word(1, 2, 103), word(1, 81, 104), word(1, 82, 102)],  # too late, again, and in time though behind the watermark
        [word(2, 1, 401), word(2, 1, 401)],
    ]
    query, got = run(spark, parts, TIMED, str(tmp_path / "late"), lambda s: jobs.stream_pauses(s, idle_ms=None, event="made"))
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted([(1, "CI", 0.5, 80.0, False), (1, "CI", 80.5, 81.0, False), (1, "CI", 81.5, 82.0, False), (1, "", 2.0, 2.5, True), (1, "", 81.0, 81.5, True), (2, "CI", 0.5, 1.0, False), (2, "CI", 1.5, 2.0, False), (2, "", 1.0, 1.5, True)])


def test_idle_utterances_are_forgotten(spark, store, tmp_path):
    word = lambda u, k, when: (u, k, 0, k * 1.0, k + 0.5, at(when))
    parts = [[word(1, 0, 1), word(1, 1, 2)], [word(2, 0, 500)], [word(2, 1, 501)], [word(1, 0, 502), word(1, 1, 503)]]
    query, got = run(spark, parts, TIMED, str(tmp_path / "idle"), lambda s: jobs.stream_pauses(s, idle_ms=60_000, event="made"))
    assert got.filter("late").count() == 0 and got.filter("utt_id = 1").count() == 2  # the second time it is a new utterance


def test_vad_and_idle_close(spark, store, tmp_path):
    """Segments as they close; those still open when a recording falls idle are closed by the timer."""
    flags = fx.frames(spark, D).select("utt_id", F.col("frame").cast("long").alias("frame"), "is_speech").filter("frame < 120 and utt_id < 2000")
    rows = [(*r, at(r.frame * 0.03)) for r in flags.collect()]
    parts = [*dealt(rows, 3), [(-1, 0, False, at(10_000))], [(-1, 1, False, at(10_001))]]
    _, got = run(spark, parts, "utt_id long, frame long, is_speech boolean, made timestamp", str(tmp_path / "vad"), lambda s: jobs.stream_vad(s, idle_ms=60_000, event="made"))
    every = vad.vad_segments(vad.smooth_vad(flags))
    assert got.filter("late").count() == 0 and jobs.open_segments(flags).count() > 3
    assert sorted(map(tuple, got.drop("late").collect())) == sorted(map(tuple, every.collect())) and got.count() > 10


def test_the_state_store_is_asked_for(spark):
    source = spark.readStream.format("rate").load().selectExpr("value as utt_id", "value as pos", "value as clause_id", "0.0 as start_time", "1.0 as end_time")
    with pytest.raises(ValueError, match="RocksDB"):
        jobs.stream_pauses(source)


def test_runs(spark, tmp_path):
    w = fx.words(spark, D).select("utt_id", F.col("pos").cast("long").alias("pos"), "start_time", "end_time").filter("pos < 60")
    batch, rows = jobs.speech_runs(w), list(map(tuple, w.collect()))
    _, got = run(spark, [rows], w.schema, str(tmp_path / "runs"), lambda s: jobs.speech_runs(s, watermark="1 second"), "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    counts = {r.utt_id: r.n for r in batch.groupBy("utt_id").agg(F.count("*").alias("n")).collect()}
    found = {r.utt_id: r.n for r in pauses.detect_pauses(w.withColumn("clause_id", F.lit(0)), GAP).groupBy("utt_id").agg(F.count("*").alias("n")).collect()}
    assert all(counts[u] == found.get(u, 0) + 1 for u in counts)


def test_runs_in_append_mode(spark, tmp_path):
    """Runs come out when the watermark passes them; what comes later still is counted."""
    rows = [(u, k, 1000 * k // (1 + k % 2), 1000 * k // (1 + k % 2) + 900) for u in range(3) for k in range(40)]
    schema = "utt_id long, pos long, start_time long, end_time long"
    parts = [*dealt(rows, 3), [end := jobs.end_of_input(40_000 + 3_600_000)], [end], [(0, 99, 5_000, 5_100)]]
    query, got = run(spark, parts, schema, str(tmp_path / "append"), lambda s: jobs.speech_runs(s, watermark="30 minutes"))
    assert sorted(map(tuple, got.filter("utt_id >= 0").collect())) == sorted(map(tuple, jobs.speech_runs(spark.createDataFrame(rows, schema)).collect()))
    assert jobs.dropped_rows(query) == 1


def test_what_waits_is_small(spark, store, tmp_path):
    """Frames in any order: they are packed before the watermark and the shuffle, and a waiting frame takes few bytes of state."""
    rng = random.Random(8)
    rows = [(u, k, rng.random() < 0.5 + 0.45 * (-1) ** (k // 40)) for u in range(12) for k in range(6000)]
    flags = spark.createDataFrame(rows, "utt_id long, frame long, is_speech boolean")
    query, got = run(spark, dealt(rows, 3), flags.schema, str(tmp_path / "small"), lambda s: jobs.stream_vad(s, idle_ms=None))
    closed = vad.vad_segments(vad.smooth_vad(flags)).join(jobs.open_segments(flags), ["utt_id", "start_ms"], "left_anti")
    assert got.filter("late").count() == 0 and got.count() > 100
    assert sorted(map(tuple, got.drop("late").collect())) == sorted(map(tuple, closed.select("utt_id", "start_ms", "end_ms").collect()))
    written = sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/small-log/state/**/*.sst", recursive=True))
    assert 0 < written < 2 * len(rows)
    plan = query._jsq.explainInternal(False)
    assert plan.index("EventTimeWatermark") < plan.index("MapInArrow")  # printed from the top: the watermark sees packed rows


def test_packed_rows():
    for a in ([], [5], [3, 1, -(1 << 63), (1 << 63) - 1], list(range(0, 9000, 7))):
        columns = [np.array(a, np.int64), np.arange(len(a)) % 3 == 0, np.array(a) / 7, np.array([None, True, "x", 1][: len(a)], object)]
        back = ordered.unpacked(ordered.packed(columns))
        assert [x.dtype for x in back] == [x.dtype for x in columns] and all(x.tolist() == y.tolist() for x, y in zip(back, columns, strict=True))
    assert len(ordered.packed([np.arange(90_000), np.arange(90_000) % 5 < 2])) < 3000


def test_lots_of_keys(spark, monkeypatch):
    """Null keys are kept, a key's rows may lie in several lots, and the newest event is the lot's."""
    monkeypatch.setattr(ordered, "LOT", 50)
    rows = [(None if k % 4 == 3 else f"u{k % 4}", k, 1000 + k % 17) for k in range(200)]
    df = spark.createDataFrame(rows, "utt_id string, place long, event_ms long").coalesce(1)
    lots = ordered.pack_by_key(df, "place", ["place", "event_ms"]).collect()
    found = [(r.utt_id, *x) for r in lots for x in zip(*(a.tolist() for a in ordered.unpacked(r.rows)), strict=True)]
    assert sorted(map(str, found)) == sorted(map(str, rows)) and len(lots) < 30
    assert all(r.newest == max(ordered.unpacked(r.rows)[1]) for r in lots)
    monkeypatch.setattr(ordered, "PIECE", 3)
    pieces = ordered.pack_by_key(df, "place", ["place", "event_ms"]).collect()
    found = [(r.utt_id, *x) for r in pieces for x in zip(*(a.tolist() for a in ordered.unpacked(r.rows)), strict=True)]
    assert sorted(map(str, found)) == sorted(map(str, rows)) and max(len(ordered.unpacked(r.rows)[0]) for r in pieces) == 3


def test_many_waiting_rows_go_to_list_state(spark, store, tmp_path):
    """Rows too many to lie beside the memory: nothing can follow until the first word comes last."""
    rng = random.Random(9)
    ends = [k + 0.2 + rng.random() for k in range(30_000)]  # do not compress
    rows = [(u, k, k // 50, k * 1.0, ends[k]) for u in (1, 2) for k in range(30_000 if u == 1 else 40)]
    parts = [[r for r in rows if r[1] % 3 == 2], [r for r in rows if r[1] % 3 == 1], [r for r in rows if r[1] % 3 == 0]]
    _, got = run(spark, parts, WORD, str(tmp_path / "many"), lambda s: jobs.stream_pauses(s, idle_ms=None))
    expect = pauses.detect_pauses(spark.createDataFrame(rows, WORD)).select("utt_id", "location", "start_time", "end_time")
    assert got.filter("late").count() == 0
    assert sorted(map(tuple, got.drop("late").collect())) == sorted(map(tuple, expect.collect())) and got.count() > 10_000


def test_recordings_are_torn_apart(spark):
    rows = spark.range(3000).selectExpr("id % 7 as utt_id", "id div 7 as pos").repartition(5)
    before = {k: spark.conf.get(k) for k in (STORE[0], *ordered.NARROW)}
    got = q_workloads._streamed(rows, "pos", lambda s: s.withColumn("at", F.current_timestamp()), "torn")
    assert {k: spark.conf.get(k) for k in before} == before != dict([STORE]) | ordered.NARROW
    assert got.count() == 3000 and got.distinct().count() == 3000
    assert [r[0] for r in got.groupBy("utt_id").agg(F.countDistinct("at").alias("n")).select("n").collect()] == [3] * 7
