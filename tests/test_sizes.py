"""What a task holds as the input grows, and joins that must not be sent whole to every task."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from speechstats.operators import clauses, tokens, vad
from speechstats.plans import fixtures, q_workloads
from speechstats.scratch import by_recording

D = "/root/testdata/sf0.001"


def test_word_times_is_linear_and_joins_nothing(spark):
    rng, spans, words, expect = random.Random(3), [], [], []
    for u in range(6):
        n, t, lo = (90, 40, 3, 0)[u % 4], 0, 0
        own = []
        for k in range(n):
            t += rng.randint(0, 3)
            own.append((t, t := t + rng.randint(1, 5)))
            spans.append((u, k, *own[-1]))
        for pos in range(12):
            text = rng.choice(["", None, "a", "word", "straße"])
            words.append((u, pos, text))
            if text:
                if taken := own[lo : lo + len(text)]:
                    expect.append((u, pos, text, taken[0][0], taken[-1][1]))
                lo += len(text)
    rng.shuffle(words)
    got = tokens.word_times(spark.createDataFrame(spans, "utt_id long, span int, start long, end long"), spark.createDataFrame(words, "utt_id long, pos int, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(expect) and len(expect) > 20
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_words_and_frames_of_a_task_do_not_grow(spark, monkeypatch):
    """Adaptive execution would put these small shuffles into one partition, and all frames into one task."""
    chars = spark.read.parquet(f"{D}/conversations.parquet").filter("role <> 'system'").agg(F.sum(F.length("text")), F.max(F.length("text"))).first()
    monkeypatch.setattr(fixtures, "TASK_CHARS", 2000)
    for table, most in ((fixtures.words, 1), (fixtures.frames, 8)):
        tasks = [r["count"] for r in table(spark, D).groupBy(F.spark_partition_id()).count().collect()]
        assert len(tasks) > chars[0] / 2000 / 2 and max(tasks) < most * (4 * 2000 + chars[1])


def test_rounds_of_owners_carry_ids_of_what_moves(spark, monkeypatch):
    """A chain below one mark beside many settled tokens: each round writes the tokens that still moved, without other columns."""
    written, real = [], clauses.stored
    monkeypatch.setattr(clauses, "stored", lambda df, name: written.append(real(df, name)) or written[-1])
    rows = [(1, 0, t, t - 1, "advcl" if t == 2 else "dep", "x" * 50) for t in range(1, 40)] + [(2, s, t, 0, "root", "y" * 50) for s in range(20) for t in range(1, 20)]
    got = clauses.clause_owner_by_joins(spark.createDataFrame(rows, "utt_id long, sent_id long, token_id int, head int, deprel string, note string"))
    assert {(r.utt_id, r.sent_id, r.token_id): r.owner for r in got.collect()} == {(u, s, t): 2 if u == 1 and t > 1 else t for u, s, t, *_ in rows}
    assert len(written) > 4 and all("note" not in w.columns for w in written) and written[0].count() == len(rows)
    counts = [w.count() for w in written[1:]]
    assert counts == sorted(counts, reverse=True) and counts[0] < 40


def test_nothing_is_broadcast_by_recording(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(k, None) for k in names]
    a = spark.range(50).selectExpr("id as utt_id", "id as pos")
    with by_recording(spark):
        assert "Broadcast" not in a.join(a.selectExpr("utt_id", "pos", "1 as x"), ["utt_id", "pos"])._jdf.queryExecution().executedPlan().toString()
    assert [spark.conf.get(k, None) for k in names] == before


def test_smooth_segments_pass_frames_once(spark):
    """The same segments as by states, from fewer rows: one window operator holds frames, the others only what changes."""
    rng, rows = random.Random(5), []
    for u in range(30):
        p = 0.5
        for k in range(rng.choice([0, 1, 9, 10, 200])):
            p = rng.choice([0.02, 0.5, 0.98]) if k % 15 == 0 else p
            rows.append((u, k, None if u % 7 == 3 and rng.random() < 0.3 else rng.random() < p))
    rng.shuffle(rows)
    flags = spark.createDataFrame(rows, "utt_id long, frame int, is_speech boolean")
    expect = sorted(map(tuple, vad.vad_segments(vad.smooth_vad(flags)).collect()))
    got = vad.smooth_segments(flags)
    found = sorted(map(tuple, got.collect()))
    assert found == expect
    assert len(expect) > 10
    ops = re.findall(r"(Window|Filter) \[?", got._jdf.queryExecution().optimizedPlan().toString())
    assert ops.count("Window") == 3 and ops[-1] == "Window" and "Filter" in ops[-3:-1]


def test_spans_without_scores_pass_frames_once(spark):
    """Runs with gaps in the frames' numbers and missing labels: the same spans from one window over frames and no aggregate."""
    rng, rows = random.Random(11), []
    for u in range(40):
        at = 0
        for k in range(rng.choice([1, 2, 30, 200])):
            at += rng.choice([1, 1, 1, 1, 3])
            rows.append((u, at, rng.choice([None, 0, 0, 1, 1, 1, 2]) if rng.random() < 0.5 or not k else rows[-1][2], rng.random()))
    rng.shuffle(rows)
    frames = spark.createDataFrame(rows, "utt_id long, frame int, label long, score double")
    got = tokens.merge_spans(frames.drop("score"))
    expect = tokens.merge_spans(frames).drop("score")
    assert got.schema.simpleString() == expect.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, expect.collect())) and got.count() > 300
    found = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in found and re.findall(r"(Window|Filter) \[?", found)[-1] == "Window" and "Filter" in re.findall(r"(Window|Filter) \[?", found)[-3:-1]


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_recordings_to_measures_pass_frames_once(spark, monkeypatch):
    written, real = [], q_workloads.stored
    monkeypatch.setattr(q_workloads, "stored", lambda df, name: written.append(df) or real(df, name))
    with by_recording(spark):
        last = q_workloads.recordings_to_measures(spark, D)
        made = [df._jdf.queryExecution().optimizedPlan().toString().count("explode(sequence(") for df in (*written, last)]
    assert made == [1, 0]


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_no_window_reads_on_to_the_end_for_each_word(spark):
    assert "unboundedfollowing" not in fixtures.tags(spark, D)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_shuffle_partitions_by_recording(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    for tasks, inside in ((1, before), (77, "77")):
        with by_recording(spark, tasks):
            assert spark.conf.get(name) == inside
        assert spark.conf.get(name) == before
