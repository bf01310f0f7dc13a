"""Operators that take one pass against the forms with joins or plain loops, and the plans of registered queries."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from speechstats.operators import clauses, corpus, grid, lexicon, measures, pauses
from speechstats.plans import q_workloads, registry
from speechstats.ranks import placed
from speechstats.scratch import by_recording

D = "/root/testdata/sf0.001"
WORDS = "utt_id long, pos int, text string, start_time double, end_time double, clause_id long, disfluency string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def words(spark, seed=1, utterances=12):
    rng, rows = random.Random(seed), []
    for u in range(utterances):
        t, clause = 0.0, 0
        for k in range(rng.randint(1, 40)):
            t = round(t + rng.choice([0, 0, 0, 0.1, 0.25, 0.5]), 2)
            clause += k > 0 and rng.random() < 0.2
            end = round(t + rng.choice([0.1, 0.2, 0.4]), 2)
            rows.append((u, k, rng.choice(['uh', 'a "b"', "straße", "table"]), t, end, clause, rng.choice([None, None, None, "FILLER", "REPETITION", "SELF_REPAIR", "FALSE_START", "OTHER"])))
            t = end
    rng.shuffle(rows)
    return spark.createDataFrame(rows, WORDS).repartition(3)


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_grid_is_that_of_the_parts(spark):
    w = words(spark)
    ps = pauses.detect_pauses(w)
    parts = grid.to_grid(w, ps)
    same(grid.grid(w), parts)
    same(grid.textgrid(w), grid.render_textgrid(parts, grid.grid_ends(w, ps)))
    assert grid.grid(w.limit(0)).count() == 0


def test_params_are_those_of_the_parts(spark):
    w = words(spark, 2).withColumn("location", F.lit("x"))
    for pruning in (True, False):
        rounded = lambda df: df.select("utt_id", *(F.round(c, 6).alias(c) for c in measures.SUMS))
        same(rounded(measures.params_of_words(w, pruning)), rounded(measures.fluency_params(w, pauses.detect_pauses(w), pruning)))


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", ["g_measures", "f6_extract", "e14_grid", "a14_textgrid"])
def test_one_exchange_and_one_scan(spark, name):
    found = plan(registry.QUERIES[name](spark, D))
    assert found.count("Exchange") == 1 and found.count("Exchange hashpartitioning(utt_id") == 1 and found.count("FileScan") == 1 and "Join" not in found


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_recordings_to_measures_on_one_partitioning(spark):
    """Of four tables (words twice, with and without their columns, edges, boundaries) each is exchanged once, by utt_id."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        with by_recording(spark):
            lines = [x for x in plan(q_workloads.recordings_to_measures(spark, D)).splitlines() if "Exchange" in x]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    own = [x for x in lines if "ReusedExchange" not in x]
    assert len(own) <= 4 and all(re.search(r"hashpartitioning\(utt_id#\d+L?, \d+\)", x) for x in own), own
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_silences_in_clauses_that_nest_and_cross(spark):
    rng = random.Random(4)
    cl = [(u, a, a + rng.randint(0, 30)) for u in range(4) for a in (rng.randint(0, 100) for _ in range(15))]
    si = [(u, a, a + rng.randint(0, 12)) for u in range(5) for a in (rng.randint(0, 110) for _ in range(60))]
    kind = "utt_id long, start_time long, end_time long"
    got = pauses.locate_pauses(spark.createDataFrame(si, kind), spark.createDataFrame(cl, kind))
    expect = [(u, "CI" if any(v == u and c < a and b < d for v, c, d in cl) else "CE", a, b) for u, a, b in si]
    assert sorted(map(tuple, got.collect())) == sorted(expect) and len({e[1] for e in expect}) == 2
    assert "Join" not in plan(got)


def owners(tokens):
    """Of (token, head, marked): the nearest marked token at or above, else the root; None on and below circles."""
    head, mark = {t: h for t, h, _ in tokens}, {t: m for t, _, m in tokens}
    out = {}
    for t in head:
        at, steps = t, 0
        while at is not None and not mark[at] and head[at] in head and head[at] != at:
            at, steps = head[at], steps + 1
            if steps > len(head):
                at = None
        out[t] = at
    return out


def test_owners_on_any_edges(spark):
    rng, rows, expect = random.Random(5), [], {}
    fixed = [[(1, 2, False), (2, 3, False), (3, 1, False)], [(1, 0, False), (2, 9, False), (3, 2, False), (4, 1, False)], [(1, None, False), (2, 1, False), (3, None, True)], [(1, 1, False)], [(1, 2, True), (2, 1, False), (3, 2, False)]]
    drawn = [[(t, rng.choice([None, *range(n + 2)]), rng.random() < 0.15) for t in range(1, n + 1)] for n in (1, 2, 5, 9, 30, 60)]
    chain = [[(t, t - 1, False) for t in range(1, 200)]]
    for s, tokens in enumerate([*fixed, *drawn, *chain]):
        rows += [(1, s, t, h, "advcl" if m else "dep", "x") for t, h, m in tokens]
        expect |= {(s, t): o for t, o in owners(tokens).items()}
    dep = spark.createDataFrame(rows, "utt_id long, sent_id long, token_id int, head int, deprel string, owner_name string")
    for form in (clauses.clause_owner, clauses.clause_owner_by_joins):
        assert {(r.sent_id, r.token_id): r.owner for r in form(dep).collect()} == expect
    assert expect[0, 1] is None and expect[1, 2] == 2 and expect[1, 4] == 1
    assert clauses.clause_owner(dep, mode="queue").count() == len(rows)  # ends on circles too


def test_places_and_totals(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", None, "b"]) if k % 3 else "hot", rng.randint(0, 50), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, place_of int").repartition(5)
    got = placed(df, ["k"], [F.col("v"), F.col("place_of")])
    by = {}
    for r in sorted(rows, key=lambda r: r[1:]):
        by.setdefault(r[0], []).append(r)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((*r, i, len(own))) for own in by.values() for i, r in enumerate(own))
    whole = [tuple(r) for r in placed(df, [], [F.col("v"), F.col("place_of")]).collect()]
    assert sorted(r[3] for r in whole) == list(range(3000)) and {r[4] for r in whole} == {3000}
    assert placed(df.limit(0), ["k"], [F.col("v")]).count() == 0


def test_batches_of_rows_of_one_length(spark, monkeypatch):
    """One length for all rows: places come from several tasks, not from one window over them."""
    from speechstats import ranks

    old, written, real = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), [], ranks.stored
    monkeypatch.setattr(ranks, "stored", lambda df, name: written.append(real(df, name)) or written[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).select(F.lit("a").alias("split"), F.col("id").alias("pos"), F.lit(7).alias("length"), F.lit(0).cast("long").alias("bucket")).repartition(4)
        got = corpus.pack_batches(df, 70, exact=True)
        shares = [r["count"] for r in written[0].groupBy(F.input_file_name().alias("task")).count().collect()]
        assert len(shares) >= 3 and max(shares) < 12_000
        assert [tuple(r) for r in got.groupBy("batch").agg(F.count("*"), F.min("pos"), F.max("pos")).orderBy("batch").collect()] == [(k, 10, 10 * k, 10 * k + 9) for k in range(2000)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_syllables_by_lexicon(spark):
    said = ["the"] * 900 + ["Table", "table", "unknown", None, "straße", "mute", "The", "x"] * 10
    w = spark.createDataFrame([(k, t, 1) for k, t in enumerate(said)], "pos int, text string, n int")
    lex = [("THE", 0, ["DH", "AH0"]), ("the", 1, ["DH", "IY0", "IY1"]), ("table", 2, ["T", "EY1", "B", "AH0", "L"]), ("mute", 0, ["M"]), (None, 0, ["AH0"]), ("straße", 0, None), ("never", 0, ["AH0", "AH1"])]
    dictionary = spark.createDataFrame(lex, "word string, order int, phones array<string>")
    expect = {"the": 1, "The": 1, "Table": 2, "table": 2, "unknown": 2, None: None, "straße": 1, "mute": 1, "x": 1}
    for size in (1 << 20, 0):
        got = lexicon.with_syllables(w, dictionary, sent_bytes=size)
        assert [r.syl for r in got.orderBy("pos").collect()] == [expect[t] for t in said] and got.columns == ["pos", "text", "n", "syl"]
    hashed = lexicon.look_up(w, lexicon.stress_counts(dictionary).withColumnRenamed("n", "syl"), sent_bytes=0)
    assert "Union" in plan(hashed) and plan(hashed).count("BroadcastHashJoin") >= 1  # the frequent words take no hash exchange
    assert lexicon.with_syllables(w.limit(0), dictionary).count() == 0 and lexicon.with_syllables(w, dictionary.limit(0)).count() == len(said)
