"""Hand-made rows for the rules that the tables do not reach."""

import math

import pytest
from pyspark.sql import functions as F

from speechstats import schema
from speechstats.functions import text as x
from speechstats.operators import clauses, corpus, grid, measures, pauses, tagging, tokens, vad
from speechstats.sources import io

WORDS = "I am a st- student He she is my friend and she is so cute".split()


@pytest.fixture(scope="module")
def turn(spark):
    """15 words of a second each, ``student`` takes two; two self-repairs; split after words 9 and 4."""
    rows, t = [], 0.0
    for k, w in enumerate(WORDS):
        end = t + (2.0 if w == "student" else 1.0)
        rows.append((1, k, w, t, end, "SELF_REPAIR" if k in (3, 5) else None, 0, 0))
        t = end
    df = spark.createDataFrame(rows, "utt_id long, pos int, text string, start_time double, end_time double, disfluency string, sent_id long, clause_id long")
    df = tagging.with_fluent_idx(df)
    # Words 4 and 9 are the fluent words 3 and 7.
    return clauses.split_clauses(df, spark.createDataFrame([(1, 7), (1, 3)], "utt_id long, fluent_idx long")).cache()


def test_turn(turn):
    rows = {r.clause_id: r for r in clauses.clause_texts(turn).collect()}
    assert [rows[k].text_full for k in range(3)] == ["I am a st- student", "He she is my friend", "and she is so cute"]
    assert [rows[k].text_fluent for k in range(3)] == ["I am a student", "she is my friend", "and she is so cute"]
    assert pauses.detect_pauses(turn).count() == 0
    whole = clauses.utterance_intervals(turn).first()
    assert (whole.start_time, whole.end_time) == (0.0, 16.0)
    both = clauses.utterance_texts(turn).first()
    assert both.text_full == " ".join(WORDS)
    assert grid.annotated_text(turn).first().text.split("\n")[1] == "text_with_pruning: I am a student :: she is my friend :: and she is so cute"


def test_grid_tiles_the_utterance(turn):
    ps = pauses.detect_pauses(turn)
    tiers = grid.to_grid(turn, ps)
    text = grid.render_textgrid(tiers, grid.grid_ends(turn, ps)).first().text
    assert "PointTier" not in text and text.count("TextTier") == 5 and "xpos" not in text and 'mark = "st-"' in text
    for tier in ("transcript", "pause"):
        own = sorted((r.xmin, r.xmax) for r in tiers.filter(F.col("tier") == tier).collect())
        assert own[0][0] == 0 and own[-1][1] == 16 and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))


def test_threshold_pair(spark):
    """A pause of exactly the threshold is annotated, not counted."""
    rows = [(1, 0, "a", 0.0, 1.0, 0), (1, 1, "b", 1.25, 2.0, 0), (1, 2, "c", 2.5, 3.0, 1)]
    df = spark.createDataFrame(rows, "utt_id long, pos int, text string, start_time double, end_time double, clause_id long").withColumn("disfluency", F.lit(None).cast("string"))
    found = pauses.detect_pauses(df)
    assert [(r.location, r.start_time, r.end_time) for r in found.orderBy("seq").collect()] == [("CI", 1.0, 1.25), ("CE", 2.0, 2.5)]
    p = measures.fluency_params(df, found).first()
    assert (p.n_mc, p.n_ec, p.sum_ec) == (0, 1, 0.5)
    m = measures.fluency_measures(measures.fluency_params(df, found)).first()
    assert m.mid_clause_p_dur == 0 and m.end_clause_p_dur == 0.5 and math.isclose(m.phonation_time_rate, 2.5 / 3)


def test_all_disfluent_utterance(spark):
    rows = [(1, 0, "uh", 0.0, 1.0), (1, 1, "um", 1.0, 2.0)]
    df = tagging.mark_fillers(spark.createDataFrame(rows, "utt_id long, pos int, text string, start_time double, end_time double"))
    df = tagging.assign_sentences(df, F.lit(True)).withColumn("clause_id", F.col("sent_id"))
    assert {r.sent_id for r in df.collect()} == {0}
    m = measures.extract(df).first()
    assert m.speech_rate == 0 and m.filled_pause_ratio is None and m.mean_length_of_run == 0
    assert measures.extract(df, pruning=False).first().filled_pause_ratio == 1.0


def test_zero_duration(spark):
    df = spark.createDataFrame([(1, 0, "a", 1.0, 1.0, None, 0)], "utt_id long, pos int, text string, start_time double, end_time double, disfluency string, clause_id long")
    assert measures.extract(df).first().speech_rate is None


def test_sentence_end_before_a_filler(spark):
    rows = [(1, 0, "so", True), (1, 1, "uh", True), (1, 2, "we", False), (1, 3, "go", True)]
    df = tagging.mark_fillers(spark.createDataFrame(rows, "utt_id long, pos int, text string, is_end boolean"))
    assert [r.sent_id for r in tagging.assign_sentences(df).orderBy("pos").collect()] == [0, 1, 1, 1]


@pytest.mark.parametrize(
    ("tags", "expect"),
    [
        ("C IE C O", [("IE:b", "c")]),  # a correction before any reparandum is ignored
        ("IE IE C C O", [("ab", "cd")]),
        ("IE O IE C", [("a", ""), ("c", "d")]),
        ("O C C O", []),
        ("IE C IE C", [("ac", "bd")]),
    ],
)
def test_spans(spark, tags, expect):
    rows = [(1, 0, k, "abcde"[k], t) for k, t in enumerate(tags.split())]
    df = spark.createDataFrame(rows, "utt_id long, sent_id long, pos int, text string, tag string")
    got = [(r.reparandum, r.correction) for r in tagging.repair_spans(df).orderBy("first_pos").collect()]
    assert got == [(a.removeprefix("IE:"), b) for a, b in expect]


def test_repetition_and_repair(spark):
    rows = [(1, 0, k, w, t, None) for k, (w, t) in enumerate([("he", "IE"), ("he", "C"), ("is", "O"), ("a", "IE"), ("the", "C")])]
    df = tagging.mark_repairs(spark.createDataFrame(rows, "utt_id long, sent_id long, pos int, text string, tag string, disfluency string"))
    assert [r.disfluency for r in df.orderBy("pos").collect()] == ["REPETITION", None, None, "SELF_REPAIR", None]


def test_model_slot(spark):
    df = spark.createDataFrame([(1, 0, k, w) for k, w in enumerate("a b c d".split())] + [(2, 0, 0, "e")], "utt_id long, sent_id long, pos int, text string")
    out = tagging.tag_sequences(df, lambda: lambda texts: [["I"] * min(2, len(t)) for t in texts]).orderBy("utt_id", "pos").collect()
    assert [r.tag for r in out] == ["I", "I", "O", "O", "I"]


def test_embedded_clause(spark):
    """The man [who came] left: the relative clause lies inside the main one."""
    dep = [(1, 2, "nsubj"), (2, 5, "nsubj"), (3, 4, "nsubj"), (4, 2, "acl:relcl"), (5, 0, "root")]
    df = spark.createDataFrame([(1, 0, t, h, r, t - 1) for t, h, r in dep], "utt_id long, sent_id long, token_id long, head long, deprel string, fluent_idx long")
    for owned in (clauses.clause_owner(df), clauses.clause_owner_by_joins(df), clauses.clause_owner(df, mode="queue")):
        assert [r.owner for r in owned.orderBy("token_id").collect()] == [5, 5, 4, 4, 5]
        assert sorted(r.fluent_idx for r in clauses.clause_boundaries(owned).collect()) == [1, 3]
    with pytest.raises(ValueError):
        clauses.clause_owner(df, mode="other")


def test_queue_loses_marks_in_frozen_trees(spark):
    """Marks 2 and 4 below different trees: the tree popped first lacks mark 4 and is frozen with it."""
    dep = [(1, 0, "root"), (2, 1, "advcl"), (3, 2, "advcl"), (4, 1, "advcl")]
    df = spark.createDataFrame([(1, 0, t, h, r) for t, h, r in dep], "utt_id long, sent_id long, token_id long, head long, deprel string")
    owner = lambda mode: [r.owner for r in clauses.clause_owner(df, mode=mode).orderBy("token_id").collect()]
    assert owner("nearest") == [1, 2, 3, 4]
    assert owner("queue") == [1, 2, 3, 1]


def test_shorten_stops_at_the_first_late_word(spark):
    rows = [(1, k, "w", t, t + 1.0, 0) for k, t in enumerate([0.0, 5.0, 2.0])]
    df = spark.createDataFrame(rows, "utt_id long, pos int, text string, start_time double, end_time double, clause_id long")
    assert [r.pos for r in clauses.shorten(df, 4.0).collect()] == [0]


def test_connector_chain(spark):
    df = spark.createDataFrame([(1, k, w, float(k), k + 1.0) for k, w in enumerate(["a", "-b", "-c", "d"])], "utt_id long, pos int, text string, start_time double, end_time double")
    assert [(r.text, r.start_time, r.end_time) for r in tokens.glue_connectors(df).orderBy("pos").collect()] == [("a-b-c", 0.0, 3.0), ("d", 3.0, 4.0)]


def flags(spark, bits):
    return spark.createDataFrame([(1, k, b == "1") for k, b in enumerate(bits)], "utt_id long, frame long, is_speech boolean")


def loop_segments(bits, step=30):
    """The frame loop that the windows stand for."""
    ring, on, start, out = [], False, 0, []
    for k, b in enumerate(bits):
        ring = (ring + [b == "1"])[-10:]
        if not on and sum(ring) >= 9:
            on, start = True, k
        elif on and sum(ring) <= 1:
            on = False
            out.append((start * step, k * step))
    return out + ([(start * step, (len(bits) - 1) * step)] if on else [])


@pytest.mark.parametrize("bits", ["1" * 20, "0" * 20, "1" * 15 + "0" * 20 + "1" * 12, "1" * 9 + "0" + "1" * 5 + "0" * 9 + "1" * 30, "01" * 40, "1" * 8])
def test_vad(spark, bits):
    got = sorted((r.start_ms, r.end_ms) for r in vad.vad_segments(vad.smooth_vad(flags(spark, bits))).collect())
    assert got == loop_segments(bits)


def test_last_island_from_frame_zero_is_dropped(spark):
    df = spark.createDataFrame([(u, k, 60.0) for u in (1, 2) for k in (range(20) if u == 1 else [*range(20), *range(30, 50)])], "utt_id long, frame long, intensity double")
    got = [(r.utt_id, r["first"]) for r in vad.sounding_intervals(vad.sounding_frames(df)).collect()]
    assert sorted(got) == [(2, 0), (2, 30)]


def test_pcm(spark):
    data = bytes(range(256)) * 7
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b""))], "utt_id long, pcm binary")
    rows = vad.pcm_frames(df, 8000, 10).orderBy("frame").collect()
    assert [bytes(r.data) for r in rows] == [data[k : k + 160] for k in range(0, len(data), 160)]
    with pytest.raises(ValueError):
        vad.pcm_frames(df, 44100)


def test_voiced_and_silences(spark):
    s = spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, 4.0), (2, 0.0, 1.0)], "utt_id long, start_time double, end_time double")
    du = spark.createDataFrame([(1, 5.0), (2, 1.0), (3, 2.0)], "utt_id long, duration double")
    got = sorted((r.utt_id, r.start_time, r.end_time) for r in pauses.voiced(s, du).collect())
    assert got == [(1, 0.0, 1.0), (1, 2.0, 3.0), (1, 4.0, 5.0), (3, 0.0, 2.0)]
    back = sorted((r.utt_id, r.start_time, r.end_time) for r in pauses.silences(pauses.voiced(s, du)).collect())
    assert back == [(1, 1.0, 2.0), (1, 3.0, 4.0)]


def test_located_ties_are_external(spark):
    c = spark.createDataFrame([(1, 0.0, 5.0), (1, 6.0, 9.0)], "utt_id long, start_time double, end_time double")
    s = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 2.0), (1, 4.0, 5.0), (1, 5.0, 6.0), (1, 6.0, 7.0), (1, 7.0, 8.0), (2, 1.0, 2.0)], "utt_id long, start_time double, end_time double")
    expect = ["CE", "CI", "CE", "CE", "CE", "CI", "CE"]
    for f in (pauses.locate_pauses,):
        assert [r.location for r in f(s, c).orderBy("utt_id", "start_time").collect()] == expect


def test_merge_is_a_ratio_of_sums(spark):
    rows = [(1, "s", *range(1, 12)), (2, "s", *range(11, 22)), (3, "t", *range(11))]
    df = spark.createDataFrame(rows, "utt_id long, speaker string, " + ", ".join(f"{c} long" for c in measures.SUMS))
    one = measures.merge_params(df.filter("utt_id = 1"), "utt_id").first()
    assert [one[c] for c in measures.SUMS] == list(range(1, 12))
    s = {r.speaker: r for r in measures.merge_params(df, "speaker").collect()}
    assert s["s"].n_syl == 14 and measures.rollup_params(df, "speaker").filter("level = 1").first().n_syl == 15
    with pytest.raises(ValueError):
        measures.fluency_measures(df, ["no_such"])


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


NUMBERS = {
    0: "zero", 7: "seven", 21: "twenty-one", 100: "one hundred", 115: "one hundred fifteen", 1000: "one thousand", 1001: "ten oh one", 1905: "nineteen oh five", 1999: "nineteen ninety-nine",
    2000: "two thousand", 2004: "two thousand four", 2010: "twenty ten", 2100: "twenty-one hundred", 2999: "twenty-nine ninety-nine", 3000: "three thousand", 12345: "twelve thousand, three hundred forty-five",
    1_000_001: "one million, one",
}


@pytest.mark.parametrize(("n", "expect"), NUMBERS.items())
def test_numbers(spark, n, expect):
    assert value(spark, x.int_to_words(F.lit(n))) == expect


TEXTS = [
    (x.expand_dollars, "$1.50 and $2 and $0.01 and $1,000.2 and $0 and $1.2.3", "1 dollar, 50 cents and 2 dollars and 1 cent and 1000 dollars, 2 cents and zero dollars and 1.2.3 dollars"),
    (x.expand_ordinals, "the 1st, 2nd, 3rd, 12th, 20th, 21st, 100th", "the first, second, third, twelfth, twentieth, twenty-first, one hundredth"),
    (x.expand_numbers, "1,2,,3,4 ,5, 3.14", "twelve thirty-four ,five, three point fourteen"),
    (x.expand_cardinals, "1" * 19, " ".join(["one"] * 19)),
    (x.english_cleaners, "Dr. Müller  paid £5 on St. Co.", "doctor muller paid psfive on saint company"),
    (x.alignment_text, "Well, <inaudible> (laughs) re-do R&D: 5%!", "well * re do r and d five percents"),
    (x.display_text, "Well, <inaudible> re-do it", "well <inaudible> re -do it"),
    (x.alternative_text, "it's 50% or 1%, re-do <x>", "its fifty percents or one percent re-do x"),
    (x.alternative_text, "it's 50% [um] {x} <y> re-do #1: a*b", "its fifty percents um x y re-do #one: a*b"),
    (x.expand_ordinals, "101st 1001st 1100th 2345th 1000000th", "one hundred and first one thousand and first one thousand, one hundredth two thousand, three hundred and forty-fifth one millionth"),
    (x.expand_ampersand, "a&b&c", "a and bandc"),
    (x.same_count_text, "Hi, -- it's  me", "hi * it's me"),
    (x.same_count_text, " a\tB\u00a0\r\n c. ", "a b c"),
    (x.fold_ascii, "Ægir “naïve” straße – Ł 日", "AEgir \"naive\" strasse - L "),
]


@pytest.mark.parametrize(("f", "text", "expect"), TEXTS)
def test_texts(spark, f, text, expect):
    assert value(spark, f(F.lit(text))) == expect
    assert value(spark, f(F.lit(None).cast("string"))) is None


def test_clock(spark):
    assert [value(spark, x.clock_to_ms(F.lit(t))) for t in ("01:02:03.5", "00:00:00.04", "00:00:01", "0:1:2.1234", "x")] == [3723500, 40, 1000, 62123, None]


def test_validation(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0, 0), ("", 0.0, 1.0, 1), (None, 0.0, 1.0, 2), ("b", -1.0, 1.0, 3), ("c", 2.0, 1.0, 4), ("d", None, 1.0, 5), ("e", 0.0, 1.0, -1)], "text string, start_time double, end_time double, pos int")
    good, bad = schema.split_valid(df)
    assert [r.text for r in good.collect()] == ["a"]
    assert [r.reason for r in bad.collect()] == ["text empty", "text missing", "start negative", "end before start", "time missing", "index negative"]


def test_buckets(spark):
    df = spark.createDataFrame([(k, k * 3 + 5) for k in range(30)], "pos long, length long")
    n, lengths = 4, [k * 3 + 5 for k in range(30)]
    edges = [min(lengths) + (max(lengths) - min(lengths)) * k / (n - 1) for k in range(n)]
    expect = {v: next(k for k, e in enumerate(edges) if v <= e + 1e-9) for v in lengths}
    assert {r.length: r.bucket for r in corpus.length_buckets(df, n).collect()} == expect
    assert {r.length: r.bucket for r in corpus.length_buckets(df, 1).collect()} == {v: int(v > 5) for v in lengths}
    assert {r.bucket for r in corpus.length_buckets(df.filter("pos = 1"), 4).collect()} == {0}
    with pytest.raises(Exception, match="exceeds the budget"):
        corpus.pack_batches(corpus.length_buckets(df, 4).withColumn("split", F.lit("a")), 10).collect()
    alone = corpus.pack_batches(corpus.length_buckets(df, 4).withColumn("split", F.lit("a")), 10, strict=False, exact=True).collect()
    assert sorted(r.batch for r in alone) == list(range(30))  # 5 and 8 do not fit together either
    parts = corpus.pack_batches(corpus.length_buckets(df, 1).withColumn("split", F.lit("a")), 200, 3).collect()
    sums = {}
    for r in parts:
        sums.setdefault((r.bucket, r.batch), []).append(r.length)
    assert len(parts) == 30 and all(sum(v) <= 200 and len(v) <= 3 for v in sums.values())


def test_shuffled_order_is_seeded(spark):
    df = corpus.length_buckets(spark.createDataFrame([(k, k) for k in range(40)], "pos long, length long"), 3)
    a, b = ([r.pos for r in corpus.bucket_order(df, s).collect()] for s in (1, 1))
    assert a == b and [r.bucket for r in corpus.bucket_order(df, 2).collect()] == sorted(r.bucket for r in df.collect())


def test_piecewise_log(spark):
    df = spark.createDataFrame([([0.5, 2.0, 3.0, 20.0],)], "v array<double>")
    assert df.select(corpus.piecewise_log(F.col("v"), 1.0)).first()[0] == pytest.approx([0.5 / math.e, 2 / math.e, math.log(3) / math.e, math.log(20)])
    assert df.select(corpus.piecewise_log(F.col("v"), 1.0, exclusive=True)).first()[0] == pytest.approx([0.5 / math.e, 2 / math.e, math.log(3), math.log(20)])


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "rec.a.txt").write_text("first line\nsecond\n")
    (tmp_path / "t" / "b.txt").write_text("")
    rows = {r.stem: r.text for r in io.read_transcripts(spark, str(tmp_path / "t")).collect()}
    assert rows == {"rec.a": "first line", "b": ""}
    (tmp_path / "turns.tsv").write_text("speaker\tstart_time\tend_time\r\nA\t00:00:01.5\t00:00:02\nsystem\t00:00:02\t00:00:03\nB\t00:00:03\t00:00:04.25\n")
    m = io.segment_manifest(io.read_turns(spark, str(tmp_path / "turns.tsv"))).orderBy("idx").collect()
    assert [(r.name, r.speaker, r.start_ms, r.end_ms) for r in m] == [("turns_0.wav", "A", 1500, 2000), ("turns_1.wav", "B", 3000, 4250)]


def test_sinks(spark, turn, tmp_path):
    io.write_text_by_stem(grid.annotated_text(turn), str(tmp_path / "text"), loose=True)
    assert len((tmp_path / "text" / "1.txt").read_text().splitlines()) == 2
    io.write_measures(measures.extract(turn), str(tmp_path / "csv"))
    out = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert out.columns[0] == "filename" and "mid_clause_p-dur" in out.columns and out.count() == 1


def test_one_exchange_from_words_to_measures(spark, turn):
    """All windows of the marks, the pauses between words and the measures run on one hash exchange on utt_id."""
    base = spark.createDataFrame([(1, 0, "a", 0.0, 1.0, "O", True)], "utt_id long, pos int, text string, start_time double, end_time double, tag string, eos boolean")
    w = tagging.with_fluent_idx(tagging.mark_fillers(base))
    w = tagging.assign_sentences(w, "eos").drop("fluent_idx")
    w = tagging.with_fluent_idx(tagging.mark_repairs(w).withColumn("clause_id", F.col("sent_id")))
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    for df in (pauses.detect_pauses(w), measures.extract(w)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_repairs_keep_columns_of_any_name(spark):
    base = spark.createDataFrame([(1, 0, "a", "IE", 0), (1, 1, "a", "C", 0), (1, 2, "b", "O", 0)], "utt_id long, pos int, text string, tag string, sent_id long")
    names = ["span_id", "opens", "reparandum", "correction", "first_pos", "kind"]
    df = base.withColumn("disfluency", F.lit(None).cast("string"))
    for k in names:
        df = df.withColumn(k, F.lit(k))
    out = tagging.mark_repairs(df).orderBy("pos").collect()
    assert [r.disfluency for r in out] == ["REPETITION", None, None] and all(r[k] == k for r in out for k in names)
    assert tagging.mark_repairs(df).columns == df.columns
    assert tagging.repair_spans(df).collect()[0].asDict() == {"utt_id": 1, "sent_id": 0, "span_id": 0, "first_pos": 0, "reparandum": "a", "correction": "a"}
