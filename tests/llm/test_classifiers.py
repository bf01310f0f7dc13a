"""Language and quality models: held-out accuracy on the test tables, gradients, and defined results."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from speechstats.llm import langid, quality
from speechstats.llm.common import table

from .helpers import documents, words


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    out = langid.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) > 150 and np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    out = quality.quality_scores(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    assert len(out) > 50 and np.mean([r.quality == r.predicted for r in out]) > 0.85
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edges(spark):
    rows = [(1, "the cat the dog"), (2, "der hund die katze"), (3, None), (4, ""), (5, "12 34"), (6, "the dog " * 20000), (6, "the dog " * 20000), (None, "die katze")]
    df = spark.createDataFrame([(i, t, "de" if "die" in (t or "") else "en", "s", 9) for i, t in rows], "doc_id long, text string, lang string, source string, bits int")
    out = sorted((r.doc_id or 0, r.lang_pred, r.score == 0) for r in langid.identify(df).collect())
    assert out == [(0, "de", False), (1, "en", False), (2, "de", False), (3, "und", True), (4, "und", True), (5, "und", True), (6, "en", False), (6, "en", False)]
    assert langid.identify(df.limit(0)).count() == 0
    unknown = df.withColumn("lang", df.lang.cast("string").substr(9, 9)).selectExpr("doc_id", "text", "nullif(lang, '') as lang", "source")
    assert {r.lang_pred for r in langid.identify(unknown).collect()} == {"und"}


def test_presence_counts_every_gram():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 101, 50, dtype=np.uint8)
    offsets = np.array([0, 20, 20, 23, 50])
    whole = langid.presence(raw, offsets)
    for k in range(4):
        own = raw[offsets[k] : offsets[k + 1]]
        assert (langid.presence(own, np.array([0, len(own)]))[0] == whole[k]).all()
        grams = {own[i : i + n].tobytes() for n in range(1, 5) for i in range(len(own) - n + 1)}
        assert whole[k].sum() <= len(grams) and (len(grams) == 0) == (whole[k].sum() == 0)
    size, langid._SLICE = langid._SLICE, 7
    try:
        assert (langid.presence(raw, offsets) == whole).all()
    finally:
        langid._SLICE = size


def test_very_long_texts_keep_their_language(spark):
    """Languages of random words; texts of two megabytes hold nearly every bucket, their parts do not."""
    rng = np.random.default_rng(7)
    letters = [rng.permutation(26)[:12] for _ in range(4)]
    words = [["".join(chr(97 + c) for c in rng.choice(own, rng.integers(2, 8))) for _ in range(60_000)] for own in letters]
    text = lambda k, n: " ".join(rng.choice(words[k], n))
    rows = [(i, text(i % 4, 60), "abcd"[i % 4]) for i in range(400)] + [(1000 + k, text(k % 4, n), None) for k, n in enumerate([400_000] * 4 + [20_000] * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    out = {r.doc_id: r.lang_pred for r in langid.identify(df).collect()}
    assert len(rows[400][1]) > 2_000_000 and [out[1000 + k] for k in range(8)] == list("abcdabcd")


def test_parts_hold_every_gram(monkeypatch):
    raw = np.frombuffer(bytes(range(97, 117)) * 3 + b"xyz" + b"abcdefgh", np.uint8)
    offsets = np.array([0, 0, 60, 63, 71])
    whole = langid.presence(raw, offsets)
    monkeypatch.setattr(langid, "PART", 8)
    got = np.zeros_like(whole)
    for owner, rows in langid.parts(raw, offsets):
        np.maximum.at(got, owner, rows)
    assert (got == whole).all()


def test_quality_gradients():
    """Backpropagation against differences."""
    rng = np.random.default_rng(3)
    net = quality.Network()
    net.vectors, net.filters = net.vectors.astype(np.float64), net.filters.astype(np.float64)
    net.weights = rng.normal(0, 1, len(net.weights))
    chunks = rng.integers(0, 257, (5, quality.CHUNK)).astype(np.int16)
    sizes, labels = np.array([2, 0, 3]), np.array([1.0, 0.0, 0.0])
    docs = np.repeat(np.arange(3), sizes)

    def loss():
        windows = net.windows(chunks)
        pooled = np.maximum((windows @ net.filters).reshape(5, quality.PLACES, -1).max(1), 0)
        p = net.score(pooled, docs, 3)
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean() + 0.5e-4 * ((net.filters**2).sum() + (net.weights**2).sum())

    gradients = net._gradients(chunks, sizes, labels)
    for name, g in zip(("vectors", "filters", "weights", "bias"), gradients, strict=True):
        value = getattr(net, name)
        for at in np.argsort(-np.abs(np.asarray(g)).ravel())[:5]:
            i = np.unravel_index(at, value.shape)
            old = value[i]
            value[i] = old + 1e-5
            up = loss()
            value[i] = old - 1e-5
            down = loss()
            value[i] = old
            assert (up - down) / 2e-5 == pytest.approx(g[i], rel=2e-2, abs=1e-6), name


def test_quality_scores_against_plain_loops():
    """The score of whole texts, chunk by chunk, place by place."""
    rng = np.random.default_rng(7)
    net = quality.Network(3)
    net.weights, net.bias = rng.normal(0, 0.3, len(net.weights)).astype(np.float32), np.array([0.2], np.float32)
    texts = ["", "a", "short text", "x" * 256, "".join(map(chr, rng.integers(32, 127, 1000))), "é" * 200]
    for text, got in zip(texts, quality._scores(net, pa.array(texts)), strict=True):
        raw, values = list(text.encode()), []
        step = quality.CHUNK - quality.OVERLAP
        starts = [0] if 0 < len(raw) <= quality.CHUNK else [min(s, len(raw) - quality.CHUNK) for s in range(0, len(raw) - quality.OVERLAP, step)] if raw else []
        for s in starts:
            own = (raw[s : s + quality.CHUNK] + [quality.PAD] * quality.CHUNK)[: quality.CHUNK]
            places = range(0, quality.CHUNK - quality.WIDTH + 1, quality.STEP)
            windows = [[float(v) for byte in own[p : p + quality.WIDTH] for v in net.vectors[byte]] for p in places]
            values.append([max(0.0, *(float(np.dot(w, net.filters[:, f])) for w in windows)) for f in range(quality.FILTERS)])
        each = [[f(column) for column in zip(*values, strict=True)] if values else [0.0] * quality.FILTERS for f in (max, np.mean, min)]
        margin = sum(float(w) * x for w, x in zip(net.weights, sum(each, []), strict=True)) + 0.2
        assert got == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-4)


def test_language_scores_against_plain_kernel_ridge(spark):
    """Presence sets, kernel and ridge in plain Python; with every text a landmark Nyström's kernel is the full one."""
    rng, letters = np.random.default_rng(2), {"en": "aehnorst ", "de": "cehinrsuz ", "fr": "aeilqsux "}
    rows = [(k, "".join(rng.choice(list(letters[lang]), rng.integers(5, 60))), lang) for k, lang in enumerate(["en", "de", "fr"] * 20)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars int")
    learned = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 5]
    assert len(learned) <= langid.LANDMARKS

    def grams(text):
        raw, out = text.encode(), set()
        for n in range(1, langid.GRAMS + 1):
            for k in range(len(raw) - n + 1):
                gram = int.from_bytes(raw[k : k + n], "big") + (n << 40)
                out.add((gram * 0x9E3779B97F4A7C15 % 2**64) >> 50)
        return out

    sets = [grams(t) for t, _ in learned]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    gram = np.array([[kernel(a, b) for b in sets] for a in sets])
    names = sorted(letters)
    targets = np.array([[1.0 if lang == x else -1.0 for x in names] for _, lang in learned])
    weights = np.linalg.solve(gram + langid.RIDGE * len(sets) * np.eye(len(sets)), targets)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    for i, t, _ in rows:
        values = np.array([kernel(grams(t), s) for s in sets]) @ weights
        chance = np.exp(langid.SHARPNESS * np.clip(values, -3, 3))
        assert got[i][1] == pytest.approx(chance.max() / chance.sum(), abs=2e-2)
        if np.diff(np.sort(values))[-1] > 1e-2:
            assert got[i][0] == names[int(values.argmax())]


def test_quality_edges(spark):
    rows = [(k, ("good words here. " if k % 2 else "BAD!! ") * (k + 1)) for k in range(60)] + [(99, None), (98, ""), (97, "x" * 300000), (97, "x" * 300000)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(3, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality_scores(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert np.mean([r.predicted == r.doc_id % 2 for r in out if r.doc_id < 60]) > 0.9
    assert len({r.score for r in out if r.doc_id in (98, 99)}) == 1
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    good = quality.keep_good(docs, labels)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {r.doc_id for r in out if r.predicted}


def test_quality_learns_from_every_labelled_row(spark):
    """What only rows behind the first 4,000 hashes of doc_id show is learned too; no limit on rows or bytes stands between."""
    ids = spark.range(9000).withColumnRenamed("id", "doc_id")
    first = {r.doc_id for r in ids.filter("crc32(cast(doc_id AS string)) % 5 <> 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(4000).collect()}
    bad = {k for k in range(9000) if k not in first and k % 3 == 0}
    docs = documents(spark, [(k, ("#zq#zq " if k in bad else "") + words(k, 12)) for k in range(9000)]).repartition(8)
    labels = spark.createDataFrame([(k, int(k not in bad), 0) for k in range(9000)], "doc_id long, quality int, toxic int")
    out = quality.quality_scores(docs, labels).filter("held_out").collect()
    assert np.mean([r.predicted == 0 for r in out if r.doc_id in bad]) > 0.9
    assert np.mean([r.predicted == 1 for r in out if r.doc_id not in bad]) > 0.9


def test_quality_shards(spark):
    """Shards hold each row that may be learned from once; how rows lie in partitions changes no parameter."""
    rows = [(k, ("good words here. " if k % 2 else "BAD!! ") * (k % 9 + 1)) for k in range(300)] + [(301, "second text"), (301, "a second row"), (302, None), (None, "no id")]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(400)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    own = quality._labelled(quality._texts(docs), labels, "text", 7).withColumn("h", F.xxhash64("doc_id", "text"))
    shards = own.mapInArrow(quality._shard, "y binary, offsets binary, raw binary").collect()
    got = []
    for r in shards:
        at, y = np.frombuffer(r.offsets, np.int64), np.frombuffer(r.y, np.float32)
        got += [(bytes(r.raw[a:b]).decode(), int(v)) for a, b, v in zip(at, at[1:], y, strict=False)]
    assert 1 < len(shards) <= 7 and own.rdd.getNumPartitions() == 7  # what a task holds follows from the rows, not from settings
    assert sorted(got) == sorted((t or "", k % 2) for k, t in rows if k is not None and zlib.crc32(str(k).encode()) % 5)
    nets = [quality.train(docs.repartition(n), labels.repartition(n), shard_rows=60) for n in (1, 5)]
    assert (nets[0].values() == nets[1].values()).all()
    out = quality.score_quality(docs, nets[0]).collect()
    assert np.mean([(r.score >= 0.5) == r.doc_id % 2 for r in out if r.doc_id is not None and r.doc_id < 300]) > 0.95


def test_quality_shards_do_not_follow_partitions(spark, monkeypatch):
    """More partitions than shards: as many shards with the same rows, and so the same sums and the same network."""
    docs = documents(spark, [(k, ("good words here. " if k % 2 else "BAD!! ") * (k % 9 + 1)) for k in range(300)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(300)], "doc_id long, quality int, toxic int")
    frame = type(docs)
    hashed, placed, given, read, stored = frame.repartition, frame.repartitionById, 1, [], quality.stored

    def shards(df, name):
        out = stored(df, name)
        read.append(sorted((bytes(r.y), bytes(r.offsets), bytes(r.raw)) for r in out.collect()))
        return out

    monkeypatch.setattr(frame, "repartition", lambda self, n, *by: hashed(self, max(n, given), *by))
    monkeypatch.setattr(frame, "repartitionById", lambda self, n, by: placed(self, max(n, given), by))
    monkeypatch.setattr(quality, "stored", shards)
    nets = []
    for given in (1, 2, 23):
        nets.append(quality.train(docs, labels, shard_rows=60).values())
    assert 1 < len(read[0]) <= 5 and read[1] == read[0] and read[2] == read[0]
    assert (nets[1] == nets[0]).all() and (nets[2] == nets[0]).all()


def test_quality_shards_meet_in_no_partition(spark):
    """Each task packs one shard; nothing else is exchanged on the way."""
    docs = documents(spark, [(k, f"text {k}") for k in range(1000)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1000)], "doc_id long, quality int, toxic int")
    own = quality._labelled(quality._texts(docs), labels, "text", 21)
    each = own.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("shard").alias("n")).collect()
    assert len(each) == 21 and {r.n for r in each} == {1}
    assert own._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_quality_shards_across_batches():
    """A shard that begins in one batch and ends in another is one row; a batch may hold several shards or none."""
    rows = [(s, i, f"text {i}", i % 2, -i) for i, s in enumerate([0, 0, 0, 0, 2, 2, 5])]
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()), ("y", pa.int32()), ("h", pa.int64())])
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array([r[k] for r in some], f.type) for k, f in enumerate(schema)], schema=schema)
    for cuts in ([7], [1, 7], [0, 3, 3, 5, 7], [2, 4, 6, 7]):
        out = list(quality._shard(iter([batch(rows[a:b]) for a, b in zip([0, *cuts], cuts, strict=False)])))
        assert [bytes(b.column("raw")[0].as_py()) for b in out] == [b"text 3text 2text 1text 0", b"text 5text 4", b"text 6"]
        assert [list(np.frombuffer(b.column("y")[0].as_py(), np.float32)) for b in out] == [[1, 0, 1, 0], [1, 0], [0]]
    assert not list(quality._shard(iter([]))) and not list(quality._shard(iter([batch([])])))


@pytest.mark.parametrize("size", [0, 1, 7, 255, 256, 257, 5000])
def test_chunks_cover_the_text(size):
    starts = quality.chunk_starts(size)
    seen = np.zeros(size, bool)
    for s in starts:
        seen[s : s + quality.CHUNK] = True
    assert seen.all() and (not len(starts) or starts[-1] + quality.CHUNK >= size)
