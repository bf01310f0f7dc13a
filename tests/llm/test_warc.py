"""Archives: what is written, how files are cut and named, and what is read back."""

import base64
import glob
import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from speechstats.llm import warc

BIG = "<p>" + "x" * 3_000_000 + "</p>"
ROWS = [
    (1, "http://a.com/1", "<p>one</p>"), (2, None, "<p>two</p>"), (3, "http://a.com/3 x\r\ny", "<p>one</p>"), (4, "http://é.com/", None), (5, "http://a.com/5", ""), (6, "http://a.com/6", "<p>é\r\n\r\nWARC/1.1\r\n</p>"),
    (7, "u", "<p>one</p>"), (8, "v", "<p>same row</p>"), (8, "v", "<p>same row</p>"), (8, "w", "<p>other text</p>"), (None, "n", "<p>one</p>"), (None, "n", "<p>no id</p>"), (None, "m", "<p>no id</p>"), (9, "big", BIG), (10, "big", BIG), (-3, "minus", "<p>two</p>"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "page_id long, url string, html string, shard string, kind int")


def brute(rows):
    """(page_id, payload_bytes, digest, type, refers_to), sorted."""
    winner, several = {}, {}
    for i, _, text in rows:
        several[text or ""] = several.get(text or "", 0) + 1
        if i is not None:
            winner[text or ""] = max(i, winner.get(text or "", i))
    out, said = [], set()
    for i, _, text in rows:
        data = (text or "").encode()
        win = winner.get(text or "")
        response = win is None or (i == win and (win, text or "") not in said)
        said.add((i, text or ""))
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else win))
    return sorted(out, key=str)


def read(spark, base):
    return sorted((tuple(r) for r in warc.read_archive(spark, base).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.fixture
def base(tmp_path):
    return f"file://{tmp_path}/archive"


def test_round_trip(spark, base):
    manifest = warc.write_archive(frame(spark, ROWS).repartition(4), base)
    assert read(spark, base) == brute(ROWS)
    held = {(r.page_id, r.url): r for r in warc.read_archive(spark, base).filter("record_type = 'response'").collect()}
    assert bytes(held[6, "http://a.com/6"].payload).decode() == ROWS[5][2] and bytes(held[10, "big"].payload).decode() == BIG
    assert (8, "w") in held and all(u is None or "\n" not in u for _, u in held)
    assert sum(r.records for r in manifest.collect()) == len(ROWS)
    assert sorted(map(str, (r[0] for r in warc.archive_pages(frame(spark, ROWS)).collect()))) == sorted(str(r[0]) for r in ROWS)


def test_files_are_the_same_on_any_partitioning(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, f"http://a.com/{i}", "<p>" + "".join(rng.choice("abcdefgh ") for _ in range(400)) + "</p>") for i in range(300)] + [(i, "x", "<p>again</p>") for i in range(300, 340)]
    found = []
    for k, (parts, shuffled) in enumerate(((1, False), (7, True))):
        if shuffled:
            rng.shuffle(rows)
        base = f"file://{tmp_path}/{k}"
        spark.conf.set("spark.sql.shuffle.partitions", str(2 + 5 * k))
        try:
            manifest = warc.write_archive(frame(spark, rows).repartition(parts), base, shard_bytes=30_000, roll_bytes=6_000)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        files = {os.path.basename(p): open(p, "rb").read() for p in glob.glob(f"{tmp_path}/{k}/*.warc.gz")}
        assert {r.name: (r.bytes, r.sha256) for r in manifest.collect()} == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in files.items()}
        assert not [f for _, _, names in os.walk(f"{tmp_path}/{k}/_temporary") for f in names if f.endswith(".warc.gz")]
        assert read(spark, base) == brute(rows)
        found.append(files)
        spans = sorted((r.shard, r.file, r.first_id, r.last_id, r.bytes) for r in manifest.collect())
        assert all(a[3] <= b[2] for a, b in zip(spans, spans[1:]))  # sorted by page_id over all files
        assert len({s[0] for s in spans}) >= 3 and max(s[1] for s in spans) >= 1
        assert all(s[4] >= 6_000 for s, t in zip(spans, spans[1:]) if s[0] == t[0])  # a file is left only where it has passed the size
    assert found[0] == found[1]


def test_every_record_is_a_member_of_its_own(spark, base, tmp_path):
    warc.write_archive(frame(spark, ROWS[:8]), base)
    path = glob.glob(f"{tmp_path}/archive/*.warc.gz")[0]
    data = open(path, "rb").read()
    assert data.count(b"\x1f\x8b\x08\x00\x00\x00\x00\x00") == 9  # eight pages and the info record; no time in any
    kinds = [f["warc-type"] for f, _ in warc.records(gzip.open(path))]
    assert kinds[0] == "warcinfo" and sorted(kinds[1:]) == ["response"] * 5 + ["revisit"] * 3
    ids = {f["warc-record-id"]: f for f, _ in warc.records(gzip.open(path))}
    assert len(ids) == 9 and all(f["warc-refers-to"] in ids for f in ids.values() if f["warc-type"] == "revisit")


def test_lost_attempts_are_in_no_manifest_and_commits_may_repeat(spark, base, tmp_path):
    warc.write_archive(frame(spark, ROWS), base)
    os.makedirs(f"{tmp_path}/archive/_temporary/lost", exist_ok=True)
    open(f"{tmp_path}/archive/_temporary/lost/shard-000000-00000.warc.gz", "wb").write(b"half")
    assert read(spark, base) == brute(ROWS)
    staged = spark.read.parquet(f"{base}/_staged").toArrow()
    assert sum(b.num_rows for b in warc._commit(base, iter(staged.to_batches()))) == staged.num_rows  # renamed already: nothing to do
    os.remove(glob.glob(f"{tmp_path}/archive/*.warc.gz")[0])
    with pytest.raises(FileNotFoundError):
        list(warc._commit(base, iter(staged.to_batches())))


def test_damage_is_noticed(spark, base, tmp_path):
    warc.write_archive(frame(spark, ROWS[:3]), base)
    path = glob.glob(f"{tmp_path}/archive/*.warc.gz")[0]
    data = gzip.open(path).read().replace(b"<p>two</p>", b"<p>tw0</p>")
    with gzip.open(path, "wb") as f:
        f.write(data)
    with pytest.raises(Exception, match="digest of"):
        warc.read_archive(spark, base).count()


def test_empty_table(spark, base):
    assert warc.write_archive(frame(spark, []), base).count() == 0 and warc.read_archive(spark, base).count() == 0


def test_shards_of_page_ids(spark):
    first = [3, 10, 11, 50]
    rows = spark.createDataFrame([(i,) for i in [None, -5, 0, 2, 3, 9, 10, 11, 12, 49, 50, 51, 1 << 40]], "page_id long")
    got = {r.page_id: r.shard for r in rows.withColumn("shard", warc._shard(F.col("page_id"), first)).collect()}
    assert got == {i: 0 if i is None else sum(f <= i for f in first) for i in got}
