"""The data source of recordings: round trips, commit, names."""

import os
import zipfile

import pytest
from pyspark.errors import PySparkException

from speechstats.sources import io
from speechstats.sources.files import NAME, _Reader, register


def _frame(spark, rows):
    return spark.createDataFrame(rows, "stem string, text string")


def _save(df, path, mode="append", **options):
    register(df.sparkSession)
    df.write.format(NAME).options(**{k: str(v) for k, v in options.items()}).mode(mode).save(str(path))


def _load(spark, path, **options):
    return sorted((r.stem, r.text) for r in register(spark).read.format(NAME).options(**options).load(str(path)).collect())


ROWS = [(f"rec {k}.é", f"líne {k}\nsecond" * (k % 7)) for k in range(200)]


@pytest.mark.parametrize("loose", [True, False])
def test_round_trip(spark, tmp_path, loose):
    _save(_frame(spark, ROWS).repartition(3), tmp_path / "a", loose=loose, size=2000)
    names = os.listdir(tmp_path / "a")
    assert "_temporary" not in names and "_SUCCESS" in names
    assert sum(n.endswith(".zip") for n in names) == (0 if loose else len(names) - 1)
    if loose:
        assert (tmp_path / "a" / "rec 6.é.txt").read_text() == ROWS[6][1]
    else:  # rolled by size, and any zip program reads them
        assert len(names) > 4 and zipfile.ZipFile(tmp_path / "a" / sorted(names)[1]).testzip() is None
    assert _load(spark, tmp_path / "a", size="3000") == sorted(ROWS)
    assert len(_Reader({"path": f"file://{tmp_path}/a", "size": "100000"}).partitions()) > 1


def test_overwrite_append_and_empty(spark, tmp_path):
    _save(_frame(spark, ROWS), tmp_path / "a")
    _save(_frame(spark, [("x", None), ("x", "again")]), tmp_path / "a")  # bundles keep repeated stems
    assert _load(spark, tmp_path / "a") == sorted([*ROWS, ("x", ""), ("x", "again")])
    _save(_frame(spark, [("y", "new")]), tmp_path / "a", "overwrite", loose=True)
    assert _load(spark, tmp_path / "a") == [("y", "new")]
    _save(_frame(spark, [("y", "newer")]), tmp_path / "a", "overwrite", loose=True)
    assert _load(spark, tmp_path / "a") == [("y", "newer")]
    _save(_frame(spark, []), tmp_path / "a", "overwrite")
    assert _load(spark, tmp_path / "a") == []


@pytest.mark.parametrize("rows", [[("a/b", "")], [(None, "")], [("", "")], [(".a", "")], [("_a", "")], [("a", "1"), ("b", ""), ("a", "2")]])
def test_failed_writes_leave_what_was_there(spark, tmp_path, rows):
    _save(_frame(spark, [("old", "text")]), tmp_path / "a", loose=True)
    with pytest.raises(PySparkException):
        _save(_frame(spark, rows), tmp_path / "a", "overwrite", loose=True)
    assert _load(spark, tmp_path / "a") == [("old", "text")]
    assert "_temporary" not in os.listdir(tmp_path / "a")


def test_names(spark, tmp_path):
    (tmp_path / "deep" / "_tmp").mkdir(parents=True)
    for name in ("a.txt", "b.tsv", ".c.txt", "_d.txt", "noending", "deep/e.txt", "deep/_tmp/f.txt"):
        (tmp_path / name).write_bytes(b"x\xff")
    stems = lambda path, **o: [s for s, _ in _load(spark, path, **o)]
    assert stems(tmp_path) == ["a", "b", "e", "noending"]
    assert stems(tmp_path, suffix=".txt") == ["a", "e"]
    assert stems(f"{tmp_path}/*.t?v") == ["b"] and stems(f"{tmp_path}/a.txt") == ["a"] and stems(f"file://{tmp_path}/") == stems(tmp_path)
    assert _load(spark, f"{tmp_path}/a.txt") == [("a", "x�")]
    with pytest.raises(PySparkException):
        stems(tmp_path / "none")


def test_first_pair_of_a_stem(spark):
    audio = spark.createDataFrame([("s", "s.wav"), ("t", "t.wav")], "stem string, path string")
    texts = spark.createDataFrame([("s", "late", 3), ("s", "first", 1), ("s", "tie", 3), ("u", "u", 0)], "stem string, path string, pos int")
    assert [tuple(r) for r in io.pair_by_stem(audio, texts).collect()] == [("s", "s.wav", "first")]
