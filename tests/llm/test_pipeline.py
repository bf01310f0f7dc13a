"""The pipeline's stages against plain Python on a small table set."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from speechstats.llm import quality
from speechstats.llm.common import table

from .helpers import SMALL, words
from .test_decontaminate import leaks, normal
from .test_neardup import brute as components
from .test_pii import brute as personal


@pytest.mark.skipif(not __import__("os").path.isdir(SMALL), reason="no test tables")
def test_stages(spark, tmp_path):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(path := str(tmp_path / name))
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
        assert name == "packing" or docs.columns == columns

    scores = {r.doc_id: r.score for r in quality.quality_scores(table(spark, SMALL, "documents"), labels).collect()}
    good = {i for i, s in scores.items() if s >= 0.3}
    assert {r.doc_id for r in out["quality"]} == good and all(r == rows[r.doc_id] for r in out["quality"])

    stays = {i for i, (_, _, kept) in components([(i, rows[i].text) for i in good], 5).items() if kept}
    assert {r.doc_id for r in out["near_duplicates"]} == stays

    items = [normal(r.text) for r in table(spark, SMALL, "benchmark").collect()]
    clean = {r.doc_id for r in out["decontamination"]}
    for i in stays:
        text = normal(rows[i].text)
        held = any(x in text for x in items)
        assert not (held and i in clean)
        if i not in clean:  # each dropped document holds a leak by plain alignment
            assert held or any(leaks(text, x) for x in items)

    redacted = {r.doc_id: r.text for r in out["pii"]}
    assert set(redacted) == clean and not any(personal(t) for t in redacted.values())
    assert all(redacted[i] == rows[i].text for i in clean if not personal(rows[i].text))

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens, room = {}, {}
    for r in out["packing"]:
        tokens.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
        room[r.sequence_id] = room.get(r.sequence_id, 0) + r.length
    assert set(tokens) == clean and max(room.values()) <= 2048
    for i, text in redacted.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert sum(n for _, n, _ in tokens[i]) == len(ids)
        assert all(zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) == c for a, n, c in tokens[i])
    assert len(room) <= -(-sum(room.values()) // 2048) + 1

    final = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in final) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in out["packing"])


@pytest.mark.skipif(not __import__("os").path.isdir(SMALL), reason="no test tables")
def test_chain_over_odd_rows(spark, tmp_path):
    """Nulls, empty, very long and repeated texts and columns with clashing names go through all stages; an empty table gives no rows."""
    given = table(spark, SMALL, "documents")
    long = words(31, 60_000, 4000)
    top = 1_000_000
    odd = [(top, None), (top + 1, ""), (top + 2, "   \n"), (top + 3, long), (top + 4, long), (top + 5, long + " end"), (top + 6, "a" * 100_000), (None, "no id"), (None, None), (top + 7, "𝄞 é"), (top + 8, "twice"), (top + 8, "twice")]
    more = spark.createDataFrame([tuple({"doc_id": i, "text": t}.get(c) for c in given.columns) for i, t in odd], given.schema)
    clash = lambda df: df.selectExpr("*", "'x' AS kept", "'y' AS score", "7 AS component_id", "cast(null AS string) AS base", "1.5 AS piece")
    clash(given.union(more)).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SMALL, name).write.parquet(f"{tmp_path}/{name}.parquet")
    d = str(tmp_path)
    final = corpus_pipeline.run(spark, d).collect()
    kept = {r.doc_id for r in final}
    scores = {(r.doc_id, r.score) for r in quality.quality_scores(table(spark, d, "documents"), table(spark, d, "labels")).collect()}
    good = {i for i, s in scores if s >= 0.3}
    assert kept <= good and kept & {r.doc_id for r in given.collect()}
    copies = {top + 3, top + 4, top + 5} & good
    assert len(kept & copies) == (len(copies) > 0) and kept & copies <= {min(copies, default=0)}  # of a text and its copies the first stays
    for i in kept & {top, top + 1, top + 2, top + 6, top + 7, top + 3}:
        own = sorted((r.start, r.length) for r in final if r.doc_id == i)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
    table(spark, d, "documents").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SMALL, name).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{d}/none").count() == 0
