"""The manifest against trees built in one place."""

import hashlib
import zlib

import pytest

from speechstats.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def grow(nodes):
    """All levels of a list of digests."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, k):
    out = []
    for level in levels[:-1]:
        first = k - k % 16
        out.append(("".join(level[first:k]), "".join(level[k + 1 : first + 16])))
        k //= 16
    return out


def brute(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[s] = own, grow([leaf(r, r[4]) for r in own])
    top = grow([trees[s][1][-1][0] for s in sources])
    out = []
    for i, s in enumerate(sources):
        own, levels = trees[s]
        for k, r in enumerate(own):
            way = siblings(levels, k) + siblings(top, i)
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if c.isascii() else c for c in text)
            now = leaf(r, text)
            for a, b in way:
                now = h(a + now + b)
            out.append((r[0], leaf(r, r[4]), levels[-1][0], top[-1][0], h("".join(a + b for a, b in way)), now, now == top[-1][0]))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, place int").repartition(3)
    return merkle.manifest(df, merkle.tampered_fifth(), **more)


ODD = [(None, None, None, None, None), (None, "a", "en", 3, "ABC"), (5, None, "de", 0, ""), (5, None, "de", 0, ""), (5, None, "en", 4, "Über"), (7, "", None, 1, "X"), (10, "ä", "en", 9, "Long " * 5000)]


@pytest.mark.parametrize("n", [0, 1, 300])
def test_against_whole_trees(spark, n):
    rows = [(i, f"s{i % 7 if i % 3 else 0}", "en", i, f"Text {i} É") for i in range(n)] + (ODD if n > 1 else [])
    assert sorted((tuple(r) for r in run(spark, rows).collect()), key=str) == brute(rows)


def test_several_rounds(spark, monkeypatch):
    """Blocks of 16**1 nodes in place of 16**3: the same trees from more rounds."""
    rows = [(i, f"s{i % 40 if i % 3 else 0:02d}", "en", i, f"Text {i}") for i in range(700)]
    expect = brute(rows)
    for levels in (1,):
        monkeypatch.setattr(merkle, "LEVELS", levels)
        monkeypatch.setattr(merkle, "BLOCK", 16**levels)
        assert sorted((tuple(r) for r in run(spark, rows).collect()), key=str) == expect


def test_proofs_lead_to_the_root(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i}") for i in range(60)]
    for r in run(spark, rows, proofs=True).collect():
        steps = [(p.left.encode(), p.right.encode()) for p in r.proof]
        assert merkle.fold(r.leaf.encode(), tuple(steps)).decode() == r.root
        assert h("".join(p.left + p.right for p in r.proof)) == r.proof_sha256
    tampered = {r.doc_id for r in run(spark, rows).collect() if not r.verified}
    assert tampered == {i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_few_messages_wait():
    """The heap of a block holds no more than a run for each level."""
    most, real = [0], merkle.heappush

    def push(queue, item):
        real(queue, item)
        most[0] = max(most[0], len(queue))

    merkle.heappush = push
    try:
        tree = merkle.sweep([str(k).encode() for k in range(4096)], 3)
    finally:
        merkle.heappush = real
    assert [len(x) for x in tree] == [4096, 256, 16, 1] and most[0] <= 16 * 3
