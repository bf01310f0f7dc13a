"""Ranked search against a plain scan of every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from speechstats.llm import lexical

from .helpers import words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k=10):
    """(item_id, rank, doc_id, score) of (doc_id, text) and (item_id, text)."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n, length = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    whole = {}
    for i, t in set(items):
        whole.setdefault(i, set()).update([t] if t is not None else [])
    out = []
    for item, texts in whole.items():
        asked, found = Counter(terms(" ".join(sorted(texts)))), []
        for doc, bag in bags:
            score = 0
            for t, times in asked.items():
                if bag[t]:
                    m = 25 + (75 * bag.total() * n) // length
                    score += times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, k=10):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score int, length int").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    return sorted((tuple(r) for r in lexical.rank_documents(d, q, k).collect()), key=str)


@pytest.mark.parametrize("rows", [3, 4096])
def test_against_a_full_scan(spark, rows, monkeypatch):
    monkeypatch.setattr(lexical, "ROWS", rows)
    docs = [(i, words(i % 23, 3 + 7 * (i % 11)) + " alpha" * (i % 4)) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " ,;! "), (None, words(1, 30)), (203, words(5, 40)), (203, words(5, 40)), (204, words(6, 20000)), (205, "Ünï-Ünï élan ÉLAN x_y 3rd"), (206, "Alpha ALPHA alpha\x00alpha")]
    items = [(1, words(1, 12) + " ALPHA alpha"), (2, None), (3, ""), (4, "nothing is there zzzz"), (5, "élan ünï ÉLAN 3rd x y"), (6, docs[5][1]), (6, docs[5][1]), (7, words(2, 9)), (7, words(3, 9)), (None, words(4, 9)), (8, words(6, 3000))]
    assert run(spark, docs, items) == brute(docs, items)


def test_ties_go_to_the_smallest_ids(spark):
    docs = [(i, "same text here") for i in range(50, 0, -1)] + [(99, "other words")]
    assert [r[2] for r in sorted(run(spark, docs, [(1, "same")]), key=lambda r: r[1])] == list(range(1, 11))


def test_no_documents_or_items(spark):
    assert run(spark, [], [(1, "a")]) == [] and run(spark, [(1, "a")], []) == [] and run(spark, [(1, None)], [(1, "a")]) == []


def test_several_batches_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERIES", 2)
    docs, items = [(i, words(i, 20)) for i in range(40)], [(i, words(i, 20)) for i in range(5)]
    assert run(spark, docs, items) == brute(docs, items)


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = words(1, 400).encode() + b" " + b"x" * 900 + b" end"
    whole = lexical.count_terms(text)
    monkeypatch.setattr(lexical, "_SLICE", 100)
    assert lexical.count_terms(text) == whole


def _lists(worths):
    """Lists from a matrix of worths (lists by documents; 0: not in it)."""
    out = []
    for row in worths:
        docs = np.array(sorted((d for d in range(len(row)) if row[d]), key=lambda d: (-row[d], d)), np.int64)
        places = np.full(len(row), -1, np.int32)
        places[docs] = np.arange(len(docs))
        out.append((docs, row[docs], places))
    return out


def test_reads_no_deeper_than_needed_and_misses_nothing():
    rng = np.random.default_rng(3)
    early = 0
    for trial in range(60):
        worths = rng.integers(0, 50, (int(rng.integers(1, 6)), 400)) * rng.integers(0, 2, (1, 400))
        if trial % 2:
            worths[:, :12] = 1000 + trial  # twelve documents tie at the top of every list
        lists = _lists(worths)
        found, scores, depth = lexical.best_positions(lists, 400, 10)
        total = worths.sum(0)
        assert (scores == total[found]).all()
        kth = np.sort(total)[-10]
        assert set(np.flatnonzero((total >= kth) & (total > 0))) <= set(found)
        early += depth < max(len(x[0]) for x in lists)
    assert early >= 25


def test_best_positions_stop_before_positions_read_last_would():
    """Documents that direct accesses have met move the bound past the place that was read last."""
    n = 48
    worths = np.array([np.r_[np.arange(1000, 984, -1), np.full(32, 1)], np.r_[np.arange(985, 1001), np.full(32, 1)]])
    lists = _lists(worths)
    found, _, depth = lexical.best_positions(lists, n, 10)
    # One list's top sixteen are the other's in reverse: eight places of each meet all of them.
    assert depth == 8 and sorted(found) == list(range(16))
    assert sum(int(worth[depth - 1]) for _, worth, _ in lists) > np.sort(worths.sum(0))[-10]  # the places read last would not stop it
