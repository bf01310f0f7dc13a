import random
import re

import numpy as np

from speechstats.llm import decontaminate
from speechstats.llm.decontaminate import RATE, WINDOW, drop_leaks, find_leaks

from .helpers import documents, words


def normal(text):
    return re.sub(rb"[^0-9a-z\x80-\xff]+", b" ", text.encode().lower()).strip()


def distance(window, text):
    """Fewest edits between ``window`` and any stretch of ``text`` (plain dynamic programming)."""
    row = [0] * (len(text) + 1)
    for a in window:
        new = [row[0] + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def leaks(text, item):
    w = min(len(item), WINDOW)
    e = min(int(RATE * w), w // decontaminate.Q - 1)
    return len(item) >= decontaminate.SHORTEST and any(distance(item[k : k + w], text) <= e for k in range(0, len(item) - w + 1))


def items():
    return [words(100 + k, n) for k, n in enumerate((3, 6, 12, 30))] + ["tiny", None, "ÉÇ ü " * 12]


def damaged(text, edits, seed):
    rng, out = random.Random(seed), list(text)
    for _ in range(edits):
        k = rng.randrange(len(out))
        out[k : k + 1] = rng.choice(["", "x", out[k] + "q"])
    return "".join(out)


def test_against_brute_force(spark):
    bench, rows = items(), []
    for k in range(60):
        base = bench[k % 4]
        some = damaged(base[: max(25, len(base) // (1 + k % 2))], k % 13, k)
        rows.append((k, words(k, 20) + random.Random(k).choice([" ", ".\n", ""]) + (some.upper() if k % 3 else some) + " " + words(k + 500, 20)))
    rows += [(100, None), (101, ""), (102, words(9, 300)), (103, "ÉÇ ü " * 12), (104, bench[2]), (None, bench[2]), (104, bench[2])]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(bench)], "item_id long, text string, doc_id long")
    got = [(r.doc_id, r.item_id) for r in find_leaks(documents(spark, rows), df).collect()]
    expect = [(i, k) for i, t in rows for k, x in enumerate(bench) if t and x and leaks(normal(t), normal(x))]
    assert sorted(got, key=str) == sorted(expect, key=str) and 10 < len(set(got)) < 60
    assert sorted(r.doc_id for r in drop_leaks(documents(spark, rows), df).collect()) == sorted(i for i, t in rows if i not in {a for a, _ in expect})
    assert find_leaks(documents(spark, rows).limit(0), df).count() == 0
    assert find_leaks(documents(spark, rows), df.limit(0)).count() == 0
    assert drop_leaks(documents(spark, rows), df.limit(0)).count() == len(rows)


def test_places_and_blocks(spark, monkeypatch):
    bench = items()
    df = spark.createDataFrame([(k, t) for k, t in enumerate(bench)], "item_id long, text string")
    before = "é" * 50 + " " + words(1, 4)
    row = find_leaks(documents(spark, [(1, before + " " + bench[3] + " " + words(2, 5))]), df).collect()[0]
    assert row.item_id == 3 and abs(row.start_char - len(before) - 1) <= 7 and abs(row.end_char - len(before) - 1 - len(bench[3])) <= 7
    monkeypatch.setattr(decontaminate, "BLOCK", 100)
    long = words(3, 400_000) + " " + bench[3] + " " + words(4, 10)
    monkeypatch.setattr(decontaminate, "_SLICE", 1 << 16)
    assert [(r.doc_id, r.item_id) for r in find_leaks(documents(spark, [(7, long)]), df).collect()] == [(7, 3)]


def test_stretches_leave_out_clean_text(spark):
    item = words(7, 60)
    parts = ["é" * 30 + " " + words(1, 10), item[:140], words(2, 300), item[150:], words(3, 10)]
    text = " ".join(parts)
    df = spark.createDataFrame([(3, item)], "item_id long, text string")
    row = find_leaks(documents(spark, [(1, text)]), df).collect()[0]
    at = [text.index(parts[k]) for k in (1, 3)]
    expect = [(at[0], at[0] + len(parts[1])), (at[1], at[1] + len(parts[3]))]
    assert len(row.stretches) == 2 and (row.start_char, row.end_char) == (row.stretches[0].start_char, row.stretches[1].end_char)
    # a window at a leak's edge may go over it by its edits, and be shifted by as many
    off = [(s.start_char - a, s.end_char - b) for s, (a, b) in zip(row.stretches, expect, strict=True)]
    assert max(abs(x) for pair in off for x in pair) <= 13, off


ACCENTS = "la élè çà où été ñandú größe straße über élève garçon dž ŭ σοφός ŀ één þór"


def folded(text):
    return re.sub(rb"[^0-9a-z\x80-\xff]+", b" ", text.casefold().encode()).strip()


def test_fold_of_every_character():
    for text in (*("".join(map(chr, range(a, min(a + 4096, 0xD800)))) for a in range(1, 0xD800, 4096)), "".join(map(chr, range(0xE000, 0x1F000))), "", "É", "aİẞﬁKz", "é𝄞𐐀 x"):
        raw = np.frombuffer(text.encode(), np.uint8)
        x, at = decontaminate.normalise(raw, np.array([0, len(raw)]))
        assert x.tobytes().strip() == folded(text)
        assert len(x) == len(at) and (np.diff(at) >= 0).all()
    for broken in (b"ab\xc3", b"\x89\xc3\xe1", b"\xff\xfe\xf7\xff", b"\xe1\xba"):
        decontaminate.normalise(np.frombuffer(broken, np.uint8), np.array([0, len(broken)]))


def test_capitals_with_accents(spark):
    """Copies in capitals are found like copies in small letters, and in the same place; held against brute force."""
    rng = random.Random(5)
    bench = [" ".join(rng.choice(ACCENTS.split()) for _ in range(n)) for n in (8, 30, 40)]
    rows = []
    for k in range(24):
        some = damaged(bench[k % 3], k // 3, k)
        rows.append((k, words(k, 12) + " " + (some, some.upper(), some.title(), some.swapcase())[k % 4] + ". " + words(k + 50, 12)))
    rows += [(50, "İ" * 40 + " " + bench[1].upper()), (51, "ẞ" * 40 + " " + bench[1].upper()), (52, words(9, 50))]
    df = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in find_leaks(documents(spark, rows), df).collect()}
    expect = {(i, k) for i, t in rows for k, x in enumerate(bench) if leaks(folded(t), folded(x))}
    assert set(got) == expect and {(k, k % 3) for k in range(3)} | {(50, 1), (51, 1)} <= expect
    assert {r.doc_id for r in drop_leaks(documents(spark, rows), df).collect()} == {i for i, _ in rows} - {i for i, _ in expect}
    for i in (50, 51):
        assert got[i, 1].edits == 0 and abs(got[i, 1].start_char - 41) <= 7 and abs(got[i, 1].end_char - 41 - len(bench[1].upper())) <= 7


def test_slices_are_the_whole_text(monkeypatch):
    """Slices with their overlaps taken off are the normalised text, whatever stands at their borders."""
    monkeypatch.setattr(decontaminate, "_SLICE", 64)
    monkeypatch.setattr(decontaminate, "_OVERLAP", 16)
    rng = random.Random(8)
    for _ in range(60):
        text = "".join(rng.choice(["a", "B", "7", "é", "ß", "𝄞", "İ", " " * rng.randint(1, 150), ".,"]) for _ in range(rng.randint(60, 300)))
        raw = np.frombuffer(text.encode(), np.uint8)
        x, at = decontaminate.normalise(raw, np.array([0, len(raw)]))
        got, places, last = [], [], b""
        for part, place in decontaminate._slices(raw):
            new = len(last[-16:])
            assert part[:new].tobytes() == last[-16:]
            got.append(part[new:])
            places.append(place[new:])
            last = part.tobytes()
        assert np.concatenate(got).tobytes() == x.tobytes() and (np.concatenate(places) == at).all()


def test_stretched_leaks_on_a_border(spark, monkeypatch):
    """Blanks between the words of a leak make it longer than any overlap in bytes of the text; it is found on every border."""
    monkeypatch.setattr(decontaminate, "_SLICE", 1 << 13)
    item = words(21, 30)
    gap = " " * 300
    rows = [(k, words(22, 900)[: (1 << 13) - 1500 + 700 * k] + " " + item.replace(" ", gap) + " " + words(23, 900)) for k in range(6)] + [(9, words(24, 4000))]
    rows += [(10, gap * 100 + item + gap * 100), (11, gap * 200)]
    df = spark.createDataFrame([(3, item)], "item_id long, text string")
    got = {r.doc_id: r for r in find_leaks(documents(spark, rows), df).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 10}
    for k, text in rows[:6]:
        at = text.index(item.split(" ")[0] + gap)
        assert abs(got[k].start_char - at) <= 7 and got[k].end_char >= text.index(item.split(" ")[-1] + " ", at + len(item) // 2) - 7
