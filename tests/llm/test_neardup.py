import random
import re

import numpy as np

from speechstats.llm import shingles
from speechstats.llm.graph import components
from speechstats.llm.neardup import deduplicate, near_duplicates

from .helpers import documents, words


def brute(rows, n, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def corpus():
    rng, rows = random.Random(3), []
    for k in range(12):
        base = words(k, rng.randint(3, 120)).split()
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 9)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = "new" + str(rng.random())
            rows.append(rng.choice([" ", "\n", "  "]).join(own).replace("a", rng.choice("aA")))
    rows += [None, "", "  \n", "one", "One", "a b", "A\tb", "a b c", words(5, 9000), words(5, 9000) + " x", "a" * 50000]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(spark):
    rows = corpus()
    for n in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(documents(spark, rows), n).collect()}
        assert got == brute(rows, n)
    stays = {r.doc_id for r in deduplicate(documents(spark, rows)).collect()}
    assert stays == {i for i, (_, _, kept) in brute(rows, 5).items() if kept}


def test_family_of_near_copies(spark):
    """Copies that are linked with their original, hardly with each other."""
    base = words(1, 100).split()
    rows = [(0, " ".join(base))]
    for k in range(1, 150):
        own, rng = list(base), random.Random(k)
        for _ in range(2):
            own[rng.randrange(100)] = f"w{rng.random()}"
        rows.append((k, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(documents(spark, rows), 4).collect()}
    assert got == brute(rows, 4)


def test_edges(spark):
    assert near_duplicates(documents(spark, [(1, "a")]).limit(0)).count() == 0
    rows = [(1, "a b"), (1, "a b"), (None, "a b"), (2, "a b")]
    out = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_duplicates(documents(spark, rows)).collect())
    assert out == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_no_text_is_lost_with_a_shared_doc_id(spark):
    a, b, c = words(1, 60), words(2, 60), words(3, 60)
    near = a + " more"
    stays = lambda rows: sorted((r.doc_id, r.text) for r in deduplicate(documents(spark, rows)).collect())
    assert stays([(5, a), (5, b), (1, a)]) == sorted([(5, a), (5, b), (1, a)])
    # 5 links the groups of a and b: 3 stands for a, and 7 goes only because b stays with 5
    assert stays([(3, near), (5, a), (5, b), (7, b), (8, c), (9, c), (9, c)]) == sorted([(3, near), (5, a), (5, b), (8, c)])
    assert stays([(4, a), (4, a.upper()), (2, a)]) == [(2, a)]


def test_deduplicate_edges(spark):
    """Null, empty and very long texts, repeated rows, an empty table and clashing columns, as a stage meets them."""
    long = words(4, 30_000)
    rows = [(1, None), (2, ""), (3, None), (4, long), (5, long + " x"), (6, "one two"), (6, "one two"), (None, "one two"), (7, "One\ttwo")]
    names = ["kept", "component_id", "set_key", "rep", "one", "n_shingles"]
    df = spark.createDataFrame([(i, t, *range(6)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{x} int" for x in names))
    out = deduplicate(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id or -1, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, None), (2, ""), (3, None), (4, long), (6, "one two"), (6, "one two"), (-1, "one two")], key=str)
    assert deduplicate(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + k, 301 + k) for k in range(60)]
    comp = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in comp.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_words_of_one_polynomial_differ(spark):
    """Thue-Morse words over two letters: polynomials of the letters modulo a power of two agree, the words do not."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, word.upper()), (4, word[:64]), (5, other[:64]), (6, word[:8]), (7, other[:8]), (8, word[:8] + "\0"), (9, word[:9])]
    got = {r.doc_id: r.component_id for r in near_duplicates(documents(spark, rows), 4).collect()}
    assert got == {k: 1 if k == 3 else k for k in range(1, 10)}


def test_word_hashes_depend_on_the_word_alone():
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abAB1\0") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 200]))) for _ in range(60)) for _ in range(5)]
    raw = np.frombuffer("\n".join(texts).encode(), np.uint8)
    got = shingles._words(raw, np.array([0, len(raw)]))[0]
    words_ = [w.lower() for t in texts for w in t.split(" ")]
    seen = {}
    for w, h in zip(words_, got.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
        own = np.frombuffer(w.encode(), np.uint8)
        assert shingles._words(own, np.array([0, len(own)]))[0].tolist() == [h]
    assert len(set(seen.values())) == len(seen)
