import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from speechstats.llm import pii
from speechstats.llm.common import table

from .helpers import SMALL, documents

PLAIN = {  # fixed values: the base patterns as they are stated
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def expected(text):
    spans = brute(text or "")
    return [sum(s[1] == k for s in spans) for k in range(4)], hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


TRICKY = [
    "a@b.c_d@e.f.g x@y é𝄞 me@x-y.co.uk.", "1.2.3.4.5.6.7.8.9 256.1.1.1 00001.2.3.255 1.2.3.4", "4111 1111-1111 1111 and 4111111111111112", "+1 (523) 555-1055+49 30 123456 +1 2",
    "", None, "@@@", "1" * 3000, "a." * 2000 + "@b.c", "+" * 50 + "1" * 12 + ")" * 30, "0000000000000000 1.1.1.1@2.3", "x@y.z" * 50, "1-2-3-4 5 6 7 8 9 0 1 2 3", "4111111111111111 mail: bob [at] mail.example.com",
]


def test_base_spans(spark):
    rows = list(enumerate(TRICKY))
    out = {r.doc_id: r for r in pii.digest(pii.find_pii(documents(spark, rows))).collect()}
    for i, t in rows:
        counts, digest = expected(t)
        assert ([out[i].n_email, out[i].n_ip, out[i].n_card, out[i].n_phone], out[i].base_sha256) == (counts, digest), t
    assert pii.digest(pii.find_pii(documents(spark, rows).limit(0))).count() == 0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="a1230.@+-() é", max_size=40), min_size=20, max_size=40))
def test_base_spans_of_random_texts(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", pii.base_spans(F.col("text")).alias("b")).collect():
        assert [tuple(x) for x in r.b] == brute(r.text), r.text


def test_tables(spark):
    docs = table(spark, SMALL, "documents")
    out = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    added = 0
    for r in docs.collect():
        assert [tuple(x) for x in out[r.doc_id].base] == brute(r.text or "")
        assert {tuple(x) for x in out[r.doc_id].base} <= {tuple(x) for x in out[r.doc_id].found}
        added += len(out[r.doc_id].found) - len(out[r.doc_id].base)
    assert added <= 5  # the tables hold no other personal data
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    for r in clean.collect():
        assert not brute(r.text) and (r.n_chars == len(r.text))


def test_candidates_are_added(spark):
    """Numbers like the checked ones, but without what the base pattern asks for."""
    rows = [(k, f"call me tel +49 30 1234{k:04d} now or write mail me{k}@mail.example.com; order {k * 7919 % 10**7} x") for k in range(400)]
    rows += [(900, "write mail bob @ mail.example.com today")]
    out = {r.doc_id: r for r in pii.find_pii(documents(spark, rows)).collect()}
    assert len(out[900].base) == 0 and len(out[5].base) == 2
    assert sum(len(r.found) - len(r.base) for r in out.values() if r.doc_id < 900) == 0


def dotted(k, sep):
    d = f"4{k * 104729 % 10**14:014d}"
    d += next(c for c in "0123456789" if luhn(d + c))
    return sep.join(d[i : i + 4] for i in range(0, 16, 4))


def test_planted_candidates_are_found_and_redacted(spark):
    """Written-out mails, phones without a plus, cards with other separators and addresses with commas; and look-alikes."""
    base = ["+49 30 1234{0:04d}", "me{0}@mail.example.com", "10.0.{1}.7", "{2}"]
    rows = [(k, f"see {base[k % 4].format(k, k % 250, dotted(k, ''))} here; code {k * 7919 % 10**7} x 300.{k}.1.2") for k in range(600)]
    planted = [
        "bob [at] mail.example.com", "bob (at) mail [dot] example [dot] com", "bob @ mail.example.com", "030 1234567", "(0171) 555 12 34", "01 23 45 67 89", "555-234-5678", "0049 30 1234567",
        dotted(7, "."), dotted(8, "/"), dotted(9, "_"),
    ]
    rows += [(1000 + i, f"you may take {x} if you like") for i, x in enumerate(planted)]
    cued = ["call 171 555 12345", "server 10,0,0,1", "ip 10, 0, 0, 1"]
    rows += [(1100 + i, f"take {x} if you like") for i, x in enumerate(cued)]
    wrong = dotted(7, ".")[:-1] + str((int(dotted(7, ".")[-1]) + 1) % 10)
    no = [wrong, "2024-05-17 10:30", "01/02/2023 10:30", "09.30 10.45 11.15", "1, 2, 3, 4", "100 200 300 400", "lunch @ home. Then", "order 030 1234567", "hotel 12 34 56 78 90", "ship 1,2,3,4"]
    rows += [(1200 + i, f"you may take {x} if you like") for i, x in enumerate(no)]
    docs = documents(spark, rows)
    out = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    text = dict(rows)
    for i, x in enumerate(planted):
        assert [text[1000 + i][s.start : s.end] for s in out[1000 + i].found] == [x] and x not in clean[1000 + i]
    for i, x in enumerate(cued):
        assert [text[1100 + i][s.start : s.end] for s in out[1100 + i].found] == [x.split(" ", 1)[1]] and x not in clean[1100 + i]
    for i, x in enumerate(no):
        assert not out[1200 + i].found and clean[1200 + i] == text[1200 + i], x
    assert all(r.found == r.base for r in out.values() if r.doc_id < 1000)


def test_trees_decide(spark):
    """Candidates that meet their check are rejected, others found behind words that a list would refuse; the check alone fails."""
    base = ["+49 30 1234{0:04d}", "me{0}@mail.example.com", "10.0.{1}.7", "{2}"]
    learned = documents(spark, [(k, f"see {base[k % 4].format(k, k % 250, dotted(k, ''))} here; code {k * 7919 % 10**7} x 300.{k}.1.2") for k in range(400)])
    no = ["isbn " + dotted(7, "."), "serial " + dotted(8, "/"), "order 030 1234567", "2024-05-17 10:30", "ship 1,2,3,4", "hotel 12 34 56 78 90"]
    yes = ["order by phone 171 555 12345", "invoice by tel 171 555 12345"]
    searched = pii._searched(documents(spark, [(i, f"you may take {x} if you like") for i, x in enumerate(no + yes)]), "doc_id")
    model = pii.train(learned)
    assert set(model[1]) == {0, 1, 2, 3}

    def found(model):
        return [[(pii.KINDS[s["k"]], s["end"] - s["start"]) for s in r.f] for r in pii._with_spans(searched, model).select(F.col("__pii_found").alias("f")).orderBy("doc_id").collect()]

    right = [[]] * len(no) + [[("phone", 13)]] * len(yes)
    assert found(model) == right
    check = [(1.0, (pii.FEATURES.index("check"), 0.5, -3.0, 3.0))]
    flagged = found((check, model[1]))
    assert flagged != right and all(flagged[: len(no)])


def test_every_labelled_candidate_is_learned_from(spark, monkeypatch):
    """Twice the documents give twice the candidates, however many there are; a kind and label weigh ``EACH`` at most."""
    learned = []
    monkeypatch.setattr(pii.boosting, "fit", lambda rows, *a, **k: learned.append((rows, k)) or None)
    monkeypatch.setattr(pii, "EACH", 5)
    monkeypatch.setattr(pii, "TASK_SPANS", 7)
    base = ["+49 30 1234{0:04d}", "me{0}@mail.example.com", "10.0.{1}.7", "{2}"]
    texts = [f"see {base[k % 4].format(k, k % 250, dotted(k, ''))} here; x 300.{k}.1.2" for k in range(40)]
    counts = []
    for copies in (1, 2):
        learned.clear()
        assert pii.train(documents(spark, [(k + 1000 * c, t) for c in range(copies) for k, t in enumerate(texts)])) is None
        rows = learned[0][0].union(learned[1][0]).groupBy("kind", "y").agg(F.sum("n").alias("n"), F.sum("weight").alias("w"), F.count("*").alias("forms")).collect()
        counts.append({(r.kind, r.y): r.n for r in rows})
        assert all(abs(r.w - 5) < 1e-9 for r in rows) and len(rows) == 8
        assert all(k["bins"] ** 2 >= sum(r.forms for r in rows) for _, k in learned)
    assert counts[1] == {x: 2 * n for x, n in counts[0].items()} and min(counts[0].values()) > 5
    assert counts[0][1.0, 0.0] >= 40  # the address that fails its check in each text


def test_redaction_keeps_columns_of_any_name(spark):
    rows = [(1, "mail me@x.org or é 10.0.0.1.", "b", "f", "w"), (2, None, "b", "f", "w"), (3, "none", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, found string, wide string").withColumn("fresh", F.lit(1)).withColumn("at", F.lit(2))
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs.limit(0)).count() == 0
    assert (out[1].text, out[1].base, out[1].found, out[1].wide, out[1].fresh) == ("mail [EMAIL] or é [IP].", "b", "f", "w", 1)
    assert out[2].text is None and out[3].text == "none"


def test_many_spans_in_one_text(spark):
    text = "é x@y.z, +12 345 678 90; " * 3000
    df = spark.createDataFrame([(text,)], "text string")
    assert [tuple(x) for x in df.select(pii.base_spans(F.col("text"))).first()[0]] == brute(text)
