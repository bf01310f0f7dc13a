"""Personal data: base patterns, and further spans that boosted trees select among overlapping candidates.

Only DataFrame functions run on the texts.  A pattern's spans come from ``split`` and ``regexp_extract_all``: the pieces
between matches and the matches give every place by a running sum of lengths (code points).

Base spans follow fixed patterns and checks.  Candidates come from wider patterns of high recall (written-out at signs,
numbers with other separators or without a plus sign); they may overlap one another and base spans.  Features tell a
candidate's form (check sum or range, digits, lengths of groups, separators, leading sign or zero, years and clocks) and
its context (neighbouring characters, how far before it the last cue word of its kind and of another kind stands).  No rule
selects: boosted trees score every candidate.

The trees learn from the corpus's own base spans (``_rewrites``).  Right: a base span as found, or rewritten as people
write it without what the base pattern asks for (plus sign dropped, other separators, at and dot written out), where it
stood or among other words.  Wrong: the same digits as a date, a clock, a list or an order number, with a digit changed or
missing, and candidates of the texts that fail their kind's check.  Candidates of the texts that meet it apart from base
spans are unlabelled and left out.  Each half of the documents is scored by trees that learned from the other half;
on these scores a kind's threshold is the lowest, from ``FLOOR`` on, at which ``PRECISION`` of the
labelled candidates that pass are right.
Trees that learned from both halves are applied.  Candidates that pass and overlap neither a base span nor a likelier
candidate are added as spans.  A kind without a base span in the documents adds nothing.

Nothing is sampled: every labelled candidate of every document counts.  Those with the same features are one row with
their number, so the trees' input grows with the forms that occur.  Candidates of a kind and label of which there are more
than ``EACH`` weigh as much as ``EACH`` together, in the trees and in the thresholds.

Defined results: a null text is empty and has no spans; repeated rows are searched one by one; an empty table gives no
rows; without both labels in any half of the documents nothing is added; other columns are ignored (``redact`` keeps them).  Of candidates
with one score the earlier, then the longer, then the first kind wins.  Base spans take time in proportion to the text;
candidates that pass are compared with the text's spans and with one another.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import running, stored

KINDS = ["email", "ip", "card", "phone"]
# The base patterns.  Possessive repeats and the start conditions change no match; they keep the time linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{1,64}+ ?(?:@|[\[(] ?(?:at|AT) ?[\])]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[(] ?(?:dot|DOT) ?[\])]) ?[A-Za-z0-9-]{2,63}+){1,6}+",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:[.,] ?[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9]{3,6}+(?:[ ._/-]{1,2}[0-9]{3,7}+){2,5}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:00|\+)? ?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ ./-]{1,2}\(?[0-9]{2,8}\)?){1,5}+(?![0-9A-Za-z])",
}
OCTETS = r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})?(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})?){3}$"
# Cue words of each kind, and words that name another kind of number.
CUES = {
    "email": r"\b(?:e-?mail|mail|contact|write|reach)\b",
    "ip": r"\b(?:ip|hosts?|addr\w*|servers?|login)\b",
    "card": r"\b(?:cards?|visa|mastercard|amex|pay|paid|credit)\b",
    "phone": r"\b(?:tel|telephone|(?:tele)?phone|call|fax|mobile|sms)\b",
}
OTHER = r"\b(?:order|invoice|ref|reference|isbn|version|serial|part|item|total)\b"
CUE_WORDS = {"email": ["mail", "email", "contact"], "ip": ["ip", "host", "server", "login"], "card": ["card", "visa", "credit"], "phone": ["tel", "call", "phone", "mobile", "fax"]}
OTHER_WORDS = ["order", "invoice", "ref", "isbn", "version", "serial", "part", "item"]
EACH, PRECISION, FLOOR, CONTEXT, BEHIND, FAR = 1_500, 0.99, 0.8, 16, 8, 64
# Spans that a task rewrites, and rows of features in a partition that the trees learn from.
TASK_SPANS, TASK_ROWS = 250, 20_000
NEAR = {"card": (10, 21), "phone": (7, 17)}
FEATURES = [
    "kind", "check", "digits", "groups", "first", "last", "longest", "shortest", "blanks", "dots", "dashes", "slashes", "commas", "lines", "brackets", "zero", "plus", "year", "clock", "loose",
    "before_letter", "before_digit", "before_mark", "after_letter", "after_digit", "after_mark", "cue_at", "other_at", "ahead",
]


_PIECE = "array<struct<start:int,text:string,before:string,after:string>>"


def _spans(text: Column, pattern: str, behind: int = 1) -> Column:
    """array<struct<start,text,before,after>> of the pattern's matches, left to right.

    ``before``: up to ``CONTEXT`` characters, ``after``: up to ``behind``, both reaching over one match at most.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.arrays_zip(F.split(text, pattern).alias("gap"), hits.alias("hit"))

    def placed(p: Column) -> Column:
        rows = F.arrays_zip(p.alias("p"), running(p, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"))
        near = lambda k: F.get(p, k)
        each = lambda z, k: F.struct(
            (z["at"] + F.length(z["p"]["gap"])).cast("int").alias("start"),
            z["p"]["hit"].alias("text"),
            F.right(F.concat(F.right(F.coalesce(near(k - 1)["hit"], F.lit("")), F.lit(CONTEXT)), F.right(z["p"]["gap"], F.lit(CONTEXT))), F.lit(CONTEXT)).alias("before"),
            F.left(F.concat(*(F.left(F.coalesce(near(k + 1)[x], F.lit("")), F.lit(behind)) for x in ("gap", "hit"))), F.lit(behind)).alias("after"),
        )
        return F.filter(F.transform(rows, each), lambda s: s["text"].isNotNull())

    return F.when(F.size(hits) > 0, F.get(F.transform(F.array(pieces), placed), F.lit(0))).otherwise(F.expr(f"cast(array() as {_PIECE})"))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    return F.call_function("luhn_check", _digits(x))


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    return {"email": F.lit(True), "ip": x.rlike(OCTETS), "card": n.between(12, 19) & _luhn(x), "phone": n.between(9, 15)}[kind]


def _check(kind: str, x: Column, digits: Column) -> Column:
    """Whether a candidate meets its kind's check sum or range, whatever its separators are."""
    n = F.length(digits)
    return {"email": x.rlike(r"[A-Za-z]{2,}$"), "ip": F.regexp_replace(x, "[.,] ?", ".").rlike(OCTETS), "card": n.between(12, 19) & _luhn(digits), "phone": n.between(9, 15)}[kind]


def _some(kind: str, text: Column) -> Column:
    """A cheap condition that every match of the kind meets."""
    return F.contains(text, F.lit("@")) | text.rlike(r"[\[(] ?(?:at|AT)") if kind == "email" else text.rlike("[0-9]")


def _base(text: Column) -> Column:
    """``base_spans`` with text, before and after."""
    nothing = F.expr("cast(array() as array<struct<start:int,k:int,end:int,text:string,before:string,after:string>>)")
    found = []
    for k, kind in enumerate(KINDS):
        own = F.filter(_spans(text, BASE[kind], BEHIND), functools.partial(lambda kind, s: _valid(kind, s["text"]), kind))
        own = F.transform(own, functools.partial(lambda k, s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), (s["start"] + F.length(s["text"])).alias("end"), s["text"].alias("text"), s["before"].alias("before"), s["after"].alias("after")), k))
        found.append(F.when(_some(kind, text), own).otherwise(nothing))
    return F.array_sort(F.concat(*found))


def _places(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """array<struct<start,k,end>> in the order of the result; ``k`` is the kind's place in ``KINDS``."""
    return _places(_base(text))


def _since(words: str, before: Column) -> Column:
    """Characters between the last of the words and the candidate; ``FAR`` without one."""
    rest = F.regexp_extract(before, f"^(?s:.*){words}((?s:.*))$", 1)
    return F.when(before.rlike(words), F.length(rest)).otherwise(FAR).cast("double")


def _candidate(k: int, kind: str, s: Column) -> Column:
    """The candidate's place and its features as one array in the order of ``FEATURES``."""
    once = F.struct(s.alias("s"), _digits(s["text"]).alias("digits"), F.lower(s["before"]).alias("low"), F.filter(F.transform(F.split(s["text"], "[^0-9]+"), F.length), lambda n: n > 0).alias("groups"))
    cues = lambda c: F.struct(c.alias("c"), _since(CUES[kind], c["low"]).alias("cue"), _since(OTHER, c["low"]).alias("other"))

    def features(z: Column) -> Column:
        c = z["c"]
        x, before, after, groups = c["s"]["text"], c["s"]["before"], c["s"]["after"], c["groups"]
        flag = lambda v: F.coalesce(v, F.lit(False)).cast("double")
        number = lambda v: F.coalesce(v, F.lit(0)).cast("double")
        count = lambda signs: (F.length(x) - F.length(F.translate(x, signs, ""))).cast("double")
        values = [
            F.lit(float(k)), flag(_check(kind, x, c["digits"])), number(F.length(c["digits"])),
            number(F.size(groups)), number(F.get(groups, F.lit(0))), number(F.get(groups, F.size(groups) - 1)), number(F.array_max(groups)), number(F.array_min(groups)),
            count(" "), count("."), count("-"), count("/"), count(","), count("_"), count("[("),
            flag(x.rlike(r"^\(?0")), flag(x.startswith("+")), flag(x.rlike(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])")), flag(x.rlike(r"(?<![0-9])[0-2]?[0-9]\.[0-5][0-9] ")),
            flag(x.rlike(r"[^ ]\. |[^ ]@ ")),
            flag(before.rlike(r"\p{L}$")), flag(before.rlike("[0-9]$")), flag(before.rlike(r"[^\p{L}0-9\s]$")), flag(after.rlike(r"\p{L}")), flag(after.rlike("[0-9]")), flag(after.rlike(r"[^\p{L}0-9\s]")),
            z["cue"], z["other"], z["other"] - z["cue"],
        ]
        return F.struct(c["s"]["start"].alias("start"), F.lit(k).alias("k"), (c["s"]["start"] + F.length(x)).alias("end"), F.array(*values).alias("f"))

    bind = lambda v, f: F.get(F.transform(F.array(v), f), F.lit(0))
    return bind(bind(once, cues), features)


def candidates(text: Column) -> Column:
    """array<struct<start,k,end,f>> of all generators; what two patterns find alike is there twice.

    Numbers that are over two digits short or long of a card's or phone's are no candidates.
    """
    nothing = F.expr("cast(array() as array<struct<start:int,k:int,end:int,f:array<double>>>)")
    found = []
    for k, kind in enumerate(KINDS):
        spans = F.concat(_spans(text, BASE[kind]), _spans(text, WIDE[kind]))
        if kind in NEAR:
            spans = F.filter(spans, lambda s: F.length(_digits(s["text"])).between(*NEAR[kind]))  # noqa: B023
        found.append(F.when(_some(kind, text), F.transform(spans, functools.partial(_candidate, k, kind))).otherwise(nothing))
    return F.concat(*found)


def _searched(documents: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the struct __pii: text, its base spans, these with their context, and candidates, each computed once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents.select(*[x for x in keep if x != "text"], F.col("text").alias("__pii_text"), text.alias("__pii_full"))
    rows = docs.select("*", _base(F.col("__pii_full")).alias("__pii_near"), candidates(F.col("__pii_full")).alias("__pii_wide"))
    found = F.struct(F.col("__pii_text").alias("text"), _places(F.col("__pii_near")).alias("base"), F.col("__pii_near").alias("near"), F.col("__pii_wide").alias("wide"))
    return rows.select(*[x for x in keep if x != "text"], found.alias("__pii"))


def _apart(a: Column, b: Column) -> Column:
    return (a["end"] <= b["start"]) | (b["end"] <= a["start"])


def _checked(c: Column) -> Column:
    return F.get(c["f"], F.lit(FEATURES.index("check"))) > 0


def _rewrites(x: Column, before: Column) -> Column:
    """array<struct<k,y,before,text>>: a base span's text as its kind is written elsewhere (y = 1), and look-alikes (y = 0).

    ``x`` is a struct of kind ``k`` and ``text``.  Digits stay those of the span but where a form asks for others.
    """
    text, d = x["text"], _digits(x["text"])
    pick = lambda items, j: F.get(F.array(*map(F.lit, items)), F.pmod(F.xxhash64(text, F.lit(j)), F.lit(len(items))).cast("int"))
    cut = lambda s, a, n: F.substring(s, a, n)
    grouped = lambda s, n, sep: F.concat_ws(sep, F.regexp_extract_all(s, F.lit("[0-9]{1,%d}" % n), F.lit(0)))
    high = lambda s: F.translate(s, "01", "47")

    def joined(sep: Column, *parts: Column) -> Column:
        return F.concat(parts[0], *(y for p in parts[1:] for y in (sep, p)))

    every = "|".join([*CUES.values(), OTHER])
    plain = F.regexp_replace(before, f"(?i){every}", "so")
    ends = lambda *words: F.right(F.concat(plain, F.lit(" "), *(y for w in words for y in (w, F.lit(" ")))), F.lit(2 * CONTEXT))
    other = lambda j: pick(OTHER_WORDS, j)
    made = lambda kind, y, where, *forms: [F.struct(F.lit(KINDS.index(kind)).alias("k"), F.lit(y).alias("y"), w.alias("before"), f.alias("text")) for f in forms for w in where]
    cue = lambda kind, j: ends(pick(CUE_WORDS[kind], j))

    # Mail addresses: at and dot written out; a stop between sentences and a price are none.
    user, host = F.regexp_extract(text, "^([^@]*)@", 1), F.regexp_extract(text, "@(.*)$", 1)
    dotted = F.regexp_replace(host, r"\.", " [dot] ")
    name = F.regexp_extract(host, r"^([^.]*)", 1)
    mails = made("email", 1, [before, plain], F.concat(user, pick([" [at] ", " (at) ", "[at]", "(at)"], 1), host), F.concat(user, F.lit(" @ "), host), F.concat(user, pick([" [at] ", " (at) "], 2), dotted))
    mails += made("email", 0, [before, plain], F.concat(user, F.lit(" @ "), name, F.lit(". "), pick(["Then", "And", "It", "We"], 3)), F.concat(user, pick([" @ ", "@ "], 4), F.lit("12."), pick(["50", "99", "00"], 5)))

    # Addresses with commas or blanks need a cue word; without one, or behind another kind's, they are lists.
    octets = [F.regexp_replace(text, r"\.", sep) for sep in (",", ", ", ". ")]
    ips = made("ip", 1, [cue("ip", 1)], *octets) + made("ip", 0, [plain, ends(other(2))], *octets)
    ips += made("ip", 0, [cue("ip", 3)], *(F.regexp_replace(o, "^[0-9]+", pick(["256", "300", "999"], 4)) for o in octets[:2]))

    # Cards with other separators; one digit changed, or numbers of articles that pass by chance.
    changed = F.concat(F.left(d, F.length(d) - 1), F.translate(F.right(d, F.lit(1)), "0123456789", "1234567890"))
    cards = made("card", 1, [before, plain], *(grouped(d, 4, sep) for sep in (".", "/", "_", " - "))) + made("card", 0, [before, plain, cue("card", 1)], *(grouped(changed, 4, sep) for sep in (".", "/", "_", "-", " ")))
    cards += made("card", 0, [ends(other(2)), ends(other(3))], *(grouped(d, 4, sep) for sep in (".", "/", "_")))

    # Phones: international with 00, national with 0, in brackets, in pairs, three-three-four; anything behind a cue word.
    sep = pick([" ", "-", ".", "/"], 1)
    d = F.left(d, F.greatest(F.length(d) - pick([0, 1, 2, 3], 9), F.lit(9)))  # numbers of other lengths are phones too
    area = F.right(d, F.greatest(F.length(d) - 2, F.lit(8)))
    ten = F.right(F.concat(d, d), F.lit(10))
    national = joined(sep, F.concat(F.lit("0"), cut(area, 1, 2)), cut(area, 3, 8))
    bare = joined(sep, cut(high(d), 1, 3), cut(d, 4, 3), cut(F.concat(d, d), 7, 5))  # not three-three-four, which tells by itself
    clear = [
        joined(sep, F.concat(F.lit("00"), cut(d, 1, 2)), cut(d, 3, 2), cut(d, 5, 8)), national, F.concat(F.lit("("), F.lit("0"), cut(area, 1, 3), F.lit(") "), cut(area, 4, 3), F.lit(" "), cut(area, 7, 2), F.lit(" "), cut(F.concat(area, d), 9, 2)),
        F.concat_ws(" ", F.regexp_extract_all(F.concat(F.lit("0"), cut(F.concat(area, d), 1, 9)), F.lit(".."), F.lit(0))), joined(sep, high(cut(ten, 1, 3)), high(cut(ten, 4, 3)), cut(ten, 7, 4)),
    ]
    phones = made("phone", 1, [before, plain], *clear) + made("phone", 1, [cue("phone", 2), ends(other(3), F.lit("by"), pick(CUE_WORDS["phone"], 4))], bare, grouped(high(cut(ten, 1, 10)), 2, " "))
    year = F.concat(pick(["19", "20"], 5), cut(ten, 1, 2))
    month, day, hour = F.concat(F.lit("0"), high(cut(ten, 3, 1))), F.concat(F.lit("1"), cut(ten, 4, 1)), F.concat(F.lit("1"), cut(ten, 5, 1))
    clocks = F.concat_ws(" ", *(F.concat(F.lit(h), cut(ten, i, 1), F.lit("."), F.lit(m), cut(ten, i + 1, 1)) for h, m, i in (("0", "3", 1), ("1", "4", 3), ("1", "1", 5))))
    lists = [F.concat_ws("-", year, month, F.concat(day, F.lit(" "), hour)), F.concat_ws("/", day, month, F.concat(year, F.lit(" "), hour)), F.concat_ws("/", month, day, F.concat(year, F.lit(" "), hour)), clocks, grouped(high(ten), 2, " "), grouped(high(F.concat(ten, cut(ten, 1, 2))), 3, " "), bare, grouped(high(F.concat(ten, cut(ten, 1, 2))), 4, " ")]
    phones += made("phone", 0, [plain], *lists) + made("phone", 0, [ends(other(6)), ends(pick(CUE_WORDS["phone"], 7), other(8))], national, bare, clear[4]) + made("phone", 0, [before, plain], cut(national, 1, 8))

    pools = [F.array(*p) for p in (mails, ips, cards, phones)]
    return F.get(F.transform(F.array(F.lit(0)), lambda _: F.when(x["k"] == 0, pools[0]).when(x["k"] == 1, pools[1]).when(x["k"] == 2, pools[2]).otherwise(pools[3])), F.lit(0))


def _labelled(searched: DataFrame) -> DataFrame:
    """half, y, f and n: how many labelled candidates of a half of the documents (by doc_id) have the features f."""
    found = searched.select(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).alias("half"), "__pii.base", "__pii.near", "__pii.wide")
    seen = found.select("half", "base", F.explode("wide").alias("c"))
    own = _checked(F.col("c")) & F.exists("base", lambda b: (b["k"] == F.col("c.k")) & (b["start"] >= F.col("c.start")) & (b["end"] <= F.col("c.end")))
    seen = seen.filter(own | ~_checked(F.col("c"))).select("half", own.cast("double").alias("y"), "c.f", F.lit(1).cast("long").alias("n"))

    # Spans that are alike with their context are rewritten once.  Rewriting multiplies them: they are dealt by their number.
    spans = found.select("half", F.explode("near").alias("b")).groupBy("half", "b.k", "b.text", "b.before", "b.after").agg(F.count("*").alias("n"))
    spans = stored(spans, "spans")
    spans = spans.repartition(-(-max(spans.count(), 1) // TASK_SPANS), "text", "before", "after")
    # Numbers that end in the middle of others would grow together with what stands behind them.
    spans = spans.select("half", "n", F.explode(_rewrites(F.struct("k", "text"), F.col("before"))).alias("w"), F.regexp_replace("after", "^[^ ].*", " ").alias("after"))
    text = F.concat("w.before", "w.text", "after")
    made = spans.select("half", "n", "w", F.length("w.before").alias("at"), F.explode(candidates(text)).alias("c"))
    upto = F.col("at") + F.length("w.text")
    same = F.col("c.k") == F.col("w.k")
    exact = same & (F.col("c.start") == F.col("at")) & (F.col("c.end") == upto)
    meets = (F.col("c.start") < upto) & (F.col("c.end") > F.col("at"))
    y = F.when(exact & (F.col("w.y") == 1) & _checked(F.col("c")), 1.0).when(meets & (same & (F.col("w.y") == 0) | ~_checked(F.col("c"))), 0.0)
    made = made.select("half", y.alias("y"), "c.f", "n").filter("y is not null")
    return seen.unionByName(made).groupBy("half", "y", "f").agg(F.sum("n").alias("n"))


def _learn(searched: DataFrame) -> tuple[list, dict[int, float]] | None:
    """Trees and each kind's threshold from all of ``searched``, or None if nothing can be learned."""
    rows = _labelled(searched).select("half", "y", *(F.get("f", F.lit(i)).alias(f) for i, f in enumerate(FEATURES)), "n")
    rows = stored(rows, "candidates")
    sizes, forms = {}, 0
    for r in rows.groupBy("kind", "y").agg(F.sum("n").alias("n"), F.count("*").alias("forms")).collect():  # 8 rows at most
        sizes[int(r.kind), r.y], forms = r.n, forms + r.forms
    share = {x: min(1.0, EACH / n) for x, n in sizes.items()}
    weight = functools.reduce(lambda out, x: F.when((F.col("kind") == x[0][0]) & (F.col("y") == x[0][1]), x[1]).otherwise(out), share.items(), F.lit(0.0))
    rows = rows.withColumn("weight", F.col("n") * weight).repartition(-(-max(forms, 1) // TASK_ROWS), *FEATURES).sortWithinPartitions("half", "y", *FEATURES)
    rows = stored(rows, "weighted")
    # With so many bins Spark ML takes the places to split at from every row.
    grown = functools.partial(boosting.fit, features=FEATURES, label="y", depth=5, step=0.5, weight="weight", bins=max(64, math.isqrt(forms) + 1))
    fits = [grown(rows.filter(F.col("half") == i)) for i in (0, 1)]
    if all(f is None for f in fits):
        return None
    score = lambda fitted: boosting.probability(fitted, lambda i: F.col(FEATURES[i]))
    scored = [rows.filter(F.col("half") == 1 - i).select("kind", "y", "n", score(f).alias("score")) for i, f in enumerate(fits) if f is not None]
    scored = functools.reduce(DataFrame.unionByName, scored)
    bins = scored.groupBy("kind", "y", F.floor(F.col("score") * 200).alias("bin")).agg(F.sum("n").alias("n")).collect()  # up to 4 kinds of 201 bins and 2 labels
    thresholds = {}
    for k in range(len(KINDS)):
        own = {(r.bin, r.y): r.n * share[k, r.y] for r in bins if r.kind == k}
        total = right = 0
        for at in range(200, int(FLOOR * 200) - 1, -1):
            right += own.get((at, 1.0), 0)
            total += own.get((at, 1.0), 0) + own.get((at, 0.0), 0)
            if right > 0 and right >= PRECISION * total:
                thresholds[k] = at / 200
    return grown(rows), thresholds


def train(documents: DataFrame) -> tuple[list, dict[int, float]] | None:
    """Trees and each kind's threshold, or None if nothing can be learned."""
    return _learn(stored(_searched(documents, "doc_id").withColumn("__pii", F.col("__pii").dropFields("text")), "searched"))


def _with_spans(searched: DataFrame, model: tuple[list, dict[int, float]] | None) -> DataFrame:
    """Adds __pii_found: base spans and selected candidates, in the order of the result."""
    if not model or not model[1]:
        return searched.withColumn("__pii_found", F.col("__pii.base"))
    fitted, thresholds = model
    least = lambda k: functools.reduce(lambda out, x: F.when(k == x[0], F.lit(x[1])).otherwise(out), thresholds.items(), F.lit(2.0))
    score = lambda c: F.struct(boosting.probability(fitted, lambda i: F.get(c["f"], F.lit(i))).alias("score"), c["start"].alias("start"), c["k"].alias("k"), c["end"].alias("end"))
    # Scores first: few candidates pass, and only these are compared with spans and with one another.
    passed = F.array_distinct(F.filter(F.transform("__pii.wide", score), lambda c: c["score"] >= least(c["k"])))
    rows = searched.withColumn("__pii_passed", passed)
    rows = rows.withColumn("__pii_passed", F.filter("__pii_passed", lambda c: ~F.exists("__pii.base", lambda b: ~_apart(b, c))))
    better = lambda a, b: (a["score"] > b["score"]) | ((a["score"] == b["score"]) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & ((a["end"] > b["end"]) | ((a["end"] == b["end"]) & (a["k"] < b["k"]))))))
    added = F.filter("__pii_passed", lambda c: ~F.exists("__pii_passed", lambda d: better(d, c) & ~_apart(c, d)))
    plain = F.transform(added, lambda c: F.struct(c["start"].alias("start"), c["k"].alias("k"), c["end"].alias("end")))
    return rows.withColumn("__pii_found", F.array_sort(F.concat("__pii.base", plain))).drop("__pii_passed")


def _written(spans: Column | str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(documents: DataFrame) -> DataFrame:
    """doc_id, base and found: array<struct<start,k,end>>, of every row."""
    # Every text is searched once: the trees learn from what was found and choose in it.
    searched = stored(_searched(documents, "doc_id").withColumn("__pii", F.col("__pii").dropFields("text")), "searched")
    return _with_spans(searched, _learn(searched)).select("doc_id", F.col("__pii.base").alias("base"), F.col("__pii_found").alias("found"))


def digest(spans: DataFrame) -> DataFrame:
    """The columns that the query returns."""
    counts = [F.size(F.filter("base", functools.partial(lambda k, s: s["k"] == k, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(_written("base"), 256).alias("base_sha256"), _written("found").alias("spans"))


def redact(documents: DataFrame) -> DataFrame:
    """The documents with every span replaced by ``[KIND]``; overlapping spans become one mark; n_chars follows.

    Columns keep their names and order, whatever they are called (but for names that begin with ``__pii``).
    """
    names = documents.columns
    searched = stored(_searched(documents, *names), "searched")
    rows = _with_spans(searched, _learn(searched))
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    # Spans that overlap are one stretch with the first one's mark.
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<from:int,upto:int,k:int>>)").alias("out"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["at"].alias("from"), s["start"].alias("upto"), s["k"].alias("k"))))).alias("out"),
    )
    cuts = F.aggregate("__pii_found", zero, step)
    rows = rows.withColumn("__pii_cuts", F.when(F.size("__pii_found") > 0, cuts))
    # 32 bits a code point: a stretch is cut out at once, however long the text is.
    rows = rows.withColumn("__pii_wide", F.when(F.size("__pii_found") > 0, F.encode("__pii.text", "UTF-32")))
    part = lambda a, n: F.decode(F.substr(F.col("__pii_wide"), a * 4 + 1, n * 4), "UTF-32")
    kept = F.transform("__pii_cuts.out", lambda c: F.concat(part(c["from"], c["upto"] - c["from"]), F.get(marks, c["k"])))
    rest = part(F.col("__pii_cuts.at"), F.greatest(F.length("__pii.text") - F.col("__pii_cuts.at"), F.lit(0)))
    text = F.when(F.size("__pii_found") > 0, F.concat(F.array_join(kept, ""), rest)).otherwise(F.col("__pii.text"))
    rows = rows.withColumn("__pii_new", text)
    own = {"text": F.col("__pii_new")}
    if "n_chars" in names:
        own["n_chars"] = F.when(F.size("__pii_found") > 0, F.length("__pii_new").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.select(*(own[x].alias(x) if x in own else F.col(f"`{x}`") for x in names))
