"""Text normalisation as column expressions: everything here is Column to Column and stays in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- folding ------------------------------------------------------------------------------------------------------
#: Letters that lose their marks, from Unicode's own decompositions.
_MARKED = [c for c in map(chr, range(0xC0, 0x250)) if unicodedata.normalize("NFD", c)[0].isascii()]
FOLD_FROM = "".join(_MARKED) + "ØøĐđŁłÐðıĦħŦŧ‘’‚‛“”„‐‑‒–—− "
FOLD_TO = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED) + "OoDdLlDdiHhTt" + "'" * 4 + '"' * 3 + "-" * 6 + " "
# Characters that become several.
FOLD_LONG = [("ß", "ss"), ("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"), ("œ", "oe"), ("Þ", "Th"), ("þ", "th"), ("…", "..."), ("£", "PS"), ("€", "EUR")]


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def fold_ascii(text: Column) -> Column:
    """Latin letters and common punctuation to ASCII; other non-ASCII characters are dropped."""
    out = F.translate(text, FOLD_FROM, FOLD_TO)
    long = out
    for old, new in FOLD_LONG:
        long = _replace(long, old, new)
    rest = F.regexp_replace(long, r"[^\x00-\x7F]+", "")
    return F.when(F.octet_length(out) == F.length(out), out).otherwise(rest)  # as many bytes as characters: all ASCII


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\S ]\s*| \s+", " ")  # \s+, but for single blanks, which stay


# --- numbers --------------------------------------------------------------------------------------------------------
# English number words.
_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = ["", " thousand", " million", " billion", " trillion", " quadrillion"]
#: Words of 0 to 99.
UNDER_100 = _SMALL + [t + ("-" + _SMALL[k] if k else "") for t in _TENS for k in range(10)]


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: What sets matches off, and what stands for it and for itself in texts that hold it: none of them letters or blanks.
_CUT, _HELD = "\u0001", [("\u0002", "\u0002\u0004"), ("\u0001", "\u0002\u0003")]


def replace_each(text: Column, pattern: str, word: Callable[[Column], Column]) -> Column:
    """Replaces every match by an expression of it: matches are set off by a mark, and every second piece is one."""
    for plain, held in _HELD:
        text = _replace(text, plain, held)
    pieces = F.split(F.regexp_replace(text, f"({pattern})", f"{_CUT}$1{_CUT}"), _CUT)
    out = F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, word(x)).otherwise(x)), "")
    for plain, held in reversed(_HELD):
        out = _replace(out, held, plain)
    return out


def _word(n: Column) -> Column:
    return F.get(F.array(*map(F.lit, UNDER_100)), n.cast("int"))


def _group(n: Column, between: str = " ") -> Column:
    """1 to 999 in words."""
    h, r = F.floor(n / 100), n % 100
    return F.concat_ws(between, F.when(h > 0, F.concat(_word(h), F.lit(" hundred"))), F.when(r > 0, _word(r)))


def _groups(n: Column, between: str = " ") -> Column:
    """The groups of thousands over the last one, largest first; null where a group is zero."""
    scales = [F.struct(F.lit(1000**k).cast("long").alias("unit"), F.lit(SCALES[k]).alias("name")) for k in range(len(SCALES) - 1, 0, -1)]
    one = lambda g, name: F.when(g > 0, F.concat(_group(g, between), name))
    return F.transform(F.array(*scales), lambda s: _let(F.floor(n / s["unit"]) % 1000, lambda g: one(g, s["name"])))


def cardinal_words(n: Column) -> Column:
    """A number under 10**18 in words, ``, `` between groups of thousands."""
    last = _let(n % 1000, lambda g: F.when(g > 0, _group(g)))
    return F.when(n == 0, "zero").otherwise(F.concat_ws(", ", _groups(n), last))


def int_to_words(n: Column) -> Column:
    """The reading of a number in a text: between 1000 and 3000 as a year, else as a cardinal."""

    def read(n: Column) -> Column:
        high, low = F.floor(n / 100), n % 100
        pair = F.when(low < 10, F.concat(F.lit("oh "), _word(low))).otherwise(_word(low))
        year = (
            F.when(n == 2000, "two thousand")
            .when((n > 2000) & (n < 2010), F.concat(F.lit("two thousand "), _word(low)))
            .when(low == 0, F.concat(_word(high), F.lit(" hundred")))
            .otherwise(F.concat(_word(high), F.lit(" "), pair))
        )
        return F.when((n > 1000) & (n < 3000), year).otherwise(cardinal_words(n))

    return _let(n.cast("long"), read)


def _spelled(digits: Column) -> Column:
    """A run of digits in words; over 18 digits one by one."""
    return F.when(F.length(digits) <= 18, int_to_words(F.when(F.length(digits) <= 18, digits).otherwise("0"))).otherwise(
        F.array_join(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: _word(c)), " ")
    )


# Ordinals that are not the cardinal and "th".
_ORDINALS = [("one$", "first"), ("two$", "second"), ("three$", "third"), ("five$", "fifth"), ("eight$", "eighth"), ("nine$", "ninth"), ("twelve$", "twelfth"), ("y$", "ieth")]


def ordinal_words(n: Column) -> Column:
    """A number under 10**18 as an ordinal: other than in cardinals, "and" follows hundreds and joins a last part under 100."""

    def spell(n: Column) -> Column:
        last = _let(n % 1000, lambda g: F.when(g > 0, _group(g, " and ")))
        ends = F.when((n % 1000 > 0) & (n % 1000 < 100), F.concat_ws(" and ", F.nullif(F.concat_ws(", ", _groups(n, " and ")), F.lit("")), last))
        return F.when(n == 0, "zero").otherwise(F.coalesce(ends, F.concat_ws(", ", _groups(n, " and "), last)))

    def ending(words: Column) -> Column:
        out = F.concat(words, F.lit("th"))
        for pattern, new in _ORDINALS:
            out = F.when(words.rlike(pattern), F.regexp_replace(words, pattern, new)).otherwise(out)
        return out

    return _let(_let(n.cast("long"), spell), ending)


def remove_commas(text: Column) -> Column:
    """Commas inside numbers go."""
    once = F.regexp_replace(text, "([0-9]),+([0-9])", "$1$2")
    return F.regexp_replace(once, "([0-9]),+([0-9])", "$1$2")


def expand_pounds(text: Column) -> Column:
    return F.regexp_replace(text, "£([0-9,]*[0-9]+)", "$1 pounds")


def dollars_in_words(amount: Column) -> Column:
    """``12.50`` (the text behind a dollar sign) as dollars and cents."""
    parts = F.split(amount, r"\.")
    number = lambda k: F.coalesce(F.when(F.get(parts, F.lit(k)).rlike("^[0-9]+$"), F.get(parts, F.lit(k))).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    d, c = number(0), number(1)
    say = lambda n, one: F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s"))
    return (
        F.when(F.size(parts) > 2, F.concat(amount, F.lit(" dollars")))
        .when((d > 0) & (c > 0), F.concat(say(d, "dollar"), F.lit(", "), say(c, "cent")))
        .when(d > 0, say(d, "dollar"))
        .when(c > 0, say(c, "cent"))
        .otherwise("zero dollars")
    )


def expand_dollars(text: Column) -> Column:
    return replace_each(text, r"\$[0-9.,]*[0-9]+", lambda m: dollars_in_words(_replace(F.substring(m, 2, 1 << 30), ",", "")))


def expand_decimals(text: Column) -> Column:
    return F.regexp_replace(text, r"([0-9]+)\.([0-9]+)", "$1 point $2")


def expand_ordinals(text: Column) -> Column:
    digits = lambda m: F.regexp_extract(m, "^[0-9]+", 0)
    return replace_each(text, "[0-9]+(?:st|nd|rd|th)", lambda m: F.when(F.length(digits(m)) <= 18, ordinal_words(F.when(F.length(digits(m)) <= 18, digits(m)).otherwise("0").cast("long"))).otherwise(m))


def expand_cardinals(text: Column) -> Column:
    return replace_each(text, "[0-9]+", _spelled)


def _in_steps(text: Column) -> Column:
    for step in (remove_commas, expand_pounds, expand_dollars, expand_decimals, expand_ordinals, expand_cardinals):
        text = step(text)
    return text


def expand_numbers(text: Column) -> Column:
    """Numbers in words: commas, pounds, dollars, decimals, ordinals, cardinals, in this order.

    No step reaches beyond a number and the marks that touch it.  So the text is taken apart twice: for amounts and decimals,
    on which the first four steps run, and for runs of digits with or without an ordinal's ending.
    """

    def amount(m: Column) -> Column:
        return F.when(m.rlike("[$£.,]"), expand_decimals(expand_dollars(expand_pounds(remove_commas(m))))).otherwise(m)

    def word(m: Column) -> Column:
        digits = F.regexp_extract(m, "^[0-9]+", 0)
        ordinal = lambda n: F.when((F.length(n) < F.length(m)) & (F.length(n) <= 18), ordinal_words(F.when(F.length(n) <= 18, n).otherwise("0").cast("long")))
        return _let(digits, lambda n: F.coalesce(ordinal(n), F.concat(_spelled(n), F.substring(m, F.length(n) + 1, F.lit(2)))))

    return replace_each(replace_each(text, "[$£0-9][$£0-9.,]*", amount), "[0-9]+(?:st|nd|rd|th)?", word)


# --- abbreviations and composites -----------------------------------------------------------------------------------
# Abbreviations, applied in this order.
ABBREVIATIONS = [
    ("mrs", "misess"), ("mr", "mister"), ("dr", "doctor"), ("st", "saint"), ("co", "company"), ("jr", "junior"), ("maj", "major"), ("gen", "general"), ("drs", "doctors"),
    ("rev", "reverend"), ("lt", "lieutenant"), ("hon", "honorable"), ("sgt", "sergeant"), ("capt", "captain"), ("esq", "esquire"), ("ltd", "limited"), ("col", "colonel"), ("ft", "fort"),
]


def _abbreviations_in_order(text: Column) -> Column:
    for short, long in ABBREVIATIONS:
        text = F.regexp_replace(text, rf"(?i)\b{short}\.", long)
    return text


#: Abbreviations that touch: one may take the word boundary before the next away, so their order counts only there.
_ABBREVIATED = rf"(?i)\b(?=[{''.join(sorted({short[0] for short, _ in ABBREVIATIONS}))}])(?:(?:{'|'.join(short for short, _ in ABBREVIATIONS)})\.)+"


def expand_abbreviations(text: Column) -> Column:
    """In the order of the list; the text is taken apart once, and the rules run on its abbreviations alone."""
    return replace_each(text, _ABBREVIATED, _abbreviations_in_order)


def basic_cleaners(text: Column) -> Column:
    return collapse_whitespace(F.lower(text))


def transliteration_cleaners(text: Column) -> Column:
    return collapse_whitespace(F.lower(fold_ascii(text)))


def english_cleaners(text: Column) -> Column:
    return collapse_whitespace(expand_abbreviations(expand_numbers(F.lower(fold_ascii(text)))))


def expand_percent(text: Column) -> Column:
    return _replace(_replace(text, " one% ", " one percent "), "%", " percents")


def expand_ampersand(text: Column) -> Column:
    return _replace(F.regexp_replace(text, r"(\w)&(\w)", "$1 & $2"), "&", "and")


def _where(opens: str, pattern: str) -> Callable[[Column], Column]:
    """Blanks for the matches, in texts that hold what a match begins with."""
    return lambda t: F.when(F.contains(t, F.lit(opens)), F.regexp_replace(t, pattern, " ")).otherwise(t)


def _drop_brackets(text: Column) -> Column:
    for opens, pattern in (("(", r"\(.*?\)"), ("[", r"\[.*?\]"), ("<", "<.*?>"), ("{", r"\{.*?\}")):
        text = _let(text, _where(opens, pattern))
    return text


def _marks_to_blanks(text: Column) -> Column:
    for mark in ".,?!":
        text = _replace(text, mark, " ")
    return text


def alignment_text(text: Column) -> Column:
    """The form of a transcript that is aligned with speech."""
    out = _replace(english_cleaners(text), "<inaudible>", "*")
    out = _marks_to_blanks(_drop_brackets(out))
    out = _replace(_replace(out, "-", " "), ":", " ")
    return F.trim(collapse_whitespace(expand_ampersand(expand_percent(out))))


_KEPT = "\u0001inaudible\u0002"


def display_text(text: Column) -> Column:
    """The form that is shown: the inaudible mark stays, ``-`` and ``:`` begin words of their own (see glue_connectors)."""
    out = _replace(english_cleaners(text), "<inaudible>", _KEPT)
    out = _marks_to_blanks(_drop_brackets(out))
    out = _replace(_replace(out, "-", " -"), ":", " :")
    out = F.trim(collapse_whitespace(expand_ampersand(expand_percent(out))))
    return _replace(out, _KEPT, "<inaudible>")


# Marks that the other preparation deletes.
DELETED = ".,!?[](){}'\"/<>"


def alternative_text(text: Column) -> Column:
    """Preparation for the second aligner: percents first, then cleaners, then marks are deleted rather than blanked."""
    out = F.regexp_replace(text, r"(\d{2})%", "$1 percents")
    out = _replace(_replace(out, "1%", "1 percent"), "%", " percents")
    return expand_ampersand(F.translate(english_cleaners(out), DELETED, ""))


# ASCII punctuation without the apostrophe.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


#: White space of any script.
_SPACES = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def same_count_text(text: Column) -> Column:
    """Normalises every word (between white space of any length) and keeps their number: an emptied word becomes ``*``."""
    clean = lambda w: F.lower(F.translate(w, PUNCTUATION, ""))
    words = F.filter(F.split(text, _SPACES), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(clean(w) == "", "*").otherwise(clean(w))), " ")


def is_speech(text: Column) -> Column:
    """False for null and for texts with a tag such as <laugh>."""
    return text.isNotNull() & ~text.rlike("<.*?>")


def element_text(text: Column) -> Column:
    """A transcript element as one token: lower case, inner blanks as underscores."""
    return _replace(F.lower(text), " ", "_")


def clock_to_ms(text: Column) -> Column:
    """``hh:mm:ss.ms`` to milliseconds; the fraction is read as decimals of a second."""
    p = F.split(text, r"[:.]")
    at = lambda k: F.get(p, F.lit(k)).try_cast("long")
    ms = F.rpad(F.substring(F.coalesce(F.get(p, F.lit(3)), F.lit("0")), 1, 3), 3, "0").try_cast("long")
    return ((at(0) * 60 + at(1)) * 60 + at(2)) * 1000 + ms


def syllables(word: Column) -> Column:
    """Vowel groups, less a silent final e; one at least."""
    w = F.lower(word)
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    return F.greatest(F.lit(1), groups - F.when(w.rlike("[^aeiouyl]e$") & (groups > 1), 1).otherwise(0)).cast("long")
