"""Queries of the text functions over whole document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..schema import duration, validate_items
from . import fixtures as fx
from .fixtures import FX
from .base import query


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _chain(expr: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        expr = f"replace({expr}, {_lit(a)}, {_lit(b)})"
    return expr


def _rx(expr: str, pattern: str, new: str) -> str:
    return f"regexp_replace({expr}, {_lit(pattern)}, {_lit(new)}, 'g')"


def fold_sql(e: str) -> str:
    return _rx(_chain(f"translate({e}, {_lit(x.FOLD_FROM)}, {_lit(x.FOLD_TO)})", x.FOLD_LONG), r"[^\x00-\x7F]", "")


def space_sql(e: str) -> str:
    return _rx(e, r"\s+", " ")


# Fixed values, written out here again, so that a wrong table in the library cannot agree with itself.
_MARKS_DELETED = ".,!?[](){}'\"/<>"
_ASCII_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_SHORT = "mrs misess mr mister dr doctor st saint co company jr junior maj major gen general drs doctors rev reverend lt lieutenant hon honorable sgt sergeant capt captain esq esquire ltd limited col colonel ft fort".split()
_ONES = "zero,one,two,three,four,five,six,seven,eight,nine,ten,eleven,twelve,thirteen,fourteen,fifteen,sixteen,seventeen,eighteen,nineteen".split(",")
_UNDER_100 = [w if n < 20 else "" for n, w in enumerate(_ONES)] + [f"{t}-{_ONES[k]}" if k else t for t in "twenty,thirty,forty,fifty,sixty,seventy,eighty,ninety".split(",") for k in range(10)]
_SCALES = ",thousand,million,billion,trillion,quadrillion".split(",")


def commas_sql(e: str) -> str:
    return _rx(_rx(e, "([0-9]),+([0-9])", r"\1\2"), "([0-9]),+([0-9])", r"\1\2")


def abbreviations_sql(e: str) -> str:
    for short, long in zip(_SHORT[::2], _SHORT[1::2], strict=True):
        e = _rx(e, rf"(?i)\b{short}\.", long)
    return e


def ampersand_sql(e: str) -> str:
    return f"replace({_rx(e, r'(\w)&(\w)', r'\1 & \2')}, '&', 'and')"


def percent_sql(e: str) -> str:
    return _chain(e, [(" one% ", " one percent "), ("%", " percents")])


_WORDS = "[" + ", ".join(_lit(w) for w in _UNDER_100) + "]"


def _w(n: str) -> str:
    return f"({_WORDS})[({n})::int + 1]"


def _group_sql(g: str, between: str = " ") -> str:
    return f"concat_ws('{between}', CASE WHEN {g} >= 100 THEN {_w(f'{g} // 100')} || ' hundred' END, CASE WHEN {g} % 100 > 0 THEN {_w(f'{g} % 100')} END)"


def _upper_sql(n: str, between: str = " ") -> list[str]:
    """The groups over the last three digits."""
    return [f"CASE WHEN ({n}) // {1000**k} % 1000 > 0 THEN {_group_sql(f'(({n}) // {1000**k} % 1000)', between)} || ' {_SCALES[k]}' END" for k in (5, 4, 3, 2, 1)]


def cardinal_sql(n: str) -> str:
    last = f"CASE WHEN ({n}) % 1000 > 0 THEN {_group_sql(f'(({n}) % 1000)')} END"
    return f"CASE WHEN ({n}) = 0 THEN 'zero' ELSE concat_ws(', ', {', '.join([*_upper_sql(n), last])}) END"


_YEAR = f"""CASE WHEN n = 2000 THEN 'two thousand' WHEN n > 2000 AND n < 2010 THEN 'two thousand ' || {_w('n % 100')} WHEN n % 100 = 0 THEN {_w('n // 100')} || ' hundred'
 ELSE {_w('n // 100')} || ' ' || CASE WHEN n % 100 < 10 THEN 'oh ' ELSE '' END || {_w('n % 100')} END"""
_READ = f"CASE WHEN n > 1000 AND n < 3000 THEN {_YEAR} ELSE {cardinal_sql('n')} END"
_ENDS = [("y$", "ieth"), ("twelve$", "twelfth"), ("nine$", "ninth"), ("eight$", "eighth"), ("five$", "fifth"), ("three$", "third"), ("two$", "second"), ("one$", "first")]
_TH = "CASE " + " ".join(f"WHEN regexp_matches(w, {_lit(p)}) THEN regexp_replace(w, {_lit(p)}, {_lit(new)})" for p, new in _ENDS) + " ELSE w || 'th' END"


def ordinal_sql(n: str) -> str:
    upper, low = f"concat_ws(', ', {', '.join(_upper_sql(n, ' and '))})", f"(({n}) % 1000)"
    words = f"CASE WHEN ({n}) = 0 THEN 'zero' WHEN {low} = 0 THEN {upper} WHEN ({n}) < 1000 THEN {_group_sql(low, ' and ')} ELSE {upper} || CASE WHEN {low} < 100 THEN ' and ' ELSE ', ' END || {_group_sql(low, ' and ')} END"
    return f"(list_transform([{words}], lambda w: {_TH})[1])"


def _each(text: str, pattern: str, word: str) -> str:
    """Every match of ``pattern`` replaced by ``word`` (an expression of ``m``)."""
    gaps, hits = f"string_split_regex({text}, {_lit(pattern)})", f"regexp_extract_all({text}, {_lit(pattern)})"
    return f"array_to_string(list_transform(list_zip({gaps}, list_transform({hits}, lambda m: {word})), lambda z: z[1] || coalesce(z[2], '')), '')"


_DOLLARS = """list_transform([{'d': coalesce(try_cast(string_split(a, '.')[1] AS HUGEINT), 0), 'c': coalesce(try_cast(string_split(a, '.')[2] AS HUGEINT), 0), 'n': len(string_split(a, '.')), 'a': a}], lambda v:
 CASE WHEN v.n > 2 THEN v.a || ' dollars' WHEN v.d > 0 AND v.c > 0 THEN v.d || ' dollar' || CASE WHEN v.d = 1 THEN '' ELSE 's' END || ', ' || v.c || ' cent' || CASE WHEN v.c = 1 THEN '' ELSE 's' END
 WHEN v.d > 0 THEN v.d || ' dollar' || CASE WHEN v.d = 1 THEN '' ELSE 's' END WHEN v.c > 0 THEN v.c || ' cent' || CASE WHEN v.c = 1 THEN '' ELSE 's' END ELSE 'zero dollars' END)[1]"""
_SPELL = f"CASE WHEN length(m) > 18 THEN array_to_string(list_transform(string_split(m, ''), lambda g: {_w('g::int')}), ' ') ELSE list_transform([try_cast(m AS BIGINT)], lambda n: {_READ})[1] END"
_NTH = f"CASE WHEN length(m) > 20 THEN m ELSE list_transform([try_cast(m[:-3] AS BIGINT)], lambda n: {ordinal_sql('n')})[1] END"


def english_steps(source: str) -> str:
    """CTEs e0 to e6 (doc_id, t): the English cleaners over ``source``, an expression of documents' columns."""
    return f"""WITH e0 AS (SELECT doc_id, {commas_sql(f"lower({fold_sql(source)})")} AS t FROM documents),
e1 AS (SELECT doc_id, {_each("t", "[$][0-9.,]*[0-9]+", f"list_transform([replace(m[2:], ',', '')], lambda a: {_DOLLARS})[1]")} AS t FROM e0),
e2 AS (SELECT doc_id, {_rx("t", r"([0-9]+)[.]([0-9]+)", r"\1 point \2")} AS t FROM e1),
e3 AS (SELECT doc_id, {_each("t", "[0-9]+(?:st|nd|rd|th)", _NTH)} AS t FROM e2),
e4 AS (SELECT doc_id, {_each("t", "[0-9]+", _SPELL)} AS t FROM e3),
e5 AS (SELECT doc_id, {space_sql(abbreviations_sql("t"))} AS t FROM e4)"""


def brackets_sql(e: str) -> str:
    for pattern in (r"\(.*?\)", r"\[.*?\]", "<.*?>", r"\{.*?\}"):
        e = _rx(e, pattern, " ")
    return e


def finish_sql(e: str) -> str:
    return f"trim({space_sql(ampersand_sql(percent_sql(e)))})"


_MARKS = [(c, " ") for c in ".,?!"]


def _scalar(name: str, f, sql: str, source=None) -> None:
    @query(name, sql if sql.startswith("WITH") else f"SELECT doc_id, {sql} AS value FROM documents")
    def _(spark, d):
        return fx.table(spark, d, "documents").select("doc_id", f(source() if source else F.col("text")).alias("value"))


#: Whole texts with amounts, ordinals, tags, marks and abbreviations beside what they hold.
_ADDED = ("Dr. <inaudible> 21% of $", " ", "th R&D (x) one% of ", " ")


def _rich():
    pos, n = F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    return F.concat(F.lit(_ADDED[0]), n, F.lit("."), pos, F.lit(_ADDED[1]), n, F.lit(_ADDED[2]), "text", F.lit(_ADDED[3]), pos)


_RICH_SQL = f"{_lit(_ADDED[0])} || n_chars || '.' || doc_id || {_lit(_ADDED[1])} || n_chars || {_lit(_ADDED[2])} || text || {_lit(_ADDED[3])} || doc_id"
_STEPS = english_steps(_RICH_SQL)
_scalar("b1_fold_ascii", x.fold_ascii, fold_sql("text"))
_scalar("b2_lower", lambda c: F.lower(x.fold_ascii(c)), f"lower({fold_sql('text')})")
_scalar("b2_upper", lambda c: F.upper(x.fold_ascii(c)), f"upper({fold_sql('text')})")
_scalar("b3_collapse_whitespace", x.collapse_whitespace, space_sql("text"))
_scalar("b4_remove_commas", x.remove_commas, commas_sql("replace(text, ' ', ',')"), lambda: F.replace("text", F.lit(" "), F.lit(",")))
_scalar("b5_pounds", x.expand_pounds, _rx(_rx("text", "([0-9])", r"£\1"), "£([0-9,]*[0-9]+)", r"\1 pounds"), lambda: F.regexp_replace("text", "([0-9])", "£$1"))
_scalar("b7_decimals", x.expand_decimals, _rx("text", r"([0-9]+)\.([0-9]+)", r"\1 point \2"))
_scalar("b10_abbreviations", x.expand_abbreviations, abbreviations_sql(f"replace({fold_sql('text')}, ' ', ' dr. ')"), lambda: F.replace(x.fold_ascii(F.col("text")), F.lit(" "), F.lit(" dr. ")))
_scalar("b11_basic_cleaners", x.basic_cleaners, space_sql("lower(text)"))
_scalar("b11_transliteration_cleaners", x.transliteration_cleaners, space_sql(f"lower({fold_sql('text')})"))
_scalar("b11_english_cleaners", x.english_cleaners, f"{_STEPS} SELECT doc_id, t AS value FROM e5", _rich)
_scalar("b12_alignment_text", x.alignment_text, f"{_STEPS} SELECT doc_id, {finish_sql(_chain(_chain(brackets_sql("replace(t, '<inaudible>', '*')"), _MARKS), [('-', ' '), (':', ' ')]))} AS value FROM e5", _rich)
_scalar("b13_percent", x.expand_percent, percent_sql("replace(text, '%%%', '%') || ' one% x'"), lambda: F.concat(F.replace("text", F.lit("%%%"), F.lit("%")), F.lit(" one% x")))
_scalar("b14_ampersand", x.expand_ampersand, ampersand_sql(f"replace({fold_sql('text')}, ' ', '&')"), lambda: F.replace(x.fold_ascii(F.col("text")), F.lit(" "), F.lit("&")))
_HIDDEN = "chr(1) || 'inaudible' || chr(2)"
_shown = finish_sql(_chain(_chain(brackets_sql(f"replace(t, '<inaudible>', {_HIDDEN})"), _MARKS), [("-", " -"), (":", " :")]))
_scalar("b15_display_text", x.display_text, f"{_STEPS} SELECT doc_id, replace({_shown}, {_HIDDEN}, '<inaudible>') AS value FROM e5", _rich)
_percents = _chain(_rx(f"({_RICH_SQL})", r"([0-9]{2})%", r"\1 percents"), [("1%", "1 percent"), ("%", " percents")])
_scalar("b16_alternative_text", x.alternative_text, f"{english_steps(_percents)} SELECT doc_id, {ampersand_sql(f'translate(t, {_lit(_MARKS_DELETED)}, {_lit("")})')} AS value FROM e5", _rich)
_scalar(
    "b17_same_count_text",
    x.same_count_text,
    f"array_to_string(list_transform(list_filter(string_split_regex({fold_sql('text')}, '\\s+'), lambda w: w <> ''), lambda w: CASE WHEN translate(w, {_lit(_ASCII_MARKS)}, '') = '' THEN '*' ELSE lower(translate(w, {_lit(_ASCII_MARKS)}, '')) END), ' ')",
    lambda: x.fold_ascii(F.col("text")),
)
_scalar("b6_dollars_in_texts", x.expand_dollars, _each(_RICH_SQL, "[$][0-9.,]*[0-9]+", f"list_transform([replace(m[2:], ',', '')], lambda a: {_DOLLARS})[1]"), _rich)


@query("b6_dollars", """SELECT doc_id, CASE WHEN d > 0 AND c > 0 THEN d || ' dollar' || CASE WHEN d = 1 THEN '' ELSE 's' END || ', ' || c || ' cent' || CASE WHEN c = 1 THEN '' ELSE 's' END
  WHEN d > 0 THEN d || ' dollar' || CASE WHEN d = 1 THEN '' ELSE 's' END WHEN c > 0 THEN c || ' cent' || CASE WHEN c = 1 THEN '' ELSE 's' END ELSE 'zero dollars' END AS value
FROM (SELECT doc_id, doc_id % 4 AS d, n_chars % 3 AS c FROM documents)""")
def _(spark, d):
    amount = F.concat(F.lit("$"), (F.col("doc_id") % 4).cast("string"), F.lit("."), (F.col("n_chars") % 3).cast("string"))
    return fx.table(spark, d, "documents").select("doc_id", x.expand_dollars(amount).alias("value"))


@query("b9_int_to_words", f"SELECT o_orderkey, CASE WHEN n > 1000 AND n < 3000 THEN {_YEAR} ELSE {cardinal_sql('n')} END AS value FROM (SELECT o_orderkey, o_orderkey * CASE WHEN o_orderkey % 3 = 0 THEN 997 WHEN o_orderkey % 3 = 1 THEN 1 ELSE 1000003 END AS n FROM orders)")
def _(spark, d):
    k = F.col("o_orderkey")
    n = k * F.when(k % 3 == 0, 997).when(k % 3 == 1, 1).otherwise(1000003)
    return fx.table(spark, d, "orders").select("o_orderkey", x.int_to_words(n).alias("value"))


@query("b9_expand_cardinals", f"SELECT o_orderkey, 'no ' || {cardinal_sql('o_orderkey % 1000')} || ' and ' || {cardinal_sql('o_orderkey % 7')} || '.' AS value FROM orders")
def _(spark, d):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("no "), (k % 1000).cast("string"), F.lit(" and "), (k % 7).cast("string"), F.lit("."))
    return fx.table(spark, d, "orders").select("o_orderkey", x.expand_cardinals(text).alias("value"))


@query("b8_expand_ordinals", f"SELECT o_orderkey, 'the ' || {ordinal_sql('o_orderkey')} || ' one of ' || {ordinal_sql('o_orderkey * 1009')} AS value FROM orders")
def _(spark, d):
    text = F.concat(F.lit("the "), F.col("o_orderkey").cast("string"), F.lit("th one of "), (F.col("o_orderkey") * 1009).cast("string"), F.lit("th"))
    return fx.table(spark, d, "orders").select("o_orderkey", x.expand_ordinals(text).alias("value"))


_TAGGED = "CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN text || '<laugh>' ELSE text END"


@query("b18_speech_only", rf"SELECT doc_id FROM (SELECT doc_id, {_TAGGED} AS t FROM documents) WHERE t IS NOT NULL AND NOT regexp_matches(t, '<.*?>')")
def _(spark, d):
    t = F.when(F.col("doc_id") % 5 == 1, F.concat("text", F.lit("<laugh>"))).when(F.col("doc_id") % 5 != 0, F.col("text"))
    return fx.table(spark, d, "documents").filter(x.is_speech(t)).select("doc_id")


@query("b19_element_text", "SELECT event_id, replace(lower(event_type || ' X'), ' ', '_') AS value FROM events WHERE event_id % 3 <> 0")
def _(spark, d):
    e = fx.table(spark, d, "events").withColumn("type", F.when(F.col("event_id") % 3 == 0, "punct").otherwise("text"))
    return e.filter("type = 'text'").select("event_id", x.element_text(F.concat("event_type", F.lit(" X"))).alias("value"))


@query("b20_clock_to_ms", FX + "SELECT utt_id, pos, start_time AS ms FROM fx_words")
def _(spark, d):
    s = F.col("start_time")
    clock = F.format_string("%02d:%02d:%02d.%03d", F.floor(s / 3600000), F.floor(s / 60000) % 60, F.floor(s / 1000) % 60, s % 1000)
    return fx.words(spark, d).select("utt_id", "pos", x.clock_to_ms(clock).alias("ms"))


@query("b21_validate", FX + """SELECT utt_id, pos, CASE WHEN t IS NULL THEN 'text missing' WHEN t = '' THEN 'text empty' WHEN e IS NULL THEN 'time missing' WHEN s < 0 THEN 'start negative' WHEN e < 0 THEN 'end negative' WHEN e < s THEN 'end before start' END AS reason
FROM (SELECT utt_id, pos, CASE WHEN pos % 11 = 3 THEN NULL WHEN pos % 11 = 4 THEN '' ELSE text END AS t, start_time - CASE WHEN pos % 7 = 0 THEN 100 ELSE 0 END AS s, CASE WHEN pos % 13 = 5 THEN NULL ELSE end_time - CASE WHEN pos % 5 = 1 THEN 400 ELSE 0 END END AS e FROM fx_words)""")
def _(spark, d):
    pos = F.col("pos")
    w = fx.words(spark, d).select(
        "utt_id", "pos", F.when(pos % 11 == 3, None).when(pos % 11 == 4, "").otherwise(F.col("text")).alias("text"), (F.col("start_time") - F.when(pos % 7 == 0, 100).otherwise(0)).alias("start_time"),
        F.when(pos % 13 == 5, None).otherwise(F.col("end_time") - F.when(pos % 5 == 1, 400).otherwise(0)).alias("end_time"),
    )
    return validate_items(w).select("utt_id", "pos", "reason")


@query("b22_duration", FX + "SELECT utt_id, pos, end_time - start_time AS duration FROM fx_words")
def _(spark, d):
    return fx.words(spark, d).select("utt_id", "pos", duration().alias("duration"))
