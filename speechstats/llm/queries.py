"""The registered queries of this subpackage: every operator over its whole table, and DuckDB SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, decontaminate, langid, lexical, merkle, neardup, packing, pii, quality, repair, urls, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(r"select * from values (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.parse_chats(chat.format_chats(rows)))


_CONTROL = "|".join("".join("\\" + c if c in "|[]" else c for c in x) for x in chat.CONTROL)
ORACLE["op1_chat"] = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) t(conv_id, turn, role, text)
), n AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before,
    length(replace(text, '\\', '\\\\')) + len(regexp_extract_all(replace(text, '\\', '\\\\'), '{_CONTROL}')) AS text_chars,
    length(replace(role, '\\', '\\\\')) + len(regexp_extract_all(replace(role, '\\', '\\\\'), '{_CONTROL}')) AS role_chars
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::bigint AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_chars + CASE WHEN before IS NOT DISTINCT FROM role THEN {len(chat.NEXT)} ELSE role_chars + {len(chat.START + chat.BODY + chat.END) + 1} END)::bigint AS formatted_chars,
  sum(CASE WHEN before IS NOT DISTINCT FROM role THEN 0 ELSE 1 END)::bigint AS n_blocks
FROM n GROUP BY conv_id
"""


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)


@query
def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=0, capacity=2048)


@query
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=80)


#: Exact: every pair of documents that shares a shingle is counted.
ORACLE["op4_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS shingles FROM w
), classes AS (
  SELECT min(doc_id) AS rep, any_value(len(shingles)) AS n, list_sort(shingles) AS key FROM s WHERE len(shingles) > 0 GROUP BY list_sort(shingles)
), x AS (SELECT rep, n, hash(unnest(key)) AS h FROM classes),
pairs AS (
  SELECT a.rep AS p, b.rep AS q FROM x a JOIN x b ON a.h = b.h AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), links AS (SELECT p, q FROM pairs UNION ALL SELECT q, p FROM pairs),
reach(node, seen) AS (SELECT p, p FROM links UNION SELECT reach.node, links.q FROM reach JOIN links ON links.p = reach.seen),
found AS (SELECT node, min(seen) AS c FROM reach GROUP BY node)
SELECT s.doc_id, len(s.shingles)::bigint AS n_shingles,
  coalesce(found.c, classes.rep, s.doc_id)::bigint AS component_id,
  s.doc_id = coalesce(found.c, classes.rep, s.doc_id) AS kept
FROM s LEFT JOIN classes ON classes.key = list_sort(s.shingles) AND len(s.shingles) > 0 LEFT JOIN found ON found.node = classes.rep
"""


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query
def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), every=100, k=10)


#: Exact search: what the index is measured against (its recall is tested); kept out of ORACLE, for an index may miss some.
EXACT_OP7 = """
WITH g AS (SELECT vec_id, embedding::double[] AS v FROM embeddings WHERE embedding IS NOT NULL)
SELECT query_id, rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, c.v), c.vec_id)::int AS rank
  FROM g q JOIN g c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
WHERE rank <= 10
"""


@query
def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE["op11_lexical"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_TERM}') AS terms FROM documents),
n AS (SELECT count(*) AS n, sum(len(terms))::bigint AS l FROM d WHERE len(terms) > 0),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{_TERM}')) AS t FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, any_value(len) AS len, t, count(*) AS tf FROM (SELECT doc_id, len(terms) AS len, unnest(terms) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t),
w AS (SELECT t, floor(1000 * ln((2 * any_value(n.n) + 2)::double / (2 * count(*) + 1)))::bigint AS w FROM p, n GROUP BY t),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len * n.n) // n.l))))::bigint AS score
 FROM q JOIN p USING (t) JOIN w USING (t), n GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


@query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered_fifth())


def _crc32(text: str) -> str:
    """Unsigned crc32 of ASCII text in DuckDB, half a byte at a time."""
    table = list(range(16))
    for _ in range(4):
        table = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in table]
    halves = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [ascii(({text})[i]) & 15, ascii(({text})[i]) >> 4]))"
    return f"xor(list_reduce({halves}, lambda c, b: xor(c >> 4, list_extract({table}, (xor(c, b) & 15) + 1)), 4294967295), 4294967295)"


def _merkle_sql(depth: int = 7, sources: int = 4) -> str:
    """Trees of up to 16**depth leaves a source and 16**sources sources, level by level."""
    field = lambda x: f"coalesce(strlen({x}::varchar) || ':' || {x}::varchar, '-')"
    row = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    sql = [
        f"d AS (SELECT doc_id, source, {row('text')} AS leaf, CASE WHEN {_crc32('doc_id::varchar')} % 5 = 0 THEN {row(_LOWER.format('text'))} END AS other FROM documents)",
        "e AS (SELECT doc_id, source, leaf, coalesce(other, leaf) AS other, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM d)",
        "a0 AS (SELECT source AS tree, k, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM e)",
    ]

    def rise(name: str, levels: int) -> None:
        for i in range(levels):
            w = "WINDOW w AS (PARTITION BY tree, k // 16 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY tree, k // 16 ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
            sides = [f"CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER {x}, '') ELSE '' END AS {y}" for x, y in (("w", "l"), ("v", "r"))]
            sql.append(f"{name}s{i} AS (SELECT tree, k, {', '.join(sides)} FROM {name}{i} {w})")
            sql.append(f"{name}{i + 1} AS (SELECT tree, k // 16 AS k, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY k)) ELSE any_value(h) END AS h, (any_value(n) + 15) // 16 AS n FROM {name}{i} GROUP BY tree, k // 16)")

    rise("a", depth)
    sql.append(f"b0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS k, h, count(*) OVER () AS n, tree AS source FROM a{depth})")
    rise("b", sources)
    first = "JOIN a0 ON a0.tree IS NOT DISTINCT FROM e.source AND a0.k = e.k JOIN b0 ON b0.source IS NOT DISTINCT FROM e.source"
    chain = ["f0 AS (SELECT e.doc_id, e.leaf, b0.h AS subroot, " + f"b{sources}.h AS root, e.other AS f, '' AS proof, e.source, e.k, b0.k AS bk, a0.n AS an, b0.n AS bn FROM e {first} CROSS JOIN b{sources})"]
    at = 0
    for name, levels, tree, k, n in (("a", depth, "source", "k", "an"), ("b", sources, "''", "bk", "bn")):
        for i in range(levels):
            chain.append(
                f"f{at + 1} AS (SELECT f{at}.* REPLACE (CASE WHEN ({n} + {16**i - 1}) // {16**i} > 1 THEN sha256(s.l || f || s.r) ELSE f END AS f, proof || s.l || s.r AS proof) "
                f"FROM f{at} JOIN {name}s{i} AS s ON s.tree IS NOT DISTINCT FROM {tree} AND s.k = f{at}.{k} // {16**i})"
            )
            at += 1
    return "WITH " + ",\n".join(sql + chain) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{at}"


ORACLE["op12_merkle"] = _merkle_sql()


@query
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


#: Five bytes of the digest are eight letters.
_BASE32 = "array_to_string(flatten(list_transform(range(4), lambda g: list_transform(range(8), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || substr(h, g * 10 + 1, 10))::bigint >> (35 - 5 * i)) & 31) + 1]))), '')"
ORACLE["op13_warc"] = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::bigint AS payload_bytes, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS html FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS winner FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> winner THEN winner END AS refers_to FROM w
"""
