"""Ranked lexical search by the Best Position Algorithm over impact-ordered lists.

Terms are the maximal runs of ASCII letters and digits and of all other characters from U+0080 on, A-Z in lower case.

1. The index is a table of blocks of up to ``ROWS`` documents: their ids and lengths, the block's terms and for each its
   postings (document, occurrences).  It holds every term, so it serves any queries; blocks are cut where documents are.
2. Document frequencies of the queries' terms are summed over blocks; the number and length of all documents are sums of two
   columns.  Queries travel in batches of up to ``QUERIES`` items and ``QUERY_BYTES`` of text, one pass over the index each.
3. In a block, a term's postings ordered by impact are its list.  The lists of an item are read downwards together.  A document
   met for the first time is looked up in all lists (direct access), and its place is marked as seen in each.  A list's best
   position is the end of its unbroken run of seen places from the top: what is not seen lies behind it in every list.  So the
   sum of the impacts that follow the best positions bounds all unseen documents, and it is never above the sum at the places
   read last, for these are seen too.  Reading stops when the bound is strictly below the k-th score, so that documents which
   tie with it are all met and the smallest ids win.  A task carries its k-th scores from block to block.
4. Each task gives its best k for each item; the best of all are merged.

Scores are whole numbers (see ``impact``), so they add up to the same total in any order.

Defined results: a null or empty text has no term and is no document of the statistics; an item without terms gives no rows.
Repeated document rows are documents of their own; a null doc_id sorts behind the others.  Rows with one item_id are one
item, whose text is its distinct texts one after another; null is an item_id too.  Terms that no document holds add nothing.
An empty table of documents or items gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, stored, utf8

ROWS, POSTINGS, QUERIES, QUERY_BYTES, STEP = 4096, 1 << 22, 1024, 8 << 20, 8
#: Percent of the length normalisation that follows a document's length.
LENGTH = 75
_INDEX = "doc_ids array<bigint>, lengths binary, documents bigint, length bigint, terms array<binary>, ends binary, docs binary, counts binary"
_HITS = "query int, doc_id bigint, score bigint"
#: Bytes of terms as they count, all others as blanks.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SLICE = 1 << 20


def count_terms(text: bytes) -> Counter:
    """Occurrences of every term; a very long text is taken apart at blanks."""
    clean = text.translate(_TERMS)
    if len(clean) <= _SLICE:
        return Counter(clean.split())
    out: Counter = Counter()
    at = 0
    while at < len(clean):
        end = clean.find(b" ", at + _SLICE)
        end = len(clean) if end < 0 else end
        out.update(clean[at:end].split())
        at = end
    return out


def impact(counts: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """What a term's occurrences are worth in documents with these normalised lengths, before its weight."""
    return (1_000_000_000 * counts) // (1000 * counts + 8 * normal)


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def build_index(documents: DataFrame) -> DataFrame:
    """The blocks of ``documents`` (doc_id, text)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        lengths: list[int] = []
        terms: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0
        vocabulary: dict[bytes, int] = defaultdict()
        vocabulary.default_factory = vocabulary.__len__

        def cut() -> pa.RecordBatch:
            nonlocal held
            term, count = np.concatenate([*terms, np.zeros(0, np.int64)]), np.concatenate([*counts, np.zeros(0, np.int64)])
            doc = np.repeat(np.arange(len(ids)), [len(t) for t in terms])
            order = np.argsort(term, kind="stable")
            ends = np.cumsum(np.bincount(term.astype(np.int64), minlength=len(vocabulary)))
            row = [ids.copy(), np.array(lengths, "<i8").tobytes(), sum(n > 0 for n in lengths), sum(lengths), list(vocabulary), ends.astype("<u4").tobytes(), doc[order].astype("<u2").tobytes(), count[order].astype("<u4").tobytes()]
            kinds = [pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary()]
            for x in (ids, lengths, terms, counts, vocabulary):
                x.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds, strict=True)], [c.split()[0] for c in _INDEX.split(", ")])

        for batch in batches:
            offsets, raw = utf8(batch.column(1))
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                found = count_terms(raw[offsets[k] : offsets[k + 1]].tobytes())
                ids.append(doc_id)
                terms.append(np.fromiter((vocabulary[t] for t in found), np.int64, len(found)))
                counts.append(np.fromiter(found.values(), np.int64, len(found)))
                lengths.append(int(counts[-1].sum()))
                held += len(found)
                if len(ids) >= ROWS or held >= POSTINGS:
                    yield cut()
        if ids:
            yield cut()
        release()

    return docs.mapInArrow(blocks, _INDEX)


def _frequencies(index: DataFrame, terms: list[bytes]) -> dict[int, int]:
    """How many documents hold each of the terms, by its number; terms that none holds are left out."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, wanted = np.zeros(len(shared.value), np.int64), pa.array(shared.value, pa.binary())
        for batch in batches:
            for k in range(batch.num_rows):
                ends = np.frombuffer(batch.column(1)[k].as_py(), "<u4").astype(np.int64)
                at = pc.index_in(wanted, value_set=batch.column(0)[k].values).fill_null(-1).to_numpy(zero_copy_only=False)
                here = np.flatnonzero(at >= 0)
                total[here] += np.diff(ends, prepend=0)[at[here]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    sums = index.select("terms", "ends").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return {r.term: r.n for r in sums.collect()}  # up to one for each term of the batch


class Lists:
    """The impact-ordered lists of a block, made when they are asked for first."""

    def __init__(self, doc_ids: list, lengths: np.ndarray, at: np.ndarray, ends: np.ndarray, docs: np.ndarray, counts: np.ndarray, documents: int, length: int):
        self.n, self.at, self.ends, self.docs, self.counts = len(lengths), at, ends, docs, counts
        self.normal = 100 - LENGTH + (LENGTH * lengths * documents) // max(1, length)
        self.made: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def __getitem__(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Documents by descending impact, their impacts, and each document's place in the list (-1: not there)."""
        slot = int(self.at[term])
        if slot < 0:
            return None
        if term not in self.made:
            if len(self.made) >= 1024:
                self.made.clear()
            own = slice(int(self.ends[slot - 1]) if slot else 0, int(self.ends[slot]))
            docs = self.docs[own].astype(np.int64)
            worth = impact(self.counts[own].astype(np.int64), self.normal[docs])
            order = np.argsort(-worth, kind="stable")
            places = np.full(self.n, -1, np.int32)
            places[docs[order]] = np.arange(len(docs))
            self.made[term] = docs[order], worth[order], places
        return self.made[term]


def best_positions(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, their scores, depth read) of all documents met: the best k are among them, and all that tie with the k-th.

    ``lists``: documents by descending worth, worths, places.  ``floor`` is a score that k documents elsewhere have reached.
    Places are read in growing steps, which only means that a list may be read a little further than it must be.
    """
    met, total = np.zeros(n, bool), np.zeros(n, np.int64)
    seen, best = [np.zeros(len(docs), bool) for docs, _, _ in lists], [0] * len(lists)
    depth, step = 0, STEP
    while True:
        fresh = np.concatenate([docs[depth : depth + step] for docs, _, _ in lists]) if lists else np.zeros(0, np.int64)
        fresh = np.unique(fresh[~met[fresh]])
        met[fresh] = True
        for j, (_, worth, places) in enumerate(lists):
            at = places[fresh]
            there = at >= 0
            at = at[there]
            total[fresh[there]] += worth[at]
            seen[j][at] = True
        depth, step = depth + step, step * 2
        bound = 0
        for j, (_, worth, _) in enumerate(lists):
            rest = seen[j][best[j] :]
            best[j] = len(worth) if rest.all() else best[j] + int(rest.argmin())
            bound += int(worth[best[j]]) if best[j] < len(worth) else 0
        found = np.flatnonzero(met)
        scores = total[found]
        kth = max(floor, int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0)
        if not bound or bound < kth:
            return found, scores, depth


def _search(index: DataFrame, queries: list[Counter], documents: int, length: int, k: int) -> DataFrame:
    """query (its number), doc_id, score: each task's best for every query."""
    terms = sorted({t for q in queries for t in q})
    number, frequency = {t: i for i, t in enumerate(terms)}, _frequencies(index, terms)
    weights = {i: weight(documents, n) for i, n in frequency.items()}
    asked = [[(number[t], times * weights[number[t]]) for t, times in sorted(q.items()) if weights.get(number[t])] for q in queries]
    shared = index.sparkSession.sparkContext.broadcast((terms, asked))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, asked = shared.value
        wanted, best = pa.array(terms, pa.binary()), [[] for _ in asked]
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, vocabulary = batch.column(0)[row].as_py(), batch.column(2)[row].values
                lengths, ends, docs, counts = (np.frombuffer(batch.column(c)[row].as_py(), kind) for c, kind in ((1, "<i8"), (3, "<u4"), (4, "<u2"), (5, "<u4")))
                at = pc.index_in(wanted, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
                block = Lists(doc_ids, lengths, at, ends, docs, counts, documents, length)
                for q, own in enumerate(asked):
                    lists = [(found[0], found[1] * w, found[2]) for t, w in own if (found := block[t]) is not None]
                    if not lists:
                        continue
                    floor = -best[q][k - 1][0] if len(best[q]) >= k else 0
                    if sum(int(worth[0]) for _, worth, _ in lists) < floor:
                        continue
                    found, scores, _ = best_positions(lists, len(lengths), k, floor)
                    keep = np.flatnonzero(scores >= max(1, floor))
                    if len(keep) > k:
                        keep = keep[scores[keep] >= np.partition(scores[keep], len(keep) - k)[len(keep) - k]]
                    new = [(-int(s), doc_ids[d] is None, doc_ids[d]) for d, s in zip(found[keep].tolist(), scores[keep].tolist(), strict=True)]
                    best[q] = sorted(best[q] + new, key=lambda x: (*x[:2], x[2] or 0))[:k]
        rows = [(q, doc, -s) for q, own in enumerate(best) for s, _, doc in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["query", "doc_id", "score"])
        release()

    return index.select("doc_ids", "lengths", "terms", "ends", "docs", "counts").mapInArrow(scan, _HITS)


def _batches(items: DataFrame) -> Iterator[list]:
    """Items in batches of bounded number and size."""
    held, size = [], 0
    for row in items.toLocalIterator():
        if held and (len(held) >= QUERIES or size + len(row.text) > QUERY_BYTES):
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row.text)
    if held:
        yield held


def search(spark: SparkSession, index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 of every item (item_id, text)."""
    kind = items.schema["item_id"].dataType.simpleString()
    whole = items.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("text")), " ").alias("text"))
    all_ = index.agg(F.sum("documents"), F.sum("length")).first()
    documents, length = all_[0] or 0, all_[1] or 0
    out = None
    for batch in _batches(whole):
        hits = _search(index, [count_terms(r.text.encode()) for r in batch], documents, length, k)
        names = spark.createDataFrame([(q, r.item_id) for q, r in enumerate(batch)], f"query int, item_id {kind}")
        best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        found = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).join(names, "query").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")


def rank_documents(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Builds the index, keeps it in the shared folder, and searches it for every item."""
    index = stored(build_index(documents), "index")
    return search(documents.sparkSession, index, items, k)
