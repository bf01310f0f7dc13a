"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and benchmark items are normalised alike: case is folded by Unicode (so capitals with accents, and SS for sharp s,
equal small letters), every run of other ASCII characters than letters and digits becomes one blank.  A leak is a stretch of a document that some window of ``WINDOW`` normalised bytes of an item (the whole
item if it is shorter) matches with at most ``RATE`` edits a byte.

Lemma: a window of w bytes within e edits shares at least ``w + 1 - q * (e + 1)`` q-grams with its match, all of them on
diagonals that differ by e at most.  So each q-gram that a document shares with an item counts in the bands of diagonals
that hold it (bands overlap by e); where a band has that many within a window's length, banded alignment of the item's
windows around there decides.

Items are searched in blocks of up to ``BLOCK`` bytes, one pass over the documents for each block, so what is broadcast
is bounded however large the benchmark is; a worker keeps the index of the block it searched last.

Defined results: a null or empty text has no leak; an item under ``SHORTEST`` normalised bytes cannot be told from
ordinary text and is not searched; repeated rows are searched one by one; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, runs, utf8

Q, WINDOW, RATE, SHORTEST, BLOCK = 10, 80, 0.08, 20, 4 << 20
_HITS = 1 << 20
_SLICE, _OVERLAP, _BITS = 1 << 20, 4096, 22
_MAP = np.full(256, 32, np.uint8)
for _k in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _MAP[_k] = _k
_MAP[65:91] = np.arange(97, 123)
_FOLD = {c: chr(c).casefold().encode() for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c)}
_FOLDS = np.zeros(0x110000 + 0xF0000, bool)  # broken UTF-8 may give codes past the last code point
_FOLDS[list(_FOLD)] = True


def fold(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The bytes with the case of other characters than ASCII folded, and the place in ``raw`` of each (None: the same)."""
    lead = np.flatnonzero(raw >= 0xC0)
    if not len(lead):
        return raw, None
    byte = raw[lead]
    size = 2 + (byte >= 0xE0) + (byte >= 0xF0)
    code = (byte & (0x7F >> size)).astype(np.int64)
    for k in range(1, 4):
        more = size > k
        code[more] = code[more] << 6 | raw.take(lead[more] + k, mode="clip") & 0x3F
    change = np.flatnonzero(_FOLDS[code] & (lead + size <= len(raw)))
    if not len(change):
        return raw, None
    lead, size, code = lead[change], size[change], code[change]
    kinds, kind = np.unique(code, return_inverse=True)
    folded = [_FOLD[c] for c in kinds.tolist()]
    new = np.array([len(x) for x in folded])[kind]
    source, start = None, lead
    if (new != size).any():
        times = np.ones(len(raw), np.int64)
        for k in range(1, 4):
            times[lead[(k < size) & (k >= new)] + k] = 0
        times[lead + np.minimum(size, new) - 1] += np.maximum(new - size, 0)
        source = np.repeat(np.arange(len(raw)), times)
        start = np.searchsorted(source, lead)
    out = raw.copy() if source is None else raw[source]
    letters = np.array([list(x.ljust(max(map(len, folded)), b"\0")) for x in folded], np.uint8)[kind]
    for k in range(letters.shape[1]):
        out[start[new > k] + k] = letters[new > k, k]
    return out, source


def normalise(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes of all texts, and the place in ``raw`` of each; blanks at a text's ends stay apart from others'."""
    folded, source = fold(raw)
    mapped = _MAP[folded]
    keep = mapped != 32
    keep[1:] |= mapped[:-1] != 32
    starts = offsets[:-1][offsets[1:] > offsets[:-1]]
    if source is not None:
        starts = np.searchsorted(source, starts)
    keep[starts] = mapped[starts] != 32
    at = np.flatnonzero(keep)
    return mapped[at], at if source is None else source[at]


def grams(x: np.ndarray) -> np.ndarray:
    """A hash of the q-gram at each place."""
    n = max(0, len(x) - Q + 1)
    one = x.astype(np.uint64)
    two = one[:-1] | one[1:] << np.uint64(8) if len(x) > 1 else one[:0]
    four = two[:-2] | two[2:] << np.uint64(16)
    eight = four[:-4] | four[4:] << np.uint64(32)
    mixed = (eight[:n] ^ eight[:n] >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + two[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[bytes]):
        self.items, codes, owner, place = [], [], [], []
        for k, text in enumerate(items):
            raw = np.frombuffer(text, np.uint8)
            x, _ = normalise(raw, np.array([0, len(raw)]))
            x = x[: len(x) - (len(x) > 0 and x[-1] == 32)]
            self.items.append(x)
            if len(x) >= SHORTEST:
                g = grams(x)
                codes.append(g)
                owner.append(np.full(len(g), k, np.int32))
                place.append(np.arange(len(g), dtype=np.int32))
        code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(code, kind="stable")
        self.code, self.owner, self.place = code[order], np.concatenate([*owner, np.zeros(0, np.int32)])[order], np.concatenate([*place, np.zeros(0, np.int32)])[order]
        self.some = np.zeros(1 << _BITS, bool)
        self.some[(self.code >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        size = np.array([len(x) for x in self.items], np.int64)
        self.window = np.minimum(size, WINDOW)
        self.edits = np.maximum(0, np.minimum((RATE * self.window).astype(np.int64), self.window // Q - 1))
        self.least = self.window + 1 - Q * (self.edits + 1)

    def search(self, x: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first byte, end byte, edits) of leaks in normalised bytes; those of one text and item may overlap."""
        if not len(x) or not len(self.code):
            return []
        code = grams(x)
        p = np.flatnonzero(self.some[(code >> np.uint64(64 - _BITS)).astype(np.int64)])
        low, high = np.searchsorted(self.code, code[p]), np.searchsorted(self.code, code[p], side="right")
        p, low, high = (v[high > low] for v in (p, low, high))
        text = np.searchsorted(offsets, at[p], side="right") - 1
        inside = text == np.searchsorted(offsets, at[p + Q - 1], side="right") - 1
        p, low, n, text = p[inside], low[inside], (high - low)[inside], text[inside]
        found: list[tuple[int, int, int, int, int]] = []
        first = 0
        while first < len(p):  # about ``_HITS`` pairs of matches at once, but whole texts
            more = int(np.searchsorted(np.cumsum(n[first:]), _HITS, side="right"))
            last = int(np.searchsorted(text, text[min(first + more, len(p) - 1)]))
            last = len(p) if first + more >= len(p) else last if last > first else int(np.searchsorted(text, text[first], side="right"))
            found += self._regions(x, at, offsets, p[first:last], low[first:last], n[first:last], text[first:last])
            first = last
        return found

    def _regions(self, x: np.ndarray, at: np.ndarray, offsets: np.ndarray, p: np.ndarray, low: np.ndarray, n: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """The leaks among matches: places ``p`` in ``x``, each with ``n`` index rows from ``low`` on."""
        row = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
        p, text, item, diagonal = np.repeat(p, n), np.repeat(text, n), self.owner[row], np.repeat(p, n) - self.place[row]
        # Bands of twice the edits, at every multiple of the edits: a diagonal is in two of them.
        width = self.edits[item] + 1
        band = np.concatenate([diagonal // width, diagonal // width - 1])
        p, text, item, diagonal = (np.tile(v, 2) for v in (p, text, item, diagonal))
        order = np.lexsort((p, band, item, text))
        p, text, item, band, diagonal = (v[order] for v in (p, text, item, band, diagonal))
        last = np.arange(len(p)) + self.least[item] - 1
        ok = last < len(p)
        last = np.minimum(last, len(p) - 1)
        ok &= (text[last] == text) & (item[last] == item) & (band[last] == band) & (p[last] - p <= self.window[item] - Q + self.edits[item])
        found: list[tuple[int, int, int, int, int]] = []
        done: set[tuple[int, ...]] = set()
        first = np.flatnonzero(ok)
        new = np.ones(len(first), bool)  # matches that follow one another closely on a band are one region
        if len(first) > 1:
            a, b = first[:-1], first[1:]
            new[1:] = (text[a] != text[b]) | (item[a] != item[b]) | (band[a] != band[b]) | (p[b] - p[a] > WINDOW)
        heads = np.flatnonzero(new)
        for i, j in zip(first[heads].tolist(), first[np.r_[heads[1:], len(first)] - 1].tolist() if len(heads) else [], strict=True):
            end = int(last[j])
            region = (int(text[i]), int(item[i]), int(p[j]), int(p[last[i]]) + Q, int(diagonal[i : end + 1].min()), int(diagonal[i : end + 1].max()))
            if region in done:  # overlapping bands often hold the same q-grams
                continue
            done.add(region)
            hit = self._align(x, *region, at, offsets)
            if hit:
                found.append((int(text[i]), int(item[i]), *hit))
        return found

    def _align(self, x: np.ndarray, text: int, k: int, start: int, end: int, low: int, high: int, at: np.ndarray, offsets: np.ndarray) -> tuple[int, int, int] | None:
        """Aligns every window of item ``k`` near the region in a band of diagonals; the stretch that matched, and its edits."""
        y, w, e = self.items[k], int(self.window[k]), int(self.edits[k])
        # A window that qualifies ends behind the first match's last q-gram and begins before the last match's first.
        first, last = max(0, end - high - w), min(len(y) - w, start - low)
        if last < first:
            return None
        begin = np.arange(first, last + 1)
        lo, hi = np.searchsorted(at, offsets[text]), np.searchsorted(at, offsets[text + 1])
        shifts = np.arange(low - e, high + e + 1)
        cost = np.zeros((len(begin), len(shifts)), np.int16)
        slope = np.arange(len(shifts), dtype=np.int16)
        for step in range(w):
            place = begin[:, None] + (step + shifts)
            other = x.take(place, mode="clip") != y[begin + step][:, None]
            if place[0, 0] < lo or place[-1, -1] >= hi:
                other |= (place < lo) | (place >= hi)
            new = cost + other
            np.minimum(new[:, :-1], cost[:, 1:] + np.int16(1), out=new[:, :-1])
            cost = np.minimum.accumulate(new - slope, axis=1) + slope
            if step % 4 == 3:  # windows that are over the budget on every diagonal are done
                alive = cost.min(axis=1) <= e
                if not alive.all():
                    begin, cost = begin[alive], cost[alive]
                    if not len(begin):
                        return None
        best = cost.min(axis=1)
        good = np.flatnonzero(best <= e)
        if not len(good):
            return None
        a, b = good[0], good[-1]
        i, j = begin[a] + shifts[cost[a].argmin()], begin[b] + w - 1 + shifts[cost[b].argmin()]
        return int(at[min(max(i, lo), hi - 1)]), int(at[min(max(j, lo), hi - 1)]) + 1, int(best.min())


_LAST: list = [None, None]


def _index(shared) -> Index:
    """The index of a broadcast block, built once in each Python worker and kept until another block comes."""
    if _LAST[0] != shared.value[0]:
        _LAST[:] = [None, None]
        _LAST[:] = [shared.value[0], Index([t.encode() for _, t in shared.value[1]])]
    return _LAST[1]


def _slices(raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Normalised bytes of one long text and their places, slice by slice; each slice begins with the last ``_OVERLAP``
    normalised bytes of the one before, however many bytes of the text these stand for."""
    x, at, start = np.zeros(0, np.uint8), np.zeros(0, np.int64), 0
    while start < len(raw):
        end = min(start + _SLICE, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80 and end < start + _SLICE + 3:  # whole characters
            end += 1
        new, place = normalise(raw[start:end], np.array([0, end - start]))
        if len(x) and x[-1] != 32 and (not len(place) or place[0] > 0):  # a blank at the slice's start is not the text's
            new, place = np.r_[np.uint8(32), new], np.r_[0, place]
        elif len(x) and x[-1] == 32 and len(new) and new[0] == 32:
            new, place = new[1:], place[1:]
        x, at = np.concatenate([x, new]), np.concatenate([at, place + start])
        if len(x) >= _SLICE or end == len(raw):  # slices of blanks alone are gathered
            yield x, at
            x, at = x[-_OVERLAP:], at[-_OVERLAP:]
        start = end


def _pieces(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, normalised bytes, places, offsets) of whole texts up to ``_SLICE`` bytes together, or of a longer text's slices."""
    for first, last in runs(offsets, _SLICE):
        part = raw[offsets[first] : offsets[last]]
        if len(part) > _SLICE:
            for x, at in _slices(part):
                yield first, x, at, np.array([0, len(part)])
        else:
            own = offsets[first : last + 1] - offsets[first]
            yield first, *normalise(part, own), own


def _leaks(index: Index, texts: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int]], int]]:
    """(row, item, stretches, edits) of an Arrow column; a stretch is a start and an end in code points.

    Stretches ascend and neither overlap nor touch: clean text between two leaks of an item is in neither.
    """
    offsets, raw = utf8(texts)
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for first, x, at, own in _pieces(raw, offsets):
        for row, item, a, b, edits in index.search(x, at, own):
            base = int(own[row])
            found.setdefault((first + row, item), []).append((a - base, b - base, edits))
    for (row, item), hits in sorted(found.items()):
        merged: list[list[int]] = []
        for a, b, _ in sorted(hits):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        points = np.r_[0, np.cumsum((raw[offsets[row] : offsets[row + 1]] & 0xC0) != 0x80)]
        yield row, item, [(int(points[a]), int(points[b])) for a, b in merged], min(h[2] for h in hits)


def _blocks(benchmark: DataFrame) -> Iterator[list]:
    """The items in blocks whose texts hold about ``BLOCK`` bytes."""
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(-(-size // BLOCK))
    for k in range(n):
        yield sorted(tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect())


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_char, end_char, edits (of the best window), stretches of every document and item that it holds part of.

    start_char and end_char span all leaks of the item; stretches, array<struct<start_char, end_char>>, leave out what is clean between them.
    """
    spark = documents.sparkSession
    kinds = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}"
    schema = f"{kinds}, start_char bigint, end_char bigint, edits int, stretches array<struct<start_char: bigint, end_char: bigint>>"
    docs = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, ids = _index(shared), [i for i, _ in shared.value[1]]
            for batch in batches:
                found = list(_leaks(index, batch.column(1)))
                if found:
                    rows, items, stretches, edits = zip(*found, strict=True)
                    ends = [pa.array([x[0][0] for x in stretches], pa.int64()), pa.array([x[-1][1] for x in stretches], pa.int64())]
                    lists = pa.array([[dict(zip(("start_char", "end_char"), x, strict=True)) for x in s] for s in stretches], pa.list_(pa.struct([("start_char", pa.int64()), ("end_char", pa.int64())])))
                    columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([ids[k] for k in items]), *ends, pa.array(edits, pa.int32()), lists]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "start_char", "end_char", "edits", "stretches"])
            release()

        out = out.unionByName(docs.mapInArrow(find, schema))
    return out


def drop_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, in one narrow pass for each block of items."""
    place = documents.columns.index("text")
    for block in _blocks(benchmark):
        shared = documents.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(shared)
            for batch in batches:
                for k in range(0, batch.num_rows, 512):
                    some = batch.slice(k, 512)
                    good = np.ones(some.num_rows, bool)
                    good[[row for row, *_ in _leaks(index, some.column(place).fill_null(""))]] = False
                    yield some.filter(pa.array(good))
            release()

        documents = documents.mapInArrow(keep, documents.schema)
    return documents
