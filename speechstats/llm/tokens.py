"""Token ids of whole texts by the ``tokenizers`` library, with repeated words encoded once.

A byte-level BPE never joins what stands before and after a blank whose left neighbour is no white space, a word BPE that
drops white space never joins anything across a blank, and neither joins a Latin letter with a mark behind it (apostrophes
aside).  So texts are cut there.  Pieces of up to ``SHORT`` bytes are looked up in a table of the whole piece, so that equal
ids rest on equal bytes; new and longer ones go through the library.  A text's ids are its pieces' ids put together: the
same ids as one call on the whole text, which the tests compare.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import cache

import numpy as np

from .common import runs

SHORT, LETTERS = 23, [*range(65, 91), *range(97, 123)]
_RUN = 1 << 20
_ONE_WORD = re.compile(r" ?[^\s|]+")
_KEEP = np.where(np.arange(SHORT + 1) < np.arange(SHORT + 1)[:, None], 255, 0).astype(np.uint8)  # row n: a piece's first n bytes
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[LETTERS] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_MARK[39] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class _Table:
    """Open addressing over whole keys of 24 bytes: key to number.  At most half of the places are taken."""

    def __init__(self, bits: int):
        self.bits, self.taken = bits, 0
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.numbers = np.zeros((1 << bits, 3), np.uint64), np.full(1 << bits, -1, np.int32)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        h = (keys[:, 0] ^ keys[:, 0] >> np.uint64(32)) * _ODD[0]
        h = (h ^ h >> np.uint64(29) ^ keys[:, 1]) * _ODD[1]
        h = (h ^ h >> np.uint64(32) ^ keys[:, 2]) * _ODD[2]
        return ((h ^ h >> np.uint64(31)) * _ODD[0] >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it has none."""
        at, todo, out = self._first(keys), np.arange(len(keys)), np.full(len(keys), -1, np.int32)
        while len(todo):
            number = self.numbers[at]
            same = (number >= 0) & (self.keys[at] == keys[todo]).all(axis=1)
            out[todo[same]] = number[same]
            on = (number >= 0) & ~same
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct keys that have no number yet."""
        if 2 * (self.taken + len(keys)) > len(self.numbers):
            old = self.numbers >= 0
            keys, numbers = np.r_[self.keys[old], keys], np.r_[self.numbers[old], numbers]
            self.__init__((2 * len(keys)).bit_length() + 1)
        self.taken += len(keys)
        at, todo = self._first(keys), np.arange(len(keys))
        while len(todo):
            free = np.flatnonzero(self.numbers[at] < 0)
            self.numbers[at[free]] = numbers[todo[free]]
            done = self.numbers[at] == numbers[todo]
            self.keys[at[done]] = keys[todo[done]]
            todo, at = todo[~done], (at[~done] + 1) & self.mask


class Encoder:
    """Encodes batches of texts; between calls it keeps about ``most`` pieces."""

    def __init__(self, path: str, most: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = self.tokenizer = Tokenizer.from_file(path)
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        self.vocabulary = max(t.get_vocab().values()) + 1
        self.width = np.uint16 if self.vocabulary <= 1 << 16 else np.uint32
        ids = lambda x: t.encode(x, add_special_tokens=False).ids
        self.blanks = ids(" b") != ids("b")  # a piece's leading blank counts
        self.lower = ids("B") == ids("b")
        # What can stand between words of one call: it gives one id of its own and changes nothing beside it.
        self.between, self.between_id = None, -1
        for x in ("\n", " | "):
            own = ids(x)
            if len(own) == 1 and ids(f" b{x} b{x}!{x}b") == [*ids(" b"), *own, *ids(" b"), *own, *ids("!"), *own, *ids("b")]:
                self.between, self.between_id = x, own[0]
                break
        self.most, self.bits = most, int(2.5 * most).bit_length()
        self.clear()

    def clear(self) -> None:
        self.table = _Table(self.bits)
        self.flat = array("H" if self.width is np.uint16 else "I")
        self.start, self.count = array("q"), array("i")

    def _starts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin: at the texts' starts, at the blanks where a text may be cut, and at marks behind letters."""
        at, back = np.flatnonzero(raw == 32), np.r_[np.zeros(3, np.uint8), raw]
        if self.blanks:
            b1, b2, b3 = back[at + 2], back[at + 1], back[at]
            space = (b1 == 32) | ((b1 >= 9) & (b1 <= 13)) | ((b1 >= 28) & (b1 <= 31))
            at = at[~(space | ((b2 == 0xC2) & ((b1 == 0xA0) | (b1 == 0x85))) | ((b1 >= 0x80) & (b2 >= 0x80) & (b3 >= 0xE1) & (b3 <= 0xE3)))]
        first = np.zeros(len(raw), bool)
        first[at] = True
        mark = np.flatnonzero(_MARK[raw])
        b1, b2 = back[mark + 2], back[mark + 1]
        first[mark[_LETTER[b1] | ((b2 == 0xC3) & (b1 >= 0x80) & (b1 <= 0xBF) & (b1 != 0x97) & (b1 != 0xB7))]] = True
        first[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        return np.flatnonzero(first)

    def _encode(self, pieces: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All pieces' ids, where each piece's begin, and how many it has."""
        flat, sizes = [], np.zeros(len(pieces), np.int64)
        plain = [k for k, x in enumerate(pieces) if _ONE_WORD.fullmatch(x)] if self.between else []
        for k in range(0, len(plain), 8192):
            own = plain[k : k + 8192]
            ids = np.array(self.tokenizer.encode_batch_fast([self.between.join([pieces[i] for i in own])], add_special_tokens=False)[0].ids, self.width)
            ends = np.r_[np.flatnonzero(ids == self.between_id), len(ids)]
            if len(ends) != len(own):  # not so for a tokenizer that keeps the rule above
                raise ValueError("the tokenizer does not keep words apart")
            sizes[own] = np.diff(ends, prepend=-1) - 1
            flat.append(ids[ids != self.between_id])
        odd = np.setdiff1d(np.arange(len(pieces)), plain).tolist()
        for k in range(0, len(odd), 1024):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[i] for i in odd[k : k + 1024]], add_special_tokens=False)]
            sizes[odd[k : k + 1024]] = [len(x) for x in found]
            flat += [np.array(x, self.width) for x in found]
        order = np.r_[np.array(plain, np.int64), np.array(odd, np.int64)]  # ids stand in this order
        begin = np.zeros(len(pieces), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        ids = np.concatenate(flat) if flat else np.zeros(0, self.width)
        return ids.tobytes(), begin, sizes

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Encodes new pieces; their numbers."""
        data, begin, sizes = self._encode([x.decode("utf-8", "replace") for x in pieces])
        first = len(self.start)
        self.start.frombytes((begin + len(self.flat)).tobytes())
        self.count.frombytes(sizes.astype(np.int32).tobytes())
        self.flat.frombytes(data)
        return np.arange(first, first + len(pieces), dtype=np.int32)

    def _numbers(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, int]:
        """Every piece's number; those from the second value on are not kept: they belong to longer pieces."""
        out, short = np.full(len(start), -1, np.int32), size <= SHORT
        padded = np.r_[raw, np.zeros(SHORT + 1, np.uint8)]
        own = np.flatnonzero(short)
        keys = np.lib.stride_tricks.sliding_window_view(padded, SHORT + 1)[start[own]] & _KEEP[size[own]]
        keys[:, SHORT] = size[own]
        keys = keys.view(np.uint64)
        found = self.table.find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            distinct, which = np.unique(keys[new].view("V24").ravel(), return_inverse=True)
            values = distinct.view(np.uint8).reshape(-1, SHORT + 1)
            numbers = self._learn([x[: x[SHORT]].tobytes() for x in values])
            self.table.add(np.ascontiguousarray(values).view(np.uint64), numbers)
            found[new] = numbers[which]
        out[own] = found
        kept, rest = len(self.start), np.flatnonzero(~short)
        if len(rest):
            data = raw.tobytes()
            texts = [data[a : a + n] for a, n in zip(start[rest].tolist(), size[rest].tolist(), strict=True)]
            numbers = dict.fromkeys(texts)
            numbers.update(zip(numbers, self._learn(list(numbers)).tolist(), strict=True))
            out[rest] = [numbers[x] for x in texts]
        return out, kept

    def _run(self, raw: np.ndarray, offsets: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        if len(self.start) > self.most:
            self.clear()
        start = self._starts(raw, offsets)
        index, kept = self._numbers(_LOWER[raw] if self.lower else raw, start, np.diff(start, append=len(raw)))
        ids, bounds = np.zeros(0, self.width), np.zeros(len(offsets), np.int64)
        if len(index):
            at, n = np.frombuffer(self.start, np.int64)[index], np.frombuffer(self.count, np.int32)[index]
            before = np.zeros(len(n) + 1, np.int64)
            np.cumsum(n, out=before[1:])
            ids = np.frombuffer(self.flat, self.width)[np.arange(before[-1]) + np.repeat(at - before[:-1], n)]
            bounds = before[np.searchsorted(start, offsets)]
        if kept < len(self.start):
            del self.flat[self.start[kept] :]
            del self.start[kept:], self.count[kept:]
        if end is None:
            return ids, bounds
        docs = len(offsets) - 1
        out = np.full(len(ids) + docs, end, self.width if end < self.vocabulary else np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(docs), np.diff(bounds))] = ids
        return out, bounds + np.arange(docs + 1)

    def encode(self, raw: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and each text's bounds there; ``end`` is put behind every text."""
        parts, bounds = [np.zeros(0, self.width)], [np.zeros(1, np.int64)]
        for i, j in runs(offsets, _RUN):
            ids, at = self._run(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end)
            parts.append(ids)
            bounds.append(at[1:] + bounds[-1][-1])
        return np.concatenate(parts), np.concatenate(bounds)


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)
