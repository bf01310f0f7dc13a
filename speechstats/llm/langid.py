"""Language identification: string kernels with Nyström landmarks and one-versus-rest kernel ridge regression.

The kernel is the blended spectrum's: how many n-grams of 1 to 4 bytes (of the lower-cased text, hashed to ``BUCKETS``)
two texts both have, over the root of the product of how many each has.  ``LANDMARKS`` training texts span the Nyström
space; a ridge regression in it for each language against the rest gives the weights.  A batch of texts is scored by two
matrix products: presence by landmarks, then landmarks by languages.

Of a text of over ``PART`` bytes nearly every bucket would be present, whatever its language.  It is taken in parts of
that length that cover it and share ``GRAMS - 1`` bytes, so no n-gram is left out: its kernel is the mean of its parts' kernels, and in
training its presence is what at least half of its parts have.

It learns from a bounded sample of the rows outside the held-out fifth that have a language: of each language and each of
``SHARES`` shares of the hashes of doc_id the ``PER_SHARE`` rows with the smallest hash, ``TRAIN`` rows in all.  Their whole texts are turned to presence bits
on the executors; only these come to the driver.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is every text if nothing can be
learned; equal scores go to the language first in the alphabet; repeated rows are predicted one by one; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, utf8

BUCKETS, GRAMS, LANDMARKS, SHARES, PER_SHARE, TRAIN, RIDGE, SHARPNESS = 1 << 14, 4, 192, 64, 7, 8000, 1e-3, 5.0
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SLICE, PART = 1 << 20, 1 << 16


def presence(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row for each text: 1 where the text has an n-gram of that bucket."""
    out = np.zeros((len(offsets) - 1, BUCKETS), np.float32)
    flat = out.reshape(-1)
    for at in range(0, len(raw), _SLICE):
        part = raw[at : at + _SLICE + GRAMS - 1].astype(np.uint64)
        doc = np.searchsorted(offsets, np.arange(at, at + len(part)), side="right") - 1
        gram = np.zeros(len(part), np.uint64)
        for n in range(1, GRAMS + 1):
            size = len(part) - n + 1
            if size <= 0:
                break
            gram = gram[:size] << np.uint64(8) | part[n - 1 :]
            bucket = ((gram + np.uint64(n << 40)) * _MIX >> np.uint64(50)).astype(np.int64)
            inside = doc[:size] == doc[n - 1 :]
            flat[(doc[:size] * BUCKETS + bucket)[inside]] = 1
    return out


def parts(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text of each part, presence of each part), up to 128 parts at once."""
    begin, end, owner = [], [], []
    for k in range(len(offsets) - 1):
        a, b = int(offsets[k]), int(offsets[k + 1])
        for at in range(a, max(b - GRAMS + 1, a + 1), PART):
            begin.append(at)
            end.append(min(at + PART + GRAMS - 1, b))
            owner.append(k)
    for k in range(0, len(begin), 128):
        pieces = [raw[a:b] for a, b in zip(begin[k : k + 128], end[k : k + 128], strict=True)]
        yield np.array(owner[k : k + 128]), presence(np.concatenate(pieces), np.cumsum([0, *map(len, pieces)]))


class Model:
    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.languages, self.weights = languages, weights.astype(np.float32)
        self.packed = np.packbits(landmarks.astype(bool), axis=1)

    def landmarks(self) -> np.ndarray:
        rows = np.unpackbits(self.packed, axis=1).astype(np.float32)
        return rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))


def fit(rows: np.ndarray, languages: list[str], names: list[str]) -> Model:
    """``rows``: presence (0 or 1) of the training texts, in random order; ``languages``: theirs; ``names``: all, sorted."""
    seen = dict.fromkeys(names, 0)
    turn = []
    for y in languages:
        turn.append(seen[y])
        seen[y] += 1
    spread = sorted(range(len(rows)), key=lambda k: (turn[k], k))[:LANDMARKS]
    unit = lambda some: some.astype(np.float32) / np.sqrt(np.maximum(some.sum(1, keepdims=True, dtype=np.float32), 1))
    chosen = unit(rows[spread])
    values, vectors = np.linalg.eigh((chosen @ chosen.T).astype(np.float64))
    some = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, some] / np.sqrt(values[some])
    features = np.concatenate([unit(rows[k : k + 256]) @ chosen.T for k in range(0, len(rows), 256)]) @ root
    targets = np.where(np.array(languages)[:, None] == np.array(names), 1.0, -1.0)
    ridge = np.linalg.solve(features.T @ features + RIDGE * len(rows) * np.eye(features.shape[1]), features.T @ targets)
    return Model(names, rows[spread], root @ ridge)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))


def train(documents: DataFrame, most: int = TRAIN) -> Model | None:
    spark = documents.sparkSession
    known = documents.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out("doc_id")).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    ranked = known.withColumn("k", F.row_number().over(Window.partitionBy("lang", F.pmod(F.col("h"), F.lit(SHARES))).orderBy("h", "doc_id"))).filter(F.col("k") <= PER_SHARE)
    chosen = ranked.orderBy("k", "h", "lang").limit(most).select("doc_id", F.col("lang").alias("y")).distinct()
    picked = chosen.collect()
    if not picked:
        return None
    ids = F.broadcast(spark.createDataFrame(picked, chosen.schema))  # up to ``most`` rows

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                some = batch.slice(k, 64)
                offsets, raw = utf8(some.column(1))
                count, n = np.zeros((some.num_rows, BUCKETS), np.int32), np.zeros((some.num_rows, 1), np.int64)
                for owner, rows in parts(raw, offsets):
                    np.add.at(count, owner, rows.astype(np.int32))
                    np.add.at(n[:, 0], owner, 1)
                rows = np.packbits((count > 0) & (2 * count >= n), axis=1)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array([x.tobytes() for x in rows], pa.binary())], ["h", "y", "bits"])

    texts = _texts(documents).join(ids, "doc_id").select(F.xxhash64("doc_id").alias("h"), "text", "y")
    rows = sorted(texts.mapInArrow(bits, "h bigint, y string, bits binary").collect())
    names = sorted({r.y for r in rows})
    packed = np.frombuffer(b"".join(bytes(r.bits) for r in rows), np.uint8).reshape(len(rows), -1)
    return fit(np.unpackbits(packed, axis=1), [r.y for r in rows], names)


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    if model is None:
        return documents.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        landmarks, names = model.landmarks().T.copy(), np.array(model.languages, object)
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                some = batch.slice(k, 128)
                offsets, raw = utf8(some.column(1))
                kernel, n = np.zeros((some.num_rows, landmarks.shape[1]), np.float32), np.zeros((some.num_rows, 1), np.float32)
                for owner, rows in parts(raw, offsets):
                    np.add.at(kernel, owner, (rows @ landmarks) / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1)))
                    np.add.at(n[:, 0], owner, 1)
                kernel /= n
                each = np.exp(SHARPNESS * np.clip(kernel @ model.weights, -3, 3).astype(np.float64))
                best, letters = each.argmax(1), some.column(2).to_numpy(zero_copy_only=False)
                chance = each[np.arange(len(best)), best] / each.sum(1)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.where(letters, names[best], "und"), pa.string()), pa.array(np.where(letters, chance, 0.0))], ["doc_id", "lang_pred", "score"])

    return _texts(documents).mapInArrow(score, f"doc_id {kind}, lang_pred string, score double")


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    return predict(documents, train(documents)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
