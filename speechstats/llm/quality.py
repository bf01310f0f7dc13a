"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of ``CHUNK`` bytes that cover all of it.  Bytes become learned vectors, learned
filters of ``WIDTH`` bytes run over a chunk in steps of two, each filter keeps its largest value in the chunk (and zero
at least).  A text's largest, mean and smallest chunk values (a chunk that repeats itself wakes few filters) give its
probability by one logistic layer.

The network learns from the whole text of every labelled row outside the held-out fifth; nothing is sampled or cut.
These rows are dealt by the hash of doc_id to shards of about ``SHARD_BYTES`` bytes and ``SHARD_ROWS`` rows, whose number grows
with them alone, whatever the number of partitions; a shard is one row of a written table.  In each of ``ROUNDS`` rounds
every shard starts from the same parameters and passes over its rows once, in tasks of Spark; the next round starts from
the shards' mean, weighted by rows.  The means are sums of whole numbers, so neither the order nor the partitions of the
rows change them.  A single shard needs no means and makes all of its ``EPOCHS`` (``STEPS`` steps at least) in one round.
Scoring reads every byte of every text.

Defined results: a null or empty text has no chunk and gets the logistic layer's constant; repeated labels of a document
count by their mean, null labels are left out; without two classes the score is the share of label 1 (0.5 without
labels); repeated rows are learned from and scored one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, release, stored, utf8

CHUNK, OVERLAP, WIDTH, STEP, VECTOR, FILTERS = 256, 32, 8, 2, 8, 40
SHARD_ROWS, SHARD_BYTES, ROUNDS = 4000, 16 << 20, 4
EPOCHS, STEPS, BATCH, LEAST_BATCH, RATE = 6, 300, 64, 8, 0.005
#: Parameters are added up as whole numbers of this fraction.
UNIT = 2.0**-24
NAMES = ("vectors", "filters", "weights", "bias")
SLICE = 256
PLACES = (CHUNK - WIDTH) // STEP + 1
PAD = 256


def chunk_starts(size: int) -> np.ndarray:
    """Starts of the chunks that cover a text of ``size`` bytes; the last one ends with the text."""
    if size <= CHUNK:
        return np.zeros(min(size, 1), np.int64)
    n = -(-(size - OVERLAP) // (CHUNK - OVERLAP))
    return np.minimum(np.arange(n) * (CHUNK - OVERLAP), size - CHUNK)


def cut(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Chunks as rows of byte numbers, ``PAD`` behind a text's end."""
    at = starts[:, None] + np.arange(CHUNK)
    inside = at < ends[:, None]
    return np.where(inside, raw[np.where(inside, at, 0)].astype(np.int16), np.int16(PAD))


class Network:
    """Parameters as plain arrays: it travels to the executors inside a broadcast."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.vectors = rng.normal(0, 0.5, (257, VECTOR)).astype(np.float32)
        self.vectors[PAD] = 0
        self.filters = rng.normal(0, (WIDTH * VECTOR) ** -0.5, (WIDTH * VECTOR, FILTERS)).astype(np.float32)
        self.weights = np.zeros(3 * FILTERS, np.float32)
        self.bias = np.zeros(1, np.float32)

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        x = np.ascontiguousarray(self.vectors[chunks])
        n, s = len(chunks), x.strides
        return np.lib.stride_tricks.as_strided(x, (n, PLACES, WIDTH * VECTOR), (s[0], STEP * s[1], s[2])).reshape(n * PLACES, WIDTH * VECTOR)

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """Each filter's largest value in each chunk."""
        out = np.zeros((len(chunks), FILTERS), np.float32)
        for k in range(0, len(chunks), 128):
            part = chunks[k : k + 128]
            out[k : k + 128] = (self.windows(part) @ self.filters).reshape(len(part), PLACES, FILTERS).max(axis=1)
        return np.maximum(out, 0, out=out)

    def score(self, pooled: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
        """One probability for each of ``n`` texts from its chunks' values; ``docs`` ascends."""
        features = np.zeros((n, 3 * FILTERS))
        if len(docs):
            own, first = np.unique(docs, return_index=True)
            features[own, :FILTERS] = np.maximum.reduceat(pooled, first, axis=0)
            features[own, FILTERS : 2 * FILTERS] = np.add.reduceat(pooled.astype(np.float64), first, axis=0) / np.diff(np.r_[first, len(docs)])[:, None]
            features[own, 2 * FILTERS :] = np.minimum.reduceat(pooled, first, axis=0)
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -30, 30)))

    def values(self) -> np.ndarray:
        """All parameters in one line."""
        return np.concatenate([getattr(self, name).ravel() for name in NAMES])

    def put(self, values: np.ndarray) -> Network:
        """The reverse of ``values``."""
        ends = np.cumsum([getattr(self, name).size for name in NAMES])
        for name, part in zip(NAMES, np.split(values, ends[:-1]), strict=True):
            setattr(self, name, part.reshape(getattr(self, name).shape).astype(np.float32))
        return self

    def fit(self, chunks: np.ndarray, docs: np.ndarray, labels: np.ndarray, epochs: int, batch: int, begin: float = 0.0, end: float = 1.0, seed: int = 2) -> Network:
        """Adam on the logistic loss; gradients flow through the places where a filter was largest.

        ``begin`` and ``end`` are the shares of the whole training before and after this call; rates fall over all of it.
        """
        n = len(labels)
        rng = np.random.default_rng(seed)
        first, moment, square, step = np.searchsorted(docs, np.arange(n + 1)), {k: 0.0 for k in NAMES}, {k: 0.0 for k in NAMES}, 0
        total = epochs * -(-n // batch)
        for _ in range(epochs):
            order = rng.permutation(n)
            for k in range(0, n, batch):
                some = order[k : k + batch]
                sizes = first[some + 1] - first[some]
                rows = np.repeat(first[some], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                step += 1
                for name, g in zip(NAMES, self._gradients(chunks[rows], sizes, labels[some]), strict=True):
                    moment[name] = 0.9 * moment[name] + 0.1 * g
                    square[name] = 0.99 * square[name] + 0.01 * g * g
                    rate = RATE * (1 - begin - (end - begin) * step / (total + 1)) * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step)
                    value = getattr(self, name)
                    value -= (rate * moment[name] / (np.sqrt(square[name]) + 1e-8)).astype(np.float32)
                self.vectors[PAD] = 0
        return self

    def _gradients(self, chunks: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, ...]:
        m, c = len(labels), len(chunks)
        doc = np.repeat(np.arange(m), sizes)
        best, place = np.zeros((c, FILTERS), self.filters.dtype), np.zeros((c, FILTERS), np.int64)
        for k in range(0, c, SLICE):  # long texts have many chunks
            values = (self.filters.T @ self.windows(chunks[k : k + SLICE]).T).reshape(FILTERS, -1, PLACES)
            at = values.argmax(axis=2)
            place[k : k + SLICE] = at.T
            best[k : k + SLICE] = np.take_along_axis(values, at[:, :, None], 2)[:, :, 0].T
        pooled = np.maximum(best, 0)
        largest, mean = np.zeros((m, FILTERS), pooled.dtype), np.zeros((m, FILTERS), pooled.dtype)
        smallest = np.where(sizes > 0, np.inf, 0)[:, None].repeat(FILTERS, 1).astype(pooled.dtype)
        np.maximum.at(largest, doc, pooled)
        np.minimum.at(smallest, doc, pooled)
        np.add.at(mean, doc, pooled)
        mean /= np.maximum(sizes, 1)[:, None]
        x = np.concatenate([largest, mean, smallest], 1)
        error = (1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30))) - labels) / m
        down = error[:, None] * self.weights
        on = (pooled == largest[doc]) * down[doc, :FILTERS] + down[doc, FILTERS : 2 * FILTERS] / sizes[doc][:, None] + (pooled == smallest[doc]) * down[doc, 2 * FILTERS :]
        on = (on * (best > 0)).astype(pooled.dtype)
        # What flows back to each byte at each place of each filter's window; both gradients are products of it.
        flow, part = np.zeros(FILTERS * WIDTH * 257), np.arange(FILTERS * WIDTH).reshape(FILTERS, WIDTH) * 257
        for k in range(0, c, SLICE):
            some, at = chunks[k : k + SLICE], place[k : k + SLICE]
            which = some[np.arange(len(some))[:, None, None], (at * STEP)[:, :, None] + np.arange(WIDTH)]
            flow += np.bincount((which + part).ravel(), np.repeat(on[k : k + SLICE].ravel(), WIDTH), len(flow))
        flow = flow.reshape(FILTERS, WIDTH, 257)
        filters = (flow @ self.vectors).reshape(FILTERS, -1).T
        vectors = np.einsum("fwb,wvf->bv", flow, self.filters.reshape(WIDTH, VECTOR, FILTERS), optimize=True)
        return vectors, filters + 1e-4 * self.filters, (x * error[:, None]).sum(0) + 1e-4 * self.weights, error.sum(keepdims=True)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _labelled(rows: DataFrame, labels: DataFrame, value: str, shards: int | None = None) -> DataFrame:
    """doc_id, ``value`` (never null) and label ``y`` of every row that the network may learn from.

    With ``shards`` each row also has the number of its shard, which only doc_id decides.  One exchange, to the partition of that
    number (hashes of a few numbers would meet), serves the window in which labels meet their rows and the shards, whose rows
    then follow each other.
    """
    own = F.col("doc_id").isNotNull() & ~held_out("doc_id")
    known = labels.filter(own & F.col("quality").isNotNull()).select("doc_id", F.lit(None).alias(value), F.col("quality").cast("double"))
    both = rows.filter(own).select("doc_id", value, F.lit(None).cast("double").alias("quality")).union(known)
    number = ["shard"] if shards else []
    if shards:
        both = both.withColumn("shard", F.pmod(F.hash("doc_id"), F.lit(shards))).repartitionById(shards, F.col("shard"))
    label = F.avg("quality").over(Window.partitionBy(*number, "doc_id"))
    known = both.select(*number, "doc_id", value, (label >= 0.5).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col(value).isNotNull())
    return known.sortWithinPartitions("shard") if shards else known


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shard's rows as one row, in an order that only they decide; the rows of a shard follow each other."""
    parts, own = [], None
    for batch in batches:
        numbers = batch.column("shard").to_numpy()
        for k in np.flatnonzero(np.diff(numbers, prepend=-1)):  # where a batch or a shard in it begins
            if parts and numbers[k] != own:
                yield _packed(parts)
                parts = []
            own = numbers[k]
            parts.append(batch.slice(k, np.searchsorted(numbers, own, side="right") - k))
    if parts:
        yield _packed(parts)
    release()


def _packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(parts).sort_by([("h", "ascending"), ("doc_id", "ascending")])
    offsets, raw = utf8(rows["text"])
    return pa.RecordBatch.from_pydict({"y": [rows["y"].to_numpy().astype(np.float32).tobytes()], "offsets": [offsets.tobytes()], "raw": [raw.tobytes()]})


def _learned(net: Network, raw: np.ndarray, offsets: np.ndarray, labels: np.ndarray, turn: int, turns: int) -> Network:
    """``net`` after its turn of a shard."""
    lists = [chunk_starts(int(n)) for n in np.diff(offsets)]
    docs = np.repeat(np.arange(len(lists)), [len(s) for s in lists])
    starts = np.concatenate([a + s for a, s in zip(offsets[:-1], lists, strict=True)])
    chunks = np.zeros((len(starts), CHUNK), np.int16)
    for k in range(0, len(starts), 1024):
        chunks[k : k + 1024] = cut(raw, starts[k : k + 1024], offsets[1:][docs[k : k + 1024]])
    n = len(labels)
    if turns == 1:
        return net.fit(chunks, docs, labels, max(EPOCHS, -(-STEPS // -(-n // BATCH))), BATCH)
    batch = min(BATCH, max(LEAST_BATCH, n * turns // STEPS))
    return net.fit(chunks, docs, labels, 1, batch, turn / turns, (turn + 1) / turns, seed=2 + turn)


def train(documents: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES) -> Network:
    """Fits a network to every labelled row (see the module's head)."""
    context, net = documents.sparkSession.sparkContext, Network()
    lengths = _texts(documents).select("doc_id", F.octet_length("text").cast("long").alias("size"))
    n, good, size = _labelled(lengths, labels, "size").agg(F.count("*"), F.sum("y"), F.sum("size")).first()
    share = float(np.clip(good / n if n else 0.5, 1e-3, 1 - 1e-3))
    net.bias[:] = np.log(share / (1 - share))
    if not n or good in (0, n):
        return net
    shards = max(-(-n // shard_rows), -(-size // shard_bytes))
    rows = _labelled(_texts(documents), labels, "text", shards).withColumn("h", F.xxhash64("doc_id", "text"))
    packed = stored(rows.mapInArrow(_shard, "y binary, offsets binary, raw binary"), "labelled")
    turns = ROUNDS if shards > 1 else 1
    for turn in range(turns):
        model = context.broadcast(net)

        def learn(batches: Iterator[pa.RecordBatch], model=model, turn=turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    raw, offsets, y = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in (("raw", np.uint8), ("offsets", np.int64), ("y", np.float32)))
                    own = _learned(copy.deepcopy(model.value), raw, offsets, y, turn, turns)
                    whole = np.rint(own.values().astype(np.float64) * (len(y) / UNIT)).astype(np.int64)
                    yield pa.RecordBatch.from_pydict({"values": pa.array([whole])})
            release()

        parts = packed.mapInArrow(learn, "values array<bigint>").select(F.posexplode("values").alias("place", "value"))
        sums = {r.place: r.value for r in parts.groupBy("place").agg(F.sum("value").alias("value")).collect()}  # as many as parameters
        net = copy.deepcopy(net).put(np.array([sums[k] for k in range(len(sums))]) * (UNIT / n))
        model.unpersist()
    return net


def _scores(net: Network, texts: pa.Array) -> np.ndarray:
    offsets, raw = utf8(texts)
    scores = np.zeros(len(texts))
    for k in range(0, len(texts), 64):
        own = offsets[k : k + 65]
        lists = [chunk_starts(int(n)) for n in np.diff(own)]
        starts = np.concatenate([a + s for a, s in zip(own[:-1], lists, strict=True)])
        docs = np.repeat(np.arange(len(lists)), [len(s) for s in lists])
        ends = own[1:][docs]
        pooled = [net.pooled(cut(raw, starts[j : j + 1024], ends[j : j + 1024])) for j in range(0, len(starts), 1024)]
        scores[k : k + 64] = net.score(np.concatenate(pooled) if pooled else np.zeros((0, FILTERS), np.float32), docs, len(lists))
    return scores


def score_quality(documents: DataFrame, network: Network) -> DataFrame:
    """doc_id and score of every row."""
    model = documents.sparkSession.sparkContext.broadcast(network)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model.value, batch.column(1)))], ["doc_id", "score"])
        release()

    return _texts(documents).mapInArrow(score, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double")


def quality_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = score_quality(documents, train(documents, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier does not reject, in one pass over their texts."""
    model, place = documents.sparkSession.sparkContext.broadcast(train(documents, labels)), documents.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                yield some.filter(pa.array(_scores(model.value, some.column(place).fill_null("")) >= threshold))
        release()

    return documents.mapInArrow(keep, documents.schema)
