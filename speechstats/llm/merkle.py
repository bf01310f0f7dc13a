"""A Merkle manifest of a table by time-forward processing: every leaf's proof without a tree in one place.

Leaves are digests of whole rows.  Within a source they ascend by doc_id; every ``FAN`` consecutive nodes of a level become
one node of the next until one is left, the subroot.  Subroots, by source, give the root in the same way.

Time-forward processing visits nodes in the order of their labels, and a node's digest travels to its parent through a
priority queue ordered by the receiver's label.  Here a label is (tree, block, node within the block): a block is the
subtree over ``FAN**LEVELS`` nodes.  Between blocks the queue is external: Spark's sorted shuffle delivers the top digest of
each block to the block above.  Within a block it is a heap, in which never more than ``FAN * LEVELS`` messages wait, since
a node's label follows that of the last leaf below it.  The reversed sweep visits labels in descending order, hands each
node's proof suffix (the siblings from there to the root) down to its children, and ends at the leaves.  A round lifts all
trees by ``LEVELS`` levels, so a billion leaves of one source take three; a task never holds more than a block.

Defined results: nulls are digested as ``-``; a null source is a source of its own and the first one; a null doc_id comes
first and is never tampered with; rows with one doc_id follow in the order of their digests, repeated rows are leaves of
their own.  A lone leaf is its subroot, a lone subroot the root; a node without siblings adds nothing to a proof, so the
proof of a table of one row is the digest of nothing.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ranks import placed
from .common import stored

FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS
#: What a node knows of the way up: the digests left and right of it, from its own level to the root.
_WAY = "tree string, place bigint, root string, subroot string, lefts array<string>, rights array<string>"
Step = tuple[bytes, bytes]


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """The digest of a row of documents with this text."""
    return F.sha2(F.concat(*map(_field, (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))), 256)


def _label(level: int, k: int) -> tuple[int, int, int]:
    """Of a block's k-th node of a level: behind its last leaf, and behind the nodes below it."""
    return (k + 1) * FAN**level, level, k


def sweep(leaves: list[bytes], levels: int) -> list[list[bytes]]:
    """The digests of every level of a block, the leaves first."""
    tree: list[list[bytes]] = [leaves, *([] for _ in range(levels))]
    queue: list[tuple[tuple[int, int, int], int, bytes]] = []

    def settle(now: int) -> None:
        while queue and queue[0][0][0] <= now:
            label, run = queue[0][0], []
            while queue and queue[0][0] == label:
                run.append(heappop(queue)[2])
            _, level, k = label
            tree[level].append(digest(b"".join(run)))
            if level < levels:
                heappush(queue, (_label(level + 1, k // FAN), k % FAN, tree[level][-1]))

    if levels:
        for i, leaf in enumerate(leaves):
            heappush(queue, (_label(1, i // FAN), i % FAN, leaf))
            settle(i + 1)
        settle(BLOCK)
    return tree


def ways_down(tree: list[list[bytes]], way: tuple[Step, ...]) -> Iterator[tuple[int, tuple[Step, ...]]]:
    """Each leaf of a block with its way to the root, last leaf first: the reversed sweep."""
    top = len(tree) - 1
    if not top:
        yield 0, way
        return
    queue = [((-BLOCK, -top, 0), way)]
    while queue:
        (_, level, k), way = heappop(queue)
        below = -level - 1
        first = -k * FAN
        run = tree[below][first : first + FAN]
        for p in range(len(run) - 1, -1, -1):
            own = ((b"".join(run[:p]), b"".join(run[p + 1 :])), *way)
            if below:
                last, _, child = _label(below, first + p)
                heappush(queue, ((-last, -below, -child), own))
            else:
                yield first + p, own


def fold(leaf: bytes, way: tuple[Step, ...]) -> bytes:
    """The root that a leaf and its proof give; a level without siblings is a run of one."""
    for left, right in way:
        leaf = digest(left + leaf + right)
    return leaf


def _levels(total: Column) -> Column:
    """How many levels a tree rises in a round."""
    rest = F.lit(0)
    for k in range(LEVELS):
        rest = rest + F.when(total > FAN**k, 1).otherwise(0)
    return rest.cast("int")


def _rise(nodes: DataFrame) -> DataFrame:
    """tree, place, digest, total: the nodes one round up; a tree of one node stays."""

    def top(block: pa.Table) -> pa.Table:
        tree, place, levels, total = (block.column(c)[0].as_py() for c in ("tree", "block", "levels", "total"))
        found = sweep([d.encode() for d in block.sort_by("place").column("digest").to_pylist()], levels)
        return pa.table({"tree": pa.array([tree], pa.string()), "place": [place], "digest": [found[-1][0].decode()], "total": [-(-total // FAN**levels)]})

    blocks = nodes.select("tree", F.floor(F.col("place") / BLOCK).alias("block"), "place", "digest", "total", _levels(F.col("total")).alias("levels"))
    return blocks.groupBy("tree", "block").applyInArrow(top, "tree string, place bigint, digest string, total bigint")


def _way(upper: pa.Table) -> tuple[Step, ...]:
    return tuple((a.encode(), b.encode()) for a, b in zip(upper.column("lefts")[0].as_py(), upper.column("rights")[0].as_py(), strict=True))


def _met(nodes: DataFrame, upper: DataFrame, each, schema: str) -> DataFrame:
    """``each(block, upper)`` for every block of ``nodes`` and the way of its top node."""
    blocks = nodes.withColumn("block", F.floor(F.col("place") / BLOCK)).withColumn("levels", _levels(F.col("total")))
    above = upper.withColumn("block", F.col("place"))
    return blocks.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(each, schema)


def _sorted(block: pa.Table) -> tuple[pa.Table, list[list[bytes]]]:
    block = block.sort_by("place")
    return block, sweep([d.encode() for d in block.column("digest").to_pylist()], block.column("levels")[0].as_py())


def _lower(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """The ways of ``nodes`` from those of the nodes one round up."""

    def ways(block: pa.Table, above: pa.Table) -> pa.Table:
        block, tree = _sorted(block)
        n, found = len(block), dict(ways_down(tree, _way(above)))
        same = lambda c: pa.array([above.column(c)[0].as_py()] * n, pa.string())
        steps = [[[s[k].decode() for s in found[i]] for i in range(n)] for k in (0, 1)]
        own = block.column("digest") if "own" in block.column_names else same("subroot")
        name = block.column("own") if "own" in block.column_names else block.column("tree")
        place = block.column("place") if "own" not in block.column_names else pa.array([0] * n, pa.int64())
        return pa.table({"tree": name, "place": place, "root": same("root"), "subroot": own, "lefts": pa.array(steps[0], pa.list_(pa.string())), "rights": pa.array(steps[1], pa.list_(pa.string()))})

    return _met(nodes, upper, ways, _WAY)


def _stack(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The nodes of every round, up to one for each tree."""
    most = nodes.agg(F.max("total")).first()[0] or 0
    out = [nodes]
    while most > 1 or len(out) == 1:
        out.append(stored(_rise(out[-1].select("tree", "place", "digest", "total")), name))
        most = -(-most // BLOCK)
    return out


def manifest(documents: DataFrame, tampered: Column | None = None, proofs: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    ``tampered`` is the text that a row is verified with, null for the original (all by default): folded_root is what that
    row's leaf and the original siblings give, verified whether it is the root.  With ``proofs`` the siblings follow as
    proof, array<struct<left, right>> from the leaf's level to the root, each level's digests one after another.
    """
    other = leaf_digest(tampered) if tampered is not None else F.lit(None).cast("string")
    rows = documents.select("doc_id", F.col("source").alias("tree"), leaf_digest(F.col("text")).alias("digest"), F.when(tampered.isNotNull() if tampered is not None else F.lit(False), other).alias("other"))
    rows = stored(rows, "digests")  # placing looks at rows twice: texts are read and digested once
    rounds = _stack(placed(rows, ["tree"], [F.col("doc_id").asc_nulls_first(), F.col("digest")], "leaves"), "nodes")

    subroots = rounds[-1].select(F.col("tree").alias("own"), "digest")
    tops = placed(subroots, [], [F.col("own").asc_nulls_first()], "subroots").withColumn("tree", F.lit(""))
    above = _stack(tops, "sources")
    nothing = F.expr("cast(array() as array<string>)")
    upper = above[-1].select("tree", "place", F.col("digest").alias("root"), F.lit(None).cast("string").alias("subroot"), nothing.alias("lefts"), nothing.alias("rights"))
    for nodes in reversed(above[:-1]):
        upper = stored(_lower(nodes, upper), "ways")
    for nodes in reversed(rounds[1:-1]):
        upper = stored(_lower(nodes, upper), "ways")

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if proofs:
        schema += ", proof array<struct<left: string, right: string>>"

    def verify(block: pa.Table, up: pa.Table) -> pa.Table:
        block, tree = _sorted(block)
        subroot, root = (up.column(c)[0].as_py() for c in ("subroot", "root"))
        n, others = len(block), block.column("other").to_pylist()
        way = _way(up)
        ends: dict[int, bytes] = {}  # siblings from the second level up, once for each run
        proof, folded, full = [""] * n, [""] * n, [None] * n
        for i, steps in ways_down(tree, way):
            if i // FAN not in ends:
                ends[i // FAN] = b"".join(a + b for a, b in steps[1:])
            proof[i] = digest((steps[0][0] + steps[0][1] if steps else b"") + ends[i // FAN]).decode()
            folded[i] = fold(others[i].encode() if others[i] is not None else tree[0][i], steps).decode()
            if proofs:
                full[i] = [{"left": a.decode(), "right": b.decode()} for a, b in steps]
        out = {"doc_id": block.column("doc_id"), "leaf": block.column("digest"), "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proof, "folded_root": folded, "verified": [f == root for f in folded]}
        return pa.table(out | ({"proof": full} if proofs else {}))

    return _met(rounds[0], upper, verify, schema)


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case, other letters as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def tampered_fifth() -> Column:
    """Lower-cased texts of the rows whose crc32(decimal doc_id) is divisible by 5; null for the others."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lowered(F.col("text")))
