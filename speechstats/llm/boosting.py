"""Gradient-boosted trees fitted by Spark ML and applied as plain column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A tree is a number (leaf) or (feature, threshold, left, right); left holds values up to the threshold.
Tree = float | tuple


def fit(sample: DataFrame, features: list[str], label: str, trees: int = 12, depth: int = 4, seed: int = 11, step: float = 0.3, weight: str | None = None, bins: int = 64) -> list[tuple[float, Tree]] | None:
    """Weighted trees; None if the sample does not hold both labels.

    ``weight`` names a column of row weights.  Spark ML finds the places to split at on max(10,000, ``bins`` squared) rows.
    """
    own = F.col(weight) if weight else F.lit(1.0)
    rows = VectorAssembler(inputCols=features, outputCol="__features").transform(sample).select("__features", F.col(label).cast("double").alias("__label"), own.alias("__weight")).cache()
    try:
        if rows.select("__label").distinct().count() < 2:
            return None
        model = GBTClassifier(featuresCol="__features", labelCol="__label", weightCol="__weight", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed, maxBins=bins).fit(rows)
    finally:
        rows.unpersist()
    return [(w, _read(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees, strict=True)]


def _read(node) -> Tree:
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return (int(split.featureIndex()), float(split.threshold()), _read(node.leftChild()), _read(node.rightChild()))


def probability(trees: list[tuple[float, Tree]], feature: Callable[[int], Column]) -> Column:
    """The ensemble's probability of label 1; ``feature`` gives the column of a feature's number."""

    def column(tree: Tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        k, at, left, right = tree
        return F.when(feature(k) <= at, column(left)).otherwise(column(right))

    margin = F.lit(0.0)
    for w, tree in trees:
        margin = margin + F.lit(w) * column(tree)
    return 1 / (1 + F.exp(-2 * margin))
