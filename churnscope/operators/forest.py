"""Decision forests as native expressions.

A forest is a handful of arrays (split feature, threshold, children, class
shares), read from a fitted model or written by hand.  It compiles to plain
conditions over columns, once for Spark and once as SQL text, so scoring needs
no vectors and no model object on the executors, and every engine gives the
same doubles: the shares of the trees are added in tree order.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.session import checkpoint_dir

LEAF = -1
NODE_SCHEMA = ("tree int, node int, feature int, threshold double, below int, above int, kept double, churned double")


@dataclass(frozen=True)
class Tree:
    """Arrays by node; node 0 is the root.  ``feature`` is ``LEAF`` at leaves;
    ``kept`` and ``churned`` are a leaf's shares of the two classes."""

    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    below: tuple[int, ...]
    above: tuple[int, ...]
    kept: tuple[float, ...]
    churned: tuple[float, ...]

    def leaf_of(self, values: Mapping[int, float]) -> int:
        """The leaf a plain record falls into."""
        node = 0
        while self.feature[node] != LEAF:
            node = self.below[node] if values[self.feature[node]] <= self.threshold[node] else self.above[node]
        return node


@dataclass(frozen=True)
class Forest:
    features: tuple[str, ...]
    trees: tuple[Tree, ...]

    def thresholds(self, feature: str) -> list[float]:
        """Every value at which a tree splits on the feature, ascending.  Between
        two of them the probability does not depend on the feature."""
        at = self.features.index(feature)
        return sorted({t.threshold[i] for t in self.trees for i, f in enumerate(t.feature) if f == at})

    def probability(self, record: Mapping[str, float]) -> float:
        """Class-1 probability of one plain record (for tests and small looks)."""
        values = {i: record[f] for i, f in enumerate(self.features)}
        leaves = [(t, t.leaf_of(values)) for t in self.trees]
        kept = churned = 0.0
        for t, leaf in leaves:
            kept, churned = kept + t.kept[leaf], churned + t.churned[leaf]
        return churned / (kept + churned)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The forest as a table of nodes (``trees x 2^depth`` rows at most)."""
        rows = [(k, i, t.feature[i], t.threshold[i], t.below[i], t.above[i], t.kept[i], t.churned[i])
                for k, t in enumerate(self.trees) for i in range(len(t.feature))]
        return spark.createDataFrame(rows, NODE_SCHEMA)


def grow(nested: Iterable, features: tuple[str, ...]) -> Forest:
    """A forest written by hand: a leaf is ``(kept, churned)`` row counts, a
    split is ``(feature, threshold, at most, above)``."""
    def lay(tree, out):
        me = len(out)
        out.append(None)
        if len(tree) == 2:
            n = float(sum(tree))
            out[me] = (LEAF, 0.0, LEAF, LEAF, tree[0] / n, tree[1] / n)
        else:
            feature, threshold, low, high = tree
            below, above = lay(low, out), lay(high, out)
            out[me] = (features.index(feature), float(threshold), below, above, 0.0, 0.0)
        return me

    trees = []
    for tree in nested:
        out: list = []
        lay(tree, out)
        trees.append(Tree(*(tuple(column) for column in zip(*out))))
    return Forest(tuple(features), tuple(trees))


def from_nodes(nodes: DataFrame, features: Iterable[str]) -> Forest:
    """Read a table of nodes back; a model's nodes fit the driver by construction."""
    by_tree: dict[int, dict[int, tuple]] = {}
    for r in nodes.select(*[c.split()[0] for c in NODE_SCHEMA.split(", ")]).collect():
        by_tree.setdefault(r.tree, {})[r.node] = tuple(r)[2:]
    trees = []
    for k in sorted(by_tree):
        rows = [by_tree[k][i] for i in range(len(by_tree[k]))]
        trees.append(Tree(*(tuple(column) for column in zip(*rows))))
    return Forest(tuple(features), tuple(trees))


def from_model(model: RandomForestClassificationModel, features: Iterable[str]) -> Forest:
    """The arrays of a fitted binary forest, from its saved node table.

    A leaf's shares are its class counts over their sum, as the model votes.
    A model that saw one class only counts the other as none."""
    spark = SparkSession.active()
    path = os.path.join(checkpoint_dir(spark), "forests", uuid.uuid4().hex)
    model.save(path)
    n = F.col("nodeData")
    stats = F.col("nodeData.impurityStats")
    total = F.aggregate(stats, F.lit(0.0), lambda a, v: a + v)
    leaf = n["leftChild"] < 0
    share = lambda i: F.when(leaf, F.coalesce(F.get(stats, F.lit(i)), F.lit(0.0)) / total).otherwise(F.lit(0.0))
    nodes = spark.read.parquet(os.path.join(path, "data")).select(
        F.col("treeID").alias("tree"), n["id"].alias("node"),
        F.when(leaf, F.lit(LEAF)).otherwise(n["split"]["featureIndex"]).alias("feature"),
        F.coalesce(F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)), F.lit(0.0)).alias("threshold"),
        n["leftChild"].alias("below"), n["rightChild"].alias("above"),
        share(0).alias("kept"), share(1).alias("churned"))
    return from_nodes(nodes, features)


def leaf_column(tree: Tree, of: Callable[[int], Column], node: int = 0) -> Column:
    """Number of the tree's leaf that a row falls into, as nested conditions."""
    if tree.feature[node] == LEAF:
        return F.lit(node)
    return F.when(of(tree.feature[node]) <= F.lit(tree.threshold[node]), leaf_column(tree, of, tree.below[node])).otherwise(
        leaf_column(tree, of, tree.above[node]))


def with_probability(df: DataFrame, forest: Forest, inputs: Mapping[str, Column], name: str = "churn_probability") -> DataFrame:
    """Add the class-1 probability of every row.

    ``inputs`` gives each feature's column as a double.  The leaf of each tree
    is staged in its own projection, then two lookups per tree add up the
    shares.  Rows are scored where they are: no shuffle, no Python, no vector."""
    staged = df.withColumns({f"_x{i}": inputs[f].cast("double") for i, f in enumerate(forest.features)})
    staged = staged.withColumns({f"_leaf{k}": leaf_column(t, lambda i: F.col(f"_x{i}")) for k, t in enumerate(forest.trees)})

    def total(side: str) -> Column:
        out = F.lit(0.0)
        for k, t in enumerate(forest.trees):
            out = out + F.get(F.array(*[F.lit(v) for v in getattr(t, side)]), F.col(f"_leaf{k}"))
        return out

    staged = staged.withColumns({"_kept": total("kept"), "_churned": total("churned")})
    return staged.withColumn(name, F.col("_churned") / (F.col("_kept") + F.col("_churned"))).drop(
        "_kept", "_churned", *[f"_x{i}" for i in range(len(forest.features))], *[f"_leaf{k}" for k in range(len(forest.trees))])


def _sql_double(v: float) -> str:
    text = repr(float(v))
    return text if "e" in text else text + "e0"


def probability_sql(forest: Forest, inputs: Mapping[str, str]) -> str:
    """The same probability as SQL text; ``inputs`` gives each feature's expression."""
    def walk(tree: Tree, side: str, node: int = 0) -> str:
        if tree.feature[node] == LEAF:
            return _sql_double(getattr(tree, side)[node])
        test = f"{inputs[forest.features[tree.feature[node]]]} <= {_sql_double(tree.threshold[node])}"
        return f"CASE WHEN {test} THEN {walk(tree, side, tree.below[node])} ELSE {walk(tree, side, tree.above[node])} END"

    kept, churned = ("(" + " + ".join(f"({walk(t, side)})" for t in forest.trees) + ")" for side in ("kept", "churned"))
    return f"({churned} / ({kept} + {churned}))"
