"""Isolation forest: one task a tree for building, one pass over the rows for scoring.

A tree sees a bounded sample (``rows_per_tree``), drawn by a hash of seed, tree
and row id, so the tree tasks don't grow with the data. The forest is a table of
nodes; its size is bounded by trees and rows a tree, and scoring broadcasts it.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import path_normaliser_py
from ..lineage import dropped, renamed
from .columns import unpivoted

NODE = "tree int, node int, is_leaf boolean, feature int, threshold double, child int, size int, depth int"


@dataclass
class ForestConfig:
    trees: int = 100
    max_samples: float = 256
    max_depth: int = 0  # 0: ceil(log2(rows a tree))
    bootstrap: bool = False
    max_features: float = 1.0
    continuous: bool = False  # cuts anywhere between the least and the largest value instead of at a value
    seed: int = 42
    most_nodes: int = 1 << 20


def rows_per_tree(n: int, max_samples: float) -> int:
    """A ratio up to 1 is a share of the rows, more is their number; at most all, at least one."""
    return max(1, min(n, math.ceil(n * max_samples) if max_samples <= 1 else math.ceil(max_samples)))


def tree_samples(df: DataFrame, row_id: str, names: list[str], cfg: ForestConfig, n: int) -> DataFrame:
    """(tree, features): each tree's sample. Without replacement: the rows with the smallest draws of the tree; a first cut at a draw that leaves a few times too many keeps the sort small."""
    size = rows_per_tree(n, cfg.max_samples)
    trees = F.explode(F.sequence(F.lit(0), F.lit(cfg.trees - 1))).alias("tree")
    vec = F.array(*[F.col(c).cast("double") for c in names])
    rows = df.select(F.col(row_id).alias("_id"), vec.alias("features"))
    draw = F.pmod(F.xxhash64(F.lit(cfg.seed), "tree", "_id"), F.lit(1 << 40)) / float(1 << 40)
    if cfg.bootstrap:
        # how often a row is drawn follows a Poisson law with the mean size / n
        mean, u = size / max(n, 1), draw
        probs, p, cum = [], math.exp(-mean), 0.0
        for k in range(1, 16):
            cum += p
            probs.append(cum)
            p *= mean / k
        times = sum((u >= c).cast("int") for c in probs)
        return rows.select("*", trees).select("tree", "_id", "features", F.explode(F.array_repeat("_id", times)).alias("_again")).select("tree", "_id", "features")
    most = min(1.0, (size + 6 * math.sqrt(size) + 20) / max(n, 1))
    some = rows.select("*", trees).withColumn("draw", draw).filter(F.col("draw") <= most)
    from pyspark.sql.window import Window

    w = Window.partitionBy("tree").orderBy("draw", "_id")
    return some.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= size).select("tree", "_id", "features")


def build_tree(x: np.ndarray, rng: np.random.Generator, max_depth: int, cfg: ForestConfig) -> list[tuple]:
    """Nodes (node, is_leaf, feature, threshold, child, size, depth) breadth first; the right child is behind the left one.

    A node is a leaf with one row, at the depth limit, if no feature of up to
    max(8, 2F) draws has two values, or if the node budget is used up.
    """
    features = x.shape[1]
    allowed = rng.permutation(features)[: max(1, round(cfg.max_features * features))] if cfg.max_features < 1 else np.arange(features)
    nodes: list[list] = [[0, True, -1, 0.0, -1, len(x), 0]]
    queue = [(0, np.arange(len(x)))]
    for at, rows in queue:  # grows while it is read
        depth = nodes[at][6]
        if len(rows) <= 1 or depth >= max_depth or len(nodes) + 2 > cfg.most_nodes:
            continue
        for _ in range(max(8, 2 * features)):
            f = int(allowed[rng.integers(len(allowed))])
            v = x[rows, f]
            if cfg.continuous:
                lo, hi = v.min(), v.max()
                cut = float(rng.uniform(lo, hi)) if hi > lo else None
            else:
                seen = np.unique(v)
                cut = float(seen[rng.integers(len(seen) - 1)]) if len(seen) > 1 else None
            if cut is not None:
                left = v <= cut
                if left.any() and not left.all():
                    break
        else:
            continue
        child = len(nodes)
        nodes[at][1:5] = [False, f, cut, child]
        for part in (rows[left], rows[~left]):
            nodes.append([len(nodes), True, -1, 0.0, -1, len(part), depth + 1])
            queue.append((len(nodes) - 1, part))
    return [tuple(n) for n in nodes]


def fit_forest(df: DataFrame, row_id: str, names: list[str], cfg: ForestConfig = ForestConfig()) -> Forest:  # noqa: B008
    n = df.count()
    size = rows_per_tree(n, cfg.max_samples)
    depth = cfg.max_depth or max(1, math.ceil(math.log2(max(size, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf.tree.iloc[0])
        x = np.stack(pdf.sort_values("_id").features.to_numpy())
        nodes = build_tree(x, np.random.default_rng([cfg.seed, tree]), depth, cfg)
        return pd.DataFrame([(tree, *n) for n in nodes], columns=[c.split()[0] for c in NODE.split(", ")])

    nodes = tree_samples(df, row_id, names, cfg, n).groupBy("tree").applyInPandas(grow, NODE)
    return Forest(names, size, nodes.orderBy("tree", "node").toPandas())


@dataclass
class Forest:
    """A fitted forest; ``nodes`` has at most trees * 2 * rows_per_tree rows."""

    features: list[str]
    rows_per_tree: int
    nodes: pd.DataFrame
    threshold: float | None = None
    meta: dict = field(default_factory=dict)

    def save(self, spark: SparkSession, path: str) -> None:
        """One Parquet table of nodes, each with the parameters and a checksum of all nodes, written beside ``path`` and moved there in one step."""
        text = json.dumps({"features": self.features, "rows_per_tree": self.rows_per_tree, "threshold": self.threshold, "checksum": self.checksum()}, sort_keys=True)
        new = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
        spark.createDataFrame(self.nodes).withColumn("_meta", F.lit(text)).coalesce(1).write.parquet(new)
        dropped(spark, path)
        renamed(spark, new, path)

    def checksum(self) -> str:
        n = self.nodes.sort_values(["tree", "node"])
        return hashlib.sha256("\n".join(map(repr, n[[c.split()[0] for c in NODE.split(", ")]].astype({"threshold": float, "is_leaf": bool}).to_numpy().tolist())).encode()).hexdigest()

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        """The forest; ValueError if its nodes are not those that were saved."""
        nodes = spark.read.parquet(path).orderBy("tree", "node").toPandas()
        m = json.loads(nodes._meta.iloc[0])
        out = Forest(m["features"], m["rows_per_tree"], nodes.drop(columns="_meta"), m["threshold"])
        if out.checksum() != m["checksum"]:
            raise ValueError(f"{path} is damaged")
        return out

    def arrays(self) -> tuple[np.ndarray, ...]:
        """All trees in one set of arrays, child places counted over all trees."""
        n = self.nodes
        first = n.groupby("tree").node.transform("size").groupby(n.tree).first().cumsum().shift(fill_value=0)
        base = n.tree.map(first).to_numpy()
        leaf = n.is_leaf.to_numpy()
        child = np.where(leaf, np.arange(len(n)), n.child.to_numpy() + base)
        path = n.depth.to_numpy() + np.array([path_normaliser_py(s) for s in n["size"]])
        return first.to_numpy(), np.where(leaf, 0, n.feature.to_numpy()), np.where(leaf, np.inf, n.threshold.to_numpy()), child, path, leaf

    def mean_path(self, x: np.ndarray) -> np.ndarray:
        roots, feature, threshold, child, path, leaf = self._arrays
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for r in roots:
            at = np.full(len(x), r)
            live = rows[~leaf[at]]
            while len(live):
                here = at[live]
                at[live] = child[here] + (x[live, feature[here]] > threshold[here])
                live = live[~leaf[at[live]]]
            total += path[at]
        return total / max(len(roots), 1)

    @property
    def _arrays(self):
        if "_cached" not in self.__dict__:
            self.__dict__["_cached"] = self.arrays()
        return self.__dict__["_cached"]

    def scores(self, x: np.ndarray) -> np.ndarray:
        c = path_normaliser_py(self.rows_per_tree)
        return np.zeros(len(x)) if c <= 0 else -np.power(2.0, -self.mean_path(x) / c)


def scored(df: DataFrame, forest: Forest, row_id: str, offset: float = 0.0) -> DataFrame:
    """(row id, score, is_anomaly): low scores are anomalous; ``is_anomaly`` is null without a threshold."""
    held = df.sparkSession.sparkContext.broadcast(forest)
    names = forest.features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(names))]) if b.num_rows else np.zeros((0, len(names)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.scores(np.nan_to_num(x)) - offset)], names=[row_id, "score"])

    kind = df.schema[row_id].dataType.simpleString()
    out = df.select(row_id, *[F.col(c).cast("double") for c in names]).mapInArrow(run, f"{row_id} {kind}, score double")
    flag = F.lit(None).cast("boolean") if forest.threshold is None else F.col("score") < forest.threshold
    return out.withColumn("is_anomaly", flag)


def calibrated_forest(train: DataFrame, valid: DataFrame, row_id: str, names: list[str], positive: str, cfg: ForestConfig = ForestConfig(), fpr: float = 0.05, strategy: str = "tpr") -> Forest:  # noqa: B008
    """Fit on ``train`` and set the threshold by a rule on ``valid``, which has the boolean column ``positive``."""
    from .threshold import choose_threshold

    forest = fit_forest(train, row_id, names, cfg)
    s = scored(valid, forest, row_id).join(valid.select(row_id, positive), row_id)
    forest.threshold = float(choose_threshold(s, "score", F.col(positive), strategy, fpr).first().threshold)
    return forest


def forest_shape(nodes: DataFrame) -> DataFrame:
    """One row: trees, nodes, leaves, their means a tree, the largest depth and leaf, and the bits a packed node needs."""
    per = nodes.groupBy("tree").agg(F.count("*").alias("n"), F.count_if("is_leaf").alias("leaves"), F.max("depth").alias("depth"), F.max(F.when(F.col("is_leaf"), F.col("size"))).alias("leaf_rows"), F.max("feature").alias("feature"))
    bits = lambda c: F.length(F.bin(F.greatest(F.max(c), F.lit(1))))
    return per.agg(
        F.count("*").alias("trees"), F.sum("n").alias("nodes"), F.avg("n").alias("mean_nodes"), F.sum("leaves").alias("leaves"), F.avg("leaves").alias("mean_leaves"), F.avg("depth").alias("mean_depth"), F.max("depth").alias("max_depth"), F.max("leaf_rows").alias("largest_leaf"),
        (bits("feature") + bits("n") + bits("leaf_rows") + bits("depth") + 1).alias("node_bits"),
    )


def raw_inference(df: DataFrame, forest: Forest, row_id: str, log_features: list[str], means: dict[str, float], scales: dict[str, float], quantizer=None) -> DataFrame:
    """Raw features to decisions: log transform, scaling, quantization, score."""
    from ..functions.scalar import log1p_abs, standardise
    from .quantize import quantized

    out = df.withColumns({c: standardise(log1p_abs(F.col(c).cast("double")) if c in log_features else F.col(c).cast("double"), means[c], scales[c]) for c in forest.features})
    return scored(quantized(out, quantizer) if quantizer else out, forest, row_id)


def fit_scaler(df: DataFrame, names: list[str], log_features: list[str] = ()) -> tuple[dict[str, float], dict[str, float]]:
    """Mean and population deviation (1 where it is 0) of each feature after its log transform."""
    from ..functions.scalar import log1p_abs

    long = unpivoted(df.withColumns({c: log1p_abs(F.col(c).cast("double")) for c in log_features}) if log_features else df, names)
    rows = long.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).collect()  # a row a feature
    return {r.feature: r.m for r in rows}, {r.feature: r.s or 1.0 for r in rows}
