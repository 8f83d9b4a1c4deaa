"""Random forest and gradient-boosted trees on quantized features.

Split search is by histogram. Sums a (node, feature, bin) are a grouped
aggregate with map-side combination, so a level of a tree is one pass over the
rows and only histograms are shuffled; the tables of splits are as small as the
tree. Random-forest trees are grown on bounded samples, one task a tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import written
from .columns import unpivoted
from .metrics import averaged_report, label_counts, majority_vote
from .splits import kfold, stratified_parts

RF_NODE = "tree int, node int, is_leaf boolean, feature int, threshold int, child int, label int, depth int"


def class_histogram(df: DataFrame, names: list[str], label: str) -> DataFrame:
    """(feature, bin, label, n)."""
    return unpivoted(df, names, [label]).groupBy("feature", F.col("value").cast("long").alias("bin"), label).agg(F.count("*").alias("n"))


def _impurity(kind: str, counts: list[str], total: str):
    p = [F.col(c) / F.col(total) for c in counts]
    if kind == "gini":
        return 1 - sum((x * x for x in p), F.lit(0.0))
    return sum((F.when(x > 0, -x * F.log2(F.when(x > 0, x).otherwise(1.0))).otherwise(0.0) for x in p), F.lit(0.0))


def split_gains(df: DataFrame, names: list[str], label: str, labels: list, kind: str = "gini", keys: list[str] | None = None, min_leaf: int = 1) -> DataFrame:
    """(keys, feature, bin, gain, n): the impurity that a split ``value <= bin`` takes away in each group of ``keys``, for every bin but the last of each feature, and the group's rows."""
    part = [*(keys or []), "feature"]
    cells = unpivoted(df, names, [*(keys or []), label]).groupBy(*part, F.col("value").cast("long").alias("bin")).agg(*[F.count_if(F.col(label) == v).alias(f"c{i}") for i, v in enumerate(labels)])
    run, whole = Window.partitionBy(*part).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*part)
    k = range(len(labels))
    x = cells.select(*part, "bin", *[F.sum(f"c{i}").over(run).alias(f"l{i}") for i in k], *[F.sum(f"c{i}").over(whole).alias(f"t{i}") for i in k])
    x = x.select("*", *[(F.col(f"t{i}") - F.col(f"l{i}")).alias(f"r{i}") for i in k])
    x = x.withColumns({"nl": sum((F.col(f"l{i}") for i in k), F.lit(0)), "nr": sum((F.col(f"r{i}") for i in k), F.lit(0)), "n": sum((F.col(f"t{i}") for i in k), F.lit(0))}).filter((F.col("nl") >= max(min_leaf, 1)) & (F.col("nr") >= max(min_leaf, 1)))
    gain = _impurity(kind, [f"t{i}" for i in k], "n") - F.col("nl") / F.col("n") * _impurity(kind, [f"l{i}" for i in k], "nl") - F.col("nr") / F.col("n") * _impurity(kind, [f"r{i}" for i in k], "nr")
    return x.select(*part, "bin", gain.alias("gain"), "n")


def best_split(gains: DataFrame) -> DataFrame:
    """The split of largest gain; of equal ones the first by feature and bin."""
    return gains.orderBy(F.desc("gain"), "feature", "bin").limit(1)


@dataclass
class RandomForestConfig:
    trees: int = 20
    max_depth: int = 8
    min_split: int = 2
    min_leaf: int = 1
    criterion: str = "gini"
    impurity_threshold: float = 0.0
    sample_ratio: float = 1.0
    bootstrap: bool = True
    most_rows: int = 20_000  # rows a tree is grown on at most
    seed: int = 42


def with_criterion(cfg: RandomForestConfig, criterion: str) -> RandomForestConfig:
    """Change the criterion and its threshold: a quarter for gini, four times but at most 0.25 for entropy."""
    if criterion == cfg.criterion:
        return cfg
    t = cfg.impurity_threshold / 4 if criterion == "gini" else min(cfg.impurity_threshold * 4, 0.25)
    return replace(cfg, criterion=criterion, impurity_threshold=t)


def single_tree(cfg: RandomForestConfig) -> RandomForestConfig:
    """One tree on all rows and features: see :func:`fit_single_tree`."""
    return replace(cfg, trees=1, bootstrap=False, sample_ratio=1.0)


#: Bounds of the rarest class and the shares (train, test, validation) from there on; fixed values.
SHARES = ((750, (0.8, 0.1, 0.1)), (150, (0.7, 0.15, 0.15)), (-1, (0.6, 0.2, 0.2)))
#: Metric above an imbalance (all rows to those of the rarest class); fixed values.
METRICS = ((10.0, "recall"), (3.0, "f1_score"), (1.5, "precision"), (0.0, "accuracy"))


def _within(x: float, lo: float, hi: float) -> float:
    return max(lo, min(hi, x))


def split_ratios(rarest: int, scoring: str, test: bool = True) -> dict[str, float]:
    """Shares of the parts by the rarest class; without validation or test rows theirs go to training. They add up to 1."""
    train, held, valid = next(shares for least, shares in SHARES if rarest > least)
    if scoring != "validation":
        train, valid = train + valid, 0.0
    if not test:
        train, held = train + held, 0.0
    total = train + held + valid
    return {"train": train / total, "test": held / total, "valid": valid / total}


def impurity_threshold(counts: dict, features: int, criterion: str = "gini") -> float:
    """Least gain of a split: smaller for many rows and rare classes, larger for many features. The factors are fixed values."""
    rows, k = sum(counts.values()), max(len(counts), 2)
    even = 100.0 / k
    rare = 100.0 * min(counts.values(), default=0) / max(rows, 1)
    size = _within(1.0 / (1.0 + max(0.0, math.log2(max(rows, 2)) - 10.0) / 2.5), 0.25, 1.15)
    balance = 1.0 - 0.5 * min(1.0, max(0.0, even - rare) / even)
    width = 0.9 + 0.1 * min(1.0, math.log2(max(features, 2)) / 8.0)
    base, lo, hi = (0.003 * (1.0 - 1.0 / k), 0.0003, 0.02) if criterion == "gini" else (0.02 * math.log2(k), 0.002, 0.2)
    return _within(base * size * balance * width, lo, hi)


def search_ranges(counts: dict, features: int) -> dict[str, tuple[int, int]]:
    """(least, most) of min_split, min_leaf and max_depth. The factors are fixed values."""
    rows, k = max(sum(counts.values()), 1), max(len(counts), 1)
    split = min(16, 8, int(math.log2(rows) / 4 + features / 25.0))
    split = split if split > 2 else 6
    density = _within(rows / k / 600.0, 0.3, 3.0)
    even, rare = 100.0 / k, 100.0 * min(counts.values(), default=0) / rows
    balance = 1.0 - min(0.5, max(0.0, even - rare) / even)
    low = _within(0.12 + 0.05 * density * balance, 0.1, 0.35)
    high = min(max(low + 0.12 + 0.04 * density, low + 0.1), 0.6)
    cap = max(split - 1, 1)
    least = int(_within(math.floor(2 * low), 1, cap))
    deepest = max(8, int(math.log2(rows) + math.log2(max(features, 1))) + 1)
    shallow = deepest - 6 if deepest > 18 else deepest - 4 if deepest > 12 else deepest - 2 if deepest > 8 else 4
    return {"min_split": (2, split), "min_leaf": (least, max(min(math.ceil(split * high), cap), least)), "max_depth": (shallow, deepest)}


def auto_config(counts: dict, features: int, criterion: str = "gini", test: bool = True) -> dict:
    """Settings from the rows of each class and the number of features."""
    rows, rarest = sum(counts.values()), min(counts.values(), default=0)
    imbalance = rows / rarest if rarest else math.inf
    per_label = rows // max(len(counts), 1)
    scoring = "kfold" if per_label < 200 else "oob" if per_label < 500 else "validation"
    ranges = search_ranges(counts, features)
    return {
        "metric": next(m for least, m in METRICS if imbalance > least), "scoring": scoring, **split_ratios(rarest, scoring, test), "ranges": ranges,
        "min_split": ranges["min_split"][0], "min_leaf": ranges["min_leaf"][0], "max_depth": ranges["max_depth"][1], "impurity_threshold": impurity_threshold(counts, features, criterion),
    }


def grow_tree(x: np.ndarray, y: np.ndarray, classes: int, rng: np.random.Generator, cfg: RandomForestConfig) -> list[tuple]:
    """Nodes (node, is_leaf, feature, threshold, child, label, depth) breadth first, by histogram search over all bins."""
    n, features = x.shape
    take = features if cfg.trees == 1 else max(1, math.isqrt(features))
    bins = int(x.max(initial=0)) + 1

    def impurity(c: np.ndarray) -> np.ndarray:
        p = c / np.maximum(c.sum(-1, keepdims=True), 1)
        if cfg.criterion == "gini":
            return 1 - (p * p).sum(-1)
        return -(p * np.log2(np.where(p > 0, p, 1))).sum(-1)

    nodes: list[list] = [[0, True, -1, 0, -1, 0, 0]]
    queue = [(0, np.arange(n))]
    for at, rows in queue:  # grows while it is read
        count = np.bincount(y[rows], minlength=classes)
        nodes[at][5] = int(count.argmax())
        depth = nodes[at][6]
        if (count > 0).sum() <= 1 or len(rows) < cfg.min_split or depth >= cfg.max_depth - 1:
            continue
        best = (0.0, -1, -1)
        for f in np.sort(rng.choice(features, take, replace=False)):
            hist = np.bincount(x[rows, f] * classes + y[rows], minlength=bins * classes).reshape(bins, classes)
            left = hist.cumsum(0)[:-1]
            right = count - left
            nl, nr = left.sum(1), right.sum(1)
            ok = (nl >= max(cfg.min_leaf, 1)) & (nr >= max(cfg.min_leaf, 1))
            if ok.any():
                gain = np.where(ok, impurity(count[None])[0] - (nl * impurity(left) + nr * impurity(right)) / len(rows), -1)
                b = int(gain.argmax())
                if gain[b] > best[0] + 1e-15:
                    best = (float(gain[b]), int(f), b)
        if best[1] < 0 or best[0] <= max(1e-4, cfg.impurity_threshold / (1 + math.log2(len(rows) + 1))):
            continue
        left = x[rows, best[1]] <= best[2]
        child = len(nodes)
        nodes[at][1:5] = [False, best[1], best[2], child]
        for part in (rows[left], rows[~left]):
            nodes.append([len(nodes), True, -1, 0, -1, 0, depth + 1])
            queue.append((len(nodes) - 1, part))
    return [tuple(v) for v in nodes]


@dataclass
class RandomForest:
    features: list[str]
    labels: list
    nodes: pd.DataFrame
    cfg: RandomForestConfig = field(default_factory=RandomForestConfig)
    again: dict[int, int] = field(default_factory=dict)  # trees that were drawn anew

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Label number of every row (rows) by every tree (columns)."""
        out = []
        for _, t in self.nodes.groupby("tree", sort=True):
            leaf, f, cut, child, label = (t[c].to_numpy() for c in ("is_leaf", "feature", "threshold", "child", "label"))
            at = np.zeros(len(x), np.int64)
            live = np.flatnonzero(~leaf[at])
            while len(live):
                here = at[live]
                at[live] = child[here] + (x[live, f[here]] > cut[here])
                live = live[~leaf[at[live]]]
            out.append(label[at])
        return np.stack(out, axis=1) if out else np.zeros((len(x), 0), np.int64)


def _draws(cfg: RandomForestConfig, key: str, n: int, again: dict[int, int] | None = None):
    """How often a row is in a tree's sample: Poisson, or once by a share; a function of seed, tree and row id alone. ``again``: how often a tree was drawn anew."""
    share = min(cfg.sample_ratio, cfg.most_rows / max(n, 1), 1.0)
    nonce = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in again.items() for v in kv]), F.col("tree")), F.lit(0)) if again else F.lit(0)
    u = F.pmod(F.xxhash64(F.lit(cfg.seed) + nonce * 1_000_003, "tree", F.col(key)), F.lit(1 << 40)) / float(1 << 40)
    if not cfg.bootstrap:
        return (u < share).cast("int")
    p, cum, steps = math.exp(-share), 0.0, []
    for k in range(1, 12):
        cum += p
        steps.append(cum)
        p *= share / k
    return F.least(sum((u >= c).cast("int") for c in steps), F.lit(7))


def _numbers(labels: list):
    """A label's place in the list, as an expression."""
    return F.create_map(*[F.lit(v) for i, lab in enumerate(labels) for v in (lab, i)])


def _labels(df: DataFrame, label: str) -> list:
    return [r[0] for r in df.select(label).filter(F.col(label).isNotNull()).distinct().orderBy(label).collect()]  # a row a class


def fit_random_forest(df: DataFrame, row_id: str, names: list[str], label: str, cfg: RandomForestConfig = RandomForestConfig()) -> RandomForest:  # noqa: B008
    """Fit on integer features (bins). Trees whose samples are the same rows are drawn anew, up to eight times."""
    labels, n = _labels(df, label), df.count()
    rows = df.filter(F.col(label).isNotNull()).select(F.col(row_id).alias("_id"), F.array(*[F.col(c).cast("int") for c in names]).alias("x"), F.element_at(_numbers(labels), F.col(label)).alias("y"))
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(cfg.trees - 1))).alias("tree"))
    again: dict[int, int] = {}
    if cfg.trees > 1:
        for _ in range(8):
            drawn = each.select("tree", "_id", _draws(cfg, "_id", n, again).alias("times")).filter("times > 0")
            marks = drawn.groupBy("tree").agg(F.sum(F.xxhash64("_id", "times").cast("decimal(38,0)")).alias("h"), F.count("*").alias("c"))
            same = marks.groupBy("h", "c").agg(F.sort_array(F.collect_list("tree")).alias("t")).filter(F.size("t") > 1).collect()  # a row a tree at most
            if not same:
                break
            for r in same:
                again |= {t: again.get(t, 0) + 1 for t in r.t[1:]}
    sample = each.withColumn("times", _draws(cfg, "_id", n, again)).filter("times > 0")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id")
        tree = int(pdf.tree.iloc[0])
        x, y = np.repeat(np.stack(pdf.x.to_numpy()), pdf.times, axis=0), np.repeat(pdf.y.to_numpy(), pdf.times)
        return pd.DataFrame([(tree, *v) for v in grow_tree(x, y, len(labels), np.random.default_rng([cfg.seed, tree]), cfg)], columns=[c.split()[0] for c in RF_NODE.split(", ")])

    return RandomForest(names, labels, sample.groupBy("tree").applyInPandas(grow, RF_NODE).orderBy("tree", "node").toPandas(), cfg, again)


def fit_single_tree(df: DataFrame, names: list[str], label: str, cfg: RandomForestConfig = RandomForestConfig()) -> RandomForest:  # noqa: B008
    """One tree on all rows and features, a level in one distributed histogram; only counts and the best split of each node are collected."""
    cfg = single_tree(cfg)
    labels = _labels(df, label)
    rows = df.filter(F.col(label).isNotNull()).select(*names, F.element_at(_numbers(labels), F.col(label)).alias("_y"))
    nodes: list[list] = [[0, True, -1, 0, -1, 0, 0]]
    numbers = list(range(len(labels)))
    open_ = [0]
    while open_ and labels:
        live = rows.withColumn("_node", _walked(nodes, names, set(open_))).filter("_node >= 0")
        counts = {r["_node"]: r for r in live.groupBy("_node").agg(*[F.count_if(F.col("_y") == c).alias(f"c{c}") for c in numbers]).collect()}
        for at in open_:
            nodes[at][5] = max(numbers, key=lambda c: (counts[at][f"c{c}"], -c))
        split = [at for at in open_ if sum(counts[at][f"c{c}"] > 0 for c in numbers) > 1 and sum(counts[at][f"c{c}"] for c in numbers) >= cfg.min_split and nodes[at][6] < cfg.max_depth - 1]
        if not split:
            break
        gains = split_gains(live.filter(F.col("_node").isin(split)), names, "_y", numbers, cfg.criterion, ["_node"], cfg.min_leaf)
        order = F.array_position(F.array(*[F.lit(c) for c in names]), F.col("feature"))
        best = gains.groupBy("_node").agg(F.max_by(F.struct("feature", "bin", "gain", "n"), F.struct(F.round("gain", 12), -order, -F.col("bin"))).alias("s")).select("_node", "s.*")
        open_ = []
        for r in sorted(best.collect(), key=lambda r: r["_node"]):
            if r.gain <= max(1e-4, cfg.impurity_threshold / (1 + math.log2(r.n + 1))):
                continue
            at, child = r["_node"], len(nodes)
            nodes[at][1:5] = [False, names.index(r.feature), int(r.bin), child]
            for _ in range(2):
                open_.append(len(nodes))
                nodes.append([len(nodes), True, -1, 0, -1, 0, nodes[at][6] + 1])
    table = pd.DataFrame([(0, *v) for v in nodes], columns=[c.split()[0] for c in RF_NODE.split(", ")])
    return RandomForest(names, labels, table, cfg)


def _walked(nodes: list[list], names: list[str], wanted: set[int]):
    """Column of the wanted node that a row is in, -1 elsewhere."""

    def walk(at: int):
        _, leaf, feature, cut, child, *_ = nodes[at]
        if leaf:
            return F.lit(at if at in wanted else -1)
        return F.when(F.col(names[feature]) <= cut, walk(child)).otherwise(walk(child + 1))

    return walk(0)


def prediction_score(df: DataFrame, predicted: str, actual: str, metric: str = "accuracy") -> float:
    """Accuracy, or macro precision, recall or f1, of two columns; 0 without rows."""
    counts = label_counts(df.filter(F.col(actual).isNotNull()), predicted, actual)
    name = {"accuracy": "micro_recall", "precision": "macro_precision", "recall": "macro_recall", "f1_score": "macro_f1"}[metric]
    return float(averaged_report(counts).first()[name] or 0.0)


def validation_score(valid: DataFrame, forest: RandomForest, row_id: str, label: str, metric: str = "accuracy") -> float:
    """The forest's score on rows that it was not fitted on."""
    return prediction_score(predicted(valid, forest, row_id).join(valid.select(row_id, label), row_id), "prediction", label, metric)


def oob_score(df: DataFrame, forest: RandomForest, row_id: str, label: str, metric: str = "accuracy") -> float:
    """The score by the trees that did not see the row."""
    votes = out_of_bag(df, forest, row_id, df.count())
    named = votes.select(row_id, F.array(*[F.lit(v) for v in forest.labels])[F.col("vote")].alias("prediction"))
    return prediction_score(named.join(df.select(row_id, label), row_id), "prediction", label, metric)


def kfold_score(df: DataFrame, row_id: str, names: list[str], label: str, cfg: RandomForestConfig = RandomForestConfig(), k: int = 5, metric: str = "accuracy", fit=None) -> float:  # noqa: B008
    """Mean score over ``k`` consecutive folds by ``row_id``; 2 to 10 folds, and two rows a fold and class at least."""
    if not 2 <= k <= 10:
        raise ValueError("folds must be 2 to 10")
    folds, _ = written(kfold(df, row_id, k), "folds")
    if folds.count() < 2 * k * folds.select(label).distinct().count():
        raise ValueError("too few rows for the folds")
    fit = fit or (lambda train: fit_random_forest(train, row_id, names, label, cfg))
    return sum(validation_score(folds.filter(F.col("fold") == f), fit(folds.filter(F.col("fold") != f)), row_id, label, metric) for f in range(1, k + 1)) / k


def grid_training(df: DataFrame, row_id: str, names: list[str], label: str, cfg: RandomForestConfig, min_split: tuple[int, int], min_leaf: tuple[int, int], scoring: str = "oob", valid: DataFrame | None = None, k: int = 5, metric: str = "accuracy", fit=None) -> tuple[RandomForest, RandomForestConfig, list[dict]]:
    """(forest, settings, results): every second min_split with every min_leaf; a later one must score strictly better.

    ``scoring``: oob, validation (needs ``valid``) or kfold. ``fit(train, cfg)`` grows the forest.
    """
    fit = fit or (lambda train, c: fit_random_forest(train, row_id, names, label, c))
    best, results = None, []
    for split in range(min_split[0], min_split[1] + 1, 2):
        for leaf in range(min_leaf[0], min_leaf[1] + 1):
            c = replace(cfg, min_split=split, min_leaf=leaf)
            forest = None if scoring == "kfold" else fit(df, c)
            if scoring == "kfold":
                score = kfold_score(df, row_id, names, label, c, k, metric, lambda train, c=c: fit(train, c))
            else:
                score = validation_score(valid, forest, row_id, label, metric) if scoring == "validation" else oob_score(df, forest, row_id, label, metric)
            results.append({"min_split": split, "min_leaf": leaf, "score": score})
            if best is None or score > best[0]:
                best = (score, c, forest)
    _, c, forest = best
    return forest or fit(df, c), c, results


def forest_votes(df: DataFrame, forest: RandomForest, row_id: str) -> DataFrame:
    """(row id, tree, vote) with label numbers."""
    held = df.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = held.value
            v = f.votes(np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(f.features))]) if b.num_rows else np.zeros((0, len(f.features)), np.int64))
            k = v.shape[1]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), k))), pa.array(np.tile(np.arange(k, dtype=np.int32), b.num_rows)), pa.array(v.ravel().astype(np.int32))], names=[row_id, "tree", "vote"])

    kind = df.schema[row_id].dataType.simpleString()
    return df.select(row_id, *[F.col(c).cast("int") for c in forest.features]).mapInArrow(run, f"{row_id} {kind}, tree int, vote int")


def predicted(df: DataFrame, forest: RandomForest, row_id: str) -> DataFrame:
    """(row id, prediction): the majority's label, the lowest of equal ones. Votes of a row are counted where the row is."""
    held = df.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = held.value
            v = f.votes(np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(f.features))]) if b.num_rows else np.zeros((0, len(f.features)), np.int64))
            count = np.stack([(v == k).sum(1) for k in range(len(f.labels))], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count.argmax(1).astype(np.int32))], names=[row_id, "prediction_id"])

    kind = df.schema[row_id].dataType.simpleString()
    out = df.select(row_id, *[F.col(c).cast("int") for c in forest.features]).mapInArrow(run, f"{row_id} {kind}, prediction_id int")
    names = F.array(*[F.lit(v) for v in forest.labels])
    return out.select(row_id, names[F.col("prediction_id")].alias("prediction"))


def out_of_bag(df: DataFrame, forest: RandomForest, row_id: str, n: int) -> DataFrame:
    """(row id, vote) by the trees whose sample lacks the row."""
    votes = forest_votes(df, forest, row_id)
    return majority_vote(votes.withColumn("times", _draws(forest.cfg, row_id, n, forest.again)).filter("times = 0"), [row_id], "vote")


@dataclass
class BoostConfig:
    """Defaults of the boosted trees; fixed values."""

    rounds: int = 100
    learning_rate: float = 0.3
    reg_lambda: float = 1.0
    gamma: float = 0.0
    max_depth: int = 6
    min_child_weight: int = 1
    train_ratio: float = 0.8
    valid_ratio: float = 0.2
    test_ratio: float = 0.0
    early_stopping: int = 0
    keep_best: bool = True


def boost_parts(df: DataFrame, label: str, order: str, cfg: BoostConfig = BoostConfig()) -> DataFrame:  # noqa: B008
    """A ``part`` (train, valid, test) for each row by the configured shares, label by label; shares that add up to more than 1 are brought down to it, and without any all rows train."""
    ratios = {"train": cfg.train_ratio, "valid": cfg.valid_ratio, "test": cfg.test_ratio}
    if sum(ratios.values()) <= 0:
        ratios["train"] = 1.0
    used = {name: share for name, share in ratios.items() if share > 0}
    return stratified_parts(df, label, order, used)


def gradients(probabilities, label_number, hessian_floor: float = 1e-4):
    """(gradient, hessian) arrays of softmax cross-entropy for an array of class probabilities."""
    g = F.transform(probabilities, lambda p, k: p - F.when(k == label_number, 1.0).otherwise(0.0))
    h = F.transform(probabilities, lambda p: F.greatest(p * (1 - p), F.lit(hessian_floor)))
    return g, h


def gradient_histogram(df: DataFrame, names: list[str], gradient: str, hessian: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, feature, bin, g, h, n)."""
    keys = keys or []
    return unpivoted(df, names, [*keys, gradient, hessian]).groupBy(*keys, "feature", F.col("value").cast("long").alias("bin")).agg(F.sum(gradient).alias("g"), F.sum(hessian).alias("h"), F.count("*").alias("n"))


def boost_gains(hist: DataFrame, reg_lambda: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """(keys, feature, bin, gain, left and right sums): gain 0.5 * (GL2/(HL+l) + GR2/(HR+l) - G2/(H+l)) of every cut that leaves rows on both sides."""
    part = [*(keys or []), "feature"]
    run, whole = Window.partitionBy(*part).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*part)
    x = hist.select(*part, "bin", *[F.sum(c).over(run).alias(f"l{c}") for c in "ghn"], *[F.sum(c).over(whole).alias(f"t{c}") for c in "ghn"])
    x = x.withColumns({f"r{c}": F.col(f"t{c}") - F.col(f"l{c}") for c in "ghn"}).filter("rn > 0")
    term = lambda s: F.col(f"{s}g") * F.col(f"{s}g") / (F.col(f"{s}h") + reg_lambda)
    return x.select(*part, "bin", (0.5 * (term("l") + term("r") - term("t"))).alias("gain"), "lg", "lh", "ln", "rg", "rh", "rn")


@dataclass
class Booster:
    features: list[str]
    labels: list
    learning_rate: float
    trees: list[list[dict]] = field(default_factory=list)  # a list of one tree a class for each round; a tree maps node -> (feature, bin) or leaf value
    losses: list[float] = field(default_factory=list)


def _assigned(tree: dict, names: list[str]):
    """Column of the leaf value of a tree for every row, as nested conditions."""

    def walk(node: int):
        kind = tree[node]
        if kind[0] == "leaf":
            return F.lit(float(kind[1]))
        return F.when(F.col(names[kind[1]]) <= kind[2], walk(2 * node + 1)).otherwise(walk(2 * node + 2))

    return walk(0)


def fit_booster(df: DataFrame, names: list[str], label: str, cfg: BoostConfig = BoostConfig(), valid: DataFrame | None = None) -> Booster:  # noqa: B008
    """Boosted trees of all classes, a level of all trees of a round in one distributed histogram.

    Scores of the rows are kept with the rows and written to the shared folder
    after every round, so a lost executor costs a round at most.
    """
    labels = _labels(df, label)
    number = _numbers(labels)
    k = len(labels)
    model = Booster(names, labels, cfg.learning_rate)
    zero = F.array(*[F.lit(0.0)] * k)

    def prepared(x: DataFrame) -> DataFrame:
        return x.filter(F.col(label).isNotNull()).select(*names, F.element_at(number, F.col(label)).alias("_y"), zero.alias("_s"))

    def kept(x: DataFrame) -> DataFrame:
        return written(x, "boost")[0]

    from ..functions.scalar import softmax

    rows, held = kept(prepared(df)), kept(prepared(valid)) if valid is not None else None
    best, since = math.inf, 0
    for _ in range(cfg.rounds):
        g, h = gradients(softmax(F.col("_s")), F.col("_y"))
        long = rows.select(*names, F.posexplode(F.arrays_zip(g.alias("g"), h.alias("h"))).alias("_k", "_gh")).select(*names, "_k", F.col("_gh.g").alias("_g"), F.col("_gh.h").alias("_h"))
        trees: list[dict] = [{0: ("open",)} for _ in range(k)]
        for depth in range(cfg.max_depth + 1):
            if not any(v[0] == "open" for t in trees for v in t.values()):
                break
            node = None
            for c in range(k):
                value = _open_node(trees[c], names)
                node = F.when(F.col("_k") == c, value) if node is None else node.when(F.col("_k") == c, value)
            live = long.withColumn("_node", node).filter(F.col("_node") >= 0)
            hist = gradient_histogram(live, names, "_g", "_h", ["_k", "_node"])
            totals = {(r._k, r._node): r for r in hist.filter(F.col("feature") == names[0]).groupBy("_k", "_node").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect()}
            gains = boost_gains(hist, cfg.reg_lambda, ["_k", "_node"]).filter((F.col("ln") >= cfg.min_child_weight) & (F.col("rn") >= cfg.min_child_weight)) if depth < cfg.max_depth else None
            cuts = {} if gains is None else {(r._k, r._node): r for r in gains.groupBy("_k", "_node").agg(F.max_by(F.struct("feature", "bin", "gain"), F.struct("gain", F.col("feature"), -F.col("bin"))).alias("c")).select("_k", "_node", "c.*").collect()}
            for (c, at), t in totals.items():
                cut = cuts.get((c, at))
                if cut is not None and cut.gain > 0 and cut.gain >= cfg.gamma and t.n >= cfg.min_child_weight:
                    trees[c][at] = ("cut", names.index(cut.feature), int(cut.bin))
                    trees[c][2 * at + 1] = trees[c][2 * at + 2] = ("open",)
                else:
                    trees[c][at] = ("leaf", -t.g / (t.h + cfg.reg_lambda))
            for t in trees:
                for at, v in t.items():
                    if v[0] == "open" and depth == cfg.max_depth:
                        t[at] = ("leaf", 0.0)
        model.trees.append(trees)
        add = F.array(*[F.col("_s")[c] + cfg.learning_rate * _assigned(trees[c], names) for c in range(k)])
        rows = kept(rows.withColumn("_s", add))
        if held is not None:
            from .metrics import multi_log_loss

            held = kept(held.withColumn("_s", add))
            loss = held.agg(multi_log_loss(softmax(F.col("_s")), F.col("_y"))).first()[0]
            model.losses.append(loss)
            since = 0 if loss < best else since + 1
            best = min(best, loss)
            if cfg.early_stopping and since >= cfg.early_stopping:
                break
    if cfg.keep_best and model.losses:
        model.trees = model.trees[: int(np.argmin(model.losses)) + 1]
    return model


def _open_node(tree: dict, names: list[str]):
    """Column of the open node that a row is in, -1 where its leaf is done."""

    def walk(node: int):
        kind = tree[node]
        if kind[0] == "open":
            return F.lit(node)
        if kind[0] == "leaf":
            return F.lit(-1)
        return F.when(F.col(names[kind[1]]) <= kind[2], walk(2 * node + 1)).otherwise(walk(2 * node + 2))

    return walk(0)


def boosted(df: DataFrame, model: Booster, keep: list[str], most_rounds: int | None = None) -> DataFrame:
    """``keep`` columns, raw scores, class probabilities and the label of the largest score (the first of equal ones), all as expressions. ``most_rounds``: trees of later rounds are left out."""
    from ..functions.scalar import softmax

    raw = F.array(*[sum((model.learning_rate * _assigned(r[c], model.features) for r in model.trees[:most_rounds]), F.lit(0.0)) for c in range(len(model.labels))])
    x = df.select(*keep, raw.alias("raw_scores"))
    best = F.array_position(F.col("raw_scores"), F.array_max("raw_scores"))
    return x.select(*keep, "raw_scores", softmax(F.col("raw_scores")).alias("probabilities"), F.array(*[F.lit(v) for v in model.labels])[(best - 1).cast("int")].alias("prediction"))


def leaf_scale_bits(model: Booster, label_bits: int) -> int:
    """Fraction bits with which the largest leaf still fits into ``label_bits`` signed bits: the calibration of a fitted model."""
    most = max((abs(v[1]) for r in model.trees for t in r for v in t.values() if v[0] == "leaf"), default=0.0)
    if most <= 0:
        return label_bits - 1
    return max(math.floor(math.log2(((1 << (label_bits - 1)) - 1) / most)), 0)


def fixed_leaf(value: float, scale_bits: int, label_bits: int) -> int:
    """A leaf in fixed point, cut to ``label_bits`` signed bits."""
    y = value * (1 << scale_bits)
    whole = math.floor(y + 0.5) if y >= 0 else math.ceil(y - 0.5)
    return min(max(whole, -(1 << (label_bits - 1))), (1 << (label_bits - 1)) - 1)


def with_fixed_leaves(model: Booster, label_bits: int, scale_bits: int | None = None) -> Booster:
    """The model with leaves as they come back from fixed point; without ``scale_bits`` these follow the largest leaf."""
    bits = leaf_scale_bits(model, label_bits) if scale_bits is None else scale_bits
    leaf = lambda v: ("leaf", fixed_leaf(v[1], bits, label_bits) / (1 << bits)) if v[0] == "leaf" else v
    return replace(model, trees=[[{at: leaf(v) for at, v in t.items()} for t in r] for r in model.trees])
