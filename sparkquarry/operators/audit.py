"""Audits of splits: distribution distance, predictability, and the gates that read them."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import rbf, squared_distance, stable_json_hash
from ..lineage import dropped, renamed, written
from .metrics import roc_auc
from .ranks import numbered

#: Rows a side of the pairwise statistics at most; these are samples by definition.
SAMPLE = 2000


def sampled(df: DataFrame, row_id: str, n: int, seed: int = 0) -> DataFrame:
    """The n rows with the smallest seeded hash of their id: the same rows on every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(row_id)), F.col(row_id)).limit(n)


def mmd2(df: DataFrame, row_id: str, vec: str, side: Column, sample: int = SAMPLE, gamma: float | None = None) -> DataFrame:
    """One row, (gamma, mmd2): biased squared maximum mean discrepancy of two sides under an RBF kernel.

    Without ``gamma`` the kernel width is one over the median squared distance of
    all pairs. Each side is a sample of bounded size, so the pair table is, too.
    """
    x = df.select(F.col(row_id).alias("id"), F.col(vec).alias("v"), side.alias("side"))
    x = sampled(x.filter("side"), "id", sample).union(sampled(x.filter(~F.col("side")), "id", sample))
    pairs = x.alias("x").join(F.broadcast(x.alias("y")), F.col("x.id") <= F.col("y.id"))
    d = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.side").alias("sa"), F.col("y.side").alias("sb"), squared_distance(F.col("x.v"), F.col("y.v")).alias("d2"))
    if gamma is None:
        med = d.filter("a < b").agg(F.percentile("d2", 0.5).alias("m")).select((1.0 / F.col("m")).alias("gamma"))
        d = d.join(F.broadcast(med))  # one row
    else:
        d = d.withColumn("gamma", F.lit(gamma))
    k = F.exp(-F.col("gamma") * F.col("d2")) * F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    n = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    mean = lambda c: F.sum(F.when(c, k)) / F.sum(F.when(c, n))
    both, none = F.col("sa") & F.col("sb"), ~F.col("sa") & ~F.col("sb")
    return d.agg(F.max("gamma").alias("gamma"), (mean(both) + mean(none) - 2 * mean(F.col("sa") != F.col("sb"))).alias("mmd2"))


def mmd_permutation_test(df: DataFrame, row_id: str, vec: str, side: Column, sample: int = 500, permutations: int = 300, seed: int = 0) -> dict:
    """Observed MMD2 and p = (1 + permutations at least as large) / (1 + permutations), on a bounded sample of each side."""
    x = df.select(F.col(row_id).alias("id"), F.col(vec).alias("v"), side.alias("side"))
    rows = sampled(x.filter("side"), "id", sample, seed).union(sampled(x.filter(~F.col("side")), "id", sample, seed)).orderBy("id").collect()
    v, y = np.array([r.v for r in rows], float), np.array([bool(r.side) for r in rows])
    d2 = ((v[:, None, :] - v[None, :, :]) ** 2).sum(-1)
    k = np.exp(-d2 / np.median(d2[np.triu_indices(len(v), 1)]))

    def value(s: np.ndarray) -> float:
        return float(k[np.ix_(s, s)].mean() + k[np.ix_(~s, ~s)].mean() - 2 * k[np.ix_(s, ~s)].mean())

    rng = np.random.default_rng(seed)
    seen = value(y)
    more = sum(value(rng.permutation(y)) >= seen for _ in range(permutations))
    return {"mmd2": seen, "p_value": (1 + more) / (1 + permutations), "rows": len(rows)}


def split_predictability(df: DataFrame, names: list[str], side: Column, row_id: str, folds: int = 5) -> DataFrame:
    """(fold, auc): how well a balanced logistic regression tells the sides apart on held-out folds. Each side's rows are dealt to the folds in turn, in order of a hash of the id."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = df.select(*[F.col(c).cast("double").alias(c) for c in names], side.cast("double").alias("label"), F.xxhash64(row_id).alias("_draw"))
    x = numbered(x, "_draw", ["label"]).withColumn("fold", F.pmod("row_no", F.lit(folds))).drop("row_no", "n", "_draw")
    x, _ = written(x, "folds")
    x = VectorAssembler(inputCols=names, outputCol="raw", handleInvalid="keep").transform(x)
    share = x.agg(F.avg("label")).first()[0] or 0.5
    x = x.withColumn("weight", F.when(F.col("label") == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))
    out = None
    for f in range(folds):
        train, test = x.filter(F.col("fold") != f), x.filter(F.col("fold") == f)
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
        model = LogisticRegression(weightCol="weight", maxIter=50).fit(scaler.transform(train))
        p = model.transform(scaler.transform(test)).select(vector_to_array("probability")[1].alias("p"), "label")
        one = roc_auc(p, "p", F.col("label") == 1).select(F.lit(f).alias("fold"), F.col("roc_auc").alias("auc"))
        out = one if out is None else out.union(one)
    return out


def pca_2d(df: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """The first two principal components beside the kept columns."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = VectorAssembler(inputCols=names, outputCol="raw").transform(df)
    x = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(x).transform(x)
    x = PCA(k=2, inputCol="scaled", outputCol="pc").fit(x).transform(x)
    return x.select(*keep, vector_to_array("pc")[0].alias("pc1"), vector_to_array("pc")[1].alias("pc2"))


def silhouette(df: DataFrame, names: list[str], cluster: str) -> float:
    """Mean silhouette of a given clustering (integer column) by squared Euclidean distance."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    return ClusteringEvaluator(predictionCol=cluster, featuresCol="features").evaluate(x.withColumn(cluster, F.col(cluster).cast("int")))


def manifest(state: dict, least_rows: int, config: dict, similarity_limit: float | None = None) -> dict:
    """The audit's outcome with its gates; the run id is a hash of configuration and state. ``similarity_limit``: no projected similarity may reach it."""
    gates = {"least_rows": state.get("rows", 0) >= least_rows, "sealed": bool(state.get("sealed_pass"))}
    if similarity_limit is not None:
        gates["projected"] = (state.get("largest_cosine") or 0.0) < similarity_limit
    return {"run_id": stable_json_hash({"config": config, "state": state}), "config": config, "state": state, "least_rows": least_rows, "similarity_limit": similarity_limit, "gates": gates, "all_pass": all(gates.values())}


def write_manifest(spark: SparkSession, m: dict, path: str) -> None:
    """A text table of one JSON document, written beside ``path`` and moved there in one step."""
    new = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(m, sort_keys=True),)], "value string").coalesce(1).write.text(new)
    dropped(spark, path)
    renamed(spark, new, path)


def require_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest, whose gates are worked out again from its state and must all hold."""
    m = json.loads(spark.read.text(path).first().value)
    again = manifest(m["state"], m["least_rows"], m["config"], m["similarity_limit"])
    if again["run_id"] != m["run_id"]:
        raise ValueError("the state does not belong to the run id")
    if not again["all_pass"]:
        raise ValueError(f"gates failed: {sorted(k for k, v in again['gates'].items() if not v)}")
    return m


def timing_report(df: DataFrame, keys: list[str], ms: str, size: str) -> DataFrame:
    """Files, total ms, ms a file and ms a MB (10**6 bytes) of each group; 0 where there are no bytes."""
    x = df.groupBy(*keys).agg(F.count("*").alias("files"), F.sum(ms).cast("double").alias("total_ms"), F.sum(size).alias("_bytes"))
    return x.select(*keys, "files", "total_ms", (F.col("total_ms") / F.col("files")).alias("ms_a_file"), F.when(F.col("_bytes") > 0, F.col("total_ms") / (F.col("_bytes") / 1e6)).otherwise(0.0).alias("ms_a_mb"))


def kernel_mean(df: DataFrame, a: str, b: str, gamma: float) -> DataFrame:
    return df.agg(F.avg(rbf(F.col(a), F.col(b), gamma)).alias("kernel_mean"))
