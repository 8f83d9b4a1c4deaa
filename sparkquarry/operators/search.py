"""Grid search and final evaluation of the isolation forest."""

from __future__ import annotations

import itertools
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import cohens_d, top_features
from .forest import ForestConfig, fit_forest, fit_scaler, scored
from .metrics import average_precision, binary_counts, binary_rates, roc_auc
from .threshold import choose_threshold


def best_config(results: DataFrame, fpr_limit: float, fpr_goal: float) -> DataFrame:
    """One row: of the configurations within the limit the largest tpr, then auc, then the fpr nearest to the goal, then the shortest time."""
    ok = results.filter(F.col("fpr_val") <= fpr_limit)
    return ok.orderBy(F.desc("tpr_val"), F.desc("auc_val"), F.abs(F.col("fpr_val") - fpr_goal), F.asc("time_s")).limit(1)


def grid(options: dict[str, list]) -> list[dict]:
    return [dict(zip(options, v, strict=True)) for v in itertools.product(*options.values())]


def evaluated(df: DataFrame, score: str, key: str, positive: Column, threshold: float) -> dict:
    """Counts, rates, AUC and average precision of anomalies (low scores) at a threshold."""
    x = df.withColumn("_p", positive).withColumn("_s", -F.col(score))
    rates = binary_rates(binary_counts(x, F.col(score) < threshold, F.col("_p"))).first().asDict()
    return rates | roc_auc(x, "_s", F.col("_p")).first().asDict() | average_precision(x, "_s", F.col("_p"), key).first().asDict()


def standardised(df: DataFrame, names: list[str], means: dict, scales: dict, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[((F.col(c) - means[c]) / scales[c]).alias(c) for c in names])


def search(train: DataFrame, valid: DataFrame, names: list[str], row_id: str, positive: str, options: dict[str, list], fpr_limit: float = 0.05, strategy: str = "tpr") -> tuple[list[dict], dict]:
    """Try every combination of ``n_features`` and forest settings; returns all results and the best one. Only train and validation rows are read."""
    ranked = [r.feature for r in top_features(cohens_d(valid, names, F.col(positive)), len(names)).orderBy("place").collect()]
    results = []
    for opt in grid(options):
        began = time.time()
        opt = dict(opt)
        use = ranked[-opt.pop("n_features", len(ranked)) :]
        means, scales = fit_scaler(train, use)
        forest = fit_forest(standardised(train, use, means, scales, [row_id]), row_id, use, ForestConfig(continuous=True, **opt))
        s = scored(standardised(valid, use, means, scales, [row_id]), forest, row_id).join(valid.select(row_id, positive), row_id)
        t = choose_threshold(s, "score", F.col(positive), strategy, fpr_limit).first()
        e = evaluated(s, "score", row_id, F.col(positive), t.threshold)
        results.append({"features": use, **opt, "threshold": t.threshold, "fpr_val": e["fpr"], "tpr_val": e["tpr"], "auc_val": e["roc_auc"], "time_s": time.time() - began})
    ok = [r for r in results if r["fpr_val"] <= fpr_limit]
    if not ok:
        raise ValueError("no configuration keeps the false-positive limit")
    return results, min(ok, key=lambda r: (-r["tpr_val"], -r["auc_val"], abs(r["fpr_val"] - fpr_limit), r["time_s"]))


def final_evaluation(train: DataFrame, test: DataFrame, best: dict, row_id: str, positive: str) -> dict:
    """Train the best configuration again and read the test split, once."""
    use = best["features"]
    means, scales = fit_scaler(train, use)
    extra = {k: v for k, v in best.items() if k in ForestConfig.__dataclass_fields__}
    forest = fit_forest(standardised(train, use, means, scales, [row_id]), row_id, use, ForestConfig(**{"continuous": True, **extra}))
    forest.threshold = best["threshold"]
    s = scored(standardised(test, use, means, scales, [row_id]), forest, row_id).join(test.select(row_id, positive), row_id)
    return evaluated(s, "score", row_id, F.col(positive), best["threshold"]) | {"forest": forest, "means": means, "scales": scales}
