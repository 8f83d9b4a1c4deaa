"""Threshold rules: a row is anomalous if its score is strictly below the threshold.

Every rule works on the table of distinct scores with exclusive running counts,
not on a join of candidates with scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import running_counts, score_table

STRATEGIES = ("fpr", "f1", "tpr", "youden", "model")


def candidates(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr): what each distinct score would give as threshold."""
    x = running_counts(score_table(df, score, positive), descending=False)
    rate = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    return x.select(F.col("score").alias("threshold"), F.col("pos_before").alias("tp"), F.col("neg_before").alias("fp"), rate("pos_before", "all_pos").alias("tpr"), rate("neg_before", "all_neg").alias("fpr"), "all_pos", "all_neg")


def threshold_at_fpr(df: DataFrame, score: str, positive: Column, fpr: float) -> DataFrame:
    """One row: the floor(fpr * n)-th smallest negative score (below all of them if that is 0), and what it gives when measured again."""
    c = candidates(df, score, positive)
    n = F.floor(F.col("all_neg") * fpr)
    neg = df.filter(~positive).groupBy(F.col(score).alias("threshold")).agg(F.count("*").alias("here"))
    at = c.join(neg, "threshold")
    # the first score up to and including which max_fp negatives lie
    pick = at.filter((n > 0) & (F.col("fp") < n) & (F.col("fp") + F.col("here") >= n)).agg(F.min("threshold").alias("threshold"))
    low = at.agg(F.min("threshold").alias("least"))
    chosen = low.join(pick).select(F.coalesce("threshold", F.col("least") - 1e-10).alias("threshold"))  # one row each
    below = F.col(score) < F.col("threshold")
    x = df.withColumn("_p", positive).join(F.broadcast(chosen))
    rate = lambda p: F.coalesce(F.count_if(below & (F.col("_p") == p)) / F.when(F.count_if(F.col("_p") == p) > 0, F.count_if(F.col("_p") == p)), F.lit(0.0))
    return x.agg(F.max("threshold").alias("threshold"), rate(False).alias("fpr"), rate(True).alias("tpr"))


def best_threshold(df: DataFrame, score: str, positive: Column, most_fpr: float, strategy: str = "tpr", beta: float = 1.0) -> DataFrame:
    """One row: the candidate with the best tpr, Youden index or F-beta among those with fpr <= most_fpr; of equal ones the lowest."""
    c = candidates(df, score, positive).filter(F.col("fpr") <= most_fpr)
    fn = F.col("all_pos") - F.col("tp")
    b2 = beta * beta
    den = (1 + b2) * F.col("tp") + b2 * fn + F.col("fp")
    goal = {"tpr": F.col("tpr"), "youden": F.col("tpr") - F.col("fpr"), "f1": F.when(den == 0, 0.0).otherwise((1 + b2) * F.col("tp") / den)}[strategy]
    return c.orderBy(goal.desc(), F.col("threshold").asc()).limit(1)


def choose_threshold(df: DataFrame, score: str, positive: Column, strategy: str, fpr: float) -> DataFrame:
    """The rule by name: fpr, f1, tpr, youden, or model (always 0)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "fpr":
        return threshold_at_fpr(df, score, positive, fpr)
    if strategy == "model":
        return df.sparkSession.range(1).select(F.lit(0.0).alias("threshold"))
    return best_threshold(df, score, positive, fpr, strategy).select("threshold", "fpr", "tpr")


def fpr_target(val_target: float | None = None, limit: float | None = None, contamination: float | None = None, delta: float = 0.0) -> float:
    """The target in use: the validation target, else the limit less delta, else the contamination, else 0.05."""
    if val_target is not None:
        return val_target
    if limit is not None:
        return max(limit - delta, 0.0)
    return contamination if contamination is not None else 0.05


def calibrated(config: dict, threshold: float, achieved_fpr: float) -> dict:
    """The configuration with the threshold and the achieved rate beside the limit, which stays."""
    return {**config, "threshold": threshold, "achieved_fpr": achieved_fpr}


def is_anomaly(score: Column, threshold: float | Column) -> Column:
    return score < (threshold if isinstance(threshold, Column) else F.lit(threshold))
