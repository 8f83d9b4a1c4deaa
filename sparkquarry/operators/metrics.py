"""Metrics of classification, regression and ranking as aggregates and windows.

Ranking metrics first reduce the rows to one a distinct score, with the counts of
both classes: that step combines on the map side, and only distinct scores reach
the ordered sums of ``ranks``, so no task holds all scores, or all rows of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import LOG_LOSS_EPS
from .ranks import running_sums


def _share(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def binary_counts(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row: tp, fp, tn, fn."""
    one = lambda p, a: F.count_if((predicted == p) & (actual == a))
    return df.agg(one(True, True).alias("tp"), one(True, False).alias("fp"), one(False, False).alias("tn"), one(False, True).alias("fn"))


@dataclass(frozen=True)
class RunningCounts:
    """Counts of a binary decision that grow by tables and merge; rates at any time."""

    tp: int = 0
    fp: int = 0
    tn: int = 0
    fn: int = 0

    def update(self, df: DataFrame, predicted: Column, actual: Column) -> RunningCounts:
        return self.merge(RunningCounts(**binary_counts(df, predicted, actual).first().asDict()))

    def merge(self, other: RunningCounts) -> RunningCounts:
        return RunningCounts(self.tp + other.tp, self.fp + other.fp, self.tn + other.tn, self.fn + other.fn)

    def calculate(self) -> dict[str, float]:
        share = lambda a, b: a / b if b else 0.0
        p, r = share(self.tp, self.tp + self.fp), share(self.tp, self.tp + self.fn)
        return {"accuracy": share(self.tp + self.tn, self.tp + self.fp + self.tn + self.fn), "precision": p, "recall": r, "f1": share(2 * p * r, p + r), "fpr": share(self.fp, self.fp + self.tn), "tpr": r, "specificity": share(self.tn, self.tn + self.fp)}


def binary_rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, f1, fpr, tpr, specificity of rows with tp, fp, tn, fn; 0 where a denominator is 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    p, r = _share(tp, tp + fp), _share(tp, tp + fn)
    return counts.withColumns({"accuracy": _share(tp + tn, tp + fp + tn + fn), "precision": p, "recall": r, "f1": _share(2 * p * r, p + r), "fpr": _share(fp, fp + tn), "tpr": r, "specificity": _share(tn, tn + fp)})


def label_counts(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """(label, tp, fp, fn) of every label that occurs on either side."""
    pairs = df.groupBy(F.col(predicted).alias("p"), F.col(actual).alias("a")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("p").alias("label"), F.lit("p").alias("side")), F.struct(F.col("a").alias("label"), F.lit("a").alias("side")))).alias("s"), "p", "a", "n")
    hit, is_p = F.col("p") == F.col("a"), F.col("s.side") == "p"
    out = sides.groupBy(F.col("s.label").alias("label")).agg(F.sum(F.when(hit & is_p, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~hit & is_p, F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(~hit & ~is_p, F.col("n")).otherwise(0)).alias("fn"))
    return out


def label_report(counts: DataFrame) -> DataFrame:
    """Precision, recall, f1 and support of every label."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = _share(tp, tp + fp), _share(tp, tp + fn)
    return counts.select("label", "tp", "fp", "fn", (tp + fn).alias("support"), p.alias("precision"), r.alias("recall"), _share(2 * p * r, p + r).alias("f1"))


def averaged_report(counts: DataFrame) -> DataFrame:
    """Micro, macro (labels with a zero denominator left out; f1: both zero), weighted and plain averages in one row."""
    x = label_report(counts)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    has_p, has_r = (tp + fp) > 0, (tp + fn) > 0
    s = lambda c: F.sum(c)
    w = lambda c: _share(s(F.col(c) * F.col("support")), s("support"))
    micro_p, micro_r = _share(s(tp), s(tp + fp)), _share(s(tp), s(tp + fn))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return x.agg(
        micro_p.alias("micro_precision"), micro_r.alias("micro_recall"), _share(2 * micro_p * micro_r, micro_p + micro_r).alias("micro_f1"),
        zero(F.avg(F.when(has_p, F.col("precision")))).alias("macro_precision"), zero(F.avg(F.when(has_r, F.col("recall")))).alias("macro_recall"), zero(F.avg(F.when(has_p | has_r, F.col("f1")))).alias("macro_f1"),
        w("precision").alias("weighted_precision"), w("recall").alias("weighted_recall"), w("f1").alias("weighted_f1"),
        zero(F.avg("precision")).alias("mean_precision"), zero(F.avg("recall")).alias("mean_recall"), zero(F.avg("f1")).alias("mean_f1"),
    )


def log_loss(probability: Column, positive: Column, eps: float = LOG_LOSS_EPS) -> Column:
    """Aggregate: mean negative log-likelihood of a binary outcome, probabilities cut at eps."""
    p = F.least(F.greatest(probability, F.lit(eps)), F.lit(1 - eps))
    return F.avg(F.when(positive, -F.log(p)).otherwise(-F.log(1 - p)))


def multi_log_loss(probabilities: Column, label: Column, eps: float = LOG_LOSS_EPS) -> Column:
    """Aggregate: mean negative log probability of the label (an index from 0)."""
    p = F.least(F.greatest(F.get(probabilities, label.cast("int")), F.lit(eps)), F.lit(1 - eps))
    return F.avg(-F.log(p))


def regression_report(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row: mae, mse, rmse, mape (denominator abs(actual) + 1e-6), r2 (0 where the total is 0), mean and largest error."""
    e = predicted - actual
    sse, n = F.sum(e * e), F.count(e)
    total = F.sum(actual * actual) - F.sum(actual) * F.sum(actual) / n
    return df.agg(
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e) / (F.abs(actual) + 1e-6)).alias("mape"),
        F.when(total <= 0, 0.0).otherwise(1 - sse / total).alias("r2"), F.avg(e).alias("mean_error"), F.max(F.abs(e)).alias("max_error"),
    )


def score_table(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """(score, pos, neg): one row a distinct score."""
    return df.groupBy(F.col(score).alias("score")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))


def running_counts(table: DataFrame, descending: bool = True) -> DataFrame:
    """A score table with the counts before each score: pos_before, neg_before, and the totals."""
    return running_sums(table, "score", ["pos", "neg"], descending=descending).withColumnsRenamed({"pos_total": "all_pos", "neg_total": "all_neg"})


def roc_auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row, ``roc_auc``: the chance that a positive has the larger score, ties counting half; 0.5 if a class is empty."""
    x = running_counts(score_table(df, score, positive), descending=False)
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    both = F.max(F.col("all_pos").cast("double") * F.col("all_neg"))
    return x.agg(F.when(F.coalesce(both, F.lit(0.0)) == 0, 0.5).otherwise(won / both).alias("roc_auc"))


def average_precision(df: DataFrame, score: str, positive: Column, key: str) -> DataFrame:
    """One row, ``average_precision``: mean precision at the positives by falling score, equal scores in order of ``key``.

    Positives are placed by the counts before their score; only rows of scores
    that both classes share are ordered one by one.
    """
    table = running_counts(score_table(df, score, positive)).withColumnRenamed("score", "_score")
    rows = df.select(F.col(score).alias("score"), positive.cast("long").alias("hit"), F.col(key).alias("key"), F.lit(1).cast("long").alias("one"))
    within = running_sums(rows, "key", ["hit", "one"], by=["score"])
    placed = within.join(table, F.col("score") == F.col("_score"))
    precision = (F.col("pos_before") + F.col("hit_before") + 1) / (F.col("pos_before") + F.col("neg_before") + F.col("one_before") + 1)
    return placed.agg(F.coalesce(F.sum(F.when(F.col("hit") == 1, precision)) / F.max(F.when(F.col("all_pos") > 0, F.col("all_pos"))), F.lit(0.0)).alias("average_precision"))


def precision_recall_curve(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """(threshold, recall, precision): one point a distinct score by falling score, and the start (null, 0, 1)."""
    x = running_counts(score_table(df, score, positive))
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    points = x.select(F.col("score").alias("threshold"), _share(tp, F.col("all_pos")).cast("double").alias("recall"), (tp / (tp + fp)).alias("precision"))
    start = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    return start.union(points)


def roc_curve(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """(threshold, fpr, tpr): one point a distinct score by falling score, and the start (null, 0, 0); the last point is (1, 1)."""
    x = running_counts(score_table(df, score, positive))
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    points = x.select(F.col("score").alias("threshold"), _share(fp, F.col("all_neg")).cast("double").alias("fpr"), _share(tp, F.col("all_pos")).cast("double").alias("tpr"))
    start = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.union(points)


def histogram(df: DataFrame, value: str, positive: Column, bins: int = 29) -> DataFrame:
    """(bin, lo, pos, neg) over the joint range, the last bin closed."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.floor((F.col(value) - F.col("lo")) / F.when(width > 0, width).otherwise(1.0)), F.lit(bins - 1)).cast("long")
    x = df.withColumn("_p", positive).join(F.broadcast(ends)).withColumn("bin", b)  # one row
    return x.groupBy("bin").agg(F.min(F.col("lo") + F.col("bin") * width).alias("lo"), F.count_if(F.col("_p")).alias("pos"), F.count_if(~F.col("_p")).alias("neg"))


def score_summary(df: DataFrame, score: str) -> DataFrame:
    return df.agg(F.avg(score).alias("mean_score"), F.min(score).alias("min_score"), F.max(score).alias("max_score"))


def majority_vote(votes: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The label with most votes for each key; of equal ones the lowest."""
    n = votes.groupBy(*keys, label).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.max_by(label, F.struct("n", -F.col(label))).alias("vote"))


def smallest_class_share(df: DataFrame, label: str) -> DataFrame:
    """One row: per cent of the rows that the rarest non-empty label has."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.least(F.lit(100.0), 100.0 * F.min("n") / F.sum("n")), F.lit(100.0)).alias("smallest_share"))


def tpr_at_fpr(curve: DataFrame, fpr: float) -> DataFrame:
    """TPR at a false-positive rate, linear between the curve's points."""
    lo = curve.filter(F.col("fpr") <= fpr).agg(F.max(F.struct("fpr", "tpr")).alias("lo"))
    hi = curve.filter(F.col("fpr") >= fpr).agg(F.min(F.struct("fpr", "tpr")).alias("hi"))
    gap = F.col("hi.fpr") - F.col("lo.fpr")
    return lo.join(hi).select(F.when(gap == 0, F.col("lo.tpr")).otherwise(F.col("lo.tpr") + (F.col("hi.tpr") - F.col("lo.tpr")) * (fpr - F.col("lo.fpr")) / gap).alias("tpr"))
