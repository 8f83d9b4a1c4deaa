"""Quantization of features to a few bits: fitting rules, applying them, drift and re-binning.

A fitted quantizer is one rule a feature: ``full`` (the values are exactly 0 to
G-1), ``custom`` (at most G distinct values, listed) or ``continuous`` (integer
edges on a scaled axis). Rules are as many as there are features and become
expressions, so applying a quantizer needs neither a join nor Python.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import zscore_clip
from ..lineage import dropped, renamed
from .columns import unpivoted
from .ranks import quantiles

#: Largest value on the scaled axis of a continuous feature; a fixed value of the stored format.
AXIS = 65535


@dataclass
class Rule:
    feature: str
    kind: str
    lo: float
    hi: float
    mean: float
    std: float
    scale: int = 1
    baseline: int = 0
    edges: list[int] = field(default_factory=list)
    values: list[float] = field(default_factory=list)


@dataclass
class Quantizer:
    bits: int
    rules: list[Rule]
    clip: bool = True
    z: float = 3.0
    labels: list[str] = field(default_factory=list)

    @property
    def bins(self) -> int:
        return 1 << self.bits

    def save(self, spark: SparkSession, path: str) -> None:
        """A text table of one JSON document, written beside ``path`` and moved there in one step."""
        new = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.text(new)
        dropped(spark, path)
        renamed(spark, new, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Quantizer:
        x = json.loads(spark.read.text(path).first().value)
        return Quantizer(x["bits"], [Rule(**r) for r in x["rules"]], x["clip"], x["z"], x["labels"])


def axis_scale(lo: float, hi: float) -> int:
    """Steps a unit of the continuous axis: floor(AXIS / range), 1 at least."""
    return max(math.floor(AXIS / (hi - lo)), 1) if hi > lo else 1


def _half_away(x: float) -> int:
    return math.floor(x + 0.5) if x >= 0 else math.ceil(x - 0.5)


def scaled_edges(cuts: list[float], scale: int, baseline: int, saturate: bool = True) -> list[int]:
    out = [max(_half_away(c * scale) - baseline, 0) for c in cuts]
    return [min(e, AXIS) for e in out] if saturate else out


def fit_quantizer(df: DataFrame, names: list[str], bits: int = 4, clip: bool = True, z: float = 3.0, saturate: bool = True) -> Quantizer:
    """Fit a rule for each feature: statistics, distinct values up to the number of bins, and exact quantiles, one pass each over the long form.

    Features with at most G distinct values are not clipped when fitting.
    """
    g = 1 << bits
    long = unpivoted(df, names).filter(F.col("value").isNotNull())
    distinct = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    stats = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    kinds = distinct.groupBy("feature").agg(F.count("*").alias("d"))
    # the values are listed only where there are at most G of them
    listed = distinct.join(F.broadcast(kinds.filter(F.col("d") <= g)), "feature").groupBy("feature").agg(F.sort_array(F.collect_list("value")).alias("values"))
    base = stats.join(kinds, "feature").join(listed, "feature", "left")
    clipped = long.join(F.broadcast(base.select("feature", "mean", "std", "d")), "feature")  # a row a feature
    value = zscore_clip(F.col("value"), F.col("mean"), F.col("std"), z) if clip else F.col("value")
    clipped = clipped.select("feature", F.when(F.col("d") <= g, F.col("value")).otherwise(value).alias("value"))
    ends = clipped.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    cuts = ends.join(quantiles(clipped, "feature", "value", [b / g for b in range(1, g)]).withColumnRenamed("q", "cuts"), "feature")
    rows = {r.feature: r for r in base.join(cuts, "feature").collect()}
    rules = []
    for name in names:
        r = rows.get(name)
        if r is None:
            rules.append(Rule(name, "custom", 0.0, 0.0, 0.0, 0.0, values=[0.0]))
            continue
        rule = Rule(name, "continuous", r.lo, r.hi, r.mean, r.std)
        if r.d <= g:
            rule.values = list(r["values"])
            rule.kind = "full" if [int(v) for v in rule.values] == list(range(g)) and len(rule.values) == g else "custom"
        else:
            rule.scale = axis_scale(r.lo, r.hi)
            rule.baseline = _half_away(r.lo * rule.scale)
            edges = scaled_edges(list(r.cuts), rule.scale, rule.baseline, saturate)
            if len(set(edges)) == 1 and r.hi - r.lo > 1e-6:
                edges = scaled_edges([r.lo + (r.hi - r.lo) * b / g for b in range(1, g)], rule.scale, rule.baseline, saturate)
            rule.edges = edges
        rules.append(rule)
    return Quantizer(bits, rules, clip, z)


def _adjusted(x: Column, rule: Rule) -> Column:
    y = x * F.lit(float(rule.scale))
    return (F.when(y < 0, F.ceil(y - 0.5)).otherwise(F.floor(y + 0.5)) - F.lit(rule.baseline)).cast("long")


def signal(x: Column, rule: Rule, bins: int, clip: bool, z: float, mode: str = "nearest") -> Column:
    """The bin before clamping. In mode ``drift`` values beyond the fitted range give -1 or ``bins`` and unknown categories ``bins``; in mode ``nearest`` categories go to the nearest."""
    v = x.cast("double")
    if clip:
        v = zscore_clip(v, F.lit(rule.mean), F.lit(rule.std), z)
    if rule.kind == "full":
        return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("int")
    if rule.kind == "custom":
        values = F.array(*[F.lit(float(a)) for a in rule.values])
        gaps = F.transform(values, lambda a, i: F.struct(F.abs(a - v).alias("gap"), i.alias("i")))
        near = F.array_min(gaps)
        if mode == "nearest":
            return near["i"].cast("int")
        return F.when(near["gap"] <= 1e-6, near["i"]).when(v < rule.lo, -1).otherwise(bins).cast("int")
    a = _adjusted(v, rule)
    inside = F.when(a <= 0, 0).otherwise(F.least(F.size(F.filter(F.array(*[F.lit(int(e)).cast("long") for e in rule.edges]), lambda e: a >= e)), F.lit(bins - 1)))
    if mode == "nearest":
        return inside.cast("int")
    return F.when(v < rule.lo, -1).when(v > rule.hi, bins).otherwise(inside).cast("int")


def quantized(df: DataFrame, q: Quantizer, mode: str = "nearest") -> DataFrame:
    """The frame with every fitted feature replaced by its bin, 0 to G-1."""
    return df.withColumns({r.feature: F.least(F.greatest(signal(F.col(r.feature), r, q.bins, q.clip, q.z, mode), F.lit(0)), F.lit(q.bins - 1)) for r in q.rules})


def quantized_splits(frames: dict[str, DataFrame], names: list[str], bits: int = 4, **options) -> tuple[Quantizer, DataFrame]:
    """(quantizer, all splits with a ``split`` column): fitted on the first split once and applied to every one."""
    q, out = fit_quantizer(next(iter(frames.values())), names, bits, **options), None
    for name, f in frames.items():
        part = quantized(f, q).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return q, out


def distinct_up_to(df: DataFrame, names: list[str], most: int) -> DataFrame:
    """(feature, n): distinct values of each column, ``most + 1`` where there are more; no more than that are kept of a column."""
    from pyspark.sql.window import Window

    values = unpivoted(df, names).filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.lit(1).alias("_one"))
    few = values.withColumn("r", F.row_number().over(Window.partitionBy("feature").orderBy("value"))).filter(F.col("r") <= most + 1)
    return few.groupBy("feature").agg(F.count("*").alias("n"))


def drift_signals(df: DataFrame, q: Quantizer, clip: bool = False) -> DataFrame:
    """The frame with ``drift``: the first feature, in rule order, out of the fitted range, as (feature, value); null if none is."""
    hits = F.array(*[F.struct(F.lit(r.feature).alias("feature"), F.col(r.feature).cast("double").alias("value"), signal(F.col(r.feature), r, q.bins, clip, q.z, "drift").alias("s")) for r in q.rules])
    out = F.filter(hits, lambda h: (h["s"] < 0) | (h["s"] >= q.bins))
    return df.withColumn("drift", F.when(F.size(out) > 0, F.struct(out[0]["feature"].alias("feature"), out[0]["value"].alias("value"))))


def rebinned(rule: Rule, values: list[float], bins: int) -> tuple[Rule, dict[int, int]]:
    """A continuous rule with its range extended to ``values``, and the new bin of every old one: that of largest overlap, the first of equal ones."""
    if rule.kind != "continuous" or not values:
        return rule, {b: b for b in range(bins)}
    lo, hi = min(rule.lo, *values), max(rule.hi, *values)
    cuts = [(e + rule.baseline) / rule.scale for e in rule.edges]
    stretch = (hi - lo) / (rule.hi - rule.lo) if rule.hi > rule.lo else 1.0
    new_cuts = [lo + (c - rule.lo) * stretch for c in cuts]
    scale = axis_scale(lo, hi)
    base = _half_away(lo * scale)
    new = Rule(rule.feature, "continuous", lo, hi, rule.mean, rule.std, scale, base, scaled_edges(new_cuts, scale, base))
    old_edges, new_edges = [rule.lo, *cuts, rule.hi], [lo, *new_cuts, hi]
    mapping = {}
    for b in range(bins):
        overlap = [min(old_edges[b + 1], new_edges[n + 1]) - max(old_edges[b], new_edges[n]) for n in range(bins)]
        mapping[b] = max(range(bins), key=lambda n: (overlap[n], -n))
    return new, mapping


def shrunk(rule: Rule, counts: dict[int, int], bins: int, most: int = 2) -> tuple[Rule, dict[int, int]]:
    """A continuous rule without up to ``most`` empty bins at each end, its edges spread again; and the new bin of every old one."""
    if rule.kind != "continuous":
        return rule, {b: b for b in range(bins)}
    low = next((b for b in range(min(most, bins - 1)) if counts.get(b, 0)), min(most, bins - 1))
    high = next((b for b in range(min(most, bins - 1)) if counts.get(bins - 1 - b, 0)), min(most, bins - 1))
    if low + high == 0 or low + high >= bins - 1:
        return rule, {b: b for b in range(bins)}
    cuts = [rule.lo, *[(e + rule.baseline) / rule.scale for e in rule.edges], rule.hi]
    lo, hi = cuts[low], cuts[bins - high]
    kept = cuts[low : bins - high + 1]
    n = len(kept) - 1
    new_cuts = []
    for b in range(1, bins):  # the kept edges, stretched over all bins
        at = b * n / bins
        i = min(int(at), n - 1)
        new_cuts.append(kept[i] + (kept[i + 1] - kept[i]) * (at - i))
    scale = axis_scale(lo, hi)
    base = _half_away(lo * scale)
    mapping = {b: min(max(int((b - low) * bins / n), 0), bins - 1) for b in range(bins)}
    return Rule(rule.feature, "continuous", lo, hi, rule.mean, rule.std, scale, base, scaled_edges(new_cuts, scale, base)), mapping


def remapped(df: DataFrame, maps: dict[str, dict[int, int]]) -> DataFrame:
    """Bins replaced through one small map a feature; bins that are not in it stay."""
    out = {}
    for name, m in maps.items():
        pairs = F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
        out[name] = F.coalesce(F.element_at(pairs, F.col(name).cast("int")), F.col(name).cast("int"))
    return df.withColumns(out)


class PendingRemap:
    """Bin maps that are applied once when a dataset is next read, and then cleared."""

    def __init__(self) -> None:
        self.maps: dict[str, dict[int, int]] = {}
        self.version = 0

    def add(self, feature: str, mapping: dict[int, int]) -> None:
        old = self.maps.get(feature)
        self.maps[feature] = {b: mapping.get(n, n) for b, n in old.items()} if old else dict(mapping)

    def read(self, df: DataFrame) -> DataFrame:
        if not self.maps:
            return df
        maps, self.maps, self.version = self.maps, {}, self.version + 1
        return remapped(df, maps)


def label_ids(df: DataFrame, label: str) -> DataFrame:
    """(label, label_id): the distinct labels in order, numbered from 0."""
    from pyspark.sql.window import Window

    return df.select(label).filter(F.col(label).isNotNull()).distinct().select(label, (F.row_number().over(Window.orderBy(label)) - 1).cast("long").alias("label_id"))
