"""Column statistics and filters over wide numeric tables.

Statistics are taken in long form (feature, value), so one aggregate serves any
number of columns and the plan does not grow with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import log1p_abs, sanitize
from .ranks import quantiles

BINARY_LEAST, HASH_LEAST = 0.005, 0.01
CV_MOST, OUTLIER_MOST, KURTOSIS_MOST, FILL_LEAST, IQR_TIMES = 50.0, 0.05, 100.0, 0.10, 5.0
RESCUE_CV, RESCUE_KURTOSIS = 10.0, 20.0


def select_features(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns in that order; missing columns and nulls are 0.0."""
    return df.select(*[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(c) for c in names])


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns, or an error that lists the first five missing ones."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"{len(missing)} columns are missing: {', '.join(missing[:5])}")
    return df.select(*names)


def align(frames: dict[str, DataFrame], held_out: set[str] = frozenset()) -> DataFrame:
    """Splits under one schema with a ``split`` column: the first split's columns, then sorted extras that splits other than the held-out ones have; gaps are 0.0."""
    first = next(iter(frames))
    base = list(frames[first].columns)
    extras = sorted({c for name, f in frames.items() if name not in held_out for c in f.columns} - set(base))
    out = None
    for name, f in frames.items():
        part = select_features(f, base + extras).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def sanitized(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({c: sanitize(F.col(c)) for c in names})


def unpivoted(df: DataFrame, names: list[str], keys: list[str] | None = None) -> DataFrame:
    """Long form (keys, feature, value)."""
    return df.unpivot(keys or [], [F.col(c).cast("double").alias(c) for c in names], "feature", "value")


def column_moments(df: DataFrame, names: list[str]) -> DataFrame:
    """One row a feature: count, mean, sample and population moments, range, distinct values, excess kurtosis, non-zero share, binary or not."""
    v = F.col("value")
    # distinct values are counted by a first grouping, which Spark combines on the map side
    counts = unpivoted(df, names).groupBy("feature", "value").agg(F.count("*").alias("n"))
    base = unpivoted(df, names).groupBy("feature").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var_samp"), F.stddev_samp(v).alias("std_samp"), F.stddev_pop(v).alias("std_pop"),
        F.min(v).alias("lo"), F.max(v).alias("hi"), F.kurtosis(v).alias("kurtosis"), F.avg((v != 0).cast("double")).alias("nonzero"),
        F.min(v.isin(0.0, 1.0).cast("int")).alias("is_binary"),
    )
    return base.join(counts.filter(v.isNotNull()).groupBy("feature").agg(F.count("*").alias("n_distinct")), "feature")


def column_quantiles(df: DataFrame, names: list[str], q: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one row a feature, columns q0, q1, ..."""
    x = quantiles(unpivoted(df, names), "feature", "value", q)
    return x.select("feature", *[F.col("q")[i].alias(f"q{i}") for i in range(len(q))])


def variance_filter(moments: DataFrame, variance_least: float = 0.0, normalised_least: float = 1e-6, hash_mark: str = "hash_") -> DataFrame:
    """(feature, kept, reason) by rules in this order: constant, rare binary, inactive hash bucket, small normalised variance."""
    spread = (F.col("hi") - F.col("lo")) * (F.col("hi") - F.col("lo"))
    reason = (
        F.when((F.col("var_samp") <= variance_least) | (F.col("n_distinct") <= 1), "constant")
        .when((F.col("is_binary") == 1) & (F.least("mean", 1 - F.col("mean")) < BINARY_LEAST), "rare_binary")
        .when(F.col("feature").contains(hash_mark) & (F.col("nonzero") < HASH_LEAST), "inactive_hash")
        .when(F.col("var_samp") / (spread + 1e-15) < normalised_least, "small_variance")
    )
    return moments.select("feature", reason.isNull().alias("kept"), F.coalesce(reason, F.lit("kept")).alias("reason"))


def stability_filter(df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, kept, use_log, ...): unstable columns go unless log1p(abs(x)) is stable; binary columns stay."""
    v = F.col("value")
    long = unpivoted(df, names)
    kind = long.groupBy("feature").agg(F.min(v.isin(0.0, 1.0).cast("int")).alias("is_binary"))
    fence = quantiles(long, "feature", "value", [0.25, 0.75]).join(kind, "feature").select("feature", "is_binary", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")).withColumn("iqr", F.col("q3") - F.col("q1"))
    out = (v < F.col("q1") - IQR_TIMES * F.col("iqr")) | (v > F.col("q3") + IQR_TIMES * F.col("iqr"))
    low = log1p_abs(v)
    cv = lambda m, s: F.col(s) / (F.abs(F.col(m)) + 1e-15)
    # the fences are one row a feature
    stats = long.join(F.broadcast(fence), "feature").groupBy("feature").agg(
        F.first("is_binary").alias("is_binary"), F.avg(v).alias("m"), F.stddev_samp(v).alias("s"), F.kurtosis(v).alias("k"), F.avg(out.cast("double")).alias("outliers"), F.avg((v != 0).cast("double")).alias("fill"),
        F.avg(low).alias("lm"), F.stddev_samp(low).alias("ls"), F.kurtosis(low).alias("lk"),
    )
    unstable = (cv("m", "s") > CV_MOST) | (F.col("outliers") > OUTLIER_MOST) | (F.coalesce(F.col("k"), F.lit(0.0)) > KURTOSIS_MOST) | (F.col("fill") < FILL_LEAST)
    rescued = (cv("lm", "ls") < RESCUE_CV) & (F.coalesce(F.col("lk"), F.lit(0.0)) < RESCUE_KURTOSIS)
    binary = F.col("is_binary") == 1
    return stats.select("feature", (binary | ~unstable | rescued).alias("kept"), (~binary & unstable & rescued).alias("use_log"), "outliers", "fill", "k")


PRODUCTS = "i int, j int, n long, sx double, sy double, sxx double, syy double, sxy double"


def _products(width: int, shift: list[float]):
    """Sums of one task's rows for every pair of columns in which both have a value; values are taken from ``shift``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, width, width))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - np.array(shift)
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            for k, (a, b) in enumerate(((m, m), (x, m), (m, x), (x * x, m), (m, x * x), (x, x))):
                total[k] += a.T @ b
        i, j = np.triu_indices(width, 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[0][i, j].astype(np.int64)), *(pa.array(total[k][i, j]) for k in range(1, 6))], names=[c.split()[0] for c in PRODUCTS.split(", ")])

    return run


def correlation_pairs(df: DataFrame, names: list[str], least: float = 0.0) -> DataFrame:
    """(a, b, r) of all column pairs with absolute Pearson correlation above ``least``; a row counts for a pair if both have a value.

    Products are taken as matrices where the rows are, about the columns' means, so
    the plan does not grow with the columns; a task hands on a row a pair.
    """
    x = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    mean = x.agg(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in names]).first()  # one row
    sums = x.mapInArrow(_products(len(names), [float(m) for m in mean]), PRODUCTS).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    noise = F.array(*[F.lit((abs(float(m)) * 1e-12) ** 2) for m in mean])  # a constant column's rounding is no variance
    r = F.when((vx > n * n * noise[F.col("i")]) & (vy > n * n * noise[F.col("j")]), F.abs((n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx) / F.sqrt(vy)))
    name = lambda c: F.array(*[F.lit(x) for x in names])[F.col(c)]
    return sums.select(name("i").alias("a"), name("j").alias("b"), F.when(r > 1, 1.0).otherwise(r).alias("r")).filter(F.col("r") > least)


def prune_correlated(pairs: list[tuple[str, str, float]], variance: dict[str, float]) -> list[str]:
    """Columns to drop. Pairs go by falling correlation; of a pair the column with more live partners goes, else the one with less variance, else the second.

    The rule is sequential; its input is one row a pair of columns, so it runs on the driver.
    """
    ordered = sorted(pairs, key=lambda p: (-p[2], p[0], p[1]))
    partners: dict[str, set[str]] = {}
    for a, b, _ in ordered:
        partners.setdefault(a, set()).add(b)
        partners.setdefault(b, set()).add(a)
    gone: list[str] = []
    for a, b, _ in ordered:
        if a in gone or b in gone:
            continue
        da, db = (len(partners[x] - set(gone)) for x in (a, b))
        if da != db:
            gone.append(a if da > db else b)
        else:
            gone.append(a if variance.get(a, 0.0) < variance.get(b, 0.0) else b)
    return gone


def cohens_d(df: DataFrame, names: list[str], positive: Column) -> DataFrame:
    """(feature, cohens_d): absolute difference of class means over the pooled population deviation."""
    long = unpivoted(df.withColumn("_positive", positive), names, ["_positive"])
    side = lambda p: F.when(F.col("_positive") == p, F.col("value"))
    x = long.groupBy("feature").agg(F.avg(side(False)).alias("mb"), F.avg(side(True)).alias("mm"), F.var_pop(side(False)).alias("vb"), F.var_pop(side(True)).alias("vm"))
    return x.select("feature", (F.abs(F.col("mb") - F.col("mm")) / (F.sqrt(0.5 * (F.col("vb") + F.col("vm"))) + 1e-10)).alias("cohens_d"))


def top_features(ranked: DataFrame, k: int) -> DataFrame:
    """The k features of largest effect, with their rank in rising order (the best comes last)."""
    top = ranked.orderBy(F.desc("cohens_d"), "feature").limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.asc("cohens_d"), F.desc("feature"))).cast("long"))


def group_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Counts for every key, every prefix of the keys and in total."""
    return df.rollup(*keys).agg(F.count("*").alias("n"))


def first_per_group(df: DataFrame, key: str, order: list[Column | str], skip_zero: bool = True) -> DataFrame:
    """One representative a key in the given order; rows whose key is zero or null stand for themselves and are left out."""
    rows = df.filter((F.col(key) != 0) & F.col(key).isNotNull()) if skip_zero else df
    struct = F.struct(*order, F.struct(*[F.col(c) for c in df.columns]).alias("_row"))
    return rows.groupBy(F.col(key).alias("_key")).agg(F.min(struct).alias("_s")).select("_s._row.*")


def column_group(name: Column, rules: list[tuple[str, str]], default: str = "unknown") -> Column:
    """Group of a column name by the first prefix that fits."""
    out, low = None, F.lower(name)
    for prefix, group in rules:
        out = F.when(low.startswith(prefix), group) if out is None else out.when(low.startswith(prefix), group)
    return out.otherwise(default) if out is not None else F.lit(default)


def byte_entropy(df: DataFrame, key: str, data: str) -> DataFrame:
    """(key, entropy) in bits of the bytes of a text (as UTF-8) or binary column; 0 for an empty or null one. Bytes are counted where the row is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, x in enumerate(batch.column(1)):
                raw = x.as_buffer() if x.is_valid else None
                if raw is not None and raw.size:
                    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
                    p = n[n > 0] / raw.size
                    out[i] = -(p * np.log2(p)).sum() + 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["key", "entropy"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(data).cast("binary").alias("data")).mapInArrow(run, f"key {kind}, entropy double").withColumnRenamed("key", key)
