"""Sets and saturating multisets of ids, as tables (id, cnt)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiset(df: DataFrame, column: str, bits: int | None = None) -> DataFrame:
    """Counts of a column's values; with ``bits`` they saturate at 2**bits - 1."""
    n = df.groupBy(F.col(column).alias("id")).agg(F.count("*").alias("cnt"))
    return n if bits is None else n.withColumn("cnt", F.least("cnt", F.lit((1 << bits) - 1)))


def _met(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    return a.select("id", F.col("cnt").alias("ca")).join(b.select("id", F.col("cnt").alias("cb")), "id", how)


def multiset_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """The larger count of each id."""
    return _met(a, b, "full_outer").select("id", F.greatest(F.coalesce("ca", F.lit(0)), F.coalesce("cb", F.lit(0))).alias("cnt"))


def multiset_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """The smaller count of each id that both have."""
    return _met(a, b, "inner").select("id", F.least("ca", "cb").alias("cnt"))


def multiset_plus(a: DataFrame, b: DataFrame, bits: int | None = None) -> DataFrame:
    """The left counts, one more for every id on the right."""
    out = _met(a, b, "full_outer").select("id", (F.coalesce("ca", F.lit(0)) + F.col("cb").isNotNull().cast("long")).alias("cnt"))
    return out if bits is None else out.withColumn("cnt", F.least("cnt", F.lit((1 << bits) - 1)))


def multiset_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """The left side without any id that the right side has."""
    return a.join(b, "id", "left_anti")


def is_subset(a: DataFrame, b: DataFrame) -> bool:
    """Whether no id of a is more frequent than in b."""
    return _met(a, b, "left").filter(F.col("ca") > F.coalesce("cb", F.lit(0))).isEmpty()


def filled(spark, lo: int, hi: int) -> DataFrame:
    """Each id of a range once."""
    return spark.range(lo, hi + 1).select("id", F.lit(1).cast("long").alias("cnt"))


def without_range(a: DataFrame, lo: int, hi: int) -> DataFrame:
    return a.filter((F.col("id") < lo) | (F.col("id") > hi))


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys of both sides and shared, Jaccard index, and the share of each side's rows with a shared key. Zero and null keys count on no side."""
    clean = lambda d: d.filter(F.col(key).isNotNull() & (F.col(key) != 0)).groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    x = clean(a).withColumnRenamed("n", "na").join(clean(b).withColumnRenamed("n", "nb"), "k", "full_outer")
    both = F.col("na").isNotNull() & F.col("nb").isNotNull()
    rate = lambda c: F.coalesce(F.sum(F.when(both, F.col(c))) / F.when(F.sum(c) > 0, F.sum(c)), F.lit(0.0))
    return x.agg(
        F.count("na").alias("keys_a"), F.count("nb").alias("keys_b"), F.count_if(both).alias("shared"),
        F.coalesce(F.count_if(both) / F.when(F.count("*") > 0, F.count("*")), F.lit(0.0)).alias("jaccard"), rate("na").alias("rate_a"), rate("nb").alias("rate_b"),
    )
