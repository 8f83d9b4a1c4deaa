"""Ordered sums, row numbers and exact quantiles without a task that holds a whole group.

Keys are cut into ranges at approximate quantiles, as many as there are shuffle
partitions, so a range has its share of the rows whatever the distribution. Each
range is summed, what earlier ranges hold is added, and a window orders single
ranges only. Ranges depend on the rows' keys alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges at most, and how many are looked up at once: a range is found in two steps.
MOST_RANGES, STEP = 4096, 64


def _ranges(df: DataFrame) -> int:
    return min(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8), MOST_RANGES)


def _splitters(key: str, ranges: int) -> Column:
    """Aggregate: the keys between the ranges, in rising order without repeats."""
    q = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    return F.array_sort(F.array_distinct(F.percentile_approx(key, q, F.lit(ranges * 20))))


def _place(key: Column, cuts: Column) -> Column:
    """The number of cuts up to a key; ``cuts`` are in order."""
    heads = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(cuts) / STEP) - 1, F.lit(0))), lambda i: F.get(cuts, (i * STEP).cast("int")))
    k = F.size(F.filter(heads, lambda x: x <= key))
    return F.when(k == 0, 0).otherwise((k - 1) * STEP + F.size(F.filter(F.slice(cuts, (k - 1) * STEP + 1, F.lit(STEP)), lambda x: x <= key)))


def running_sums(df: DataFrame, key: str, columns: list[str], by: list[str] | None = None, descending: bool = False, tie: str | None = None) -> DataFrame:
    """``df`` with ``c_before``, the sum of c over the rows before in order of a numeric ``key`` (then ``tie``), and ``c_total``, of each of ``columns``; in each group of ``by``, where nulls are a group.

    Rows with a null key come first in rising order and last in falling order. Only
    rows with one and the same key and group meet in one task by need.
    """
    by = by or []
    names = df.columns
    cuts = df.agg(F.coalesce(_splitters(key, _ranges(df)), F.array().cast(df.select(F.array(key)).schema[0].dataType)).alias("_cuts"))
    placed = df.join(F.broadcast(cuts))  # one row of at most MOST_RANGES keys
    placed = placed.withColumn("_range", F.when(F.col(key).isNull(), -1).otherwise(_place(F.col(key), F.col("_cuts")))).drop("_cuts")
    sums = placed.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    order = F.desc("_range") if descending else F.asc("_range")
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = sums.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_range").alias("_at"), *[zero(F.sum(f"_{c}").over(before)).alias(f"_{c}_0") for c in columns], *[zero(F.sum(f"_{c}").over(whole)).alias(f"{c}_total") for c in columns])
    on = F.col("_range") == F.col("_at")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    inside = [F.desc(key) if descending else F.asc(key), *([F.asc(tie)] if tie else [])]
    w = Window.partitionBy(*by, "_range").orderBy(*inside).rowsBetween(Window.unboundedPreceding, -1)
    met = placed.join(sums if by else F.broadcast(sums), on)  # without groups a row a range
    return met.select(*names, *[(F.col(f"_{c}_0") + zero(F.sum(c).over(w))).alias(f"{c}_before") for c in columns], *[f"{c}_total" for c in columns])


def numbered(df: DataFrame, key: str, by: list[str] | None = None, tie: str | None = None) -> DataFrame:
    """``row_no`` from 0 in order of ``key`` within each group of ``by``, and ``n``, the group's rows."""
    x = running_sums(df.withColumn("_one", F.lit(1).cast("long")), key, ["_one"], by, tie=tie)
    return x.drop("_one").withColumnsRenamed({"_one_before": "row_no", "_one_total": "n"})


def quantiles(long: DataFrame, by: str, value: str, q: list[float]) -> DataFrame:
    """(by, q array<double>): exact quantiles of each group with linear interpolation; nulls do not count.

    Rows become one a distinct value first. Of each group's ranges only those that
    hold a wanted rank are ordered.
    """
    counts = long.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("_g"), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    cuts = counts.groupBy(F.col("_g").alias("_h")).agg(_splitters("_v", _ranges(long)).alias("_cuts"))
    placed = counts.join(F.broadcast(cuts), F.col("_g").eqNullSafe(F.col("_h"))).select("_g", "_v", "_n", _place(F.col("_v"), F.col("_cuts")).alias("_range"))  # a row a group
    over = Window.partitionBy("_g")
    cells = placed.groupBy("_g", "_range").agg(F.sum("_n").alias("_c"))
    cells = cells.withColumns({"_before": F.coalesce(F.sum("_c").over(over.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_c").over(over)})
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), r.alias("rank")) for i, p in enumerate(q) for r in (F.floor(F.lit(float(p)) * (F.col("_all") - 1)), F.ceil(F.lit(float(p)) * (F.col("_all") - 1)))])
    wanted = F.filter(ranks, lambda x: (x["rank"] >= F.col("_before")) & (x["rank"] < F.col("_before") + F.col("_c")))
    hit = cells.withColumn("_wanted", F.array_distinct(wanted)).filter(F.size("_wanted") > 0).select(F.col("_g").alias("_h"), F.col("_range").alias("_at"), "_before", "_all", "_wanted")
    rows = placed.join(hit, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_range") == F.col("_at")))
    start = F.col("_before") + F.coalesce(F.sum("_n").over(Window.partitionBy("_g", "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_start", start)
    found = rows.select("_g", "_v", "_all", F.explode(F.filter("_wanted", lambda x: (x["rank"] >= F.col("_start")) & (x["rank"] < F.col("_start") + F.col("_n")))).alias("w"))
    out = []
    for i, p in enumerate(q):
        at = F.lit(float(p)) * (F.max("_all") - 1)
        lo, hi = (F.max(F.when((F.col("w.i") == i) & (F.col("w.rank") == f(F.lit(float(p)) * (F.col("_all") - 1))), F.col("_v"))) for f in (F.floor, F.ceil))
        out.append(F.when(F.ceil(at) == F.floor(at), lo).otherwise(lo * (F.ceil(at) - at) + hi * (at - F.floor(at))))
    return found.groupBy(F.col("_g").alias(by)).agg(F.array(*out).alias("q"))
