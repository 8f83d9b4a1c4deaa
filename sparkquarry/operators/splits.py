"""Splits and their hygiene: duplicates, overlaps, families, similarity, stratified and k-fold parts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import written
from .ranks import numbered, quantiles
from .setops import key_overlap

#: Vectors that a block of the nested-loop joins holds, and queries that are multiplied at once.
QUERY_BLOCK, REF_BLOCK, STRIP = 2048, 8192, 256


def distinct_rows(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row for each combination of ``columns``: the one with the smallest ``order``."""
    rest = [c for c in df.columns if c not in columns]
    return df.groupBy(*columns).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*columns, "_r.*").select(*df.columns)


def without_rows_of(target: DataFrame, source: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of target whose values in ``columns`` source does not have; nulls equal nulls. Exact: no row hash is compared."""
    s = source.select(*[F.col(c).alias(f"_s_{c}") for c in columns]).distinct()
    cond = None
    for c in columns:
        here = F.col(c).eqNullSafe(F.col(f"_s_{c}"))
        cond = here if cond is None else cond & here
    return target.join(s, cond, "left_anti")


def shared_rows(target: DataFrame, source: DataFrame, columns: list[str]) -> int:
    return target.join(source.select(*columns).distinct(), columns, "left_semi").count()


def without_family_of(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Rows of target whose non-zero key source does not have; zero means unknown and never matches."""
    return target.join(source.filter(F.col(key) != 0).select(key).distinct(), key, "left_anti")


def _unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    x = np.array(column.to_pylist(), float)
    n = np.linalg.norm(x, axis=1)
    return x / np.where(n == 0, 1, n)[:, None]


def _tile(k: int, skip_self: bool):
    """The k best references of each query of a tile; of equal cosines the lower ids."""

    def run(queries: pa.Table, refs: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if queries.num_rows and refs.num_rows:
            ids, rid = queries.column("id").to_numpy(), refs.column("id").to_numpy()
            q, r = _unit_rows(queries.column("v")), _unit_rows(refs.column("v"))
            for at in range(0, len(ids), STRIP):
                sim = np.round(q[at : at + STRIP] @ r.T, 9)
                if skip_self:
                    sim[ids[at : at + STRIP, None] == rid[None, :]] = -np.inf
                least = np.partition(sim, -k, axis=1)[:, -k, None] if k < len(rid) else np.full((len(sim), 1), -np.inf)
                x, y = np.nonzero((sim >= least) & np.isfinite(sim))  # more than k of a query where cosines are equal
                order = np.lexsort((rid[y], -sim[x, y], x))
                x, y = x[order], y[order]
                place = np.arange(len(x)) - np.searchsorted(x, x)
                x, y = x[place < k], y[place < k]
                out.append((ids[at + x], rid[y], sim[x, y]))
        joined = [np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in range(3)]
        return pa.table({"id": pa.array(joined[0].astype(np.int64)), "neighbour": pa.array(joined[1].astype(np.int64)), "cosine": pa.array(joined[2].astype(float))})

    return run


def nearest_cosine(queries: DataFrame, refs: DataFrame, id_col: str, vec_col: str, k: int = 1, skip_self: bool = True) -> DataFrame:
    """(id, neighbour, cosine, place): the k most similar reference vectors of every query vector.

    The query set meets all references in tiles: queries are dealt to blocks of about
    ``QUERY_BLOCK`` and references to blocks of about ``REF_BLOCK`` by a hash of the
    id, and each pair of blocks is one matrix product in strips, which hands on its k
    best a query. Nothing goes through the driver; a task holds two blocks.
    """

    def dealt(df: DataFrame, size: int) -> tuple[DataFrame, int]:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).filter("id is not null and v is not null")
        blocks = max(-(-rows.count() // size), 1)
        return rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), blocks

    (q, nq), (r, nr) = dealt(queries, QUERY_BLOCK), dealt(refs, REF_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select("id", "v", F.col("own").alias("qb"), every(nr).alias("rb"))
    r = r.select("id", "v", every(nq).alias("qb"), F.col("own").alias("rb"))
    near = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(_tile(k, skip_self), "id long, neighbour long, cosine double")
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return near.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= k)


def max_cosine(queries: DataFrame, refs: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, cosine): the largest similarity of each query to any reference, 0 if there is none."""
    best = nearest_cosine(queries, refs, id_col, vec_col, 1, skip_self=False).select("id", "cosine")
    return queries.select(F.col(id_col).cast("long").alias("id")).join(best, "id", "left").select("id", F.coalesce("cosine", F.lit(0.0)).alias("cosine"))


def similarity_profile(a: DataFrame, b: DataFrame, id_col: str, vec_col: str, limits: tuple[float, ...] = (0.9, 0.95, 0.99)) -> DataFrame:
    """One row a direction: quantiles 0.5, 0.9, 0.99 and the largest of the maximal similarities, and counts at limits."""
    rows = None
    for name, x, y in (("a_to_b", a, b), ("b_to_a", b, a)):
        m, _ = written(max_cosine(x, y, id_col, vec_col), "similar")
        counts = m.agg(F.max("cosine").alias("most"), *[F.count_if(F.col("cosine") >= t).alias(f"at_least_{int(t * 100)}") for t in limits])
        one = quantiles(m.withColumn("all", F.lit(1)), "all", "cosine", [0.5, 0.9, 0.99]).join(F.broadcast(counts))  # a row each
        one = one.select(F.lit(name).alias("direction"), F.col("q")[0].alias("q50"), F.col("q")[1].alias("q90"), F.col("q")[2].alias("q99"), "most", *[f"at_least_{int(t * 100)}" for t in limits])
        rows = one if rows is None else rows.union(one)
    return rows


def mixing_rate(df: DataFrame, id_col: str, vec_col: str, side: Column, k: int = 5) -> DataFrame:
    """One row: the share of the k nearest neighbours that come from the other side."""
    sides = df.select(F.col(id_col).cast("long").alias("id"), side.alias("side"))
    near = nearest_cosine(df, df, id_col, vec_col, k)
    x = near.join(sides, "id").join(sides.withColumnRenamed("id", "neighbour").withColumnRenamed("side", "other"), "neighbour")
    return x.agg(F.avg((F.col("side") != F.col("other")).cast("double")).alias("cross_rate"), F.count("*").alias("neighbours"))


def separation_audit(train: DataFrame, test: DataFrame, columns: list[str], family: str, id_col: str | None = None, vec_col: str | None = None, limit: float = 0.99) -> tuple[DataFrame, dict]:
    """Remove from ``train`` what ``test`` has (equal rows, families, too similar vectors); the rest and the state after."""
    clean = without_family_of(without_rows_of(train, test, columns), test, family)
    most = None
    if vec_col:
        far = max_cosine(clean, test, id_col, vec_col)
        clean = clean.join(far.filter(F.col("cosine") < limit).select(F.col("id").alias(id_col)), id_col, "left_semi")
        most = far.filter(F.col("cosine") < limit).agg(F.max("cosine")).first()[0]
    overlap = key_overlap(clean, test, family).first().asDict()
    state = {"rows": clean.count(), "equal_rows": shared_rows(clean, test, columns), "largest_cosine": most, **overlap}
    state["sealed_pass"] = state["equal_rows"] == 0 and overlap["shared"] == 0
    return clean, state


def family_downsample(df: DataFrame, key: str, row_id: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows: one of each non-zero family first, then others, both in order of a seeded hash."""
    draw = F.xxhash64(F.lit(seed), F.col(row_id))
    reps = df.filter(F.col(key) != 0).groupBy(key).agg(F.min_by(row_id, draw).alias("_id")).select(F.col("_id").alias(row_id), F.lit(0).alias("_late"))
    marked = df.join(reps, row_id, "left").withColumn("_late", F.coalesce("_late", F.lit(1)))
    return marked.orderBy("_late", draw, row_id).limit(n).drop("_late")


def stratified_parts(df: DataFrame, label: str, order: Column | str, ratios: dict[str, float]) -> DataFrame:
    """A ``part`` for each row, label by label: consecutive ratios in the given numeric order, at least one row each where there are enough, the rest to the last."""
    x = numbered(df.withColumn("_order", order if isinstance(order, Column) else F.col(order)), "_order", [label]).drop("_order")
    names, total = list(ratios), sum(ratios.values())
    ends, at = [], 0.0
    for i, name in enumerate(names[:-1]):
        at += ratios[name] / total
        ends.append((name, F.greatest(F.floor(F.col("n") * F.lit(at) + 1e-9), F.least(F.lit(i + 1), F.col("n")))))
    part = None
    for name, end in ends:
        part = F.when(F.col("row_no") < end, name) if part is None else part.when(F.col("row_no") < end, name)
    return x.withColumn("part", part.otherwise(names[-1]) if part is not None else F.lit(names[-1])).drop("row_no", "n")


def kfold(df: DataFrame, key: str, k: int) -> DataFrame:
    """A ``fold`` from 1 to k in consecutive parts of nearly equal size by ``key``.

    Rows are numbered range by range (see ``ranks``), not by one global window.
    """
    x = numbered(df, key)
    big = F.col("n") % k
    size = F.floor(F.col("n") / k)
    fold = F.when(F.col("row_no") < big * (size + 1), F.floor(F.col("row_no") / (size + 1))).otherwise(big + F.floor((F.col("row_no") - big * (size + 1)) / F.greatest(size, F.lit(1))))
    return x.withColumn("fold", (fold + 1).cast("long")).drop("row_no", "n")


def require_rows(df: DataFrame, name: str, least: int = 1) -> DataFrame:
    """The frame, or an error if it has fewer rows than ``least``."""
    if df.limit(least).count() < least:
        raise ValueError(f"{name} has fewer than {least} rows")
    return df


def sealed_paths(val_path: str, test_path: str, expose_test_during_search: bool = False) -> None:
    """An error if the test split could be seen before the search is over."""
    if val_path == test_path:
        raise ValueError("validation and test paths are the same")
    if expose_test_during_search:
        raise ValueError("the test split must stay sealed during the search")


def resolve_split(names: list[str], preferred: str, pattern: str) -> str:
    """The preferred name, else the only one that matches a shell pattern; errors list up to five."""
    import fnmatch

    if preferred in names:
        return preferred
    found = sorted(n for n in names if fnmatch.fnmatch(n, pattern))
    if len(found) != 1:
        raise ValueError(f"{len(found)} names match {pattern}: {', '.join(found[:5])}")
    return found[0]


def prune_similar(query: DataFrame, refs: DataFrame, ranked: list[str], ks: list[int], id_col: str, limit: float, rounds: int) -> DataFrame:
    """Drop query rows that are too similar to a reference in any projection to the top-k features, until none is or ``rounds`` are over.

    Each round's rows are written to the shared folder.
    """
    for _ in range(rounds):
        bad = None
        for k in ks:
            names = ranked[-k:]
            stats = refs.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in names]).first()
            vec = F.array(*[(F.col(c) - float(stats[c].m)) / float(stats[c].s or 1.0) for c in names])
            near = max_cosine(query.withColumn("_v", vec), refs.withColumn("_v", vec), id_col, "_v").filter(F.col("cosine") >= limit).select(F.col("id").alias(id_col))
            bad = near if bad is None else bad.union(near)
        kept = query.join(bad.distinct(), id_col, "left_anti")
        kept, _ = written(kept, "pruned")
        if kept.count() == query.count():
            return kept
        query = kept
    return query
