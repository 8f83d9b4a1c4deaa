"""Harmonic packing of token sequences.

A sequence holds ``capacity`` tokens. Class k is that of the reciprocal k of the
capacity: its pieces have floor(capacity / k) tokens, and its bins hold k of
them. Every document (its ids, then an end id) is cut from the front: whole
sequences first, then the longest class length that what is left can fill, and
so on. The rest left after class k is shorter than capacity / k**2, so a
document has hardly more than three pieces besides the whole sequences.

Bins of a class are filled by number alone: piece number r of class k lies in
bin r // k at slot r % k. Workers number their own pieces, a table of the
counts of every (worker, class) gives each worker its first number, and every
worker then fills its bins without seeing another's pieces. Only the last bin
of a class can stay short. These few bins (under capacity tokens a class, so
bounded by the number of classes whatever the input) are strung together and
cut into whole sequences again; what remains of them is cut into sequences of
power-of-two length, which need no padding.

Edge cases: a null or empty text is a document of the end id alone. Rows with a
null or repeated doc_id are documents of their own and are packed like others.
Very long texts are encoded wholly and cut into many pieces. Other columns than
doc_id and text are not read. An empty table gives no piece.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.taskcontext import TaskContext

from . import scratch
from .textkernel import slices, text_buffer
from .tokenkernel import default_vocabulary, encoder

CAPACITY, END_ID = 2048, 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
CUT = f"{PIECE}, part int, rank long"
PACKED = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@functools.cache
def class_lengths(capacity: int) -> tuple[int, ...]:
    """The lengths floor(capacity / k) of all classes, longest first; there are under 2 * sqrt(capacity)."""
    return tuple(sorted({capacity // k for k in range(1, capacity + 1)}, reverse=True))


@functools.lru_cache(maxsize=1 << 16)
def pieces_of(rest: int, capacity: int) -> tuple[int, ...]:
    """How ``rest`` < capacity tokens are cut into class lengths."""
    out = []
    while rest:
        size = capacity // -(-capacity // rest)  # the longest class length that is no longer than rest
        out.append(size)
        rest -= size
    return tuple(out)


def _per_bin(capacity: int) -> np.ndarray:
    return np.concatenate([[0], capacity // np.arange(1, capacity + 1)])


def _cut(vocabulary: str, capacity: int, end_id: int, with_ids: bool):
    """Encode and cut; without ``with_ids`` only the last pieces of each class in this worker, which may end in a short bin, carry their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        per_bin, waiting = _per_bin(capacity), None
        for batch in batches:
            ids_col = batch.column(0)
            buf, offs = text_buffer(batch.column(1))
            for i, j in slices(offs):
                ids, begin = enc.encode(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                # every document's ids with the end id behind them
                flat = np.insert(ids, begin[1:], end_id).astype("<u4")
                begin = begin + np.arange(len(begin))
                total = np.diff(begin)
                lens = [(*([capacity] * (n // capacity)), *pieces_of(n % capacity, capacity)) for n in total.tolist()]
                count = np.array([len(x) for x in lens])
                length = np.fromiter((y for x in lens for y in x), np.int64, count.sum())
                at = np.cumsum(length) - length
                raw = memoryview(flat.tobytes())
                spans = [raw[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                # numbers of the pieces within the worker and their class
                order = np.argsort(length, kind="stable")
                sorted_len = length[order]
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.searchsorted(sorted_len, sorted_len, "left") + seen[sorted_len]
                seen += np.bincount(length, minlength=capacity + 1)
                late = rank >= (seen - per_bin)[length] if not with_ids else np.ones(len(rank), bool)
                doc = np.repeat(np.arange(j - i), count)
                made = pa.RecordBatch.from_arrays(
                    [
                        ids_col.slice(i, j - i).take(pa.array(doc)), pa.array(at - begin[:-1][doc]), pa.array(length), pa.array([zlib.crc32(x) for x in spans], pa.int64()), pa.array(total[doc]),
                        pa.array([bytes(x) if y else None for x, y in zip(spans, late.tolist(), strict=True)], pa.binary()), pa.array(np.full(len(length), part, np.int32)), pa.array(rank),
                    ],
                    names=[c.split()[0] for c in CUT.split(", ")],
                )
                if with_ids:
                    yield made
                    continue
                both = made if waiting is None else pa.concat_batches([waiting, made])
                done = both.column("rank").to_numpy() < (seen - per_bin)[both.column("length").to_numpy()]
                waiting = both.filter(pa.array(~done))
                ready = both.filter(pa.array(done))
                yield ready.set_column(5, "ids", pa.nulls(ready.num_rows, pa.binary()))
        if waiting is not None:
            yield waiting

    return run


def _string_together(capacity: int):
    """The pieces of the short bins, one after the other, cut at whole sequences; the rest of them at powers of two."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("length", "descending"), ("part", "ascending"), ("rank", "ascending")]).to_pylist()
        total = sum(r["length"] for r in rows)
        edges = list(range(0, total, capacity))
        at = edges.pop() if total else 0
        while at < total:
            edges.append(at)
            at += 1 << ((total - at).bit_length() - 1)
        edges.append(total)
        out, base = [], 0
        for r in rows:
            here, end = base, base + r["length"]
            while here < end:
                k = bisect.bisect_right(edges, here) - 1
                n = min(end, edges[k + 1]) - here
                own = r["ids"][4 * (here - base) : 4 * (here - base + n)]
                out.append({"doc_id": r["doc_id"], "start": r["start"] + here - base, "length": n, "ids_crc32": zlib.crc32(own), "doc_tokens": r["doc_tokens"], "ids": own, "bin": k, "offset": here - edges[k]})
                here += n
            base = end
        kinds = {"ids": pa.binary()}
        return pa.Table.from_pylist(out, pa.schema([(c, kinds.get(c, pa.int64())) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "bin", "offset")]))

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row a piece: ``PACKED`` and, if asked for, its ids as little-endian unsigned 32-bit integers."""
    cut, _ = scratch.cut(docs.select("doc_id", "text").mapInArrow(_cut(vocabulary or default_vocabulary(), capacity, end_id, with_ids), CUT), "pieces")
    counts = cut.groupBy("part", "length").agg((F.max("rank") + 1).alias("n"))
    by_part = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "length", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("length")).alias("n"))
    counts, _ = scratch.cut(counts, "counts")
    # under 2 * sqrt(capacity) classes, whatever the input
    classes = counts.groupBy("length").agg(F.max("n").alias("n")).orderBy(F.desc("length")).collect()
    base, rows = 0, []
    for c in classes:
        whole = c.n // (capacity // c.length)
        rows.append((c.length, base, whole))
        base += whole
    sizes = docs.sparkSession.createDataFrame(rows, "length long, base long, whole long")
    numbered = cut.join(counts.select("part", "length", "before"), ["part", "length"]).join(F.broadcast(sizes), "length").withColumn("number", F.col("before") + F.col("rank"))
    per_bin = F.floor(F.lit(capacity) / F.col("length"))
    in_whole = F.col("number") < F.col("whole") * per_bin
    whole = numbered.filter(in_whole).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", (F.col("base") + F.floor(F.col("number") / per_bin)).alias("sequence_id"), (F.pmod("number", per_bin) * F.col("length")).alias("offset"))
    short = numbered.filter(~in_whole).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "part", "rank")
    strung = short.groupBy(F.lit(0).alias("one")).applyInArrow(_string_together(capacity), f"{PIECE}, bin long, offset long")
    strung = strung.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", (F.lit(base) + F.col("bin")).alias("sequence_id"), "offset")
    out = whole.union(strung)
    return out.select(*PACKED, "ids") if with_ids else out.select(*PACKED)


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and places of all documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: pieces and places of the documents that are left."""
    return pack(docs, with_ids=False)
