"""Repeated passages across documents by sparse suffixes.

Words (ASCII letters in lower case) are the alphabet. A passage is made of
windows of ``least`` words. Of all suffixes only those are kept that begin at a
*minimiser*: in every window the one of its ``SEED``-word grams with the smallest
hash. Documents that share a window share the gram and its place in the window.

1. Grams at kept places are counted; only those that two documents hold go on.
   A bitmap sized by their number (see ``idfilter``) carries them to the second
   reading. Grams are half as long as a passage, so few go on that are part of none.
2. A kept suffix goes on with the hashes of all windows that have it as their
   minimiser, which lie side by side. Suffixes meet by gram, and every window of
   each is looked up among those of the same gram: each split of ``least`` words
   to the left and right of the gram is compared, whatever lies next to it in any
   order. Windows of one gram are told apart by ``WINDOW_BYTES`` bytes of hash.
3. The windows of a gram that more than ``HOT`` suffixes have (a line that a third
   of the documents hold) meet by their own hash instead, so no task gets them
   all: the windows that two documents hold are found with a first count on the
   map side, and joined with all.
4. Windows that another document has mark words; overlapping or touching marks of
   a document make one passage.

Edge cases: texts that are null or have under ``least`` words have no window
and no passage. Rows with a null doc_id are left out. Rows that repeat a doc_id
are one document: what only they share is not a repeat across documents. An
empty table gives an empty result. Repeats within one document don't count. Very
long texts are read wholly; other columns than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch
from .idfilter import has_bit, hash_bits
from .textkernel import U64, mix, shingles, signed, slices, span_hash, text_buffer, word_bounds

LEAST, SEED, WINDOW_BYTES = 50, 25, 6
#: Suffixes with one gram that are compared in one task at most.
HOT = 20_000
SUFFIX = "key long, doc_id long, pos int, windows binary"
MARK = "doc_id long, lo int, hi int"


def minimisers(h: np.ndarray, begin: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first grams, places) of all windows within a document's grams ``begin[i]`` to ``begin[i + 1]``: the place is that of the smallest (then leftmost) gram."""
    n = np.diff(begin)
    if len(h) < window or not (n >= window).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = max(int(len(h)).bit_length(), 1)
    low = (U64(1) << U64(bits)) - U64(1)
    best = (h & ~low) | np.arange(len(h), dtype=U64)
    size = 1
    while size * 2 <= window:  # smallest of 1, 2, 4, ... entries
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < window:
        best = np.minimum(best[: len(best) - (window - size)], best[window - size :])
    count = np.maximum(n - window + 1, 0)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[:-1], count)
    return at, (best[at] & low).astype(np.int64)


def _kept(buf: np.ndarray, offs: np.ndarray, least: int):
    """(grams, all windows' first grams, the kept suffixes' first windows (one entry more than suffixes), their documents, first words and gram hashes).

    The windows that have a suffix's gram as their minimiser lie side by side.
    """
    starts, ends, first = word_bounds(buf, offs)
    grams, begin = shingles(span_hash(buf, starts, ends, lower=True), first, SEED, short=False)
    at, place = minimisers(grams, begin, least - SEED + 1)
    cut = np.append(np.flatnonzero(np.append(len(at) > 0, place[1:] != place[:-1])), len(at)) if len(at) else np.zeros(1, np.int64)
    doc = np.searchsorted(begin, at[cut[:-1]], "right") - 1
    return grams, at, cut, doc, at[cut[:-1]] - begin[doc], grams[place[cut[:-1]]]


def _grams(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            for i, j in slices(offs):
                *_, doc, _, key = _kept(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], least)
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), batch.column(0).slice(i, j - i).take(pa.array(doc))], names=["key", "doc_id"])

    return run


def _flat(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of all numbers from ``begin`` to ``end`` of each row."""
    count = end - begin
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begin[row]


def _suffixes(least: int, wanted: np.ndarray, hot: np.ndarray, alone: bool):
    """The suffixes whose gram is wanted and not hot, each with its windows; ``alone``: those whose gram is hot, a row a window with the window's hash as key."""
    steps = [*range(0, least - SEED, SEED), least - SEED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            for i, j in slices(offs):
                grams, at, cut, doc, pos, key = _kept(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], least)
                hit = has_bit(key, wanted) & (np.isin(key, hot) == alone)
                if not hit.any():
                    continue
                row, window = _flat(cut[:-1][hit], cut[1:][hit])
                h = np.zeros(len(window), U64)
                for step in steps:  # grams that cover the window
                    h = mix(h * U64(0x9E3779B97F4A7C15) + grams[at[window] + step])
                doc, pos, key, first = doc[hit], pos[hit], key[hit], cut[:-1][hit]
                ids = batch.column(0).slice(i, j - i)
                if alone:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(h)), ids.take(pa.array(doc[row])), pa.array((pos[row] + window - first[row]).astype(np.int32))], names=["key", "doc_id", "pos"])
                    continue
                ends = np.searchsorted(row, np.arange(len(doc) + 1)).astype(np.int32) * np.int32(WINDOW_BYTES)
                short = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :WINDOW_BYTES])
                windows = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(short.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), ids.take(pa.array(doc)), pa.array(pos.astype(np.int32)), windows], names=["key", "doc_id", "pos", "windows"])

    return run


def _marks(table: pa.Table, least: int) -> pa.RecordBatch:
    """The words of the windows that another document has with the same gram."""
    key, doc, pos = (table.column(c).to_numpy() for c in ("key", "doc_id", "pos"))
    windows = table.column("windows").to_pylist()
    short = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW_BYTES)
    h = np.pad(short, ((0, 0), (0, 8 - WINDOW_BYTES))).view(U64).ravel()
    end = np.cumsum(np.array([len(w) for w in windows], np.int64) // WINDOW_BYTES)
    begin = np.append(0, end[:-1])
    row, number = _flat(np.zeros(len(end), np.int64), end - begin)
    h = mix(key.view(U64)[row] * U64(0x9E3779B97F4A7C15) + h)
    order = np.argsort(h, kind="stable")
    new = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    held = doc[row][order]
    several = np.minimum.reduceat(held, new) < np.maximum.reduceat(held, new)
    shared = np.zeros(len(h), bool)
    shared[order] = np.repeat(several, np.diff(np.append(new, len(h))))
    at = np.flatnonzero(shared)
    if len(at):  # windows of a suffix that lie side by side make one mark
        ends = np.append((np.diff(at) > 1) | (np.diff(row[at]) > 0), True)
        lo, hi = at[np.append(True, ends[:-1])], at[ends]
    else:
        lo = hi = at
    return pa.RecordBatch.from_arrays([pa.array(doc[row[lo]]), pa.array((pos[row[lo]] + number[lo]).astype(np.int32)), pa.array((pos[row[hi]] + number[hi] + least).astype(np.int32))], names=["doc_id", "lo", "hi"])


def _compared(least: int):
    """Marks of suffixes that come sorted by gram, a gram's all in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1], "left"))  # the last gram may go on in the next batch
            if last or (waiting and waiting[-1].column(0)[-1].as_py() != key[0]):
                waiting.append(batch.slice(0, last))
                yield _marks(pa.Table.from_batches(waiting), least)
                waiting = []
            waiting.append(batch.slice(last))
        if waiting:
            yield _marks(pa.Table.from_batches(waiting), least)

    return run


def repeated_passages(docs: DataFrame, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, n_words): all maximal runs of words of a document that windows of ``least`` words cover which other documents have, too."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    keys = docs.mapInArrow(_grams(least), "key long, doc_id long").groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    keys, _ = scratch.cut(keys.select("key", "n"), "grams")
    common = np.sort(keys.filter(F.col("n") > hot).select("key").toArrow().column("key").to_numpy())  # a gram of each HOT suffixes at most
    held = spark.sparkContext.broadcast((hash_bits(keys.select(F.col("key").alias("h"))), common.view(U64)))

    def kept(alone: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _suffixes(least, *held.value, alone)(batches)

        return run

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    marks = docs.mapInArrow(kept(False), SUFFIX).repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_compared(least), MARK)
    if len(common):
        windows = docs.mapInArrow(kept(True), "key long, doc_id long, pos int")
        several = windows.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("key")
        marks = marks.union(windows.join(several, "key", "left_semi").select("doc_id", F.col("pos").alias("lo"), (F.col("pos") + least).alias("hi")))
    by_doc = Window.partitionBy("doc_id").orderBy("lo", "hi")
    reach = F.max("hi").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    marks = marks.withColumn("new", F.coalesce((F.col("lo") > reach).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    out = marks.groupBy("doc_id", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return out.select("doc_id", F.col("lo").cast("long").alias("start_word"), (F.col("hi") - F.col("lo")).cast("long").alias("n_words"))


def op5_sparse_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that documents share."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
