"""A bitmap of hashed ids that lets the rows of an id set through where they lie.

The bitmap has ``PER_ID`` bits for each id that it holds, at most 2**``MOST_BITS``
in all, the bound of what is broadcast. A row that passes by chance is dropped by
the exact join that follows, so a fuller bitmap costs time and loses nothing. So
texts of rows that no join needs are not shuffled.

Edge cases: an empty id set lets no row through. A null id is in no set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
PER_ID, LEAST_BITS, MOST_BITS = 16, 16, 28


def bits_for(n: int) -> int:
    return min(max((n * PER_ID - 1).bit_length(), LEAST_BITS), MOST_BITS)


def hash_bits(hashes: DataFrame) -> np.ndarray:
    """The bitmap of the hashes in column h, sized by their number."""
    bits = bits_for(hashes.count())
    place = hashes.select(F.col("h").bitwiseAND(F.lit((1 << bits) - 1)).alias("p"))
    words = place.select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("w").to_numpy().astype(np.int64)] = words.column("m").to_numpy()
    return out.view(U64)


def id_bits(ids: DataFrame) -> np.ndarray:
    """The bitmap of the ids in column doc_id."""
    return hash_bits(ids.select(F.xxhash64("doc_id").alias("h")))


def has_bit(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    place = hashes.view(U64) & U64(len(bitmap) * 64 - 1)
    return (bitmap[(place >> U64(6)).astype(np.int64)] >> (place & U64(63))) & U64(1) == 1


def rows_by_bit(docs: DataFrame, held, wanted: bool) -> DataFrame:
    """The rows of ``docs`` whose doc_id may be in the set (``wanted``), or surely is not; ``held`` is the broadcast bitmap of :func:`id_bits`. Rows without an id surely are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield by_bit(b, held.value, wanted)

    return with_id_hash(docs).mapInArrow(run, docs.schema)


def with_id_hash(docs: DataFrame) -> DataFrame:
    """All columns and, last, the hash that :func:`by_bit` looks up."""
    return docs.select("*", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).alias("_id_hash"))


def by_bit(batch: pa.RecordBatch, bitmap: np.ndarray, wanted: bool) -> pa.RecordBatch:
    """The rows of a batch of :func:`with_id_hash` that have their bit set (``wanted``) or not, without the hash."""
    h = batch.column(batch.num_columns - 1)
    hit = has_bit(pc.fill_null(h, 0).to_numpy(zero_copy_only=False), bitmap) & np.asarray(h.is_valid())
    kept = batch.filter(pa.array(hit == wanted))
    return pa.RecordBatch.from_arrays(kept.columns[:-1], schema=pa.schema(list(batch.schema)[:-1]))
