"""Benchmark decontamination: size-partitioned MinHash containment search.

Finds test items inside documents: a pair is reported if at least ``percent``
per cent of the item's distinct ``k``-word shingles occur in the document
(lower case, words split at ASCII white space). DataFrame functions only.

Items are partitioned by size: partition p holds items of 2**p to 2**(p+1)-1
shingles. An item's signature are its m smallest shingle hashes, with one m for
the partition: u - ceil(percent * u / 100) + 1 for its upper bound u. A
document that holds ``percent`` of an item lacks at most u - ceil(percent * u /
100) of its shingles, so it holds at least one of any m: no pair is lost,
however long the document, which a signature of fixed size on the document's
side can't promise (the similarity of 30 shingles to 20,000 is 0.0015).

1. Documents are streamed once: their shingle hashes meet the signatures. The
   signatures are a few numbers an item; Spark broadcasts them only under its
   size threshold and shuffles both sides beyond.
2. Candidate pairs are verified exactly on the full shingle sets of the
   candidate documents, which are the only ones read again.

Edge cases: a null or repeated doc_id: null is no document, rows that repeat an
id are alternatives of which the best match counts. Rows that repeat an item_id
are one item with the shingles of all its rows; a null item_id is no item. Texts
that are null, empty or under k words have no shingle and match nothing. Very long
texts are read wholly. Other columns than the id and text are not read and pass the
pipeline stage. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

BLANKS = "[\\\\x20\\\\x09-\\\\x0D]+"


def shingle_hashes(text: str, k: int) -> Column:
    """array<long> of the hashes of all k-word shingles of a text column, in order; empty where there is none."""
    words = f"transform(array_remove(split(lower({text}), '{BLANKS}'), ''), w -> xxhash64(w))"
    window = ", ".join(f"element_at(h, i + {j})" for j in range(k))
    # two nested steps, as the hashes of the words are used k times
    return F.expr(f"flatten(transform(array({words}), h -> if(size(h) >= {k}, transform(sequence(1, size(h) - {k - 1}), i -> xxhash64({window})), cast(array() as array<bigint>))))")


def item_sets(items: DataFrame, k: int) -> DataFrame:
    """(item_id, members, n): the distinct shingles of every item that has any."""
    each = items.filter("item_id is not null and text is not null").select("item_id", F.explode(shingle_hashes("text", k)).alias("h"))
    return each.groupBy("item_id").agg(F.sort_array(F.collect_set("h")).alias("members")).withColumn("n", F.size("members").cast("long"))


def signatures(sets: DataFrame, percent: int) -> DataFrame:
    """(h, item_id): each item's smallest hashes, as many as its size partition asks for."""
    upper = F.expr("cast(shiftleft(2L, cast(floor(log2(n)) as int)) - 1 as bigint)")
    m = upper - F.ceil(upper * percent / 100) + 1
    return sets.select("item_id", F.explode(F.slice("members", F.lit(1), F.least(m, F.col("n")).cast("int"))).alias("h"))


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared): all pairs with 100 * shared >= percent * item_shingles."""
    docs = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    sets, _ = scratch.cut(item_sets(items, k), "items")
    marks, _ = scratch.cut(signatures(sets, percent), "signatures")
    stream = docs.select("doc_id", F.explode(shingle_hashes("text", k)).alias("h"))
    met = stream.join(marks, "h").select("doc_id", "item_id").distinct()
    pairs, _ = scratch.cut(met, "candidates")
    full = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", shingle_hashes("text", k).alias("s"))
    shared = F.size(F.array_intersect("members", "s")).cast("long")
    checked = full.join(pairs, "doc_id").join(sets, "item_id").select("doc_id", "item_id", F.col("n").alias("item_shingles"), shared.alias("shared"))
    best = checked.groupBy("doc_id", "item_id").agg(F.max("item_shingles").alias("item_shingles"), F.max("shared").alias("shared"))
    return best.filter(F.col("shared") * 100 >= F.col("item_shingles") * percent)


def op9_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of documents and benchmark items they contain."""
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that contain a benchmark item go; rows without a doc_id stay."""
    found = contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti")


_WORDS = "[x for x in regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+') if x <> '']"
ORACLE = f"""
with d as (select doc_id, {_WORDS} as w from documents where doc_id is not null and text is not null),
i as (select item_id, {_WORDS} as w from benchmark where item_id is not null and text is not null),
ds as (select distinct doc_id, array_to_string(w[p:p+4], ' ') as s from (select doc_id, w, unnest(generate_series(1, len(w) - 4)) as p from d)),
i_s as (select distinct item_id, array_to_string(w[p:p+4], ' ') as s from (select item_id, w, unnest(generate_series(1, len(w) - 4)) as p from i)),
n as (select item_id, count(*) as item_shingles from i_s group by item_id)
select doc_id, item_id, cast(item_shingles as bigint) as item_shingles, cast(count(*) as bigint) as shared
from ds join i_s using (s) join n using (item_id)
group by doc_id, item_id, item_shingles having 100 * count(*) >= 80 * item_shingles
"""
