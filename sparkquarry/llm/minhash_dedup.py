"""MinHash near-duplicate detection with odd sketches.

A document is the set of its distinct ``k``-word shingles (ASCII letters in
lower case, words split at ASCII white space; a document of 1 to k-1 words is
one shingle, one without words is the empty set, which is linked with nothing).

1. Every document gets ``bands * rows`` MinHash samples. Rows of samples are
   folded into band keys, and all samples into an *odd sketch*: a parity bitmap
   in which each (sample number, sample) flips one bit.
2. Equal sets are one class, represented by the smallest doc_id.
3. Representatives that share a band key are compared with one leader of the
   key: first with its smallest doc_id, in two more rounds with one drawn by a
   hash of key and doc_id. The exclusive or of two odd sketches has a population
   count from which the number of differing samples, and so the similarity, is
   estimated; at most ``limit`` of it is *near*. The count keeps the triangle
   inequality: what is near a member near the leader is within twice the limit,
   the ball. Members near the leader leave the key, as all they may be linked to
   is in the ball; those between are in the ball and go on, those outside go on.
   Members of a key that are left after the rounds are compared with each other
   in blocks, like the members of a ball.
4. What remains is a ball of candidates around each leader. Links to the leader
   are confirmed on the full sets. Those of a ball that are not linked to it may
   still be linked to each other or to linked ones: they are compared in blocks,
   by distance to the leader (the Jaccard distance keeps the triangle
   inequality), size and sketch first and then on the full sets, until they are
   joined. Only links that join something leave a block.
5. Links make components.

With 32 bands of 4 rows a pair at the threshold of 0.8 shares no key with a
probability of 5e-8, and 13 keys on average; under each they are compared.
The sets of candidates are built from a second reading of the documents, of
which a bitmap (see ``idfilter``) lets only candidates and a few others through,
so that texts are not shuffled.

Edge cases: null text and text without words have the empty set (n_shingles 0,
own component, kept). Rows that repeat a doc_id are one document: the row with the
largest set, of equally large ones that with the greatest two sums over its
members (``fingerprints``). The same row's set is compared and, in the pipeline,
the same row stays. A null doc_id is no document and gives no row; the pipeline
stage keeps such rows. Very long texts are read wholly. Other columns than doc_id
and text are not read and pass the pipeline stage. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .components import connected_components
from .idfilter import by_bit, id_bits, rows_by_bit, with_id_hash
from .textkernel import U64, long_lists, mix, shingles, signed, slices, span_hash, text_buffer, word_bounds

BANDS, ROWS, SKETCH_BITS, ROUNDS = 32, 4, 1024, 3
SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>, odd array<long>"
#: Members of a ball in a block.
BLOCK = 512


def _distinct(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.unique(h[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
    return (np.concatenate(parts) if parts else h[:0]), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)


def sketch_samples(h: np.ndarray, begin: np.ndarray, samples: int) -> np.ndarray:
    """MinHash samples, one row a set; every set has members."""
    rng = np.random.default_rng(20_14)
    flip = rng.integers(0, 1 << 32, samples, dtype=np.uint64).astype(np.uint32)
    times = rng.integers(0, 1 << 31, samples, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    low = (h >> U64(32)).astype(np.uint32)
    out = np.empty((len(begin) - 1, samples), np.uint32)
    tmp = np.empty_like(low)
    for i in range(samples):
        np.bitwise_xor(low, flip[i], out=tmp)
        np.multiply(tmp, times[i], out=tmp)
        np.bitwise_xor(tmp, tmp >> np.uint32(15), out=tmp)
        np.multiply(tmp, times[i] ^ np.uint32(0x2C1B3C6C), out=tmp)
        out[:, i] = np.minimum.reduceat(tmp, begin[:-1])
    return out


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmaps as ``bits / 64`` words a row: bit mix(i, sample) mod bits is flipped for every sample i."""
    n, k = samples.shape
    place = (mix(samples.astype(U64) * U64(0x9E3779B97F4A7C15) + np.arange(k, dtype=U64) * U64(0xD1B54A32D192ED03)) & U64(bits - 1)).astype(np.int64)
    counts = np.bincount((np.arange(n)[:, None] * bits + place).ravel(), minlength=n * bits).reshape(n, bits // 64, 64) & 1
    return (counts.astype(U64) << np.arange(64, dtype=U64)).sum(axis=2, dtype=U64)


def most_flips(similarity: float, samples: int, bits: int) -> int:
    """Population count above which a pair of sketches is given up: where the estimate is five deviations of the samples below ``similarity``."""
    differing = samples * (1 - similarity) + 5 * (samples * similarity * (1 - similarity)) ** 0.5
    return int(np.ceil(bits / 2 * (1 - np.exp(-4 * differing / bits))))


def estimated_similarity(flips: float, samples: int, bits: int) -> float:
    """The odd-sketch estimate of the Jaccard similarity from the population count of an exclusive or."""
    return 1 + bits / (4 * samples) * float(np.log1p(-min(2 * flips / bits, 1 - 1e-9)))


def _shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_bounds(buf, offs)
    return _distinct(*shingles(span_hash(buf, starts, ends, lower=True), first, k, short=True))


def fingerprints(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over the members of each set; 0 for the empty set."""
    some = np.flatnonzero(np.diff(begin))
    out = np.zeros((2, len(begin) - 1), U64)
    if len(some):
        out[0, some] = np.add.reduceat(mix(h), begin[some])
        out[1, some] = np.bitwise_xor.reduceat(mix(h ^ U64(0x1234567)), begin[some])
    return out


def _sketches(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            buf, offs = text_buffer(batch.column(1))
            for i, j in slices(offs):
                b, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                h, begin = _shingle_sets(b, o, k)
                size = np.diff(begin)
                some = np.flatnonzero(size)
                sums = fingerprints(h, begin)
                keys = np.zeros((len(some), bands), U64)
                odd = np.zeros((len(size), SKETCH_BITS // 64), U64)
                if len(some):
                    at = np.append(begin[some], begin[-1])
                    samples = sketch_samples(h, at, bands * rows)
                    odd[some] = odd_sketch(samples)
                    for x in range(bands):
                        key = np.full(len(some), x + 1, U64)
                        for y in range(rows):
                            key = mix(key * U64(0x9E3779B97F4A7C15) + samples[:, x * rows + y])
                        keys[:, x] = key
                ends_of = np.concatenate([[0], np.cumsum((size > 0) * bands)])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(size.astype(np.int64)), pa.array(signed(sums[0])), pa.array(signed(sums[1])), long_lists(signed(keys.ravel()), ends_of), long_lists(signed(odd.ravel()), np.arange(len(size) + 1) * odd.shape[1])],
                    names=[x.split()[0] for x in SKETCH.split(", ")],
                )

    return run


FULL = "doc_id long, n_shingles long, set_a long, set_b long, members array<long>"


def _sets(k: int, held):
    """Sorted shingle sets and what tells them apart, of the rows that the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = by_bit(batch, held.value, wanted=True)
            buf, offs = text_buffer(batch.column(1))
            for i, j in slices(offs):
                h, begin = _shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)
                sums = fingerprints(h, begin)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(begin)), pa.array(signed(sums[0])), pa.array(signed(sums[1])), long_lists(signed(h), begin)], names=[x.split()[0] for x in FULL.split(", ")])

    return run


def _with_fingerprints(k: int, held):
    """All columns and, behind them, the size and the sums of the text's set, of the rows that the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = by_bit(batch, held.value, wanted=True)
            buf, offs = text_buffer(batch.column(batch.schema.get_field_index("text")))
            for i, j in slices(offs):
                h, begin = _shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)
                sums = fingerprints(h, begin)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(begin)), pa.array(signed(sums[0])), pa.array(signed(sums[1]))], names=[*part.schema.names, "_set_n", "_set_a", "_set_b"])

    return run


def _flips(x: str, y: str):
    n = SKETCH_BITS // 64
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(1, n)), F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0])))


def _leaders(members: DataFrame, drawn: bool) -> DataFrame:
    """(key, doc_id, b): the members of each key of two or more with its leader, leaders themselves left out."""
    pick = F.min_by("doc_id", F.xxhash64("key", "doc_id")) if drawn else F.min("doc_id")
    led = members.groupBy("key").agg(pick.alias("b"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("key", "b")
    return members.join(led, "key").filter("doc_id <> b")


def _balls(members: DataFrame, light: DataFrame, limit: int, percent: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables (a, b) of members a and leaders b of their ball, one table a round; and the members (key, doc_id) left after the rounds."""
    out = []
    for r in range(ROUNDS):
        led, _ = scratch.cut(_leaders(members, drawn=r > 0), "led")
        pairs = led.select(F.col("doc_id").alias("a"), "b").distinct()
        pairs = pairs.join(light.select(F.col("doc_id").alias("a"), F.struct("n_shingles", "odd").alias("x")), "a").join(light.select(F.col("doc_id").alias("b"), F.struct("n_shingles", "odd").alias("y")), "b")
        small, large = F.least("x.n_shingles", "y.n_shingles"), F.greatest("x.n_shingles", "y.n_shingles")
        near = (F.col("flips") <= limit) & F.col("sized")
        # what may be linked to a member near the leader: both steps have the limit and the share of sizes
        ball = (F.col("flips") <= 2 * limit) & F.col("both_sized")
        judged = pairs.select("a", "b", _flips("x.odd", "y.odd").alias("flips"), (small * 100 >= large * percent).alias("sized"), (small * 10_000 >= large * percent**2).alias("both_sized"))
        judged, _ = scratch.cut(judged.select("a", "b", near.alias("near"), ball.alias("ball")), "judged")
        out.append(judged.filter("ball").select("a", "b"))
        members = led.join(judged.filter("not near").select(F.col("a").alias("doc_id"), "b"), ["doc_id", "b"], "left_semi").select("key", "doc_id")
    several = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    left, _ = scratch.cut(members.join(several, "key"), "left")
    return out, left


def _joined_in_block(limit: int, percent: int):
    """Links between the members of two blocks of a ball, of which at least one is not linked to the leader."""

    def run(table: pa.Table) -> pa.Table:
        block, i, j = (table.column(c).to_numpy() for c in ("block", "i", "j"))
        doc, n, linked, away = (table.column(c).to_numpy() for c in ("doc_id", "n_shingles", "linked", "away"))
        odd = np.stack(table.column("odd").to_numpy()).view(U64)
        members = table.column("members").to_numpy()
        left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
        root = {-1: -1}  # -1: the leader and what is linked to it

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x in np.flatnonzero(linked).tolist():
            root[x] = -1
        links = []
        for at in range(0, len(left), 64):
            rows = left[at : at + 64]
            ok = ~(linked[rows][:, None] & linked[right][None, :])
            if i[0] == j[0]:
                ok &= doc[rows][:, None] < doc[right][None, :]
            ok &= np.abs(away[rows][:, None] - away[right][None, :]) <= 1 - percent / 100 + 1e-9
            ok &= np.minimum(n[rows][:, None], n[right][None, :]) * 100 >= np.maximum(n[rows][:, None], n[right][None, :]) * percent
            x, y = np.nonzero(ok)
            x, y = rows[x], right[y]
            flips = np.bitwise_count(odd[x] ^ odd[y]).sum(axis=1)
            near = flips <= limit
            x, y, flips = x[near], y[near], flips[near]
            for k in np.argsort(flips, kind="stable").tolist():
                a, b = int(x[k]), int(y[k])
                if find(a) != find(b):
                    shared = len(np.intersect1d(members[a], members[b], assume_unique=True))
                    if shared * 100 >= (n[a] + n[b] - shared) * percent:
                        links.append((max(doc[a], doc[b]), min(doc[a], doc[b])))
                        a, b = find(a), find(b)
                        root[max(a, b)] = min(a, b)
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document with an id; ``docs`` needs doc_id and text.

    Two documents are linked if 100 * shared shingles >= percent * united shingles.
    """
    docs = docs.select("doc_id", "text").filter("doc_id is not null")
    sketches, _ = scratch.cut(docs.mapInArrow(_sketches(k, bands, rows), SKETCH), "sketches")
    one = ["n_shingles", "set_a", "set_b"]
    # of rows that repeat a doc_id the one with the largest set counts
    sets = sketches.groupBy("doc_id").agg(F.max(F.struct(*one)).alias("s")).select("doc_id", "s.*")
    filled = F.col("n_shingles") > 0
    classes, _ = scratch.cut(sets.filter(filled).groupBy(*one).agg(F.min("doc_id").alias("rep")), "classes")
    reps = sketches.join(classes.select(F.col("rep").alias("doc_id"), *one), ["doc_id", *one], "left_semi").dropDuplicates(["doc_id"])
    reps, _ = scratch.cut(reps.select("doc_id", *one, "keys", "odd"), "reps")
    limit = most_flips(percent / 100, bands * rows, SKETCH_BITS)
    light = reps.select("doc_id", "n_shingles", "odd")
    rounds, left = _balls(reps.select("doc_id", F.explode("keys").alias("key")), light, limit, percent)
    balls = rounds[0]
    for more in rounds[1:]:
        balls = balls.union(more)
    balls, _ = scratch.cut(balls.distinct(), "balls")
    wanted, _ = scratch.cut(balls.select(F.explode(F.array("a", "b")).alias("doc_id")).union(left.select("doc_id")).distinct(), "wanted")
    held = docs.sparkSession.sparkContext.broadcast(id_bits(wanted))
    full = with_id_hash(docs).mapInArrow(_sets(k, held), FULL)
    # of rows that repeat a doc_id the set that was sketched
    full = full.join(reps.join(wanted, "doc_id", "left_semi").select("doc_id", *one), ["doc_id", *one], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "members")
    full, _ = scratch.cut(full, "sets")
    # each member with its leader
    both = balls.join(full.select(F.col("doc_id").alias("a"), F.col("members").alias("x")), "a").join(full.select(F.col("doc_id").alias("b"), F.col("members").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    measured = both.select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y")).alias("sizes")).select("a", "b", (F.col("shared") * 100 >= (F.col("sizes") - F.col("shared")) * percent).alias("linked"), (1 - F.col("shared") / (F.col("sizes") - F.col("shared"))).alias("away"))
    measured, _ = scratch.cut(measured, "measured")
    # members of a ball that are not linked to its leader
    cut = measured.groupBy("b").agg(F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("loose")).filter("loose > 0 and n > 1")
    cut = cut.select("b", F.ceil(F.col("loose") / BLOCK).cast("int").alias("loose_blocks"), F.ceil((F.col("n") - F.col("loose")) / BLOCK).cast("int").alias("linked_blocks"))
    own = F.pmod(F.xxhash64("a"), F.when(F.col("linked"), F.col("linked_blocks")).otherwise(F.col("loose_blocks"))).cast("int")
    # loose blocks are 0 to loose_blocks - 1, linked ones lie behind; a pair of blocks has a loose one
    met = measured.join(cut, "b").withColumn("block", F.when(F.col("linked"), F.col("loose_blocks") + own).otherwise(own))
    others = F.when(F.col("linked"), F.sequence(F.lit(0), F.col("loose_blocks") - 1)).otherwise(F.sequence(F.lit(0), F.col("loose_blocks") + F.col("linked_blocks") - 1))
    met = met.select("b", F.col("a").alias("doc_id"), "linked", "away", "block", F.explode(others).alias("o")).select("b", "doc_id", "linked", "away", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    met = met.join(light, "doc_id").join(full, "doc_id")
    more = met.groupBy("b", "i", "j").applyInArrow(_joined_in_block(limit, percent), "a long, b long")
    # members left of a key: blocks of a ball that has no leader
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    apart = left.select("key", "doc_id", F.lit(False).alias("linked"), F.lit(0.0).alias("away"), F.pmod(F.xxhash64("doc_id"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o"))
    apart = apart.select("key", "doc_id", "linked", "away", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j")).join(light, "doc_id").join(full, "doc_id")
    rest = apart.groupBy("key", "i", "j").applyInArrow(_joined_in_block(limit, percent), "a long, b long").distinct()
    comps = connected_components(measured.filter("linked").select("a", "b").union(more).union(rest))
    placed = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(*one, F.coalesce("component", "rep").alias("component"))
    component = F.coalesce("component", "doc_id")
    return sets.join(placed, one, "left").select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def op2_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents on four-word shingles at 80 percent."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=80)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group stays (five-word shingles, 80 percent), one row each; rows without a doc_id stay.

    Only rows whose id goes or is repeated are shuffled, with the others that the bitmap lets through.
    """
    judged, _ = scratch.cut(near_duplicates(docs, k=5, percent=80).select("doc_id", "kept"), "judged-ids")
    several = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    open_, _ = scratch.cut(judged.filter("not kept").select("doc_id").union(several).distinct(), "open-ids")
    held = spark.sparkContext.broadcast(id_bits(open_))
    found = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    marked = with_id_hash(docs).mapInArrow(_with_fingerprints(5, held), f"{found}, _set_n long, _set_a long, _set_b long")  # one Python worker a task
    best = marked.join(judged.filter("kept").select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by(F.struct(*docs.columns), F.struct("_set_n", "_set_a", "_set_b", "text")).alias("_row"))
    return rows_by_bit(docs, held, wanted=False).union(best.select("_row.*"))
