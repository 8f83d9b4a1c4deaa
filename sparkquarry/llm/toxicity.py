"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models, of toxic and of ordinary text, over words and
the beginnings of words (``STEM`` bytes), with one distribution shared by both
below them. N_c(. w) is the number of different words that w follows in texts of
class c (its continuation count), N(. w) that in all documents, and the count of
a beginning is the sum over its words:

    P_c(w) = max(N_c(. w) - D, 0) / N_c(. .) + rest * P_c(stem of w) * N(. w) / N(. stem)
    P_c(s) = max(N_c(. s) - D, 0) / N_c(. .) + rest * P(s),    P(x) = N(. x) / N(. .)

The discounts D (of counts 1, 2, 3 and more) come from the counts of counts of
each class and order. So a rare expression is smoothed by the counts that it and
its beginning have in the whole corpus. Log-likelihoods are given relative to the
shared P: log P_c(w) - log P(w). This leaves every comparison as it is, and a word
that neither class has needs no count of its own.

The comparison is that of the length-normalised log-likelihoods, toxic less
ordinary, of a document's span of ``SPAN`` words where it is greatest (of the whole
text, if it is shorter), so that a few abusive words in a long text are not
averaged away. A logistic unit of this one number gives the score; it is fitted on
labelled documents held out from the counts (every ``UNIT_OF``-th by crc32 of the
id), at most ``UNIT_DOCUMENTS`` of them (smallest hash of the id).

Class counts are taken from at most ``FIT_DOCUMENTS`` labelled documents of each
class (smallest hash of the id), whole texts: the bound of what is broadcast. The
shared counts cover all documents and every different pair of neighbouring words:
they are counted in the cluster, and only those of words that a class has reach
the model. Words are told apart by 64 bits of hash (the first 32 are those of the
beginning), contexts of one word by 30.

A bigram order on top of these (raw counts of both classes) was measured and left
out: it made held-out results worse (see README).

Labels are read from rows with crc32(doc_id as text) mod 4 <> 2 alone. A
repeated label of one document counts as toxic if any is.

Edge cases: a text that is null, empty or blank has a difference of 0. Very long
texts are read wholly. A null doc_id is not held out and has no label. Rows that
repeat a doc_id are scored each; all texts of a labelled id are learned from.
Other columns than doc_id and text are not read. Without labelled rows of both
classes, as with empty tables, every score is the share of toxic labels among
those that may be learned (0 if there are none). No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .textkernel import U64, mix, signed, slices, span_hash, text_buffer, word_bounds

STEM, SPAN, HELD_OUT, UNIT_OF, THRESHOLD = 5, 3, 2, 6, 0.3
FIT_DOCUMENTS, UNIT_DOCUMENTS = 50_000, 6_000
STEM_BITS = 32
LOW = U64((1 << (64 - STEM_BITS)) - 1)
#: Pairs that a task holds before it hands them on, and groups of words in which they meet at least.
HOLD, LEAST_BUCKETS = 1 << 21, 256

_MARK = np.zeros(256, bool)
_MARK[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def _crc() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def _held_out() -> Column:
    return F.coalesce(_crc() % 4 == HELD_OUT, F.lit(False))


def word_keys(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, first words): words in lower case without up to three marks at each end; a key begins with the hash of the word's beginning."""
    starts, ends, first = word_bounds(buf, offs)
    starts, ends = starts.copy(), ends.copy()
    for _ in range(3 if len(ends) else 0):
        ends -= (ends - starts > 1) & _MARK[buf[ends - 1]]
        starts += (ends - starts > 1) & _MARK[buf[starts]]
    word = span_hash(buf, starts, ends, lower=True)
    stem = span_hash(buf, starts, np.minimum(ends, starts + STEM), lower=True)
    return (stem & ~LOW) | (word & LOW), first


def _contexts(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """30 bits of hash of the word before each word, two free bits below them; 0 before a text's first."""
    out = np.zeros(len(keys), np.uint32)
    if len(keys):
        out[1:] = np.maximum((mix(keys[:-1]) >> U64(32)).astype(np.uint32) & ~np.uint32(3), 4)
        out[first[:-1][first[:-1] < len(keys)]] = 0
    return out


def _distinct(keys: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different (word, context); the classes in the two low bits of contexts are united."""
    if not len(keys):
        return keys, contexts
    h = mix(keys * U64(0x9E3779B97F4A7C15) + (contexts >> np.uint32(2)))
    order = np.argsort(h)
    h = h[order]
    new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return keys[order[new]], np.bitwise_or.reduceat(contexts[order], new)


PAIRS = "bucket int, words binary, counts binary, contexts binary"


def _packed(keys: np.ndarray, contexts: np.ndarray, kinds: int, split: int) -> pa.RecordBatch:
    """One row a bucket: its words, how many contexts each has here, and these. A word's contexts are split over ``split`` buckets."""
    bucket = (mix(keys) % U64(kinds)).astype(np.int64) * split + ((contexts >> np.uint32(2)) % np.uint32(split)).astype(np.int64)
    order = np.lexsort((keys, bucket))
    keys, contexts, bucket = keys[order], contexts[order], bucket[order]
    new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (bucket[1:] != bucket[:-1])))
    ends = np.append(new, len(keys))
    counts, words = np.diff(ends).astype(np.uint32), keys[new]
    at = np.flatnonzero(np.append(True, bucket[new][1:] != bucket[new][:-1]))
    rows = [(words[a:b].tobytes(), counts[a:b].tobytes(), contexts[ends[a] : ends[b]].tobytes()) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(new)], strict=True)]
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(bucket[new][at].astype(np.int32)), *(pa.array(c, pa.binary()) for c in columns)], names=[c.split()[0] for c in PAIRS.split(", ")])


def _pairs(kinds: int, split: int):
    """The different (word, word before) of all texts, with the classes that have each (bit 0 toxic, bit 1 ordinary). Columns: text, toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return _distinct(*(np.concatenate([x[c] for x in held]) for c in (0, 1)))

        for batch in batches:
            label = batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
            bit = np.where(label == 1, 1, np.where(label == 0, 2, 0)).astype(np.uint32)
            buf, offs = text_buffer(batch.column(0))
            for i, j in slices(offs):
                keys, first = word_keys(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                if not len(keys):
                    continue
                held.append(_distinct(keys, _contexts(keys, first) | np.repeat(bit[i:j], np.diff(first))))
                size += len(held[-1][0])
                if size > HOLD:
                    held = [joined()]
                    size = len(held[0][0])
                    if size > HOLD // 2:
                        yield _packed(*held[0], kinds, split)
                        held, size = [], 0
        if held:
            yield _packed(*joined(), kinds, split)

    return run


def _counted(table: pa.Table) -> pa.Table:
    """The number of different contexts of each word of one bucket, of all texts and of each class."""
    words, counts, contexts = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("words", U64), ("counts", np.uint32), ("contexts", np.uint32)))
    keys, contexts = _distinct(np.repeat(words, counts), contexts)
    keys, back, every = np.unique(keys, return_inverse=True, return_counts=True)
    of = [np.bincount(back, contexts >> np.uint32(c) & np.uint32(1), minlength=len(keys)).astype(np.int64) for c in (0, 1)]
    return pa.table({"word": pa.array(signed(keys)), "every": pa.array(every), "toxic": pa.array(of[0]), "ordinary": pa.array(of[1])})


def continuation_counts(docs: DataFrame) -> DataFrame:
    """(word, every, toxic, ordinary): for each word the number of different words before it, in all texts and in those of each class. ``docs``: text, toxic (null: unknown)."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), LEAST_BUCKETS)
    split = -(-parts // 64)  # the contexts of one word meet in so many groups
    pairs = docs.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_pairs(max(parts // split, 1), split), PAIRS)
    names = ("every", "toxic", "ordinary")
    counts = pairs.groupBy("bucket").applyInArrow(_counted, "word long, every long, toxic long, ordinary long")
    return counts.groupBy("word").agg(*(F.sum(c).alias(c) for c in names))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts of one, two, and three or more from the counts of counts; kept above 0 where a count of counts is 0."""
    a, b, c, d = (max(n, 1) for n in (n1, n2, n3, n4))
    y = a / (a + 2 * b)
    return tuple(float(np.clip(k - (k + 1) * y * more / less, 0.1, k - 0.05)) for k, more, less in ((1, b, a), (2, c, b), (3, d, c)))


def _spectrum(table: DataFrame) -> dict[str, tuple[float, tuple[float, float, float], float]]:
    """class -> (total, discounts, mass handed down) of a table with a row a word or beginning; one row of sums is collected."""
    names = [f"{c}_{k}" for c in ("toxic", "ordinary") for k in ("total", 1, 2, 3, 4, "more")]
    sums = [e for c in ("toxic", "ordinary") for e in (F.sum(c), *(F.count_if(F.col(c) == k) for k in (1, 2, 3, 4)), F.count_if(F.col(c) >= 3))]
    got = table.agg(*(e.alias(n) for e, n in zip(sums, names, strict=True))).first()
    out = {}
    for c in ("toxic", "ordinary"):
        total, *n, more = (got[f"{c}_{k}"] or 0 for k in ("total", 1, 2, 3, 4, "more"))
        d = discounts(*n)
        out[c] = (float(max(total, 1)), d, (n[0] * d[0] + n[1] * d[1] + more * d[2]) / max(total, 1) if total else 1.0)
    return out


def _taken(column: str, d: tuple[float, float, float]) -> Column:
    n = F.col(column)
    return F.when(n == 0, 0.0).when(n == 1, 1 - d[0]).when(n == 2, 2 - d[1]).otherwise(n - d[2])


@dataclass(frozen=True)
class ToxicModel:
    """Relative log-likelihoods (toxic, ordinary) of words and of the beginnings of other words, and of words with neither."""

    words: np.ndarray  # sorted keys
    word_values: np.ndarray
    stems: np.ndarray  # sorted, the first bits of keys
    stem_values: np.ndarray
    unknown: np.ndarray
    unit: tuple[float, float] = (0.0, 0.0)  # weight of the difference, offset

    def relative(self, keys: np.ndarray) -> np.ndarray:
        """log P_c(w) - log P(w) of each word for both classes."""
        keys, back = np.unique(keys, return_inverse=True)
        out = np.tile(self.unknown.astype(float), (len(keys), 1))
        for table, values, wanted in ((self.stems, self.stem_values, keys >> U64(64 - STEM_BITS)), (self.words, self.word_values, keys)):
            if len(table):
                at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
                ok = table[at] == wanted
                out[ok] = values[at[ok]]
        return out[back]

    def compare(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Each text's length-normalised toxic and ordinary log-likelihood, and the largest difference of a span."""
        keys, first = word_keys(buf, offs)
        n = np.diff(first)
        total = np.concatenate([np.zeros((1, 2)), np.cumsum(self.relative(keys), axis=0)]) if len(keys) else np.zeros((1, 2))
        out = np.zeros((len(n), 3))
        out[:, :2] = (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)[:, None]
        out[:, 2] = out[:, 0] - out[:, 1]
        long = np.flatnonzero(n >= SPAN)
        if len(long):
            gap = total[:, 0] - total[:, 1]
            mean = (gap[SPAN:] - gap[:-SPAN]) / SPAN
            # the last place where a span may begin is SPAN words before a text's end
            edges = np.stack([first[long], first[long + 1] - SPAN + 1], axis=1).ravel()
            out[long, 2] = np.maximum.reduceat(np.append(mean, -np.inf), edges)[::2]
        return out

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.unit[0] * difference + self.unit[1], -60, 60)))


def build_model(counts: DataFrame) -> ToxicModel:
    """The model of continuation counts; what is collected are the words and beginnings that a class has."""
    stem = F.shiftrightunsigned("word", 64 - STEM_BITS)
    sums = [F.sum(c).alias(f"{c}_of_stem") for c in ("every", "toxic", "ordinary")]
    stems, _ = scratch.cut(counts.groupBy(stem.alias("stem")).agg(*sums), "stems")
    total = float(stems.agg(F.sum("every_of_stem")).first()[0] or 1)
    classes = ("toxic", "ordinary")
    low = _spectrum(stems.select(*(F.col(f"{c}_of_stem").alias(c) for c in classes)))
    high = _spectrum(counts)
    shared = F.col("every_of_stem") / total
    below = {c: _taken(f"{c}_of_stem", low[c][1]) / low[c][0] / shared + low[c][2] for c in classes}
    known = counts.filter("toxic > 0 or ordinary > 0").withColumn("stem", stem).join(stems, "stem")
    value = {c: F.log(_taken(c, high[c][1]) / high[c][0] / (F.col("every") / total) + high[c][2] * below[c]).cast("float").alias(c[0]) for c in classes}
    words = known.select("word", *(value[c] for c in classes)).toArrow()
    begins = stems.filter("toxic_of_stem > 0 or ordinary_of_stem > 0").select("stem", *(F.log(high[c][2] * below[c]).cast("float").alias(c[0]) for c in classes)).toArrow()

    def table(t: pa.Table, key: str) -> tuple[np.ndarray, np.ndarray]:
        keys = t.column(key).to_numpy().view(U64)
        order = np.argsort(keys)
        return keys[order], np.column_stack([t.column("t").to_numpy(), t.column("o").to_numpy()]).astype(np.float32).reshape(-1, 2)[order]

    return ToxicModel(*table(words, "word"), *table(begins, "stem"), np.array([np.log(high[c][2] * low[c][2]) for c in classes], np.float32))


def _fit_unit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Logistic regression on one number by Newton steps, each halved until the penalised loss falls."""
    x = np.column_stack([x, np.ones(len(x))])
    theta = np.array([0.0, np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))])
    penalty = np.array([ridge, 0.0])

    def loss(t: np.ndarray) -> float:
        z = x @ t
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + (penalty * t * t).sum() / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-6), x.T @ (p - y) + penalty * theta)
        now = loss(theta)
        while loss(theta - step) > now and np.abs(step).max() > 1e-7:
            step = step / 2
        theta = theta - step
        if np.abs(step).max() < 1e-6:
            break
    return float(theta[0]), float(theta[1])


RESULT = "doc_id long, toxic_loglik double, ordinary_loglik double, span_difference double"


def _compared(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            for i, j in slices(offs):
                x = model.compare(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(x[:, c]) for c in range(3)), pa.array(model.score(x[:, 2]))], names=[c.split()[0] for c in f"{RESULT}, score double".split(", ")])

    return run


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(doc_id, both log-likelihoods a word, largest span difference, score) of every row of ``docs`` (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # words of FIT_DOCUMENTS documents a class
    return docs.select("doc_id", "text").mapInArrow(_compared(held), f"{RESULT}, score double")


def fit(docs: DataFrame, labels: DataFrame, documents: int = FIT_DOCUMENTS, unit_documents: int = UNIT_DOCUMENTS) -> ToxicModel:
    """Count, build both models and fit the unit."""
    marked = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked, _ = scratch.cut(marked, "labels")
    apart = F.floor(_crc() / 4) % UNIT_OF == 0

    def smallest(rows: DataFrame, n: int) -> DataFrame:
        return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)

    learned = smallest(marked.filter(~apart & (F.col("toxic") == 1)), documents).union(smallest(marked.filter(~apart & (F.col("toxic") == 0)), documents))
    texts = docs.filter("text is not null").select("doc_id", "text")
    counts, _ = scratch.cut(continuation_counts(texts.join(F.broadcast(learned), "doc_id", "left")), "continuations")  # ids and labels, 2 * documents rows
    model = build_model(counts)
    chosen = smallest(marked.filter(apart), unit_documents)
    rows = score_toxicity(texts.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"), model).groupBy("doc_id").agg(F.max("span_difference").alias("x")).join(F.broadcast(chosen), "doc_id")
    rows = rows.orderBy("doc_id").toPandas()  # unit_documents rows of numbers
    y = rows.toxic.to_numpy().astype(float)
    share = marked.agg(F.avg("toxic")).first()[0] or 0.0
    if model.words.size == 0 or len(y) == 0 or y.min() == y.max():
        unit = (0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    else:
        unit = _fit_unit(rows.x.to_numpy(), y)
    return replace(model, unit=unit)


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "toxic_loglik", "ordinary_loglik", "span_difference")
