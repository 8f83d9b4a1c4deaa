"""Quality rules by line labelling.

Every line with a word is labelled content or boilerplate by Viterbi decoding
of a linear-chain conditional random field; the share of a document's words in
content lines decides whether the document stays. Base rules (too few words,
too many words in repeated three-word windows) reject before that.

The field is trained here, on documents with a quality label, of which at most
``FIT_DOCUMENTS`` of each class are used (those with the smallest hash of their
id), of longer ones ``FIT_LINES`` consecutive lines at a hashed place: the only
bounded sample; counts and decisions cover every line of every document. A line starts with its document's
label; lines of rejected documents that the fitted field sees as content are
relabelled and the field is fitted again.

Edge cases: null or blank text has no line, no word, fails the base rules and
is not kept. Rows with a null doc_id or a repeated one are judged like any
other row; every input row gives one output row, and an empty table none. Very long
texts are read wholly. Other columns than doc_id and text are not read and pass the
pipeline stage. Of rows that repeat a labelled doc_id the least features of each
line are learned from. Without labelled documents of both classes the base rules
alone decide (content_share is 1).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkernel import U64, mix, shingles, slices, span_hash, text_buffer, word_bounds

FIT_DOCUMENTS, FIT_LINES, FIT_ROUNDS = 2000, 200, 2
LEAST_WORDS, LEAST_SHARE = 50, 0.5
FEATURES = ("bias", "symbols", "capitals", "exclamations", "bars", "digits", "repeated_line", "repeated_words", "length", "short", "sentence_end", "word_length", "first", "last")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80
_WORDCHAR = _LEAD.copy()
_WORDCHAR[[9, 10, 11, 12, 13, 32]] = False


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends] - total[starts]


def _line_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, documents) of all lines; every document has at least one."""
    nl = np.flatnonzero(buf == 10)
    doc = np.searchsorted(offs, nl, "right") - 1
    n, at = len(offs) - 1, np.arange(len(nl)) + doc
    first = np.arange(n + 1) + np.searchsorted(nl, offs)
    starts, ends = np.empty(n + len(nl), np.int64), np.empty(n + len(nl), np.int64)
    starts[first[:-1]], starts[at + 1] = offs[:-1], nl + 1
    ends[first[1:] - 1], ends[at] = offs[1:], nl
    return starts, ends, np.repeat(np.arange(n), np.diff(first))


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all, later): which keys occur more than once, and which are not the first of their kind."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    every, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    every[order] = np.append(same, False) | np.append(False, same)
    return every, later


def measure(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of every document (one row of ``COUNTS`` each), and of every line with a word: features, document and words."""
    n = len(offs) - 1
    starts, ends, first = word_bounds(buf, offs)
    words = np.diff(first)
    counts = np.zeros((n, 5), np.int64)
    counts[:, 0] = words
    counts[:, 1] = _sums(_WORDCHAR[buf], offs[:-1], offs[1:])
    counts[:, 2] = _sums(_SYMBOL[buf], offs[:-1], offs[1:])
    # words that lie in a three-word window which the text has twice or more
    h, begin = shingles(span_hash(buf, starts, ends, lower=False), first, 3, short=False)
    size = np.diff(begin)
    own = np.repeat(np.arange(n), size)
    twice, _ = _again(mix(h + own.astype(U64) * U64(0x9E3779B97F4A7C15)))
    at = (np.arange(len(h)) - np.repeat(begin[:-1], size) + np.repeat(first[:-1], size))[twice]
    repeated = np.zeros(len(starts), bool)
    for j in range(3):
        repeated[at + j] = True
    counts[:, 4] = _sums(repeated, first[:-1], first[1:])
    a, b, doc = _line_bounds(buf, offs)
    w0, w1 = np.searchsorted(starts, a), np.searchsorted(starts, b)
    full = w1 > w0
    a, b, doc, w0, w1 = a[full], b[full], doc[full], w0[full], w1[full]
    key = span_hash(buf, a, b, lower=False)
    _, later = _again(mix(key + doc.astype(U64) * U64(0xD1B54A32D192ED03)))
    counts[:, 3] = np.bincount(doc[later], minlength=n)
    nw = (w1 - w0).astype(float)
    chars = np.maximum(_sums(_WORDCHAR[buf], a, b), 1)
    upper, lower = _sums((buf >= 65) & (buf <= 90), a, b), _sums((buf >= 97) & (buf <= 122), a, b)
    x = np.zeros((len(a), len(FEATURES)))
    x[:, 0] = 1
    x[:, 1] = np.minimum(_sums(_SYMBOL[buf], a, b) / nw, 3)
    x[:, 2] = upper / np.maximum(upper + lower, 1)
    x[:, 3] = np.minimum(_sums(buf == 33, a, b) / nw, 2)
    x[:, 4] = np.minimum(_sums(buf == 124, a, b) / nw, 1)
    x[:, 5] = _sums((buf >= 48) & (buf <= 57), a, b) / chars
    x[:, 6] = later
    x[:, 7] = _sums(repeated, w0, w1) / nw
    x[:, 8] = np.log1p(nw) / 4
    x[:, 9] = nw <= 3
    x[:, 10] = np.isin(buf[ends[w1 - 1] - 1], list(b".!?"))
    x[:, 11] = np.minimum(chars / nw / 10, 3)
    edge = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    x[:, 13] = edge
    x[:, 12] = np.append(True, edge[:-1]) if len(doc) else edge
    return counts, x, doc, nw


@dataclass(frozen=True)
class LineField:
    """Weights of the field: ``emit`` (2 x features), ``move`` (from x to). State 1 is content."""

    emit: np.ndarray
    move: np.ndarray

    def decode(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The most probable labels of all lines, document by document, all documents in lock step."""
        if not len(doc):
            return np.zeros(0, np.int64)
        score, (begin, length, order) = x @ self.emit.T, _sequences(doc)
        best = np.zeros((len(doc), 2))
        back = np.zeros((len(doc), 2), np.int8)
        best[begin] = score[begin]
        for t in range(1, int(length.max())):
            at = begin[order[: np.searchsorted(-length[order], -t, "left")]] + t
            via = best[at - 1][:, :, None] + self.move
            back[at] = via.argmax(axis=1)
            best[at] = via.max(axis=1) + score[at]
        out = np.zeros(len(doc), np.int64)
        last = begin + length - 1
        out[last] = best[last].argmax(axis=1)
        for t in range(int(length.max()) - 1, 0, -1):
            at = begin[order[: np.searchsorted(-length[order], -t, "left")]] + t
            out[at - 1] = back[at, out[at]]
        return out


def _sequences(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    length = np.diff(np.append(begin, len(doc)))
    return begin, length, np.argsort(-length, kind="stable")


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit_field(x: np.ndarray, doc: np.ndarray, y: np.ndarray, steps: int = 120, ridge: float = 1e-3) -> LineField:
    """Maximum conditional likelihood by gradient ascent with adaptive steps; classes weigh alike."""
    begin, length, order = _sequences(doc)
    seq = np.repeat(np.arange(len(begin)), length)
    rejected = np.array([y[b : b + n].mean() < 0.5 for b, n in zip(begin, length, strict=True)])
    weight = np.where(rejected, 0.5 / max(rejected.sum(), 1), 0.5 / max((~rejected).sum(), 1)) / np.sqrt(length)
    weight /= weight.sum()
    theta = np.zeros(2 * x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    gold = np.eye(2)[y]
    inside = np.ones(len(doc), bool)
    inside[begin] = False
    later = np.flatnonzero(inside)
    steps_at = [begin[order[: np.searchsorted(-length[order], -t, "left")]] + t for t in range(int(length.max()))]
    for step in range(1, steps + 1):
        emit, move = theta[:-4].reshape(2, -1), theta[-4:].reshape(2, 2)
        score = x @ emit.T
        alpha, beta = score.copy(), np.zeros_like(score)
        for at in steps_at[1:]:
            alpha[at] += _lse(alpha[at - 1][:, :, None] + move, 1)
        for at in reversed(steps_at[1:]):
            beta[at - 1] = _lse(move + (score[at] + beta[at])[:, None, :], 2)
        z = _lse(alpha[begin + length - 1], 1)[seq]
        p = np.exp(alpha + beta - z[:, None])
        pair = np.exp(alpha[later - 1][:, :, None] + move + (score[later] + beta[later])[:, None, :] - z[later][:, None, None])
        w = weight[seq]
        g_emit = ((gold - p) * w[:, None]).T @ x
        g_move = np.einsum("n,nij->ij", w[later], gold[later - 1][:, :, None] * gold[later][:, None, :] - pair)
        g = np.concatenate([g_emit.ravel(), g_move.ravel()]) - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return LineField(theta[:-4].reshape(2, -1), theta[-4:].reshape(2, 2))


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = text_buffer(batch.column(1))
        quality = batch.column(2).to_numpy(zero_copy_only=False)
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j in slices(offs):
            _, x, doc, _ = measure(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            if not len(doc):
                continue
            begin, length, _ = _sequences(doc)
            line = np.arange(len(doc)) - np.repeat(begin, length)
            # FIT_LINES lines from a place that the document's id decides
            spare = np.maximum(length - FIT_LINES, 0) + 1
            place = (mix(ids[i:j][doc[begin]].astype(np.int64).view(U64)) % spare.astype(U64)).astype(np.int64)
            use = (line >= np.repeat(place, length)) & (line < np.repeat(place + FIT_LINES, length))
            yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][doc[use]]), pa.array(line[use]), pa.array(quality[i:j][doc[use]].astype(np.int32)), pa.array(list(x[use]), pa.list_(pa.float64()))], names=["doc_id", "line", "quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, documents: int = FIT_DOCUMENTS) -> LineField | None:
    """The field fitted on at most ``documents`` labelled documents of each class."""
    marked = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = [marked.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents) for q in (0, 1)]
    chosen = chosen[0].union(chosen[1])  # at most 2 * documents rows of two integers
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = sample.mapInArrow(_fit_rows, "doc_id long, line long, quality int, x array<double>")
    got = rows.groupBy("doc_id", "line").agg(F.min(F.struct("quality", "x")).alias("s")).select("doc_id", "line", "s.*").toPandas()  # FIT_LINES rows a document
    if got.quality.nunique() < 2:
        return None
    got = got.sort_values(["doc_id", "line"])
    x, doc, given = np.stack(got.x.to_numpy()), got.doc_id.to_numpy(), got.quality.to_numpy()
    y = given.copy()
    field = fit_field(x, doc, y)
    for _ in range(FIT_ROUNDS - 1):
        # lines of rejected documents may be content; those of accepted ones stay as given
        y = np.where(given == 1, 1, np.minimum(field.decode(x, doc), 1))
        y = np.where((given == 0) & (x @ (field.emit[1] - field.emit[0]) < 0), 0, y)
        if (y == 0).any():
            field = fit_field(x, doc, y)
    return field


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, content_share double"


def _judge(field: LineField | None, least_words: int, least_share: float, passing: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffer(batch.column(batch.schema.get_field_index("text")))
            for i, j in slices(offs):
                counts, x, doc, words = measure(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                n = j - i
                content = field.decode(x, doc) if field is not None else np.ones(len(doc))
                total = np.bincount(doc, words, minlength=n)
                share = np.bincount(doc, words * content, minlength=n) / np.maximum(total, 1)
                failed = (counts[:, 0] < least_words) | (100 * counts[:, 4] > 50 * counts[:, 0])
                kept = ~failed & (share >= least_share)
                if passing:
                    yield batch.slice(i, n).filter(pa.array(kept))
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), *(pa.array(counts[:, c]) for c in range(5)), pa.array(failed), pa.array(kept), pa.array(np.bincount(doc, minlength=n)), pa.array(share)], names=[c.split()[0] for c in RESULT.split(", ")])

    return run


def judge_lines(docs: DataFrame, field: LineField | None, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """Counts, base verdict, content share and verdict of every row of ``docs`` (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_judge(field, least_words, least_share, passing=0), RESULT)


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line labelling and verdicts of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge_lines(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_content(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go; the others pass with all their columns."""
    field = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.mapInArrow(_judge(field, LEAST_WORDS, LEAST_SHARE, passing=1), docs.schema)
