"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed
against it from the left: each phrase is the longest match from where the last
one ended (a character that no match can begin with is a phrase of its own). The
phrases a character, times the logarithm of the size of the language's text, are
the cross-entropy estimate in bits a character; the language with the least wins.

The automata become tables of the next state for every state and letter class;
where a match ends, the entry leads on from the root and is marked, so a parse is
one table look-up a character. Texts are cut into windows of ``WINDOW`` letters
that are parsed side by side, a phrase ending with its window; every window of a
text counts, whatever its length. Letters are lower-cased; all other characters
are blanks, and runs of blanks are one.

Training text: of each language at most ``FIT_DOCUMENTS`` documents (smallest hash
of doc_id) with crc32(doc_id as text) mod 5 <> 0, chosen for all languages in one
pass, and ``FIT_LETTERS`` characters in equal excerpts of them, each from a hashed
place of its whole text. All languages together have at most ``FIT_TOTAL``
characters, the bound of what is broadcast (512 bytes a character). Nothing else
is sampled.

Edge cases: a text that is null or has no letter is ``und`` with score 0; so is
every text if no language could be learned, as with an empty table. Of languages
with equal cost the first by name wins. A null doc_id is not held out and is never
trained on; rows with repeated doc_ids are judged like others, and the least of
their excerpts is learned from. Very long texts are read wholly. Other columns than
doc_id, text and (for learning) lang are not read. No rows give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textkernel import text_buffer

WINDOW, FIT_DOCUMENTS, FIT_LETTERS, FIT_TOTAL, CLASSES = 512, 300, 40_000, 400_000, 64
FOLDS, HELD_OUT = 5, 0
BATCH_BYTES = 4 << 20
_MARK = 1 << 30
_LIMIT = 0x110000


def _fold():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(-1))


def letter_classes(texts: list[str], classes: int = CLASSES) -> np.ndarray:
    """Class of every code point: 0 for what is no letter, 1 for rare letters, then the most frequent letters in lower case."""
    seen = Counter()
    for t in texts:
        seen.update(t.lower())
    common = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if c.isalpha()][: classes - 2]
    number = {c: i + 2 for i, c in enumerate(common)}
    out = np.zeros(_LIMIT, np.uint8)
    for cp in range(0x30000):
        c = chr(cp)
        if c.isalpha():
            out[cp] = number.get(c.lower(), 1)
    out[0x30000:0x32000] = 1
    return out


def code_points(text: str, classes: np.ndarray) -> np.ndarray:
    return classes[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


def squeeze(codes: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes with one blank for each run of them, and the texts' bounds among these. No run goes across texts."""
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    keep[breaks[:-1][breaks[:-1] < len(codes)]] = True
    return codes[keep], np.concatenate([[0], np.cumsum(keep)])[breaks]


def suffix_automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings; state 0 is the root."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


def parse_table(nexts: list[dict[int, int]], classes: int) -> np.ndarray:
    """Flat table: at state * classes + class the next state * classes, marked if a phrase ends before this character."""
    root = np.full(classes, _MARK, np.int32)
    for c, t in nexts[0].items():
        root[c] = (t * classes) | _MARK
    out = np.tile(root, (len(nexts), 1))
    for s, row in enumerate(nexts):
        for c, t in row.items():
            out[s, c] = t * classes
    # what the root does not know is a phrase at once
    return out.ravel()


@dataclass(frozen=True)
class Parser:
    languages: tuple[str, ...]
    classes: np.ndarray
    tables: tuple[np.ndarray, ...]
    bits: np.ndarray  # bits a phrase, for each language
    width: int = CLASSES

    def phrases(self, codes: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> np.ndarray:
        """Phrases of every text (rows) in every language (columns)."""
        n = np.diff(bounds)
        windows = -(-n // window)
        owner = np.repeat(np.arange(len(n)), windows)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        begin = bounds[:-1][owner] + k * window
        size = np.minimum(begin + window, bounds[1:][owner]) - begin
        order = np.argsort(-size, kind="stable")
        begin, size, owner = begin[order], size[order], owner[order]
        out = np.zeros((len(n), len(self.languages)), np.int64)
        if not len(size):
            return out
        codes = np.append(codes, 0).astype(np.int32)
        alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
        for lang, table in enumerate(self.tables):
            state = np.zeros(len(size), np.int32)
            count = np.ones(len(size), np.int32)
            for t in range(int(size[0])):
                m = alive[t]
                to = table[state[:m] + codes[begin[:m] + t]]
                count[:m] += to >> 30
                np.bitwise_and(to, _MARK - 1, out=state[:m])
            out[:, lang] = np.bincount(owner, count, minlength=len(n)).astype(np.int64)
        return out

    def identify(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(languages, scores) of the texts."""
        if not texts or not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        codes = code_points("".join(texts), self.classes)
        letters = np.concatenate([[0], np.cumsum(codes > 0)])
        known = letters[bounds[1:]] > letters[bounds[:-1]]
        codes, bounds = squeeze(codes, bounds)
        cost = self.phrases(codes, bounds) * self.bits / np.maximum(np.diff(bounds), 1)[:, None]
        best = cost.argmin(axis=1)
        # the winner's share of 2 ** -cost over a few dozen characters
        rel = np.exp2(-8 * (cost - cost.min(axis=1, keepdims=True)))
        share = rel.max(axis=1) / rel.sum(axis=1)
        return [self.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, share, 0.0)


def excerpts(docs: DataFrame, documents: int, letters: int, total: int) -> DataFrame:
    """(lang, doc_id, t): one excerpt of each document to learn from; all languages in one pass, at most ``documents`` rows a language."""
    rows = docs.filter("doc_id is not null and lang is not null and text is not null").filter(_fold() != HELD_OUT)
    order = Window.partitionBy("lang").orderBy("o", "doc_id")  # each task hands on its first rows of a language only
    chosen = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("o")).distinct().withColumn("r", F.row_number().over(order)).filter(F.col("r") <= documents)
    each = Window.partitionBy("lang")
    langs = F.greatest(F.size(F.collect_set("lang").over(Window.partitionBy())), F.lit(1))  # over the chosen rows, a few hundred a language
    chosen = chosen.withColumn("n", F.count("*").over(each)).withColumn("size", F.ceil(F.least(F.lit(letters), F.floor(F.lit(total) / langs)) / F.col("n")).cast("int")).select("lang", "doc_id", "size")
    found = rows.select("lang", "doc_id", "text").join(F.broadcast(chosen), ["lang", "doc_id"])  # documents rows a language
    place = F.pmod(F.xxhash64("doc_id", "lang"), F.greatest(F.length("text") - F.col("size") + 1, F.lit(1))).cast("int") + 1
    return found.select("lang", "doc_id", F.expr("text").substr(place, F.col("size")).alias("t")).groupBy("lang", "doc_id").agg(F.min("t").alias("t"))


def fit(docs: DataFrame, documents: int = FIT_DOCUMENTS, letters: int = FIT_LETTERS, total: int = FIT_TOTAL) -> Parser:
    """Automata of all languages that labelled rows outside the held-out fold have."""
    got = excerpts(docs, documents, letters, total).toPandas().sort_values(["lang", "doc_id"])  # at most ``total`` characters
    texts = {lang: " ".join(g.t) for lang, g in got.groupby("lang")}
    classes = letter_classes(list(texts.values()))
    names, tables, bits = [], [], []
    for lang in sorted(texts):
        codes = code_points(texts[lang], classes)
        codes, _ = squeeze(codes, np.array([0, len(codes)]))
        if not (codes > 0).any():
            continue
        names.append(lang)
        tables.append(parse_table(suffix_automaton(codes), CLASSES))
        bits.append(np.log2(len(codes) + 1))
    return Parser(tuple(names), classes, tuple(tables), np.array(bits))


RESULT = "doc_id long, lang_pred string, score double"


def _predict(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = held.value
        for batch in batches:
            texts = batch.column(1)
            _, offs = text_buffer(texts)
            i = 0
            while i < batch.num_rows:
                j = min(max(i + 1, int(np.searchsorted(offs, offs[i] + BATCH_BYTES, "right")) - 1), batch.num_rows)
                lang, score = parser.identify([t or "" for t in texts.slice(i, j - i).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(lang), pa.array(score)], names=["doc_id", "lang_pred", "score"])
                i = j

    return run


def predict(docs: DataFrame, parser: Parser) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs`` (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(parser)  # languages * states * classes, bounded by FIT_LETTERS
    return docs.select("doc_id", "text").mapInArrow(_predict(held), RESULT)


def op4_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs)).select("doc_id", (_fold() == HELD_OUT).alias("held_out"), "lang_pred", "score")
