"""Secret scan: exact patterns, and a character convolutional network for what they miss.

Base spans are the leftmost non-overlapping matches of three kinds:
    assign  a keyword, ``:`` or ``=``, and a value of 6 or more characters
    access  AKIA and capitals or digits, 20 or more characters
    hex     24 or more characters of 0-9a-f
Candidates for the network are all runs of 16 or more characters of
``[A-Za-z0-9+/_=-]`` that no base span overlaps and that have a letter and a digit,
or that have 20 or more characters and change case four times or more. A candidate
is seen with its surroundings, by character class, as windows of ``WINDOW``
characters: one around its middle, or, where ``CONTEXT`` characters on both sides
don't fit in with it, as many as cover it and these, each overlapping the next by
half. One layer of convolutions, a maximum over all places and a logistic unit give
a score; Platt scaling calibrates it, and the threshold is the largest calibrated
probability at which the recall on findings held out from training stays at
``RECALL`` or more. A candidate with an accepted window is a span of kind ``model``.

Labelled findings: in a bounded sample of ``FIT_DOCUMENTS`` documents (those
with the smallest hash of doc_id) and of at most ``FIT_FINDINGS`` findings in
them (smallest hash again) the values of base spans are positive, and so are they with a random value of another alphabet in their
place; in half of the cases the keyword is blanked, so that the network learns
values and not only keywords. Negative are word runs, numbers, addresses
and other long runs of the same texts, and runs in ordinary words joined by
``-``, ``_`` or ``/``. The sample bounds training alone; the scan covers all
texts wholly.

Edge cases: a null or empty text has no span (counts 0, base_sha256 of the empty
string, spans ''). Very long texts are scanned wholly. Rows with null or repeated
doc_ids are scanned like others; a null one is not trained on. Other columns than
doc_id and text are not read; masking keeps them, and n_chars follows the text.
Without a base span in the sample, as with an empty table, there is no network and
base spans alone count. No rows give no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkernel import run_bounds, text_buffer

KINDS = ("assign", "access", "hex", "model")
WINDOW, CONTEXT, FIT_DOCUMENTS, FIT_FINDINGS, RECALL = 64, 12, 20_000, 8_000, 0.99
LEAST_RUN, LEAST_LETTERS, LEAST_CHANGES = 16, 20, 4
_ASSIGN = re.compile(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_RUNCHAR = np.zeros(256, bool)
_RUNCHAR[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: Character classes of the network: 0 padding, then letters by vowel and case, a-f apart, digits, blanks, marks.
_CLASSES = ("AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "ae", "bcdf", "iou", "ghjklmnpqrstvwxyz", "01234", "56789", " \t\n\r", "+/", "_-", "=:", "\"'`", ".,;!?", "@#$%&*<>|()[]{}\\~^")
_CLASS = np.full(256, len(_CLASSES) + 1, np.int64)
for _i, _s in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _s]] = _i + 1
_ALPHABETS = ("0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz0123456789")
N_CLASS = len(_CLASSES) + 2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base spans, in order."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _unions(base: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """(starts, ends) of the disjoint unions of spans that overlap or touch, in order."""
    starts, ends = [], []
    for s, _, e in base:  # by start
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def is_candidate(run: str) -> bool:
    if any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
        return True
    letters = [c.isupper() for c in run if c.isalpha()]
    return len(run) >= LEAST_LETTERS and sum(a != b for a, b in zip(letters[:-1], letters[1:], strict=True)) >= LEAST_CHANGES


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs that may be keys and that no base span overlaps."""
    out = []
    starts, ends = _unions(base)
    for m in _RUN.finditer(text):
        at = bisect.bisect_right(ends, m.start())  # the first union that ends behind the run's start
        if (at == len(starts) or starts[at] >= m.end()) and is_candidate(m[0]):
            out.append((m.start(), m.end()))
    return out


def _window(text: str, lo: int, blank: int = -1) -> np.ndarray:
    """Character classes of ``WINDOW`` characters from ``lo``; what lies before ``blank`` counts as spaces."""
    piece = text[max(lo, 0) : max(lo + WINDOW, 0)]
    if blank > lo:
        piece = " " * min(blank - max(lo, 0), len(piece)) + piece[max(blank - max(lo, 0), 0) :]
    codes = _CLASS[np.frombuffer(piece.encode("latin-1", "replace"), np.uint8)]
    out = np.zeros(WINDOW, np.int64)
    out[max(-lo, 0) : max(-lo, 0) + len(codes)] = codes
    return out


def windows_of(text: str, start: int, end: int, blank: int = -1) -> list[np.ndarray]:
    """All windows of a candidate: one around its middle, or as many as cover it with ``CONTEXT`` characters on both sides."""
    if end - start + 2 * CONTEXT <= WINDOW:
        return [_window(text, (start + end) // 2 - WINDOW // 2, blank)]
    first, last = start - CONTEXT, end + CONTEXT - WINDOW
    return [_window(text, lo, blank) for lo in [*range(first, last, WINDOW // 2), last]]


@dataclass(frozen=True)
class CharNetwork:
    """Width-5 convolutions over character classes, maximum over places, logistic unit, calibration and threshold."""

    kernel: np.ndarray  # (5, classes, filters)
    bias: np.ndarray
    out: np.ndarray
    shift: float
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    def _layers(self, x: np.ndarray):
        w = self.kernel.shape[0]
        places = x.shape[1] - w + 1
        conv = sum(self.kernel[i][x[:, i : i + places]] for i in range(w)) + self.bias
        best = conv.argmax(axis=1)
        top = np.maximum(np.take_along_axis(conv, best[:, None, :], 1)[:, 0], 0)
        return best, top, top @ self.out + self.shift

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        z = np.concatenate([self._layers(x[i : i + 2000])[2] for i in range(0, len(x), 2000)])
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * z + self.scale[1], -60, 60)))


def train_network(x: np.ndarray, y: np.ndarray, held: np.ndarray, filters: int = 24, epochs: int = 6, seed: int = 7, recall: float = RECALL) -> CharNetwork:
    """Train on rows that are not ``held``; calibrate and set the threshold on those that are."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.2, (5, N_CLASS, filters)), np.zeros(filters), rng.normal(0, 0.2, filters), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    train = np.flatnonzero(~held)
    weight = np.where(y == 1, 0.5 / max((y[train] == 1).sum(), 1), 0.5 / max((y[train] == 0).sum(), 1)) * len(train)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(train), max(len(train) // 64, 1)):
            net = CharNetwork(params[0], params[1], params[2], float(params[3][0]))
            best, top, z = net._layers(x[batch])
            g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[batch]) * weight[batch] / len(batch)
            back = g[:, None] * params[2] * (top > 0)
            grads = [np.zeros_like(params[0]), back.sum(0), top.T @ g, np.array([g.sum()])]
            f = np.broadcast_to(np.arange(filters), best.shape)
            for i in range(5):
                np.add.at(grads[0][i], (np.take_along_axis(x[batch], best + i, 1), f), back)
            step += 1
            for k, gr in enumerate(grads):
                gr = gr + 1e-4 * params[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * gr, 0.999 * v[k] + 0.001 * gr * gr
                params[k] = params[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = CharNetwork(params[0], params[1], params[2], float(params[3][0]))
    z, t = net._layers(x[held])[2], y[held].astype(float)
    a, b = 1.0, 0.0
    goal = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))  # Platt's targets
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        d = np.linalg.solve(h, np.array([((p - goal) * z).sum(), (p - goal).sum()]))
        a, b = a - float(np.clip(d[0], -1, 1)), b - float(np.clip(d[1], -1, 1))
    net = CharNetwork(net.kernel, net.bias, net.out, net.shift, (a, b))
    good = np.sort(net.probability(x[held][t == 1]))
    least = float(good[int(np.floor(len(good) * (1 - recall)))]) if len(good) else 0.5
    return CharNetwork(net.kernel, net.bias, net.out, net.shift, (a, b), least)


def _findings(text: str, rng: np.random.Generator) -> list[tuple[np.ndarray, int]]:
    """Labelled windows of one text."""
    base, out = base_spans(text), []
    starts, ends = _unions(base)
    for s, k, e in base:
        m = _ASSIGN.match(text, s) if k == 0 else None
        vs = m.start(2) if m else s
        if e - vs >= LEAST_RUN:
            out += [(w, 1) for w in windows_of(text, vs, e, blank=vs if rng.random() < 0.5 else -1)]
            # the same finding with a value of another alphabet
            letters = list(_ALPHABETS[int(rng.integers(len(_ALPHABETS)))])
            other = text[max(s - 40, 0) : vs] + "".join(rng.choice(letters, e - vs)) + text[e : e + 40]
            at = vs - max(s - 40, 0)
            out += [(w, 1) for w in windows_of(other, at, at + e - vs, blank=at if rng.random() < 0.5 else -1)]
    plain = []
    for m in re.finditer(r"\S{10,}", text):
        at = bisect.bisect_right(ends, m.start())
        if at == len(starts) or starts[at] >= m.end():
            plain.append((m.start(), m.end()))
    for i in rng.permutation(len(plain))[:6]:
        out += [(w, 0) for w in windows_of(text, *plain[i])]
    words = re.findall(r"[A-Za-z]{3,}", text)
    for _ in range(3):
        if len(words) >= 3:  # runs as they occur in paths, names and numbered items
            joined = str(rng.choice(list("-_/"))).join(str(words[int(i)]) for i in rng.integers(0, len(words), 3)) + str(rng.choice(["", "2", "-2024", "/17", "_v3"]))
            at = int(rng.integers(0, max(len(text) - WINDOW, 1)))
            made = text[at : at + 24] + " " + joined + " " + text[at + 24 : at + 48]
            begin = len(text[at : at + 24]) + 1
            out += [(w, 0) for w in windows_of(made, begin, begin + len(joined))]
    return out


def _suspects(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which texts may hold a span: a superset, found on the bytes."""
    n = len(offs) - 1
    hot = np.zeros(n, bool)
    if not len(buf):
        return hot
    # runs of LEAST_RUN characters; a hex or access match is such a run, too
    starts, ends = run_bounds(_RUNCHAR[buf], offs)
    long = ends - starts >= LEAST_RUN
    starts, ends = starts[long], ends[long]
    digits = np.concatenate([[0], np.cumsum(_DIGIT[buf], dtype=np.int64)])
    some = (digits[ends] - digits[starts] > 0) | (ends - starts >= 20)
    hot[np.searchsorted(offs, starts[some], "right") - 1] = True
    raw = buf.tobytes().lower()
    for word in _KEYWORDS:
        p = raw.find(word)
        while p >= 0:
            d = int(np.searchsorted(offs, p, "right")) - 1
            hot[d] = True
            p = raw.find(word, max(int(offs[d + 1]), p + 1))  # one find is enough for a text
    return hot


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in np.flatnonzero(_suspects(*text_buffer(batch.column(1)))).tolist():
            doc = batch.column(0)[r].as_py()
            for n, (x, y) in enumerate(_findings(batch.column(1)[r].as_py(), np.random.default_rng([abs(doc), 11]))):
                rows.append((doc, n, x.astype(np.int8).tobytes(), y))
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int32())], names=["doc_id", "n", "x", "y"])


def fit(docs: DataFrame, documents: int = FIT_DOCUMENTS, findings: int = FIT_FINDINGS) -> CharNetwork | None:
    """The network trained on at most ``findings`` findings in at most ``documents`` documents."""
    chosen = docs.filter("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)  # a bounded number of integers
    found = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id", "left_semi").mapInArrow(_sample, "doc_id long, n int, x binary, y int")
    got = found.orderBy(F.xxhash64("doc_id", "n"), "doc_id", "n").limit(findings).toPandas()
    if not (got.y == 1).any() or not (got.y == 0).any():
        return None
    got = got.drop_duplicates(["doc_id", "n"]).sort_values(["doc_id", "n"])
    x = np.frombuffer(b"".join(got.x), np.int8).reshape(-1, WINDOW).astype(np.int64)
    y = got.y.to_numpy()
    held = (got.doc_id.to_numpy() % 4) == 0
    if any(not (y[side] == label).any() for side in (held, ~held) for label in (0, 1)):
        held = np.arange(len(y)) % 2 == 0
    return train_network(x, y, held)


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    base = base_spans(text)
    return base, candidates(text, base)


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SPANS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_NOTHING = hashlib.sha256(b"").hexdigest()


def _found(net: CharNetwork | None, column: pa.Array) -> Iterator[tuple[int, str, list, list]]:
    """(row, text, base spans, all spans) of the rows that have any, in order."""
    buf, offs = text_buffer(column)
    rows = np.flatnonzero(_suspects(buf, offs)).tolist()
    scanned = []
    for r in rows:
        text = column[r].as_py()
        if text:
            scanned.append((r, text, *scan_text(text)))
    accepted = iter(accepted_runs(net, [(text, s, e) for _, text, _, found in scanned for s, e in found]))
    for r, text, base, found in scanned:
        extra = [(s, 3, e) for s, e in found if next(accepted)]
        yield r, text, base, sorted(base + extra)


def accepted_runs(net: CharNetwork | None, runs: list[tuple[str, int, int]]) -> list[bool]:
    """Which of the runs (text, start, end) have a window that the network accepts."""
    if net is None or not runs:
        return [False] * len(runs)
    windows = [windows_of(*run) for run in runs]
    seen = net.probability(np.stack([w for some in windows for w in some])) >= net.threshold
    return np.logical_or.reduceat(seen, np.cumsum([0, *map(len, windows[:-1])])).tolist()


def _scan(net: CharNetwork | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                n = batch.num_rows
                counts = np.zeros((3, n), np.int64)
                sha, said = [_NOTHING] * n, [""] * n
                for r, _, base, spans in _found(net, batch.column(1)):
                    for _, k, _ in base:
                        counts[k, r] += 1
                    sha[r] = hashlib.sha256(_said(base).encode()).hexdigest()
                    said[r] = _said(spans)
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(sha), pa.array(said)], names=[c.split()[0] for c in SPANS.split(", ")])

    return run


def scan(docs: DataFrame, net: CharNetwork | None) -> DataFrame:
    """Counts, digest and spans of every row of ``docs`` (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_scan(net), SPANS)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every maximal union of spans replaced by a mark of its first span's kind."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]} removed>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def _mask(net: CharNetwork | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            t, c = whole.schema.get_field_index("text"), whole.schema.get_field_index("n_chars")
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                changed = {r: redacted(text, spans) for r, text, _, spans in _found(net, batch.column(t)) if spans}
                if changed:
                    texts = [changed.get(r, x) for r, x in enumerate(batch.column(t).to_pylist())]
                    batch = batch.set_column(t, batch.schema.field(t), pa.array(texts, batch.schema.field(t).type))
                    if c >= 0:
                        chars = [len(changed[r]) if r in changed else x for r, x in enumerate(batch.column(c).to_pylist())]
                        batch = batch.set_column(c, batch.schema.field(c), pa.array(chars, batch.schema.field(c).type))
                yield batch

    return run


def op7_secret_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, fit(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: spans are replaced by a mark in the text, and n_chars follows; no document goes."""
    return docs.mapInArrow(_mask(fit(docs)), docs.schema)
