"""The feedback loop: predictions wait for labels, matched pairs go to a log, and the log gives metrics.

The batch form reads events in order, the streaming form keeps a bounded queue
for each key as state. Both run the same :class:`Queue` and give the same pairs:
the k-th label goes to the k-th waiting prediction, a label that finds none is
ignored, and when more than ``MOST_PENDING`` predictions wait, the queue is
flushed: all that wait leave without a label.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

PAIR = "key string, seq long, predicted string, actual string, status string"
MOST_PENDING = 100


class Queue:
    """Waiting predictions of one key as (number, value); ``skip_ms``: a gap of so much between labels skips a waiting prediction each time."""

    def __init__(self, most_pending: int, skip_ms: int = 0, pending: list | None = None, last_label: int = 0, count: int = 0):
        self.most_pending, self.skip_ms, self.last_label, self.count = most_pending, skip_ms, last_label, count
        self.pending = [tuple(p) for p in pending or []]

    def prediction(self, value) -> list[tuple]:
        """(number, value, label, status) of what leaves the queue."""
        self.count += 1
        self.pending.append((self.count, value))
        if len(self.pending) <= self.most_pending:
            return []
        out = [(*p, None, "overflow") for p in self.pending]
        self.pending = []
        return out

    def label(self, value, at_ms: int = 0) -> list[tuple]:
        out = []
        skip = (at_ms - self.last_label) // self.skip_ms if self.skip_ms and self.last_label else 0
        self.last_label = at_ms
        for _ in range(min(int(skip), len(self.pending))):
            out.append((*self.pending.pop(0), None, "skipped"))
        if self.pending:
            out.append((*self.pending.pop(0), value, "labelled"))
        return out


def matched_in_order(predictions: DataFrame, labels: DataFrame, key: str, order: str, most_pending: int = MOST_PENDING) -> DataFrame:
    """(key, order, actual): every prediction with its label, null where it has none. ``labels`` has ``actual``; ``order`` is a number common to both.

    Events of a key are read as a stream in order, so memory is bounded by the queue.
    """
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    both = predictions.select(F.col(key).alias("_k"), F.col(order).cast("long").alias("_o"), F.lit(0).alias("_label"), F.lit(None).cast("string").alias("actual")).union(labels.select(F.col(key), F.col(order).cast("long"), F.lit(1), F.col("actual").cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, now, first = Queue(most_pending), None, True

        def made(rows: list[tuple]) -> pa.RecordBatch:
            keys, orders, actual = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(keys, kinds[0]), pa.array(orders, pa.int64()), pa.array(actual, pa.string())], names=["_k", "_o", "actual"])

        for b in batches:
            kinds = [b.column(0).type]
            out = []
            for k, at, is_label, actual in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if first or k != now:
                    out += [(now, v, None) for _, v in queue.pending]
                    queue, now, first = Queue(most_pending), k, False
                gone = queue.label(actual) if is_label else queue.prediction(at)
                out += [(k, v, lab) for _, v, lab, _ in gone]
            yield made(out)
        if not first:
            yield made([(now, v, None) for _, v in queue.pending])

    ordered = both.repartition("_k").sortWithinPartitions("_k", "_o", "_label")
    got = ordered.mapInArrow(run, f"_k {kind(predictions, key)}, _o long, actual string")
    return got.select(F.col("_k").alias(key), F.col("_o").alias(order), "actual")


def skipped_slots(labels: DataFrame, key: str, at: str, wait_s: float) -> DataFrame:
    """Labels with the queue place they fill when a gap of ``wait_s`` seconds or more skips floor(gap / wait) places; a key's first label never skips."""
    w = Window.partitionBy(key).orderBy(at)
    seconds = F.col(at).cast("timestamp").cast("double")
    gap = seconds - F.lag(seconds).over(w)
    skip = F.coalesce(F.floor(gap / wait_s), F.lit(0))
    return labels.withColumn("skipped", skip).withColumn("slot", F.row_number().over(w) + F.sum(skip).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def trimmed_log(log: DataFrame, order: str, most: int) -> DataFrame:
    """The log, or its newest ``most / 2`` rows if it has more than ``most``."""
    n = log.agg(F.count("*").alias("_n"))
    newest = log.select(F.col(order).alias("_o")).orderBy(F.desc("_o")).limit(max(most // 2, 1)).agg(F.min("_o").alias("_edge"))
    x = log.join(F.broadcast(n)).join(F.broadcast(newest))  # one row each
    return x.filter((F.col("_n") <= most) | (F.col(order) >= F.col("_edge"))).drop("_n", "_edge")


def last_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(order)).limit(n)


def online_accuracy(log: DataFrame, order: str, n: int | None = None) -> DataFrame:
    """Accuracy over the newest n pairs, or all."""
    x = last_rows(log, order, n) if n else log
    return x.agg(F.avg((F.col("predicted") == F.col("actual")).cast("double")).alias("accuracy"), F.count("*").alias("pairs"))


def admitted_labels(known: list[str], arrived: list[str], allow_new: bool) -> list[str]:
    """Label list after new labels arrived; they are appended in order if allowed."""
    out = list(known)
    for x in arrived:
        if x not in out and allow_new:
            out.append(x)
    return out


def _feed(most_pending: int, wait_ms: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, last_label, count = (json.loads(state.get[0]), state.get[1], state.get[2]) if state.exists else ([], 0, 0)
        queue, out = Queue(most_pending, wait_ms, pending, last_label, count), []
        if state.hasTimedOut:
            out = [(*p, None, "timeout") for p in queue.pending]
            state.remove()
        else:
            for pdf in frames:
                for r in pdf.assign(_label=(pdf.kind != "prediction").astype(int)).sort_values(["at_ms", "_label"], kind="stable").itertuples(index=False):
                    out += queue.prediction(r.value) if r.kind == "prediction" else queue.label(r.value, int(r.at_ms))
            state.update((json.dumps(queue.pending), int(queue.last_label), int(queue.count)))
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["key", "seq", "predicted", "actual", "status"])

    return run


def feedback_stream(events: DataFrame, most_pending: int = MOST_PENDING, wait_ms: int = 0) -> DataFrame:
    """Pairs from a stream (key string, kind 'prediction' or 'label', value string, at_ms long).

    State a key: at most ``most_pending`` waiting predictions.
    """
    return events.groupBy("key").applyInPandasWithState(_feed(most_pending, wait_ms), PAIR, "pending string, last_label long, seq long", "append", GroupStateTimeout.NoTimeout)


def write_feedback(pairs: DataFrame, path: str, checkpoint: str, on_batch=None):
    """Append labelled pairs to a Parquet log, batch by batch; ``on_batch(df, id)`` may re-bin or retrain."""

    def sink(df: DataFrame, batch: int) -> None:
        df = df.filter("status = 'labelled'")
        # a folder a batch: a batch that is run again replaces its own rows
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        if on_batch:
            on_batch(df, batch)

    return pairs.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint)


def drift_flush(pending: DataFrame, quantizer, drifted: dict[str, list[float]]):
    """Extend the rules by drifted values; the quantizer, the maps, and the waiting rows with their bins replaced."""
    from dataclasses import replace

    from ..operators.quantize import rebinned, remapped

    rules, maps = [], {}
    for r in quantizer.rules:
        new, m = rebinned(r, drifted.get(r.feature, []), quantizer.bins)
        rules.append(new)
        if any(a != b for a, b in m.items()):
            maps[r.feature] = m
    return replace(quantizer, rules=rules), maps, remapped(pending, maps) if maps else pending


class Retraining:
    """Switch and bound of repeated training on a base table that grows by feedback."""

    def __init__(self, most_rows: int, enabled: bool = True):
        self.most_rows, self.enabled = most_rows, enabled

    def run(self, base: DataFrame, feedback: DataFrame, order: str, fit):
        """``fit`` on the newest ``most_rows`` rows of base and feedback; None where it is switched off."""
        from ..sources.files import bounded_append

        return fit(bounded_append(base, feedback, order, self.most_rows)[0]) if self.enabled else None
