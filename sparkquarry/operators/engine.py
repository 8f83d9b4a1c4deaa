"""One object from a fitted forest to decisions: quantized rows, raw features, files, bytes."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import dropped, renamed
from ..sources import files, pe
from .forest import Forest, raw_inference, scored
from .quantize import Quantizer

OK, MISSING, UNREADABLE = "ok", "missing value", "unreadable file"


@dataclass
class Engine:
    """A forest with what its inputs go through before it. Every answer has ``status``; rows that are not ``ok`` have no score."""

    forest: Forest
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)
    log_features: list[str] = field(default_factory=list)
    quantizer: Quantizer | None = None

    def save(self, spark: SparkSession, path: str) -> None:
        new = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
        self.forest.save(spark, f"{new}/forest")
        if self.quantizer:
            self.quantizer.save(spark, f"{new}/quantizer")
        text = json.dumps({"means": self.means, "scales": self.scales, "log_features": self.log_features, "quantizer": self.quantizer is not None})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{new}/inputs")
        dropped(spark, path)
        renamed(spark, new, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Engine:
        x = json.loads(spark.read.text(f"{path}/inputs").first().value)
        q = Quantizer.load(spark, f"{path}/quantizer") if x["quantizer"] else None
        return Engine(Forest.load(spark, f"{path}/forest"), x["means"], x["scales"], x["log_features"], q)

    def metadata(self) -> dict:
        f = self.forest
        return {"features": len(f.features), "trees": int(f.nodes.tree.nunique()), "nodes": len(f.nodes), "threshold": f.threshold, "bits": self.quantizer.bits if self.quantizer else None}

    def _answered(self, df: DataFrame, row_id: str, scores) -> DataFrame:
        whole = None
        for c in self.forest.features:
            there = F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
            whole = there if whole is None else whole & there
        rows = df.withColumn("status", F.when(whole, OK).otherwise(MISSING))
        s = scores(df.filter(whole)).withColumn("status", F.lit(OK))
        rest = rows.filter(F.col("status") != OK).select(row_id, F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("is_anomaly"), "status")
        return s.select(row_id, "score", "is_anomaly", "status").union(rest)

    def infer_quantized(self, df: DataFrame, row_id: str) -> DataFrame:
        """(row id, score, is_anomaly, status) of rows whose features are bins already."""
        return self._answered(df, row_id, lambda x: scored(x, self.forest, row_id))

    def infer_raw(self, df: DataFrame, row_id: str) -> DataFrame:
        """The same for raw features."""
        return self._answered(df, row_id, lambda x: raw_inference(x, self.forest, row_id, self.log_features, self.means, self.scales, self.quantizer))

    def infer_bytes(self, contents: DataFrame) -> DataFrame:
        """(path, score, is_anomaly, status, error, processing_time_ms) of files (path, content); those that cannot be read have no score."""
        pe.resolve(self.forest.features)
        got = pe.extracted(contents, self.forest.features)
        good = self.infer_raw(got.filter("parse_ok"), "path").join(got.select("path", "error", "processing_time_ms"), "path")
        bad = got.filter("not parse_ok").select("path", F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("is_anomaly"), F.lit(UNREADABLE).alias("status"), "error", "processing_time_ms")
        return good.select(bad.columns).union(bad)

    def infer_path(self, spark: SparkSession, folder: str, suffixes: list[str] | None = None) -> DataFrame:
        """:meth:`infer_bytes` of all files below a folder."""
        return self.infer_bytes(files.raw_files(spark, folder, suffixes))

    def evaluate_path(self, spark: SparkSession, folders: dict[str, str], positive: set[str]) -> dict:
        """Counts, rates, AUC and average precision over folders of files by class, with failures and times; ``positive``: classes that are anomalous."""
        from ..lineage import written
        from .audit import timing_report
        from .metrics import roc_curve
        from .search import evaluated

        out = None
        for name, folder in folders.items():
            part = self.infer_path(spark, folder).withColumn("class", F.lit(name)).withColumn("positive", F.lit(name in positive))
            out = part if out is None else out.union(part)
        size = None
        for folder in folders.values():
            one = files.raw_files(spark, folder).select("path", "length")
            size = one if size is None else size.union(one)
        rows, _ = written(out.join(size, "path"), "evaluated")
        good = rows.filter(F.col("status") == OK).withColumn("key", F.xxhash64("path"))
        return {
            **evaluated(good, "score", "key", F.col("positive"), self.forest.threshold or 0.0), "failures": rows.filter(F.col("status") != OK).count(),
            "timing": timing_report(rows, ["class"], "processing_time_ms", "length"), "roc": roc_curve(good.withColumn("anomaly", -F.col("score")), "anomaly", F.col("positive")),
        }
