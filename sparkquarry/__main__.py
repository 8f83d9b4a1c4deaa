"""Command line: extract, quantize, evaluate and run.

    python -m sparkquarry extract FOLDER OUT [--features NAMES.json]
    python -m sparkquarry quantize TRAIN OUT QUANTIZER.json [--bits N] [--others IN=OUT ...]
    python -m sparkquarry forest TRAIN MODEL --key ID [--trees N]
    python -m sparkquarry score IN MODEL OUT --key ID
    python -m sparkquarry query NAME TABLES OUT

Inputs and outputs are Parquet paths.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .deploy import ship


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparkquarry")
    sub = p.add_subparsers(dest="what", required=True)
    for name, places in {"extract": ["folder", "out"], "quantize": ["train", "out", "quantizer"], "forest": ["train", "model"], "score": ["table", "model", "out"], "query": ["name", "tables", "out"]}.items():
        s = sub.add_parser(name)
        for place in places:
            s.add_argument(place)
        if name == "extract":
            s.add_argument("--features")
        if name == "quantize":
            s.add_argument("--bits", type=int, default=4)
            s.add_argument("--others", nargs="*", default=[])
        if name in ("forest", "score"):
            s.add_argument("--key", required=True)
        if name == "forest":
            s.add_argument("--trees", type=int, default=100)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    if a.what == "extract":
        from .sources import files, pe

        names = json.loads(Path(a.features).read_text()) if a.features else None
        pe.extracted(files.raw_files(spark, a.folder), names).write.mode("overwrite").parquet(a.out)
    elif a.what == "quantize":
        from .operators import quantize

        train = spark.read.parquet(a.train)
        names = [f.name for f in train.schema if f.dataType.typeName() in ("double", "float")]
        q = quantize.fit_quantizer(train, names, a.bits)
        q.save(spark, a.quantizer)
        for source, out in [(a.train, a.out), *(x.split("=", 1) for x in a.others)]:
            quantize.quantized(spark.read.parquet(source), q).write.mode("overwrite").parquet(out)
    elif a.what == "forest":
        from .operators import forest

        train = spark.read.parquet(a.train)
        names = [f.name for f in train.schema if f.name != a.key and f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")]
        forest.fit_forest(train, a.key, names, forest.ForestConfig(trees=a.trees)).save(spark, a.model)
    elif a.what == "score":
        from .operators import forest

        forest.scored(spark.read.parquet(a.table), forest.Forest.load(spark, a.model), a.key).write.mode("overwrite").parquet(a.out)
    else:
        from .plans import catalog, catalog_more  # noqa: F401

        df = catalog.QUERIES[a.name](spark, a.tables)
        df.select([F.col(c) for c in df.columns]).write.mode("overwrite").parquet(a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
