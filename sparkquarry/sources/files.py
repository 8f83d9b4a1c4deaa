"""File sources and sinks: raw files, tables, CSV for fitting, dataset parameters, reports."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File name suffixes that count as programs on each system; fixed values.
PROGRAM_SUFFIXES = {"windows": [".exe", ".dll", ".sys", ".scr", ".ocx"], "linux": [".so", ".elf", ".bin", ".run"], "macos": [".dylib", ".macho", ".bundle"]}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_files(spark: SparkSession, folder: str, suffixes: list[str] | None = None) -> DataFrame:
    """(path, length, content) of all files below a folder; suffixes filter by name before any content is read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return df.filter(suffix_of(F.col("path")).isin([s.lower() for s in suffixes])).select("path", "length", "content") if suffixes else df.select("path", "length", "content")


def entries(spark: SparkSession, folder: str, suffixes: list[str] | None = None) -> DataFrame:
    """(name) of what lies directly below a folder, a row each: files, and subfolders with files at any depth.

    A table that was written as a folder of part files is one entry, whatever its parts
    are called; suffixes filter by the entry's own name. Hidden and empty files do not
    count, as in every Spark reader. No content is read.
    """
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().getPath().rstrip("/")
    path = F.regexp_replace("path", r"^[^:/]+:(//[^/]*)?", "")  # without scheme and authority, as the root is
    names = raw_files(spark, folder).select(F.regexp_extract(F.substr(path, F.lit(len(root) + 2)), r"^[^/]+", 0).alias("name"))
    return (names.filter(suffix_of(F.col("name")).isin([s.lower() for s in suffixes])) if suffixes else names).distinct()


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def has_magic(content: Column, magic: bytes = b"MZ") -> Column:
    return F.substring(content, 1, len(magic)) == F.lit(magic)


def unique_contents(files: DataFrame) -> DataFrame:
    """One file for each content: the first path, with ``sha256``. Contents are compared by digest and are not shuffled."""
    named = files.select("path", "length", F.sha2("content", 256).alias("sha256"))
    return named.groupBy("sha256").agg(F.min("path").alias("path"), F.min_by("length", "path").alias("length"), F.count("*").alias("copies"))


def write_split_table(df: DataFrame, path: str) -> None:
    """Snappy Parquet, a folder a split."""
    df.write.mode("overwrite").option("compression", "snappy").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split; other splits' folders are not listed as input."""
    return spark.read.parquet(path).filter(F.col("split") == split).drop("split")


def has_header(first: list[str], second: list[str]) -> bool:
    """Whether the first row is a header: the second is at least 80 per cent numeric, the first under 50, 30 points apart."""

    def share(cells: list[str]) -> float:
        ok = 0
        for c in cells:
            try:
                float(c.strip())
                ok += 1
            except ValueError:
                pass
        return ok / max(len(cells), 1)

    a, b = share(first), share(second)
    return b >= 0.8 and a < 0.5 and b - a >= 0.3


def fit_csv(spark: SparkSession, path: str, names: list[str] | None = None, labelled: bool = False) -> DataFrame:
    """Rows of a CSV for fitting: cells are trimmed, bad cells are 0.0, rows with another number of cells are left out."""
    lines = spark.read.text(path).filter(F.length("value") > 0)
    head = [next(csv.reader(io.StringIO(r.value))) for r in lines.limit(2).collect()]
    header = len(head) == 2 and has_header(head[0][labelled:], head[1][labelled:])
    width = len(head[0]) if head else 0
    names = names or ([c.strip() for c in head[0]] if header else (["label"] if labelled else []) + [f"f{i}" for i in range(width - labelled)])
    schema = ", ".join(f"c{i} string" for i in range(max(width, 1))) + ", _bad string"
    # the reader drops the header, which is a file's first line and no other that is equal to it
    rows = spark.read.csv(path, schema=schema, header=header, quote='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", enforceSchema=True).filter(F.col("_bad").isNull())
    number = lambda c: F.coalesce(F.trim(c).try_cast("double"), F.lit(0.0))
    return rows.select(*[(F.trim(F.col(f"c{i}")) if labelled and i == 0 else number(F.col(f"c{i}"))).alias(n) for i, n in enumerate(names)])


def dataset_params(df: DataFrame, features: int, bits: int, label: str | None = None) -> DataFrame:
    """(parameter, value) of a quantized dataset: bits, features, samples, labels, samples of each label."""
    base = df.agg(F.count("*").alias("n"), (F.count_distinct(label) if label else F.lit(0)).alias("k"))
    rows = base.select(F.explode(F.array(*[F.struct(F.lit(p).alias("parameter"), v.cast("string").alias("value")) for p, v in (("quantization_coefficient", F.lit(bits)), ("num_features", F.lit(features)), ("num_samples", F.col("n")), ("num_labels", F.col("k")))])).alias("p")).select("p.*")
    if label:
        rows = rows.union(df.groupBy(label).agg(F.count("*").alias("n")).select(F.concat(F.lit("samples_label_"), F.col(label).cast("string")), F.col("n").cast("string")))
    return rows


def read_dataset_params(text: str) -> dict[str, str]:
    """Parameters from ``key,value`` or ``key=value`` lines; bits are cut to 1..8."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        for sep in (",", "="):
            if sep in line:
                k, v = (x.strip() for x in line.split(sep, 1))
                if k and k != "parameter":
                    out[k] = v
                break
    if "quantization_coefficient" in out:
        out["quantization_coefficient"] = str(min(max(int(out["quantization_coefficient"]), 1), 8))
    return out


def config_or_scan(config: dict | None, df: DataFrame, label: str) -> dict:
    """Counts from a configuration, else from the data, with the settings that follow from them."""
    from ..operators.trees import auto_config

    if config and "samples" in config:
        return config
    counts = {r[0]: r.n for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}  # a row a class
    features = len(df.columns) - 1
    return {"samples": sum(counts.values()), "labels": len(counts), "counts": counts, **auto_config(counts, features)}


def bounded_append(old: DataFrame, new: DataFrame, order: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): the newest ``most`` rows by a unique ``order``, and the rest."""
    both = old.unionByName(new)
    edge = both.select(order).orderBy(F.desc(order)).limit(most).agg(F.min(order).alias("_edge"))  # one row
    marked = both.join(F.broadcast(edge))
    return marked.filter(F.col(order) >= F.col("_edge")).drop("_edge"), marked.filter((F.col(order) < F.col("_edge")) | F.col("_edge").isNull()).drop("_edge")


def newest_first_log(old: DataFrame, new: DataFrame, order: str, most: int = 50) -> DataFrame:
    """The newest rows of a log, newest first; rows with a null cell are malformed and go."""
    return old.unionByName(new).dropna().orderBy(F.desc(order)).limit(most)


def report_lines(sections: dict[str, dict], curves: dict[str, DataFrame]) -> str:
    """A report of ``[section]`` parts with key=value lines, then curves as CSV. Curves are small results."""
    out = []
    for name, values in sections.items():
        out += [f"[{name}]", *[f"{k}={v}" for k, v in values.items()], ""]
    for name, df in curves.items():
        out += [f"[{name}]", ",".join(df.columns), *[",".join(map(str, r)) for r in df.collect()], ""]
    return "\n".join(out)


def read_report(text: str) -> tuple[dict[str, dict[str, str]], dict[str, list[list[str]]]]:
    """(sections, curves) of a report."""
    sections: dict[str, dict[str, str]] = {}
    curves: dict[str, list[list[str]]] = {}
    name = ""
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("[") and line.endswith("]"):
            name = line[1:-1]
        elif "=" in line:
            k, v = line.split("=", 1)
            sections.setdefault(name, {})[k] = v
        elif line:
            curves.setdefault(name, []).append(line.split(","))
    return sections, curves


def markdown_table(df: DataFrame, digits: int = 4) -> str:
    """A small result as a Markdown table."""
    cell = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(cell(v) for v in r) + " |" for r in df.collect()]])


def curve_svg(points: list[tuple[float, float]], title: str, size: int = 320) -> str:
    """A curve over the unit square as an SVG text."""
    xy = " ".join(f"{20 + x * (size - 40):.1f},{size - 20 - y * (size - 40):.1f}" for x, y in points)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}"><title>{title}</title><rect x="20" y="20" width="{size - 40}" height="{size - 40}" fill="none" stroke="gray"/><polyline points="{xy}" fill="none" stroke="black"/></svg>'


#: Schema of a line of the evaluation log.
EVENT_SCHEMA = T.StructType([T.StructField("predicted", T.IntegerType()), T.StructField("actual", T.IntegerType())])
