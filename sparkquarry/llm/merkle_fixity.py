"""Merkle fixity audit of WARC replicas.

A replica is a folder of WARC files: records of the format's version 1.1, each a
gzip member of its own, so that any record can be read at its offset. Every file
has an offset table beside it (``.idx``): a magic, the number of records, the
SHA-256 of what follows, and for each record its page id, offset and length.

Fixity: a record's digest is the SHA-256 of its stored bytes. A leaf is the SHA-256
of offset, length and digest. Leaves are ordered by file and offset; ``FANOUT``
consecutive nodes of a file make the node above by the SHA-256 of their ranges
(first offset, length) and digests in order, until the file has one; files go on in
the same way up to the replica's root.

Audit: the files of a replica are found by listing its folder, and both replicas'
files are numbered together by name. The roots are compared, and only the children
of nodes that differ are looked at on the next level, down to single records: the
audit reads nodes, never the records of ranges that agree.

Edge cases: null url or html is an empty one; a null page_id gives the record id
``null``. Rows that repeat a page_id are records of their own. Very long pages are
records like others; other columns than page_id, url and html are not read. An
empty table gives a replica without a file, whose root equals another such. A
record or file that one replica lacks differs (its leaf there is null). A file whose
offset table is missing, short, damaged or not of one row of records has one leaf
with number -1 instead of its records, and an offset table without its file gives
leaves without bytes; both differ from everything. A record cut short differs;
bytes behind the last record are a leaf of their own.
"""

from __future__ import annotations

import gzip
import hashlib
import itertools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import scratch

FANOUT = 16
DAMAGED_OF = 97
MAGIC = b"WIX2"
#: Leaves that are handed on at once.
ROWS = 10_000
ENTRY = np.dtype([("page_id", "<i8"), ("known", "<i8"), ("offset", "<i8"), ("length", "<i8")])
WRITTEN = "replica int, file_no int, name string, records long, bytes long"
LEAF = "file_no int, number long, page_id long, offset long, length long, digest string"


def warc_record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """One resource record; its id is derived from the page's, so that equal rows give equal bytes."""
    body = (html or "").encode()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id if page_id is not None else 'null'}")
    head = (
        "WARC/1.1\r\nWARC-Type: resource\r\n"
        f"WARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n"
        f"WARC-Target-URI: {(url or '').replace(chr(13), '').replace(chr(10), '')}\r\nWARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\n"
        f"Content-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return head.encode() + body + b"\r\n\r\n"


def stored(record: bytes) -> bytes:
    return gzip.compress(record, compresslevel=6, mtime=0)


def _damaged(data: bytes) -> bytes:
    return data[:-6] + bytes([data[-6] ^ 1]) + data[-5:]


def offset_table(index: np.ndarray) -> bytes:
    body = index.tobytes()
    return MAGIC + struct.pack("<Q", len(index)) + hashlib.sha256(body).digest() + body


def read_offset_table(data: bytes) -> np.ndarray | None:
    """The entries of an offset table; None if it is damaged or its records do not lie one behind the other."""
    head = len(MAGIC) + 8 + 32
    if len(data) < head or data[: len(MAGIC)] != MAGIC:
        return None
    n, body = struct.unpack("<Q", data[len(MAGIC) : len(MAGIC) + 8])[0], data[head:]
    if len(body) != n * ENTRY.itemsize or hashlib.sha256(body).digest() != data[head - 32 : head]:
        return None
    index = np.frombuffer(body, ENTRY)
    ends = np.cumsum(index["length"])
    return index if (index["length"] >= 0).all() and (index["offset"] == ends - index["length"]).all() else None


def _write(replicas: list[tuple[str, int]]):
    """Write the rows of each task as one file in every replica, (folder, damaged_of); with ``damaged_of`` a byte of every record is changed whose page id's crc32 it divides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        stores = [scratch.open_store(folder) for folder, _ in replicas]
        name, mine = f"part-{part:06d}.warc.gz", f".{uuid.uuid4().hex}"
        entries, at, outs = [], 0, None
        for batch in batches:
            for page, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if outs is None:
                    for fs, root in stores:
                        fs.create_dir(root, recursive=True)
                    outs = [fs.open_output_stream(f"{root}/{mine}") for fs, root in stores]
                mark = zlib.crc32(str(page).encode())
                for out, (_, damaged_of) in zip(outs, replicas, strict=True):
                    out.write(_damaged(data) if damaged_of and mark % damaged_of == 0 else data)
                entries.append((page if page is not None else 0, int(page is not None), at, len(data)))
                at += len(data)
        if outs is None:
            return
        index = np.array(entries, ENTRY)
        for out, (fs, root) in zip(outs, stores, strict=True):
            out.close()
            fs.move(f"{root}/{mine}", f"{root}/{name}")
            with fs.open_output_stream(f"{root}/{mine}") as f:
                f.write(offset_table(index))
            fs.move(f"{root}/{mine}", f"{root}/{name}.idx")
        n = len(replicas)
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([part] * n, pa.int32()), pa.array([name] * n), pa.array([len(index)] * n), pa.array([at] * n)], names=[c.split()[0] for c in WRITTEN.split(", ")])

    return run


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            data = [stored(warc_record(*row)) for row in zip(*(c.to_pylist() for c in part.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], names=["page_id", "data"])


def write_replicas(pages: DataFrame, replicas: list[tuple[str, int]]) -> DataFrame:
    """Write ``pages`` (page_id, url, html) in order of page_id under each folder; records are compressed where the pages lie and sorted once. One row for each file and replica."""
    parts = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    records = pages.select("page_id", "url", "html").mapInArrow(_records, "page_id long, data binary")
    ordered = records.repartitionByRange(parts, F.col("page_id").asc_nulls_first()).sortWithinPartitions(F.col("page_id").asc_nulls_first(), "data")
    return ordered.mapInArrow(_write(replicas), WRITTEN)


def replica_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(file_no, name): the files that any of the folders lists, numbered by name."""
    names = set()
    for folder in folders:
        fs, root = scratch.open_store(folder)
        for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            names.add(info.base_name.removesuffix(".idx"))
    return spark.createDataFrame(list(enumerate(sorted(n for n in names if n.endswith(".warc.gz")))), "file_no int, name string")


def _bytes(fs: pafs.FileSystem, path: str) -> bytes | None:
    if fs.get_file_info(path).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def _file_leaves(fs: pafs.FileSystem, root: str, name: str) -> Iterator[tuple]:
    """(number, page, offset, length, digest) of one file's records."""
    there = fs.get_file_info(f"{root}/{name}").type == pafs.FileType.File
    table = _bytes(fs, f"{root}/{name}.idx")
    if table is None and not there:
        return
    index = read_offset_table(table) if table is not None else None
    if index is None:
        yield -1, None, 0, 0, f"no offset table in {root}"
        return
    if not there:
        for n, e in enumerate(index):
            yield n, int(e["page_id"]) if e["known"] else None, int(e["offset"]), int(e["length"]), f"no file in {root}"
        return
    end = 0
    with fs.open_input_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20) as f:
        for n, e in enumerate(index):
            yield n, int(e["page_id"]) if e["known"] else None, int(e["offset"]), int(e["length"]), hashlib.sha256(f.read(int(e["length"]))).hexdigest()
            end = int(e["offset"] + e["length"])
        rest, more = hashlib.sha256(), 0
        while data := f.read(1 << 20):
            rest.update(data)
            more += len(data)
    if more:
        yield len(index), None, end, more, rest.hexdigest()


def _leaves(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = scratch.open_store(folder)
        for batch in batches:
            for no, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                leaves = _file_leaves(fs, root, name)
                while rows := list(itertools.islice(leaves, ROWS)):
                    columns = [[no] * len(rows), *zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[c.split()[0] for c in LEAF.split(", ")])

    return run


def read_leaves(files: DataFrame, folder: str) -> DataFrame:
    """Every record of a replica with the digest of its stored bytes. ``files``: those of :func:`replica_files`."""
    parts = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return files.select("file_no", "name").repartition(parts).mapInArrow(_leaves(folder), LEAF)


#: How a level's nodes lie under those of the level above, and what names a node.
STEPS = {"records": (["file_no", "number"], "number"), "tops": (["file_no", "number"], None), "files": (["file_no"], "file_no")}


def _above(nodes: DataFrame, step: str) -> DataFrame:
    """The level above: nodes of FANOUT consecutive children each, with the range that they cover."""
    names, index = STEPS[step]
    if index is None:  # the top of a file's own tree stands for the file
        return nodes.select(F.col("file_no").cast("long").alias("file_no"), "offset", "length", "digest")
    rest = [c for c in names if c != index]
    child = F.struct(index, "offset", "length", "digest")
    up = nodes.groupBy(*rest, F.floor(F.col(index) / FANOUT).alias("up")).agg(F.sort_array(F.collect_list(child)).alias("c"))
    said = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x[index], x["offset"], x["length"], x["digest"])), ",")
    return up.select(*rest, F.col("up").alias(index), F.col("c")[0]["offset"].alias("offset"), F.aggregate("c.length", F.lit(0).cast("long"), lambda a, x: a + x).alias("length"), F.sha2(said, 256).alias("digest"))


def _below(nodes: DataFrame, bad: DataFrame, step: str) -> DataFrame:
    """Those of the nodes that lie under a bad node of the level above."""
    names, index = STEPS[step]
    if index is None:
        return nodes.join(bad.select("file_no"), "file_no", "left_semi")
    rest = [c for c in names if c != index]
    return nodes.withColumn("up", F.floor(F.col(index) / FANOUT)).join(bad.select(*rest, F.col(index).alias("up")), [*rest, "up"], "left_semi").drop("up")


def _extent(leaves: DataFrame) -> tuple[int, int]:
    """(records of the largest file, files): two numbers that tell how many levels there are."""
    x = leaves.groupBy("file_no").agg((F.max("number") + 1).alias("n")).agg(F.max("n").alias("n"), (F.max("file_no") + 1).alias("files")).first()
    return int(x.n or 0), int(x.files or 0)


def merkle_levels(leaves: DataFrame, records: int, files: int) -> list[tuple[DataFrame, str]]:
    """Levels from the leaves to the root, each with the step to the one above."""
    steps, n = [], records
    while n > 1:
        steps.append("records")
        n = -(-n // FANOUT)
    steps.append("tops")
    n = files
    while n > 1:
        steps.append("files")
        n = -(-n // FANOUT)
    leaf = F.sha2(F.concat_ws(":", "offset", "length", "digest"), 256)
    out = [leaves.select(F.col("file_no").cast("long").alias("file_no"), "number", "offset", "length", leaf.alias("digest"))]
    for step in steps:
        up = _above(out[-1], step)
        out.append(up if step == "tops" else scratch.cut(up, "nodes")[0])
    return list(zip(out, [*steps, ""], strict=True))


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Places whose digests differ, or that one side lacks."""
    names = [c for c in a.columns if c in ("file_no", "number")]
    x, y = a.select(*names, F.col("digest").alias("digest_a")), b.select(*names, F.col("digest").alias("digest_b"))
    return x.join(y, names, "full_outer").filter(~F.col("digest_a").eqNullSafe(F.col("digest_b")))


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file_no, number, digest_a, digest_b) of the leaves in which two replicas differ, found from the roots down."""
    (ra, fa), (rb, fb) = _extent(a), _extent(b)
    tree_a, tree_b = (merkle_levels(x, max(ra, rb), max(fa, fb)) for x in (a, b))
    bad = None
    for (x, step), (y, _) in zip(reversed(tree_a), reversed(tree_b), strict=True):
        if bad is not None:
            x, y = _below(x, bad, step), _below(y, bad, step)
        bad, _ = scratch.cut(_differ(x, y), "bad")
        if bad.isEmpty():  # nothing below can differ
            return _differ(tree_a[0][0].limit(0), tree_b[0][0].limit(0))
    return bad


def op6_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drill over all pages: two replicas are written, the second with a changed byte in the records of about one page in ``DAMAGED_OF``, and audited.

    One row a record: where it lies, its digest and whether the audit found it damaged.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folders = [scratch.new_path(spark, "replica") for _ in range(2)]
    scratch.cut(write_replicas(pages, list(zip(folders, (0, DAMAGED_OF), strict=True))), "replica-files")
    files = replica_files(spark, folders)
    leaves = [scratch.cut(read_leaves(files, folder), "leaves")[0] for folder in folders]
    bad = audit(*leaves).select(F.col("file_no").cast("int").alias("file_no"), "number", F.lit(True).alias("found"))
    return leaves[0].join(bad, ["file_no", "number"], "left").select("page_id", "file_no", "number", "offset", "length", "digest", F.coalesce("found", F.lit(False)).alias("damaged"))
