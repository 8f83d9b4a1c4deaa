"""Length-delimited binary token records with a separate offset index.

A record file is a row of frames. A frame is
    length of the payload   unsigned 64 bits, little endian
    masked crc32 of these eight bytes, 32 bits
    payload: the ids, as unsigned integers of the file's width (2 or 4 bytes)
    masked crc32 of the payload, 32 bits
with mask(c) = ((c >> 15 | c << 17) + 0xA282EAD8) mod 2**32, so that a checksum
kept inside a payload does not look like its own.

Beside each record file lies an index file: the magic ``RIX1``, the width, the
number of records, then for each record its doc_id (64 bits), a flag that is 0
for a null doc_id, and its frame's offset and length (64 bits each). A shuffled
reader needs the index alone to seek to any record.

Files are numbered in ascending order of doc_id (nulls first; rows that repeat a
doc_id in the order of their texts), and so are the records in each. A file is
written under another name and then renamed, with bytes that depend on its rows
alone, so a task that is run again leaves the same file.

Edge cases: a null text is an empty text; its record holds the end id alone. Null
doc_ids come first and keep that in the index; rows that repeat a doc_id are records
of their own. Very long texts are one record each, encoded wholly. Other columns
than doc_id and text are not read. An empty table gives no file and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.taskcontext import TaskContext

from . import scratch
from .textkernel import slices, text_buffer
from .tokenkernel import default_vocabulary, encoder

END_ID = 0
MAGIC = b"RIX1"
ENTRY = np.dtype([("doc_id", "<i8"), ("known", "<i8"), ("offset", "<i8"), ("length", "<i8")])
WRITTEN = "file_no int, path string, records long, tokens long, bytes long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one frame; ValueError if a length or checksum is wrong."""
    if len(data) < 16 or struct.unpack("<I", data[8:12])[0] != masked(data[:8]):
        raise ValueError("a frame's length is damaged")
    n = struct.unpack("<Q", data[:8])[0]
    payload = data[12 : 12 + n]
    if len(data) != n + 16 or struct.unpack("<I", data[12 + n :])[0] != masked(payload):
        raise ValueError("a frame's payload is damaged")
    return payload


def _write(folder: str, vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        kind = np.dtype("<u2") if len(enc.width) <= 1 << 16 and end_id < 1 << 16 else np.dtype("<u4")
        part = TaskContext.get().partitionId()
        fs, root = scratch.open_store(folder)
        name, mine = f"{root}/part-{part:06d}.rec", f"{root}/.{uuid.uuid4().hex}"
        entries, at, tokens, out = [], 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(mine)
            known = np.asarray(batch.column(0).is_valid())
            doc = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            buf, offs = text_buffer(batch.column(1))
            for i, j in slices(offs):
                ids, begin = enc.encode(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                raw = np.insert(ids, begin[1:], end_id).astype(kind).tobytes()
                begin = (begin + np.arange(len(begin))) * kind.itemsize
                frames = [frame(raw[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                length = np.array([len(f) for f in frames], np.int64)
                e = np.zeros(j - i, ENTRY)
                e["doc_id"], e["known"], e["length"] = doc[i:j], known[i:j], length
                e["offset"] = at + np.cumsum(length) - length
                entries.append(e)
                at += int(length.sum())
                tokens += len(raw) // kind.itemsize
                out.write(b"".join(frames))
        if out is None:
            return
        out.close()
        fs.move(mine, name)
        index = np.concatenate(entries)
        with fs.open_output_stream(mine) as f:
            f.write(MAGIC + struct.pack("<IQ", kind.itemsize, len(index)) + index.tobytes())
        fs.move(mine, name + ".idx")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{folder}/part-{part:06d}.rec"]), pa.array([len(index)]), pa.array([tokens]), pa.array([at])], names=[c.split()[0] for c in WRITTEN.split(", ")])

    return run


def write_records(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into record files under ``folder``, a URI that all executors reach; one row for each file."""
    spark = docs.sparkSession
    ordered = docs.select("doc_id", "text").repartitionByRange(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return ordered.mapInArrow(_write(folder, vocabulary or default_vocabulary(), end_id), WRITTEN)


def read_index(fs: pafs.FileSystem, path: str) -> tuple[int, np.ndarray]:
    """(bytes of an id, entries) of a record file's index."""
    with fs.open_input_stream(path + ".idx") as f:
        data = f.read()
    if data[:4] != MAGIC:
        raise ValueError(f"{path}.idx is no index")
    width, n = struct.unpack("<IQ", data[4:16])
    return width, np.frombuffer(data, ENTRY, n, 16)


def read_one(path: str, number: int) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids) of one record, found by the index alone."""
    fs, name = scratch.open_store(path)
    width, index = read_index(fs, name)
    e = index[number]
    with fs.open_input_file(name) as f:
        f.seek(int(e["offset"]))
        payload = unframe(f.read(int(e["length"])))
    return (int(e["doc_id"]) if e["known"] else None), np.frombuffer(payload, f"<u{width}")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fs, name = scratch.open_store(uri)
            width, index = read_index(fs, name)
            with fs.open_input_stream(name, buffer_size=1 << 20) as f:
                at = 0
                while at < len(index):
                    part = index[at : at + 1000]
                    n = np.empty(len(part), np.int64)
                    crc = np.empty(len(part), np.int64)
                    for x, size in enumerate(part["length"].tolist()):
                        ids = np.frombuffer(unframe(f.read(size)), f"<u{width}")
                        n[x], crc[x] = len(ids), zlib.crc32(ids.astype("<u4").tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(part["doc_id"]), mask=part["known"] == 0), pa.array(base + np.cumsum(n) - n), pa.array(n), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    base += int(n.sum())
                    at += len(part)


def read_digests(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record of the files, all frames checked. ``files``: rows of :func:`write_records`."""
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.select("path", before.alias("base"))  # one row a file
    spark = files.sparkSession
    return placed.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as record files in the shared folder and digest what the files hold."""
    folder = scratch.new_path(spark, "records")
    files, _ = scratch.cut(write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder), "record-files")
    return read_digests(files)
