"""Packed binary datasets of small integers, and their readers and writers.

Two layouts, both little endian: the plain one has the number of rows (32 bits)
and of features (16 bits), then a row as one label byte and the features in
``bits`` bits each, least significant bit first; the checked one has a header of
32 bytes in front (magic ``EMLD``, version, bits, features, rows, bytes a row)
and an FNV-1a checksum of the rows behind.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import fnv1a
from ..lineage import open_store

MAGIC = b"EMLD"
HEADER = struct.Struct("<4sHBBHHIQQ")


def valid_rows(df: DataFrame, features: str, width: int, bits: int) -> DataFrame:
    """Rows whose array has the right length and values of 0 to 2**bits - 1."""
    return df.filter((F.size(features) == width) & F.forall(F.col(features), lambda v: (v >= 0) & (v < (1 << bits))))


def packed_bits(features: Column, width: int, bits: int) -> Column:
    """An array of small integers as binary: every output byte is put together from the values that reach into it."""
    out = []
    for byte in range((width * bits + 7) // 8):
        value = F.lit(0)
        for i in range(byte * 8 // bits, min((byte * 8 + 7) // bits + 1, width)):
            shift = i * bits - byte * 8
            v = F.get(features, i).cast("int")
            value = value.bitwiseOR(F.shiftleft(v, shift) if shift >= 0 else F.shiftright(v, -shift))
        out.append(F.lpad(F.hex(value.bitwiseAND(F.lit(255))), 2, "0"))
    return F.unhex(F.concat(*out))


def pack_matrix(x: np.ndarray, bits: int) -> np.ndarray:
    """Rows of values to rows of bytes."""
    n, f = x.shape
    flags = ((x[:, :, None].astype(np.uint16) >> np.arange(bits)) & 1).astype(np.uint8).reshape(n, f * bits)
    return np.packbits(flags, axis=1, bitorder="little")


def unpack_matrix(raw: np.ndarray, features: int, bits: int) -> np.ndarray:
    """Rows of bytes to rows of values, including values that span two bytes."""
    flags = np.unpackbits(raw, axis=1, bitorder="little")[:, : features * bits].reshape(len(raw), features, bits)
    return (flags.astype(np.uint16) << np.arange(bits, dtype=np.uint16)).sum(axis=2).astype(np.uint8)


def encode(labels: np.ndarray, x: np.ndarray, bits: int, checked: bool = False) -> bytes:
    return _framed(labels, pack_matrix(x, bits), x.shape[1], bits, checked)


def _framed(labels: np.ndarray, packed: np.ndarray, f: int, bits: int, checked: bool) -> bytes:
    rows = np.concatenate([labels.astype(np.uint8)[:, None], packed], axis=1).tobytes()
    n = len(labels)
    if not checked:
        return struct.pack("<IH", n, f) + rows
    size = 1 + (f * bits + 7) // 8
    return HEADER.pack(MAGIC, 1, bits, 0, f, size, n, len(rows), 0) + rows + struct.pack("<I", fnv1a(rows))


def decode(data: bytes, bits: int, check: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(labels, features); ValueError where magic, sizes or the checksum are wrong."""
    if data[:4] == MAGIC:
        _, _, bits, _, f, size, n, total, _ = HEADER.unpack(data[: HEADER.size])
        rows = data[HEADER.size : HEADER.size + total]
        if total != n * size or len(rows) != total or len(data) != HEADER.size + total + 4:
            raise ValueError("the sizes in the header are wrong")
        if check and struct.unpack("<I", data[-4:])[0] != fnv1a(rows):
            raise ValueError("the checksum is wrong")
    else:
        n, f = struct.unpack("<IH", data[:6])
        rows, size = data[6:], 1 + (f * bits + 7) // 8
        if len(rows) != n * size:
            raise ValueError("the file's length is wrong")
    raw = np.frombuffer(rows, np.uint8).reshape(n, size)
    return raw[:, 0], unpack_matrix(raw[:, 1:], f, bits)


def read_packed(spark: SparkSession, path: str, bits: int) -> DataFrame:
    """(path, row_no, label, features) of packed files, a file at a time in the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                labels, x = decode(data, bits)
                for i in range(0, len(labels), 10_000):
                    part = x[i : i + 10_000].astype(np.int16)
                    ends = np.arange(len(part) + 1, dtype=np.int32) * x.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(i, i + len(part))), pa.array(labels[i : i + 10_000].astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(part.ravel()))], names=["path", "row_no", "label", "features"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row_no long, label int, features array<short>")


def write_packed(df: DataFrame, label: str, names: list[str], bits: int, folder: str, checked: bool = True) -> DataFrame:
    """Write rows as packed files below a folder that all executors reach, a file a partition; (path, rows, dropped) of each. Rows with a null or a value that the bits cannot hold are dropped.

    A file is written under another name and then renamed, so a task that is run
    again replaces its own file.
    """
    import uuid

    from pyspark.taskcontext import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, rows, dropped = [], [], 0
        for b in batches:
            x = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in b.columns]) if b.num_rows else np.zeros((0, len(names) + 1))
            with np.errstate(invalid="ignore"):
                ok = (x[:, 1:] >= 0).all(axis=1) & (x[:, 1:] < 1 << bits).all(axis=1) & (x[:, 0] >= 0) & (x[:, 0] < 256) & ~np.isnan(x).any(axis=1)
            dropped += int((~ok).sum())
            labels.append(x[ok, 0].astype(np.uint8))
            rows.append(pack_matrix(x[ok, 1:].astype(np.uint8), bits))
        if not labels:
            return
        y, packed = np.concatenate(labels), np.concatenate(rows)
        fs, root = open_store(folder)
        fs.create_dir(root, recursive=True)
        name, mine = f"part-{TaskContext.get().partitionId():06d}.bin", f"{root}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(mine) as f:
            f.write(_framed(y, packed, len(names), bits, checked))
        fs.move(mine, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(y)]), pa.array([dropped])], names=["path", "rows", "dropped"])

    return df.select(F.col(label).cast("double"), *[F.col(c).cast("double") for c in names]).mapInArrow(run, "path string, rows long, dropped long")


def _layout(head: bytes, bits: int) -> tuple[int, int, int, int, int]:
    """(rows, features, bits, bytes a row, where the first row begins) from a file's first bytes."""
    if head[:4] == MAGIC:
        _, _, bits, _, count, size, n, *_ = HEADER.unpack(head[: HEADER.size])
        return n, count, bits, size, HEADER.size
    n, count = struct.unpack("<IH", head[:6])
    return n, count, bits, 1 + (count * bits + 7) // 8, 6


def read_rows(wanted: DataFrame, bits: int) -> DataFrame:
    """(path, row_no, label, features) of the wanted rows (path, row_no) of packed files: only their bytes are read, by seeking."""

    def run(table: pa.Table) -> pa.Table:
        path = table.column("path")[0].as_py()
        numbers = np.unique(table.column("row_no").to_numpy())
        fs, name = open_store(path)
        with fs.open_input_file(name) as f:
            n, count, width, size, begin = _layout(f.read(32), bits)
            numbers = numbers[(numbers >= 0) & (numbers < n)]
            raw = []
            for k in numbers.tolist():
                f.seek(begin + k * size)
                raw.append(f.read(size))
        got = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, size)
        x = unpack_matrix(got[:, 1:], count, width).astype(np.int16) if len(got) else np.zeros((0, count), np.int16)
        ends = np.arange(len(x) + 1, dtype=np.int32) * count
        return pa.table({"path": pa.array([path] * len(x), pa.string()), "row_no": pa.array(numbers), "label": pa.array(got[:, 0].astype(np.int32)), "features": pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))})

    return wanted.select("path", "row_no").groupBy("path").applyInArrow(run, "path string, row_no long, label int, features array<short>")


def copy_valid(spark: SparkSession, source: str, target: str, bits: int) -> DataFrame:
    """Copy the packed files of a folder whose sizes and checksum hold; (path, rows, error) of each: rows is null, and nothing is copied, where one does not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = error = None
                try:
                    rows = len(decode(data, bits)[0])
                    fs, root = open_store(target)
                    fs.create_dir(root, recursive=True)
                    name = path.rsplit("/", 1)[1]
                    with fs.open_output_stream(f"{root}/.{name}") as f:
                        f.write(data)
                    fs.move(f"{root}/.{name}", f"{root}/{name}")
                except (ValueError, struct.error) as x:
                    error = str(x)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([rows], pa.int64()), pa.array([error], pa.string())], names=["path", "rows", "error"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(source).select("path", "content").mapInArrow(run, "path string, rows long, error string")


def encode_log(pairs: list[tuple[int, int]]) -> bytes:
    """An inference log: magic ``INFL``, the number of pairs, then (predicted, actual) bytes."""
    return b"INFL" + struct.pack("<I", len(pairs)) + bytes(v for p in pairs for v in p)


def decode_log(data: bytes) -> list[tuple[int, int]]:
    if data[:4] != b"INFL":
        raise ValueError("not an inference log")
    n = struct.unpack("<I", data[4:8])[0]
    return [(data[8 + 2 * i], data[9 + 2 * i]) for i in range(min(n, (len(data) - 8) // 2))]
