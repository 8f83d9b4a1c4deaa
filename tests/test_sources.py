"""Sources, sinks and the feedback loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkquarry.sources import files, packed
from sparkquarry.streaming import feedback


def test_raw_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.EXE").write_bytes(b"MZ12")
    (tmp_path / "y.exe").write_bytes(b"MZ12")
    (tmp_path / "z.txt").write_bytes(b"hello")
    df = files.raw_files(spark, f"file://{tmp_path}", [".exe"])
    assert df.count() == 2 and df.filter(files.has_magic(F.col("content"))).count() == 2
    one = files.unique_contents(files.raw_files(spark, f"file://{tmp_path}"))
    assert sorted(r.copies for r in one.collect()) == [1, 2]


def test_entries(spark, tmp_path):
    root = tmp_path / "run.parquet" / "é data"
    for name in ("a.parquet", "b.parquet/part-0.parquet", "b.parquet/part-1.parquet", "c.PARQUET/k=1/part-0.parquet", "c.PARQUET/k=2/0", "d.txt", "sub/a.parquet", "e.parquet/_SUCCESS", "_f.parquet"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x")
    for folder in (f"file://{root}", f"{root}/", str(root)):
        assert sorted(r.name for r in files.entries(spark, folder, [".parquet"]).collect()) == ["a.parquet", "b.parquet", "c.PARQUET"]
    assert sorted(r.name for r in files.entries(spark, f"file://{root}").collect()) == ["a.parquet", "b.parquet", "c.PARQUET", "d.txt", "sub"]


def test_fit_csv(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("a,b,c\n1, 2 ,3\n4,bad,6\n7,8\n")
    rows = files.fit_csv(spark, f"file://{p}").collect()
    assert sorted(tuple(r) for r in rows) == [(1.0, 2.0, 3.0), (4.0, 0.0, 6.0)]
    assert not files.has_header(["1", "2"], ["3", "4"])


def test_params_and_reports(spark):
    assert files.read_dataset_params("quantization_coefficient,12\nnum_features=3\n") == {"quantization_coefficient": "8", "num_features": "3"}
    text = files.report_lines({"summary": {"fpr": 0.05}}, {"roc": spark.createDataFrame([(0.0, 0.5)], "fpr double, tpr double")})
    sections, curves = files.read_report(text)
    assert sections["summary"]["fpr"] == "0.05" and curves["roc"] == [["fpr", "tpr"], ["0.0", "0.5"]]
    assert "<svg" in files.curve_svg([(0, 0), (1, 1)], "roc") and "|" in files.markdown_table(spark.range(1))
    assert files.config_or_scan(None, spark.createDataFrame([("a",), ("b",)], "y string"), "y")["labels"] == 2


def test_split_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "x int, split string")
    files.write_split_table(df, f"file://{tmp_path}/t")
    assert [r.x for r in files.read_split(spark, f"file://{tmp_path}/t", "test").collect()] == [2]


def test_bounded_append(spark):
    old, new = spark.createDataFrame([(i,) for i in range(5)], "seq long"), spark.createDataFrame([(i,) for i in range(5, 8)], "seq long")
    kept, dropped = files.bounded_append(old, new, "seq", 4)
    assert sorted(r.seq for r in kept.collect()) == [4, 5, 6, 7] and sorted(r.seq for r in dropped.collect()) == [0, 1, 2, 3]


def test_packed_source(spark, tmp_path):
    x = np.array([[1, 15, 7], [3, 0, 9]], np.uint8)
    (tmp_path / "d.bin").write_bytes(packed.encode(np.array([1, 0]), x, 4, checked=True))
    rows = packed.read_packed(spark, f"file://{tmp_path}/d.bin", 4).orderBy("row_no").collect()
    assert [list(r.features) for r in rows] == x.tolist() and [r.label for r in rows] == [1, 0]
    got = packed.read_rows(spark.createDataFrame([(f"file://{tmp_path}/d.bin", n) for n in (1, 1, 7, -1)], "path string, row_no long"), 4).collect()
    assert [(r.row_no, r.label, list(r.features)) for r in got] == [(1, 0, [3, 0, 9])]
    (tmp_path / "bad.bin").write_bytes(packed.encode(np.array([1, 0]), x, 4, checked=True)[:-1] + b"?")
    copied = {r.path.rsplit("/", 1)[1]: (r.rows, r.error) for r in packed.copy_valid(spark, f"file://{tmp_path}", f"file://{tmp_path}/copy", 4).collect()}
    assert copied["d.bin"] == (2, None) and "checksum" in copied["bad.bin"][1] and not (tmp_path / "copy" / "bad.bin").exists()
    odd = spark.createDataFrame([(1, 3, 4), (0, 16, 1), (2, None, 1), (None, 1, 1), (3, -1, 0), (7, 15, 15)], "y int, a int, b int").coalesce(1)
    for checked in (True, False):
        folder = f"file://{tmp_path}/made{checked}"
        r = packed.write_packed(odd, "y", ["a", "b"], 4, folder, checked).collect()
        assert [(x.rows, x.dropped) for x in r] == [(2, 4)]
        assert [(x.label, list(x.features)) for x in packed.read_packed(spark, folder, 4).orderBy("row_no").collect()] == [(1, [3, 4]), (7, [15, 15])]
    f = spark.createDataFrame([([1, 15, 7],)], "f array<int>").select(packed.packed_bits(F.col("f"), 3, 4).alias("b")).first().b
    assert bytes(f) == packed.pack_matrix(x[:1], 4).tobytes()
    assert packed.decode_log(packed.encode_log([(1, 2), (3, 4)])) == [(1, 2), (3, 4)]
    with pytest.raises(ValueError):
        packed.decode_log(b"nope")


def test_feedback_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    schema = "key string, kind string, value string, at_ms long"
    rows = [("k", "prediction", f"p{i}", i) for i in range(4)] + [("k", "label", "l0", 10), ("k", "label", "l1", 5010), ("j", "label", "x", 1)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{src}")
    stream = spark.readStream.schema(schema).parquet(f"file://{src}")
    pairs = feedback.feedback_stream(stream, most_pending=3, wait_ms=5000)
    q = pairs.writeStream.outputMode("append").format("memory").queryName("pairs").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        got = sorted((r.seq, r.predicted, r.actual, r.status) for r in spark.table("pairs").collect())
    finally:
        q.stop()
    assert got == [(n + 1, f"p{n}", None, "overflow") for n in range(4)]
    q = feedback.write_feedback(feedback.feedback_stream(stream), f"file://{out}", f"file://{tmp_path}/cp2").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.read.parquet(f"file://{out}").count() == 2


def test_queue_skips_and_flushes():
    q = feedback.Queue(3, 5000)
    out = [x for i in range(3) for x in q.prediction(f"p{i}")]
    out += q.label("l0", 10) + q.label("l1", 5010) + q.label("l2", 5020)
    assert out == [(1, "p0", "l0", "labelled"), (2, "p1", None, "skipped"), (3, "p2", "l1", "labelled")] and not q.pending
    assert [s for *_, s in (x for i in range(4) for x in q.prediction(i))] == ["overflow"] * 4


def test_batch_and_stream_give_the_same_pairs(spark, tmp_path):
    rng = np.random.default_rng(2)
    events = [(str(rng.integers(0, 4)), "prediction" if rng.random() < 0.6 else "label", f"v{i}", i) for i in range(400)]
    want = {}
    for k in "0123":
        q = feedback.Queue(5)
        gone = [x for key, kind, v, _ in events if key == k for x in (q.prediction(v) if kind == "prediction" else q.label(v))]
        want |= {v: label for _, v, label, _ in gone} | {v: None for _, v in q.pending}
    df = spark.createDataFrame(events, "key string, kind string, value string, at long")
    p = df.filter("kind = 'prediction'").select("key", "at", "value")
    got = feedback.matched_in_order(p.select("key", "at"), df.filter("kind = 'label'").select("key", "at", F.col("value").alias("actual")), "key", "at", 5).join(p, ["key", "at"])
    assert {r.value: r.actual for r in got.collect()} == want
    schema = "key string, kind string, value string, at_ms long"
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    q = feedback.feedback_stream(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), 5).writeStream.outputMode("append").format("memory").queryName("same").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        streamed = {r.predicted: r.actual for r in spark.table("same").collect()}
    finally:
        q.stop()
    assert streamed == {v: label for v, label in want.items() if v in streamed} and {v for v, label in want.items() if label} <= set(streamed)


def test_csv_rows_equal_to_the_header_stay(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\nx,y\n3,4,5\n6\n\n 7 ,oops\n")
    (tmp_path / "b.csv").write_text("x,y\n8,9\n")
    rows = sorted(tuple(r) for r in files.fit_csv(spark, f"file://{tmp_path}", names=["x", "y"]).collect())
    assert rows == [(0.0, 0.0), (1.0, 2.0), (7.0, 0.0), (8.0, 9.0)]


def test_log_tools(spark):
    log = spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "seq long, predicted int, actual int")
    assert feedback.trimmed_log(log, "seq", 20).count() == 10
    assert sorted(r.seq for r in feedback.trimmed_log(log, "seq", 6).collect()) == [7, 8, 9]
    assert feedback.online_accuracy(log, "seq", 4).first().accuracy == 0.5
    assert feedback.admitted_labels(["a"], ["b", "a"], True) == ["a", "b"] and feedback.admitted_labels(["a"], ["b"], False) == ["a"]
    gaps = spark.createDataFrame([("k", 0), ("k", 25)], "key string, s long").select("key", F.timestamp_seconds("s").alias("at"))
    assert [r.slot for r in feedback.skipped_slots(gaps, "key", "at", 10).orderBy("at").collect()] == [1, 4]


def test_command_line(spark, tmp_path):
    from sparkquarry.__main__ import main

    spark.createDataFrame([(i, float(i % 7), float(i)) for i in range(50)], "id long, a double, b double").write.parquet(f"{tmp_path}/t")
    assert main(["quantize", f"{tmp_path}/t", f"{tmp_path}/q", f"{tmp_path}/q.json", "--bits", "2", "--others", f"{tmp_path}/t={tmp_path}/o"]) == 0
    assert main(["forest", f"{tmp_path}/q", f"{tmp_path}/m", "--key", "id", "--trees", "5"]) == 0
    assert main(["score", f"{tmp_path}/o", f"{tmp_path}/m", f"{tmp_path}/s", "--key", "id"]) == 0
    assert spark.read.parquet(f"{tmp_path}/s").count() == 50
    assert main(["query", "label_ids", "/root/testdata/sf0.001", f"{tmp_path}/l"]) == 0
    assert spark.read.parquet(f"{tmp_path}/l").count() == 25
