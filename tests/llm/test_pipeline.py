"""The pipeline against its stages in plain Python."""

import corpus_pipeline
from sparkquarry.llm import line_quality, registry, secret_scan

from . import brute
from .test_operators import check_packing

LABELS = "doc_id long, quality int, toxic int"


def plain(spark, sf_dir, docs, labels, items):
    """Texts that should be packed, by doc_id."""
    field = line_quality.fit(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    kept = {r.doc_id for r in line_quality.judge_lines(spark.createDataFrame(docs, "doc_id long, text string"), field).filter("kept").collect()}
    texts = {d: t for d, t in docs if d in kept}
    comp = brute.components(texts, 5, 80)
    texts = {d: t for d, t in texts.items() if comp[d][1] == d}
    bad = {d for d, *_ in brute.contained(texts, items)}
    texts = {d: t for d, t in texts.items() if d not in bad}
    net = secret_scan.fit(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    out = {}
    for d, t in texts.items():
        base, found = secret_scan.scan_text(t)
        hit = secret_scan.accepted_runs(net, [(t, s, e) for s, e in found])
        out[d] = secret_scan.redacted(t, sorted(base + [(s, 3, e) for (s, e), h in zip(found, hit) if h]))
        assert not brute.secret_spans(out[d])
    return out


def test_pipeline(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = {r.item_id: r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    want = plain(spark, small, docs, spark.read.parquet(f"{small}/labels.parquet"), items)
    assert {r.doc_id for r in rows} == set(want)
    check_packing(rows, want)


def test_stages_on_odd_rows(spark, small, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, small)
            assert sorted(out.columns) == sorted(docs.columns)
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() >= docs.count()


def test_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "packing"]
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 11)}
