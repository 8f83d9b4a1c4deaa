"""Properties of operators that have no SQL twin, and edge cases of those that have."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkquarry.functions import scalar as S
from sparkquarry.operators import audit, columns, engine, forest, metrics, quantize, ranks, search, setops, splits, threshold, trees


def scores(spark, rows):
    return spark.createDataFrame([(i, float(s), bool(p)) for i, (s, p) in enumerate(rows)], "id long, score double, pos boolean")


def test_auc_of_one_class_and_ties(spark):
    one = scores(spark, [(0.1, True), (0.2, True)])
    assert metrics.roc_auc(one, "score", F.col("pos")).first()[0] == 0.5
    assert metrics.average_precision(scores(spark, [(0.1, False)]), "score", F.col("pos"), "id").first()[0] == 0.0
    tied = scores(spark, [(1, True), (1, False), (1, True), (1, False)])
    assert metrics.roc_auc(tied, "score", F.col("pos")).first()[0] == 0.5


def test_auc_is_invariant_under_monotone_maps(spark):
    rng = np.random.default_rng(3)
    df = scores(spark, zip(rng.normal(size=200).round(2), rng.random(200) < 0.3))
    a = metrics.roc_auc(df, "score", F.col("pos")).first()[0]
    b = metrics.roc_auc(df.withColumn("score", F.exp("score")), "score", F.col("pos")).first()[0]
    assert a == pytest.approx(b, abs=1e-12)


def test_thresholds_keep_the_limit(spark):
    rng = np.random.default_rng(5)
    df = scores(spark, zip(rng.normal(size=300).round(1), rng.random(300) < 0.2)).withColumn("pos", F.col("pos"))
    for rule in ("fpr", "tpr", "youden", "f1"):
        t = threshold.choose_threshold(df, "score", F.col("pos"), rule, 0.07).first()
        below = df.filter((F.col("score") < t.threshold) & ~F.col("pos")).count()
        assert below / df.filter(~F.col("pos")).count() <= 0.07
        assert t.fpr == pytest.approx(below / df.filter(~F.col("pos")).count())
    assert threshold.threshold_at_fpr(df, "score", F.col("pos"), 0.0).first().fpr == 0.0
    assert threshold.choose_threshold(df, "score", F.col("pos"), "model", 0.1).first()[0] == 0.0
    with pytest.raises(ValueError):
        threshold.choose_threshold(df, "score", F.col("pos"), "nope", 0.1)
    assert threshold.fpr_target(None, 0.05, None, 0.01) == pytest.approx(0.04)


def test_counts_merge(spark):
    rows = [(i % 3, (i * 7) % 3) for i in range(100)]
    df = spark.createDataFrame(rows, "p int, a int")
    whole = {r.label: (r.tp, r.fp, r.fn) for r in metrics.label_counts(df, "p", "a").collect()}
    parts = [metrics.label_counts(spark.createDataFrame(rows[i::2], "p int, a int"), "p", "a") for i in (0, 1)]
    both = parts[0].union(parts[1]).groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    assert whole == {r.label: (r.tp, r.fp, r.fn) for r in both.collect()}


@given(st.integers(1, 10_000))
def test_path_normaliser_grows(n):
    assert S.path_normaliser_py(n + 1) >= S.path_normaliser_py(n)


def test_scalar_edges(spark):
    df = spark.createDataFrame([("1e3",), ("abc",), ("inf",), ("nan",), (None,), (" 7 ",)], "x string")
    assert [r[0] for r in df.select(S.sanitize(F.col("x"))).collect()][:5] == [1000.0, 0.0, 0.0, 0.0, 0.0]
    z = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r[0] for r in z.select(S.l2_normalise(F.col("v"))).collect()] == [[0.0, 0.0], [0.6, 0.8]]
    n = spark.createDataFrame([(-2.5,), (2.5,), (1e30,)], "x double")
    assert [r[0] for r in n.select(S.scaled_integer(F.col("x"), F.lit(1.0))).collect()] == [-3, 3, 9223372036854775807]
    assert S.fnv1a(b"") == 0x811C9DC5 and S.fnv1a(b"a") == 0xE40C292C
    b = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b""),), (bytearray(b"hello"),)], "x binary")
    assert [r[0] for r in b.select(S.fnv1a_udf(32)(F.col("x"))).collect()] == [S.fnv1a(b"a"), S.fnv1a(b""), S.fnv1a(b"hello")]
    assert S.replace_json_number('{"threshold": -0.5, "b": 1}', "threshold", 0.25) == '{"threshold": 0.25, "b": 1}'
    assert S.metric_name("AUC") == "roc_auc" and S.better("logloss", 0.1, 0.2) and S.ratio_of(5) == 0.05
    with pytest.raises(ValueError):
        S.metric_name("nope")
    assert S.stable_json_hash({"b": 1, "a": 2}) == S.stable_json_hash({"a": 2, "b": 1})


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "a int, b double, c double")
    assert columns.select_features(df, ["c", "zz", "b"]).first()[:] == (0.0, 0.0, 2.0)
    with pytest.raises(ValueError, match="zz"):
        columns.require_columns(df, ["a", "zz"])
    # b has two live partners, a one; then c has none left
    assert columns.prune_correlated([("a", "b", 0.99), ("b", "c", 0.98)], {"a": 1.0, "b": 2.0, "c": 0.5}) == ["b"]
    same = columns.prune_correlated([("a", "b", 0.99)], {"a": 1.0, "b": 2.0})
    assert same == ["a"]


def test_multisets(spark):
    a = setops.multiset(spark.createDataFrame([(1,)] * 9 + [(2,)], "x long"), "x", 3)
    b = setops.multiset(spark.createDataFrame([(2,), (2,), (3,)], "x long"), "x", 3)
    got = lambda d: {r.id: r.cnt for r in d.collect()}
    assert got(a) == {1: 7, 2: 1}
    assert got(setops.multiset_union(a, b)) == {1: 7, 2: 2, 3: 1}
    assert got(setops.multiset_intersection(a, b)) == {2: 1}
    assert got(setops.multiset_plus(a, b, 3)) == {1: 7, 2: 2, 3: 1}
    assert got(setops.multiset_minus(a, b)) == {1: 7}
    assert setops.is_subset(setops.multiset_intersection(a, b), a) and not setops.is_subset(b, a)
    assert got(setops.without_range(setops.filled(spark, 1, 5), 2, 4)) == {1: 1, 5: 1}


def test_split_hygiene(spark):
    a = spark.createDataFrame([(1, "x", 0), (2, "y", 5), (3, None, 7), (4, "z", 0)], "id long, t string, f int")
    b = spark.createDataFrame([(9, "x", 5), (8, None, 0)], "id long, t string, f int")
    assert sorted(r.id for r in splits.without_rows_of(a, b, ["t"]).collect()) == [2, 4]
    again = splits.without_rows_of(splits.without_rows_of(a, b, ["t"]), b, ["t"])
    assert sorted(r.id for r in again.collect()) == [2, 4]
    assert sorted(r.id for r in splits.without_family_of(a, b, "f").collect()) == [1, 3, 4]
    clean, state = splits.separation_audit(a, b, ["t"], "f")
    assert state["sealed_pass"] and clean.count() == 1
    m = audit.manifest(state, 1, {"k": 1})
    assert m["all_pass"] and len(m["run_id"]) == 16
    with pytest.raises(ValueError):
        splits.sealed_paths("a", "a")
    assert splits.resolve_split(["tr_1", "te"], "x", "tr*") == "tr_1"
    down = splits.family_downsample(spark.createDataFrame([(i, i % 4) for i in range(20)], "id long, f int"), "f", "id", 5)
    assert down.count() == 5 and down.filter("f <> 0").select("f").distinct().count() == 3


def test_manifest_gates(spark, tmp_path):
    p = f"file://{tmp_path}/m"
    good = {"rows": 5, "sealed_pass": True, "largest_cosine": 0.9}
    for state, gate in (({"rows": 1, "sealed_pass": False}, "sealed"), ({**good, "rows": 0}, "least_rows"), ({**good, "largest_cosine": 0.99}, "projected")):
        audit.write_manifest(spark, audit.manifest(state, 1, {}, 0.95), p)
        with pytest.raises(ValueError, match=gate):
            audit.require_manifest(spark, p)
    m = audit.manifest(good, 1, {}, 0.95)
    audit.write_manifest(spark, m, p)
    assert audit.require_manifest(spark, p)["run_id"] == m["run_id"]
    audit.write_manifest(spark, {**m, "state": {**good, "rows": 9}}, p)
    with pytest.raises(ValueError, match="run id"):
        audit.require_manifest(spark, p)


def test_kfold_and_strata(spark):
    df = spark.createDataFrame([(i * 3, i % 2) for i in range(23)], "id long, y int")
    sizes = [r.n for r in splits.kfold(df, "id", 5).groupBy("fold").agg(F.count("*").alias("n")).orderBy("fold").collect()]
    assert sizes == [5, 5, 5, 4, 4]
    parts = splits.stratified_parts(df, "y", "id", {"a": 0.7, "b": 0.3})
    assert parts.groupBy("part", "y").count().count() == 4


def test_quantizer(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, float(i % 4), float([0.5, 2.0, 9.0][i % 3]), float(rng.normal()), 5.0) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, full double, few double, real double, same double")
    q = quantize.fit_quantizer(df, ["full", "few", "real", "same"], bits=2)
    assert [r.kind for r in q.rules] == ["full", "custom", "continuous", "custom"]
    out = quantize.quantized(df, q).toPandas().sort_values("id")
    src = df.toPandas().sort_values("id")
    assert out[["full", "few", "real", "same"]].to_numpy().min() >= 0 and out[["full", "few", "real", "same"]].to_numpy().max() <= 3
    order = np.argsort(src.real.to_numpy())
    assert (np.diff(out.real.to_numpy()[order]) >= 0).all()
    p = f"file://{tmp_path}/q"
    q.save(spark, p)
    q.save(spark, p)
    assert quantize.Quantizer.load(spark, p) == q
    far = spark.createDataFrame([(0.0, 5.2, 99.0, 5.0)], "full double, few double, real double, same double")
    assert quantize.drift_signals(far, q).first().drift.feature == "few"
    assert quantize.quantized(far, q, "drift").first()["few"] == 3  # unknown category: top bin
    assert quantize.quantized(far, q).first()["few"] == 1  # nearest
    rule, m = quantize.rebinned(q.rules[2], [50.0], 4)
    assert rule.hi == 50.0 and sorted(m) == [0, 1, 2, 3] and all(0 <= v <= 3 for v in m.values())
    wide = quantize.axis_scale(0, 1e6)
    assert wide == 1
    pending = quantize.PendingRemap()
    pending.add("real", {0: 1})
    assert pending.read(quantize.quantized(df, q)).filter("real = 0").count() == 0 and pending.version == 1 and not pending.maps


def test_isolation_forest(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(400, 2)), rng.normal(size=(20, 2)) * 0.2 + 9])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    f = forest.fit_forest(df, "id", ["a", "b"], forest.ForestConfig(trees=60, max_samples=128, continuous=True))
    s = forest.scored(df, f, "id").toPandas().sort_values("id")
    assert s.score.between(-1, 0).all()
    assert s.score[400:].mean() < s.score[:400].mean()
    g = forest.fit_forest(df, "id", ["a", "b"], forest.ForestConfig(trees=60, max_samples=128, continuous=True))
    pd.testing.assert_frame_equal(f.nodes, g.nodes)
    f.threshold = -0.6
    f.save(spark, str(tmp_path / "m"))
    h = forest.Forest.load(spark, str(tmp_path / "m"))
    assert h.threshold == -0.6 and len(h.nodes) == len(f.nodes)
    shape = forest.forest_shape(spark.createDataFrame(f.nodes)).first()
    assert shape.trees == 60 and shape.nodes == 2 * shape.leaves - 60 and shape.max_depth <= 7
    binned = df.select("id", F.round("a").cast("int").alias("a"), F.round("b").cast("int").alias("b"))
    assert forest.scored(binned, forest.fit_forest(binned, "id", ["a", "b"], forest.ForestConfig(trees=10, bootstrap=True)), "id").count() == 420


def test_random_forest_and_booster_beat_the_majority(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(a), int(b), int((a > 7) ^ (b > 7))) for i, (a, b) in enumerate(rng.integers(0, 16, (600, 2)))]
    df = spark.createDataFrame(rows, "id long, a int, b int, y int")
    f = trees.fit_random_forest(df, "id", ["a", "b"], "y", trees.RandomForestConfig(trees=15))
    acc = trees.predicted(df, f, "id").join(df, "id").agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    assert acc > 0.9
    oob = trees.out_of_bag(df, f, "id", 600).join(df, "id").agg(F.avg((F.col("vote") == F.col("y")).cast("double"))).first()[0]
    assert oob > 0.8
    m = trees.fit_booster(df, ["a", "b"], "y", trees.BoostConfig(rounds=3, max_depth=4), valid=df)
    acc = trees.boosted(df, m, ["id", "y"]).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    assert acc > 0.75 and len(m.losses) == 3 and m.losses[-1] < math.log(2)
    assert trees.with_criterion(trees.RandomForestConfig(impurity_threshold=0.1), "entropy").impurity_threshold == 0.25
    assert trees.auto_config({"a": 90, "b": 10}, 100, 4)["scoring"] == "kfold"


def test_search_and_audits(spark):
    rng = np.random.default_rng(6)
    good, bad = rng.normal(size=(300, 3)), rng.normal(size=(40, 3)) * 0.3 + 5
    names = ["a", "b", "c"]
    frame = lambda x, y, at: spark.createDataFrame([(at + i, *map(float, r), y) for i, r in enumerate(x)], "id long, a double, b double, c double, pos boolean")
    train, valid = frame(good[:150], False, 0), frame(good[150:], False, 1000).union(frame(bad, True, 5000))
    results, best = search.search(train, valid, names, "id", "pos", {"n_features": [2, 3], "trees": [20]}, 0.06)
    assert len(results) == 2 and best["tpr_val"] > 0.8
    final = search.final_evaluation(train, valid, best, "id", "pos")
    assert final["roc_auc"] > 0.9
    vec = valid.select("id", F.array(*names).alias("v"), "pos")
    t = audit.mmd_permutation_test(vec, "id", "v", F.col("pos"), 60, 50)
    assert t["p_value"] < 0.1 and audit.mmd2(vec, "id", "v", F.col("pos"), 60).first().mmd2 > 0.1
    auc = audit.split_predictability(valid, names, F.col("pos"), "id", 2)
    assert min(r.auc for r in auc.collect()) > 0.9
    assert audit.silhouette(valid.withColumn("k", F.col("pos").cast("int")), names, "k") > 0.3
    assert audit.pca_2d(valid, names, ["id"]).columns == ["id", "pc1", "pc2"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 7), min_size=5, max_size=5), min_size=1, max_size=20))
def test_bit_packing_round_trip(rows):
    from sparkquarry.sources import packed

    x = np.array(rows, np.uint8)
    labels = np.arange(len(x), dtype=np.uint8)
    for checked in (False, True):
        data = packed.encode(labels, x, 3, checked)
        got_labels, got = packed.decode(data, 3)
        assert (got == x).all() and (got_labels == labels).all()
    broken = bytearray(packed.encode(labels, x, 3, True))
    broken[33] ^= 1
    with pytest.raises(ValueError):
        packed.decode(bytes(broken), 3)


def test_ordered_sums_match_plain_ones(spark):
    """Outliers, ties, nulls and one hot group; ranges are cut where the rows are."""
    rng = np.random.default_rng(7)
    rows = [(i, None if i % 50 == 0 else float(rng.normal()) if i % 3 else 1e300, "hot" if i % 5 else None, int(rng.integers(0, 9))) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, key double, g string, v long").repartition(5)
    got = {r.id: r for r in ranks.running_sums(df, "id", ["v"], by=["g"]).collect()}
    for g in ("hot", None):
        total = 0
        mine = [r for r in rows if r[2] == g]
        for i, _, _, v in mine:
            assert (got[i].v_before, got[i].v_total) == (total, sum(r[3] for r in mine))
            total += v
    n = {r.id: r.row_no for r in ranks.numbered(df, "key", tie="id").collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert [n[r[0]] for r in order] == list(range(900))
    down = {r.id: r.v_before for r in ranks.running_sums(df.filter("key is not null"), "key", ["v"], descending=True, tie="id").collect()}
    total = 0
    for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[0])):
        assert down[r[0]] == total
        total += r[3]
    assert ranks.numbered(df.limit(0), "id").count() == 0


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    data = {"same": [4.0] * 70, "one": [2.5], "wide": [*rng.normal(size=400).tolist(), 1e18, -1e18], "few": rng.integers(0, 3, 300).astype(float).tolist()}
    df = spark.createDataFrame([(f, v) for f, vs in data.items() for v in [*vs, None]], "feature string, value double").repartition(4)
    q = [0.0, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {r.feature: list(r.q) for r in ranks.quantiles(df, "feature", "value", q).collect()}
    assert set(got) == set(data)
    for f, vs in data.items():
        assert got[f] == pytest.approx(np.quantile(vs, q).tolist(), rel=1e-9)


def test_neighbours_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(splits, "QUERY_BLOCK", 30)
    monkeypatch.setattr(splits, "REF_BLOCK", 40)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(120, 6))
    v[60:] = v[:60] * 2  # equal cosines
    v[7] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(500, None)], "id long, v array<double>")
    u = v / np.where((n := np.linalg.norm(v, axis=1)) == 0, 1, n)[:, None]
    sim = np.round(u @ u.T, 9)
    got = {}
    for r in splits.nearest_cosine(df, df, "id", "v", 3).collect():
        got.setdefault(r.id, {})[r.place] = (r.neighbour, r.cosine)
    for i in range(120):
        want = sorted((j for j in range(120) if j != i), key=lambda j: (-sim[i, j], j))[:3]
        assert [got[i][p][0] for p in (1, 2, 3)] == want
    assert splits.nearest_cosine(df, df.limit(0), "id", "v").count() == 0 and len(got) == 120


def test_correlations_with_gaps(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)) * [1, 1e6, 1, 1] + [0, 1e9, 5, 5]
    x[:, 2] = x[:, 0] * 2 + rng.normal(size=200)
    x[:, 3] = 7
    rows = [[None if rng.random() < 0.1 else float(c) for c in r] for r in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(3)
    got = {(r.a, r.b): r.r for r in columns.correlation_pairs(df, list("abcd")).collect()}
    y = np.array([[np.nan if c is None else c for c in r] for r in rows])
    for i, j in ((0, 1), (0, 2), (1, 2)):
        ok = ~np.isnan(y[:, i]) & ~np.isnan(y[:, j])
        assert got["abcd"[i], "abcd"[j]] == pytest.approx(abs(np.corrcoef(y[ok, i], y[ok, j])[0, 1]), rel=1e-6)
    assert not any("d" in k for k in got)


def test_byte_entropy_counts_bytes(spark):
    rows = [(1, "é" * 4), (2, "aab"), (3, ""), (4, None), (5, "".join(map(chr, range(128))))]
    got = {r.id: r.entropy for r in columns.byte_entropy(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect()}
    assert got == pytest.approx({1: 1.0, 2: 0.9182958, 3: 0.0, 4: 0.0, 5: 7.0})


def test_settings_follow_the_counts():
    for counts, metric, scoring in (({0: 1000, 1: 1000}, "precision", "validation"), ({0: 900, 1: 100}, "f1_score", "validation"), ({0: 990, 1: 10}, "recall", "validation"), ({0: 300}, "accuracy", "oob"), ({i: 100 for i in range(3)}, "precision", "kfold")):
        c = trees.auto_config(counts, 20)
        assert (c["metric"], c["scoring"]) == (metric, scoring) and c["train"] + c["test"] + c["valid"] == pytest.approx(1)
        assert (c["valid"] > 0) == (scoring == "validation")
    assert trees.auto_config({0: 1000, 1: 1000}, 20)["train"] == pytest.approx(0.8) and trees.auto_config({0: 1000, 1: 151}, 20)["train"] == pytest.approx(0.7)
    r = trees.search_ranges({0: 16000, 1: 16000}, 40)
    assert r["min_split"] == (2, 5) and r["max_depth"] == (15, 21) and 1 <= r["min_leaf"][0] <= r["min_leaf"][1] <= 4
    small = trees.impurity_threshold({0: 500, 1: 500}, 2), trees.impurity_threshold({0: 500_000, 1: 500_000}, 2), trees.impurity_threshold({0: 990, 1: 10}, 2)
    assert small[1] < small[0] and small[2] < small[0] and trees.impurity_threshold({}, 2, "entropy") >= 0.002


def test_equal_samples_are_drawn_anew(spark):
    df = spark.createDataFrame([(i, i % 2, i % 2) for i in range(3)], "id long, x int, y int")
    cfg = trees.RandomForestConfig(trees=30, bootstrap=False, sample_ratio=0.5)
    model = trees.fit_random_forest(df, "id", ["x"], "y", cfg)
    assert model.again and all(1 <= n <= 8 for n in model.again.values())


def test_scores_of_a_forest(spark):
    df = spark.createDataFrame([(i, i % 8, (i * 7) % 5, int(i % 8 > 3)) for i in range(400)], "id long, a int, b int, y int")
    cfg = trees.RandomForestConfig(trees=5, max_depth=4)
    model = trees.fit_random_forest(df, "id", ["a", "b"], "y", cfg)
    assert trees.validation_score(df, model, "id", "y") > 0.95 and trees.oob_score(df, model, "id", "y") > 0.9
    assert trees.kfold_score(df, "id", ["a", "b"], "y", cfg, 3, "f1_score") > 0.9
    with pytest.raises(ValueError):
        trees.kfold_score(df, "id", ["a", "b"], "y", cfg, 11)
    with pytest.raises(ValueError):
        trees.kfold_score(df.limit(7), "id", ["a", "b"], "y", cfg, 2)
    one = trees.fit_single_tree(df, ["a", "b"], "y", trees.RandomForestConfig(max_depth=4))
    assert trees.validation_score(df, one, "id", "y") == 1.0 and len(one.nodes) == 3


def test_leaves_in_fixed_point():
    model = trees.Booster(["x"], [0, 1], 0.3, [[{0: ("cut", 0, 3), 1: ("leaf", 1.7), 2: ("leaf", -2.4)}, {0: ("leaf", 0.01)}]])
    bits = trees.leaf_scale_bits(model, 8)
    assert bits == 5 and trees.fixed_leaf(2.4, 5, 8) == 77 and trees.fixed_leaf(99, 5, 8) == 127 and trees.fixed_leaf(-99, 5, 8) == -128
    out = trees.with_fixed_leaves(model, 8).trees[0][0]
    assert out[0] == ("cut", 0, 3) and abs(out[1][1] - 1.7) <= 2**-6 and abs(out[2][1] + 2.4) <= 2**-6


def test_engine_answers_with_a_status(spark, tmp_path):
    from sparkquarry.plans.catalog_more import _fixed_forest

    e = engine.Engine(_fixed_forest())
    e.save(spark, f"file://{tmp_path}/e")
    e = engine.Engine.load(spark, f"file://{tmp_path}/e")
    assert e.metadata()["trees"] == 2 and e.metadata()["threshold"] == -0.5
    rows = spark.createDataFrame([(1, 10.0, 50.0), (2, None, 1.0), (3, float("nan"), 1.0)], "id long, a double, b double")
    got = {r.id: (r.status, r.score is None) for r in e.infer_quantized(rows, "id").collect()}
    assert got == {1: ("ok", False), 2: ("missing value", True), 3: ("missing value", True)}
    assert e.infer_quantized(rows.limit(0), "id").count() == 0
    nodes = spark.read.parquet(f"file://{tmp_path}/e/forest").withColumn("threshold", F.col("threshold") + 1)
    nodes.write.parquet(f"file://{tmp_path}/changed")
    with pytest.raises(ValueError, match="damaged"):
        forest.Forest.load(spark, f"file://{tmp_path}/changed")


def test_draws_are_even(spark):
    x = spark.range(6000).select(S.bounded_draw(3, 6, "id").alias("d")).groupBy("d").count().collect()
    assert sorted(r.d for r in x) == list(range(6)) and all(850 < r["count"] < 1150 for r in x)
