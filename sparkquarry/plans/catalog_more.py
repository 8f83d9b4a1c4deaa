"""More queries of the catalogue: sources and sinks, models with fixed nodes, training, guards and the feedback loop."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from .. import lineage
from ..functions import scalar as S
from ..operators import audit, engine, forest, metrics, quantize, search, setops, splits, threshold, trees
from ..sources import files, packed
from ..streaming import feedback
from .catalog import NORMED, SCORED, query, r6, rounded, scored_events

# --- sources and sinks


@query("file_scan", "select unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) || '.parquet' as name, '.parquet' as suffix")
def file_scan(spark, d):
    return files.entries(spark, d, [".parquet"]).filter(F.col("name").isin([f"{t}.parquet" for t in files.TABLES])).select("name", files.suffix_of(F.col("name")).alias("suffix"))


@query("magic_prefix", "select doc_id, coalesce(left(text, 2) = 'Th', false) as found from documents")
def magic_prefix(spark, d):
    return files.table(spark, d, "documents").select("doc_id", F.coalesce(files.has_magic(F.col("text").cast("binary"), b"Th"), F.lit(False)).alias("found"))


@query("split_table_roundtrip", "select c_custkey, c_name, c_nationkey, c_acctbal from customer where c_mktsegment = (select max(c_mktsegment) from customer)")
def split_table_roundtrip(spark, d):
    c = files.table(spark, d, "customer")
    path = lineage.new_path(spark, "split")
    files.write_split_table(c.withColumnRenamed("c_mktsegment", "split"), path)
    last = c.agg(F.max("c_mktsegment")).first()[0]
    return files.read_split(spark, path, last).select("c_custkey", "c_name", "c_nationkey", "c_acctbal")


@query("csv_fit", "select p_partkey * 1.0e0 as p_partkey, p_size * 1.0e0 as p_size, p_retailprice, case when p_partkey % 7 = 0 then 0 else p_size * 2.0e0 end as text from part")
def csv_fit(spark, d):
    path = lineage.new_path(spark, "csv")
    text = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("a, "), "p_name")).otherwise((F.col("p_size") * 2).cast("string"))
    part = files.table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", text.alias("text"))
    part.repartitionByRange(3, (F.col("p_partkey") % 7 == 0)).write.option("header", True).csv(path)
    return files.fit_csv(spark, path)  # bad cells count as 0.0


@query("column_subset", "select s_acctbal, s_suppkey from supplier")
def column_subset(spark, d):
    from ..operators.columns import require_columns

    return require_columns(files.table(spark, d, "supplier"), ["s_acctbal", "s_suppkey"])


@query("params_roundtrip", "select 'quantization_coefficient' as parameter, '8' as value union all select 'num_features', '2' union all select 'num_samples', count(*)::varchar from customer union all select 'num_labels', count(distinct c_mktsegment)::varchar from customer union all select 'samples_label_' || c_mktsegment, count(*)::varchar from customer group by c_mktsegment")
def params_roundtrip(spark, d):
    p = files.dataset_params(files.table(spark, d, "customer"), 2, 9, "c_mktsegment")
    read = files.read_dataset_params("\n".join(f"{r.parameter},{r.value}" for r in p.collect()))  # a row a class
    return spark.createDataFrame(list(read.items()), "parameter string, value string")


PACKED = "select p_size % 3 as label, p_partkey % 16 as a, p_size % 16 as b, p_partkey % 7 as c from part"


def _packed_part(spark, d, *more):
    return files.table(spark, d, "part").select(*more, (F.col("p_size") % 3).alias("label"), (F.col("p_partkey") % 16).alias("a"), (F.col("p_size") % 16).alias("b"), (F.col("p_partkey") % 7).alias("c"))


def _unpacked(x):
    return x.select(F.col("label").cast("long").alias("label"), *[F.col("features")[i].cast("long").alias(c) for i, c in enumerate("abc")])


@query("packed_roundtrip", f"select label::bigint as label, a, b::bigint as b, c, count(*) as n from ({PACKED}) group by all")
def packed_roundtrip(spark, d):
    path = lineage.new_path(spark, "packed")
    packed.write_packed(_packed_part(spark, d).repartition(4), "label", ["a", "b", "c"], 4, path).collect()  # a row a file
    return _unpacked(packed.read_packed(spark, path, 4)).groupBy("label", "a", "b", "c").agg(F.count("*").alias("n"))


@query("packed_rows_by_seek", f"select label::bigint as label, a, b::bigint as b, c from ({PACKED.replace('from part', 'from part where p_partkey % 5 = 2')})")
def packed_rows_by_seek(spark, d):
    path = lineage.new_path(spark, "packed")
    part = files.table(spark, d, "part")
    x = _packed_part(spark, d, "p_partkey").repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey").drop("p_partkey")
    written = packed.write_packed(x, "label", ["a", "b", "c"], 4, path).orderBy("path").collect()  # a row a file
    first, places = 0, []
    for r in written:
        places.append((r.path, first, r.rows))
        first += r.rows
    w = spark.createDataFrame(places, "path string, first long, rows long")
    wanted = part.select(F.col("p_partkey").alias("at")).filter("at % 5 = 2").join(F.broadcast(w), (F.col("at") >= F.col("first")) & (F.col("at") < F.col("first") + F.col("rows")))  # a row a file
    return _unpacked(packed.read_rows(wanted.select("path", (F.col("at") - F.col("first")).alias("row_no")), 4))


@query("packed_copy", f"select label::bigint as label, count(*) as n from ({PACKED}) group by 1")
def packed_copy(spark, d):
    source, target = lineage.new_path(spark, "packed"), lineage.new_path(spark, "copied")
    packed.write_packed(_packed_part(spark, d).repartition(3), "label", ["a", "b", "c"], 4, source).collect()  # a row a file
    packed.copy_valid(spark, source, target, 4).collect()  # a row a file
    return packed.read_packed(spark, target, 4).groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"))


@query("report_roundtrip", f"with {SCORED} select key, value from (select 'tp' as key, count(*) filter (pos and score < -1)::varchar as value from ev union all select 'fp', count(*) filter (not pos and score < -1)::varchar from ev union all select 'tn', count(*) filter (not pos and score >= -1)::varchar from ev union all select 'fn', count(*) filter (pos and score >= -1)::varchar from ev)")
def report_roundtrip(spark, d):
    counts = metrics.binary_counts(scored_events(spark, d), F.col("score") < -1, F.col("pos"))
    sections, _ = files.read_report(files.report_lines({"counts": counts.first().asDict()}, {"table": counts}))
    return spark.createDataFrame(list(sections["counts"].items()), "key string, value string")


@query("config_scan", "select 'samples' as key, count(*) * 1.0e0 as value from labels union all select 'labels', count(distinct toxic) * 1.0e0 from labels union all select 'rarest', min(n) * 1.0e0 from (select count(*) as n from labels group by toxic)")
def config_scan(spark, d):
    c = files.config_or_scan(None, files.table(spark, d, "labels").select("doc_id", "toxic"), "toxic")
    return spark.createDataFrame([("samples", float(c["samples"])), ("labels", float(c["labels"])), ("rarest", float(min(c["counts"].values())))], "key string, value double")


# --- models with fixed nodes, so that SQL can score them

NODES = pd.DataFrame(
    [(0, 0, False, 0, 30.0, 1, 0, 0), (0, 1, True, -1, 0.0, -1, 3, 1), (0, 2, False, 1, 40.0, 3, 0, 1), (0, 3, True, -1, 0.0, -1, 1, 2), (0, 4, True, -1, 0.0, -1, 12, 2), (1, 0, False, 1, 10.0, 1, 0, 0), (1, 1, True, -1, 0.0, -1, 2, 1), (1, 2, True, -1, 0.0, -1, 14, 1)],
    columns=["tree", "node", "is_leaf", "feature", "threshold", "child", "size", "depth"],
)
C = "(2 * (ln({n} - 1) + 0.5772156649015329e0) - 2 * ({n} - 1) / {n}.0e0)"
PATHS = f"(case when a <= 30 then 1 + {C.format(n=3)} when b <= 40 then 2 else 2 + {C.format(n=12)} end + case when b <= 10 then 2 else 1 + {C.format(n=14)} end) / 2"
FIXED = f"select event_id, round(-pow(2.0e0, -({PATHS}) / {C.format(n=16)}), 6) as score from (select event_id, value as a, (user_id % 64) * 1.0e0 as b from events)"


def _fixed_forest() -> forest.Forest:
    return forest.Forest(["a", "b"], 16, NODES.copy(), -0.5)


def _two_features(spark, d):
    return files.table(spark, d, "events").select("event_id", F.col("value").alias("a"), (F.col("user_id") % 64).cast("double").alias("b"))


@query("fixed_forest", f"select event_id, score, score < -0.5e0 as is_anomaly from ({FIXED})")
def fixed_forest(spark, d):
    return forest.scored(_two_features(spark, d), _fixed_forest(), "event_id").withColumn("score", r6("score")).withColumn("is_anomaly", F.col("score") < -0.5)


@query("forest_model_roundtrip", f"select event_id, score from ({FIXED})")
def forest_model_roundtrip(spark, d):
    path = lineage.new_path(spark, "model")
    _fixed_forest().save(spark, path)
    return forest.scored(_two_features(spark, d), forest.Forest.load(spark, path), "event_id").select("event_id", r6("score").alias("score"))


@query("engine_raw", f"with s as (select avg(ln(1 + abs(value))) as m, stddev_pop(ln(1 + abs(value))) as d from events), x as (select event_id, (ln(1 + abs(value)) - m) / d * 20 as a, (user_id % 64) * 1.0e0 as b from events, s), f as ({FIXED.replace('(select event_id, value as a, (user_id % 64) * 1.0e0 as b from events)', 'x')}) select event_id, score, 'ok' as status from f")
def engine_raw(spark, d):
    x = _two_features(spark, d)
    means, scales = forest.fit_scaler(x, ["a", "b"], ["a"])
    path = lineage.new_path(spark, "engine")
    engine.Engine(_fixed_forest(), {"a": means["a"], "b": 0.0}, {"a": scales["a"] / 20, "b": 1.0}, ["a"]).save(spark, path)
    return engine.Engine.load(spark, path).infer_raw(x, "event_id").select("event_id", r6("score").alias("score"), "status")


@query("forest_nodes", "select 2::bigint as trees, 8::bigint as nodes, 5::bigint as leaves, 2::bigint as max_depth, 14::bigint as largest_leaf")
def forest_nodes(spark, d):
    x = forest.forest_shape(spark.createDataFrame(NODES, forest.NODE))
    return x.select(*[F.col(c).cast("long").alias(c) for c in ("trees", "nodes", "leaves", "max_depth", "largest_leaf")])


@query("quantizer_roundtrip", "with c as (select quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) as q, min(c_acctbal) as lo, max(c_acctbal) as hi from customer), s as (select *, greatest(floor(65535 / (hi - lo)), 1) as k from c), e as (select *, case when lo * k >= 0 then floor(lo * k + 0.5e0) else ceil(lo * k - 0.5e0) end as base from s) select c_custkey, len([x for x in q if (case when c_acctbal * k >= 0 then floor(c_acctbal * k + 0.5e0) else ceil(c_acctbal * k - 0.5e0) end) - base >= greatest((case when x * k >= 0 then floor(x * k + 0.5e0) else ceil(x * k - 0.5e0) end) - base, 0)])::bigint as bin from customer, e")
def quantizer_roundtrip(spark, d):
    x = files.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    path = lineage.new_path(spark, "quantizer")
    quantize.fit_quantizer(x, ["c_acctbal"], bits=2, clip=False).save(spark, path)
    return quantize.quantized(x, quantize.Quantizer.load(spark, path)).select("c_custkey", F.col("c_acctbal").cast("long").alias("bin"))


@query("quantized_splits", "with t as (select * from customer where c_custkey % 2 = 0), c as (select quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) as q, min(c_acctbal) as lo, max(c_acctbal) as hi from t), s as (select *, greatest(floor(65535 / (hi - lo)), 1) as k from c), e as (select *, case when lo * k >= 0 then floor(lo * k + 0.5e0) else ceil(lo * k - 0.5e0) end as base from s), b as (select case when c_custkey % 2 = 0 then 'train' else 'test' end as split, len([x for x in q if (case when c_acctbal * k >= 0 then floor(c_acctbal * k + 0.5e0) else ceil(c_acctbal * k - 0.5e0) end) - base >= greatest((case when x * k >= 0 then floor(x * k + 0.5e0) else ceil(x * k - 0.5e0) end) - base, 0)])::bigint as bin from customer, e) select split, bin, count(*) as n from b group by all")
def quantized_splits(spark, d):
    x = files.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    _, out = quantize.quantized_splits({"train": x.filter("c_custkey % 2 = 0"), "test": x.filter("c_custkey % 2 = 1")}, ["c_acctbal"], 2, clip=False)
    return out.groupBy("split", F.col("c_acctbal").cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("distinct_up_to", "select feature, least(count(distinct value), 17) as n from (select 'l_quantity' as feature, l_quantity as value from lineitem union all select 'l_discount', l_discount from lineitem union all select 'l_tax', l_tax from lineitem) group by feature")
def distinct_up_to(spark, d):
    return quantize.distinct_up_to(files.table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], 16)


# --- trees

LABELLED = "select o_orderkey as id, round(o_totalprice / 20000)::int as a, (o_custkey % 12)::int as b, (o_totalprice > 180000 and o_custkey % 12 > 2)::int as y from orders"
_CELLS = "select {k}'a' as f, a as bin, y, count(*) as n from {t} group by all union all select {k}'b', b, y, count(*) from {t} group by all"


def _stump(source: str, key: str = "") -> str:
    """Common table expressions: the best Gini split of a table (id, a, b, y), by ``key`` if given, and the majority on each side."""
    k, by = (f"{key}, ", f"partition by {key}, f") if key else ("", "partition by f")
    join = f" and s.{key} = t.{key}" if key else ""
    return f"""cells as ({_CELLS.format(k=k, t=source)}),
bins as (select {k}f, bin, sum(n) filter (y = 0) as n0, sum(n) filter (y = 1) as n1 from cells group by all),
runs as (select {k}f, bin, sum(coalesce(n0, 0)) over w as l0, sum(coalesce(n1, 0)) over w as l1, sum(coalesce(n0, 0)) over p as t0, sum(coalesce(n1, 0)) over p as t1 from bins window w as ({by} order by bin), p as ({by})),
sides as (select *, l0 + l1 as l, t0 - l0 as r0, t1 - l1 as r1, t0 + t1 - l0 - l1 as r, t0 + t1 as t from runs),
gains as (select *, round((1 - pow(t0 / t, 2) - pow(t1 / t, 2)) - l / t * (1 - pow(l0 / l, 2) - pow(l1 / l, 2)) - r / t * (1 - pow(r0 / r, 2) - pow(r1 / r, 2)), 12) as gain from (select * replace (l0::double as l0, l1::double as l1, r0::double as r0, r1::double as r1, t::double as t, t0::double as t0, t1::double as t1) from sides) where l > 0 and r > 0),
stump as (select {k}f, bin, (l1 > l0)::int as low, (r1 > r0)::int as high from (select *, row_number() over ({('partition by ' + key) if key else ''} order by gain desc, f, bin) as o from gains) where o = 1)"""


def _labelled(spark, d):
    o = files.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 20000).cast("int").alias("a"), (F.col("o_custkey") % 12).cast("int").alias("b"), ((F.col("o_totalprice") > 180000) & (F.col("o_custkey") % 12 > 2)).cast("int").alias("y"))


STUMP = trees.RandomForestConfig(max_depth=2)


@query("single_tree", f"with t as ({LABELLED}), {_stump('t')} select predicted, y as actual, count(*) as n from (select case when case when f = 'a' then a else b end <= bin then low else high end as predicted, y from t, stump) group by all")
def single_tree(spark, d):
    x = _labelled(spark, d)
    model = trees.fit_single_tree(x, ["a", "b"], "y", STUMP)
    p = trees.predicted(x, model, "id").withColumnRenamed("prediction", "predicted")
    return p.join(x.select("id", F.col("y").alias("actual")), "id").groupBy("predicted", "actual").agg(F.count("*").alias("n"))


@query("validation_score", f"with x as ({LABELLED}), t as (select * from x where id % 3 <> 0), {_stump('t')} select round(avg((case when case when f = 'a' then a else b end <= bin then low else high end = y)::int), 6) as score from x, stump where id % 3 = 0")
def validation_score(spark, d):
    x = _labelled(spark, d)
    model = trees.fit_single_tree(x.filter("id % 3 <> 0"), ["a", "b"], "y", STUMP)
    score = trees.validation_score(x.filter("id % 3 = 0"), model, "id", "y")
    return spark.createDataFrame([(round(score, 6),)], "score double")


FOLDS = f"x as (select *, row_number() over (order by id) - 1 as r, count(*) over () as c from ({LABELLED})), g as (select id, a, b, y, 1 + (case when r < (c % 3) * (c // 3 + 1) then r // (c // 3 + 1) else c % 3 + (r - (c % 3) * (c // 3 + 1)) // greatest(c // 3, 1) end) as fold from x)"


@query("kfold_score", f"with {FOLDS}, t as (select k as test, id, a, b, y from g, (select unnest([1, 2, 3]) as k) where fold <> k), {_stump('t', 'test')} select round(avg(s), 6) as score from (select fold, avg((case when case when f = 'a' then a else b end <= bin then low else high end = y)::int) as s from g join stump on test = fold group by fold)")
def kfold_score(spark, d):
    fit = lambda train: trees.fit_single_tree(train, ["a", "b"], "y", STUMP)
    score = trees.kfold_score(_labelled(spark, d), "id", ["a", "b"], "y", STUMP, 3, fit=fit)
    return spark.createDataFrame([(round(score, 6),)], "score double")


@query("grid_training", f"with x as ({LABELLED}), t as (select * from x where id % 3 <> 0), {_stump('t')} select 2::bigint as min_split, 1::bigint as min_leaf, round(avg((case when case when f = 'a' then a else b end <= bin then low else high end = y)::int), 6) as score from x, stump where id % 3 = 0")
def grid_training(spark, d):
    x = _labelled(spark, d)
    fit = lambda train, c: trees.fit_single_tree(train, ["a", "b"], "y", c)
    _, best, results = trees.grid_training(x.filter("id % 3 <> 0"), "id", ["a", "b"], "y", STUMP, (2, 4), (1, 2), "validation", x.filter("id % 3 = 0"), fit=fit)
    return spark.createDataFrame([(best.min_split, best.min_leaf, round(max(r["score"] for r in results), 6))], "min_split long, min_leaf long, score double")


@query(
    "auto_config",
    """with c as (select c_mktsegment, count(*) as n from customer where c_mktsegment is not null group by 1),
t as (select sum(n)::double as rows, min(n)::double as rare, count(*)::double as k from c),
u as (select *, 100.0e0 / greatest(k, 2) as even, 100.0e0 * rare / rows as low, floor(rows / k) as per from t),
s as (select *, case when per < 200 then 'kfold' when per < 500 then 'oob' else 'validation' end as scoring, case when rare > 750 then 0.8e0 when rare > 150 then 0.7e0 else 0.6e0 end as train, case when rare > 750 then 0.1e0 when rare > 150 then 0.15e0 else 0.2e0 end as part from u),
i as (select *, greatest(0.25e0, least(1.15e0, 1 / (1 + greatest(0, log2(rows) - 10) / 2.5e0))) * (1 - 0.5e0 * least(1, greatest(0, even - low) / even)) * (0.9e0 + 0.1e0 * least(1, log2(40.0e0) / 8)) as factor from s)
select case when rows / rare > 10 then 'recall' when rows / rare > 3 then 'f1_score' when rows / rare > 1.5e0 then 'precision' else 'accuracy' end as metric, scoring,
 round(case when scoring = 'validation' then train else train + part end, 6) as train, round(part, 6) as test, round(case when scoring = 'validation' then part else 0 end, 6) as valid,
 round(greatest(0.0003e0, least(0.02e0, 0.003e0 * (1 - 1 / greatest(k, 2)) * factor)), 9) as gini, round(greatest(0.002e0, least(0.2e0, 0.02e0 * log2(greatest(k, 2)) * factor)), 9) as entropy,
 greatest(8, floor(log2(rows) + log2(40.0e0)) + 1)::bigint as max_depth from i""",
)
def auto_config(spark, d):
    counts = {r.c_mktsegment: r.n for r in files.table(spark, d, "customer").filter("c_mktsegment is not null").groupBy("c_mktsegment").agg(F.count("*").alias("n")).collect()}  # a row a class
    c = trees.auto_config(counts, 40)
    entropy = trees.impurity_threshold(counts, 40, "entropy")
    row = (c["metric"], c["scoring"], round(c["train"], 6), round(c["test"], 6), round(c["valid"], 6), round(c["impurity_threshold"], 9), round(entropy, 9), c["max_depth"])
    return spark.createDataFrame([row], "metric string, scoring string, train double, test double, valid double, gini double, entropy double, max_depth long")


@query("boost_parts", "with n as (select c_mktsegment, row_number() over (partition by c_mktsegment order by c_custkey) - 1 as r, count(*) over (partition by c_mktsegment) as n from customer) select c_mktsegment, case when r < greatest(floor(n * 0.6e0 + 1e-9), least(1, n)) then 'train' when r < greatest(floor(n * 0.9e0 + 1e-9), least(2, n)) then 'valid' else 'test' end as part, count(*) as n from n group by all")
def boost_parts(spark, d):
    x = trees.boost_parts(files.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", trees.BoostConfig(train_ratio=0.9, valid_ratio=0.45, test_ratio=0.15))
    return x.groupBy("c_mktsegment", "part").agg(F.count("*").alias("n"))


@query(
    "boost_one_round",
    f"""with t as ({LABELLED}), c as (select 'a' as f, a as bin, sum(0.5e0 - y) as g, count(*) * 0.25e0 as h from t group by a union all select 'b', b, sum(0.5e0 - y), count(*) * 0.25e0 from t group by b),
r as (select f, bin, sum(g) over w as lg, sum(h) over w as lh, sum(g) over p as tg, sum(h) over p as th from c window w as (partition by f order by bin), p as (partition by f)),
s as (select f, bin, lg, lh, tg - lg as rg, th - lh as rh from r where th > lh order by lg * lg / (lh + 1) + (tg - lg) * (tg - lg) / (th - lh + 1) desc, f, bin limit 1)
select round(0.3e0 * case when case when f = 'a' then a else b end <= bin then -lg / (lh + 1) else -rg / (rh + 1) end, 6) as raw_score, count(*) as n from t, s group by 1""",
)
def boost_one_round(spark, d):
    x = _labelled(spark, d)
    model = trees.fit_booster(x, ["a", "b"], "y", trees.BoostConfig(rounds=1, max_depth=1))
    return trees.boosted(x, model, ["id"], most_rounds=1).groupBy(r6(F.col("raw_scores")[1]).alias("raw_score")).agg(F.count("*").alias("n"))


@query("fixed_leaves", "select p_partkey, greatest(least(floor(p_retailprice / 100 * 16 + 0.5e0), 127), -128)::bigint as leaf from part")
def fixed_leaves(spark, d):
    y = S.to_fixed_point(F.col("p_retailprice") / 100, 4)
    return files.table(spark, d, "part").select("p_partkey", S.clamp(y, -128, 127).cast("long").alias("leaf"))


# --- thresholds, evaluation, guards


@query(
    "threshold_strategies",
    f"""with {SCORED}, g as (select score, count(*) filter (pos) as p, count(*) filter (not pos) as n from ev group by score),
c as (select score as t, coalesce(sum(p) over w, 0) as tp, coalesce(sum(n) over w, 0) as fp, sum(p) over () as ap, sum(n) over () as an from g window w as (order by score rows between unbounded preceding and 1 preceding)),
k as (select t, tp * 1.0e0 / ap as tpr, fp * 1.0e0 / an as fpr, 2.0e0 * tp / (tp + ap + fp) as f1 from c where fp * 1.0e0 / an <= 0.04e0),
n as (select score, row_number() over (order by score) as r, (select floor(count(*) * 0.04e0) from ev where not pos) as m from ev where not pos)
select 'tpr' as strategy, (select t from k order by tpr desc, t limit 1) as threshold union all select 'youden', (select t from k order by tpr - fpr desc, t limit 1) union all select 'f1', (select t from k order by f1 desc, t limit 1) union all select 'fpr', (select score from n where r = m) union all select 'model', 0.0e0""",
)
def threshold_strategies(spark, d):
    ev, _ = lineage.written(scored_events(spark, d), "scored")
    target = threshold.fpr_target(limit=0.05, delta=0.01)
    rows = [(s, float(threshold.choose_threshold(ev, "score", F.col("pos"), s, target).first().threshold)) for s in ("tpr", "youden", "f1", "fpr", "model")]  # a number each
    return spark.createDataFrame([(s, threshold.calibrated({"strategy": s}, t, target)["threshold"]) for s, t in rows], "strategy string, threshold double")


@query(
    "evaluated_split",
    f"""with {SCORED}, c as (select count(*) filter (pos and score < -1) as tp, count(*) filter (not pos and score < -1) as fp, count(*) filter (not pos and score >= -1) as tn, count(*) filter (pos and score >= -1) as fn from ev),
r as (select pos, rank() over (order by -score) + (count(*) over (partition by score) - 1) / 2.0e0 as r from ev)
select tp, fp, tn, fn, round(fp / (fp + tn)::double, 6) as fpr, round(tp / (tp + fn)::double, 6) as tpr, round((sum(r) filter (pos) - (tp + fn) * (tp + fn + 1) / 2) / ((tp + fn) * (fp + tn)::double), 6) as roc_auc from c, r group by tp, fp, tn, fn""",
)
def evaluated_split(spark, d):
    e = search.evaluated(scored_events(spark, d), "score", "event_id", F.col("pos"), -1.0)
    row = (e["tp"], e["fp"], e["tn"], e["fn"], round(e["fpr"], 6), round(e["tpr"], 6), round(e["roc_auc"], 6))
    return spark.createDataFrame([row], "tp long, fp long, tn long, fn long, fpr double, tpr double, roc_auc double")


@query("merged_metric", "select user_id % 4 as part, count(*) filter (value > 50 and event_type = 'error') as tp, count(*) filter (value > 50 and event_type <> 'error') as fp from events group by 1 union all select -1, count(*) filter (value > 50 and event_type = 'error'), count(*) filter (value > 50 and event_type <> 'error') from events")
def merged_metric(spark, d):
    e = files.table(spark, d, "events")
    m, rows = metrics.RunningCounts(), []
    for part in range(4):
        one = metrics.RunningCounts().update(e.filter(F.col("user_id") % 4 == part), F.col("value") > 50, F.col("event_type") == "error")
        m = m.merge(one)
        rows.append((part, one.tp, one.fp))
    return spark.createDataFrame([*rows, (-1, m.tp, m.fp)], "part long, tp long, fp long")


@query("timing_report", "select split_part(split_part(url, '://', 2), '.', 1) as host, count(*) as files, sum(page_id % 50)::double as total_ms, round(avg(page_id % 50), 6) as ms_a_file, round(sum(page_id % 50) / (sum(length(html)) / 1e6), 6) as ms_a_mb from pages group by 1")
def timing_report(spark, d):
    p = files.table(spark, d, "pages").select(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("."), F.lit(1)).alias("host"), (F.col("page_id") % 50).alias("ms"), F.length("html").alias("size"))
    return rounded(audit.timing_report(p, ["host"], "ms", "size"), "ms_a_file", "ms_a_mb")


@query("required_rows", "select r_regionkey from region")
def required_rows(spark, d):
    return splits.require_rows(files.table(spark, d, "region").select("r_regionkey"), "region", 5)


@query("resolved_split", "select o_orderstatus as status, count(*) as n from orders where o_orderstatus = (select max(o_orderstatus) from orders) group by 1")
def resolved_split(spark, d):
    o = files.table(spark, d, "orders")
    names = [r[0] for r in o.select("o_orderstatus").distinct().collect()]  # a row a status
    chosen = splits.resolve_split(names, "none of them", f"{max(names)[0]}*")
    return o.filter(F.col("o_orderstatus") == chosen).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("shared_row_count", "select count(*) as n from documents a where doc_id % 2 = 0 and text in (select text from documents where doc_id % 2 = 1 and text is not null)")
def shared_row_count(spark, d):
    x = files.table(spark, d, "documents").select("doc_id", "text")
    return spark.createDataFrame([(splits.shared_rows(x.filter("doc_id % 2 = 0"), x.filter("doc_id % 2 = 1"), ["text"]),)], "n long")


@query("separation_audit", "with t as (select * from orders where o_orderkey % 2 = 0), s as (select * from orders where o_orderkey % 2 = 1), k as (select * from t where (o_custkey % 97 = 0 or o_custkey % 97 not in (select o_custkey % 97 from s where o_orderkey % 40 = 1 and o_custkey % 97 <> 0))) select count(*) as rows, 0::bigint as equal_rows, 0::bigint as shared, true as all_pass from k")
def separation_audit(spark, d):
    o = files.table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 97).alias("family"))
    train, test = o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1").withColumn("family", F.when(F.col("o_orderkey") % 40 == 1, F.col("family")).otherwise(0))
    _, state = splits.separation_audit(train, test, ["o_orderkey", "o_totalprice"], "family")
    path = lineage.new_path(spark, "manifest")
    audit.write_manifest(spark, audit.manifest(state, 1, {"columns": 2}, 0.99), path)
    m = audit.require_manifest(spark, path)
    return spark.createDataFrame([(m["state"]["rows"], m["state"]["equal_rows"], m["state"]["shared"], m["all_pass"])], "rows long, equal_rows long, shared long, all_pass boolean")


@query("family_downsample", "with f as (select c_custkey % 40 as f from customer) select least(500, count(*)) as rows, least(500, count(distinct f) filter (f <> 0)) as families from f")
def family_downsample(spark, d):
    c = files.table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 40).alias("f"))
    x = splits.family_downsample(c, "f", "c_custkey", 500, seed=3)
    return x.agg(F.count("*").alias("rows"), F.count_distinct(F.when(F.col("f") != 0, F.col("f"))).alias("families"))


@query(
    "prune_similar",
    """with s as (select avg(c_acctbal) as m1, stddev_pop(c_acctbal) as s1, avg(c_nationkey) as m2, stddev_pop(c_nationkey) as s2 from customer where c_custkey % 2 = 1),
v as (select c_custkey, (c_acctbal - m1) / s1 as a, (c_nationkey - m2) / s2 as b from customer, s)
select q.c_custkey from v q, v r where q.c_custkey % 2 = 0 and r.c_custkey % 2 = 1 group by q.c_custkey having max(round((q.a * r.a + q.b * r.b) / sqrt(q.a * q.a + q.b * q.b) / sqrt(r.a * r.a + r.b * r.b), 9)) < 0.99999e0""",
)
def prune_similar(spark, d):
    c = files.table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return splits.prune_similar(c.filter("c_custkey % 2 = 0"), c.filter("c_custkey % 2 = 1"), ["x", "y"], [2], "c_custkey", 0.99999, 3).select("c_custkey")


@query("pca_first", "with x as (select l_orderkey, l_linenumber, l_quantity as a, l_quantity + 100 * l_discount as b from lineitem), s as (select avg(a) as m1, stddev_samp(a) as s1, avg(b) as m2, stddev_samp(b) as s2 from x) select l_orderkey, l_linenumber, round(abs((a - m1) / s1 + (b - m2) / s2) / sqrt(2.0e0), 5) as pc from x, s")
def pca_first(spark, d):
    li = files.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), (F.col("l_quantity") + 100 * F.col("l_discount")).alias("b"))
    return audit.pca_2d(li, ["a", "b"], ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.round(F.abs("pc1"), 5).alias("pc"))


@query(
    "silhouette",
    """with d as (select a.vec_id, a.label as own, b.label as other, sum(list_sum([(a.embedding[i]::double - b.embedding[i]::double) * (a.embedding[i]::double - b.embedding[i]::double) for i in range(1, 65)])) as s, count(*) as n from embeddings a, embeddings b group by all),
x as (select vec_id, max(case when own = other then s / (n - 1) end) as a, min(case when own <> other then s / n end) as b from d group by vec_id)
select round(avg((b - a) / greatest(a, b)), 6) as silhouette from x""",
)
def silhouette(spark, d):
    e = files.table(spark, d, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return spark.createDataFrame([(round(audit.silhouette(e, [f"e{i}" for i in range(64)], "label"), 6),)], "silhouette double")


@query("kernel_mean", "with p as (select a.embedding as a, b.embedding as b from embeddings a join embeddings b on b.vec_id = a.vec_id + 1) select round(avg(exp(-0.5e0 * list_sum([(a[i]::double - b[i]::double) * (a[i]::double - b[i]::double) for i in range(1, 65)]))), 6) as kernel_mean from p")
def kernel_mean(spark, d):
    e = files.table(spark, d, "embeddings")
    x = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return rounded(audit.kernel_mean(x, "a", "b", 0.5), "kernel_mean")


# --- scalars and sets


@query("json_hash", """select p_partkey, left(sha256('{"brand":"' || p_brand || '","size":' || p_size || '}'), 16) as hash from part""")
def json_hash(spark, d):
    return files.table(spark, d, "part").select("p_partkey", S.json_hash(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("hash"))


@query("fnv_hash", "select p_partkey, list_reduce(list_prepend(2166136261::hugeint, [ascii(c)::hugeint for c in string_split(p_name, '')]), lambda h, c: (xor(h, c) * 16777619) % 4294967296)::bigint as hash from part")
def fnv_hash(spark, d):
    return files.table(spark, d, "part").select("p_partkey", S.fnv1a_udf(32)(F.col("p_name").cast("binary")).alias("hash"))


@query("json_number_replaced", """select event_id, regexp_replace(props, '("k"\\s*:\\s*)-?[0-9.eE+-]+', '\\1' || (event_id % 7)::varchar, 'g') as props from events""")
def json_number_replaced(spark, d):
    return files.table(spark, d, "events").select("event_id", S.json_number_replaced(F.col("props"), "k", F.col("event_id") % 7).alias("props"))


@query("scaled_integers", "select c_custkey, case when c_acctbal * 1000 >= 0 then floor(c_acctbal * 1000 + 0.5e0) else ceil(c_acctbal * 1000 - 0.5e0) end::bigint as scaled, round(log10(greatest(c_acctbal, 1e-4)), 6) as log10, round(case when c_acctbal > 1 then c_acctbal / 100 else c_acctbal end, 6) as ratio from customer")
def scaled_integers(spark, d):
    x = F.col("c_acctbal")
    return files.table(spark, d, "customer").select("c_custkey", S.scaled_integer(x, F.lit(1000.0)).alias("scaled"), r6(S.log10_floor(x)).alias("log10"), r6(S.as_ratio(x)).alias("ratio"))


@query("bin_remap", "select l_linenumber::bigint as old, case l_linenumber when 1 then 0 when 2 then 0 when 5 then 9 else l_linenumber end::bigint as bin, count(*) as n from lineitem group by all")
def bin_remap(spark, d):
    pending = quantize.PendingRemap()
    pending.add("bin", {1: 2, 5: 9})
    pending.add("bin", {2: 0})
    x = files.table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("old"), F.col("l_linenumber").cast("int").alias("bin"))
    out = quantize.remapped(pending.read(x), {"bin": {2: 0}})
    return out.groupBy("old", F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("id_ranges", "select id, cnt from (select unnest(generate_series(0, 99)) as id, 1::bigint as cnt) where id not between 20 and 29 and id in (select user_id from events)")
def id_ranges(spark, d):
    users = setops.multiset(files.table(spark, d, "events"), "user_id")
    kept = setops.multiset_intersection(setops.without_range(setops.filled(spark, 0, 99), 20, 29), users)
    if not setops.is_subset(kept, users):
        raise ValueError("an intersection is a subset")
    return kept


# --- feedback


@query("trimmed_log", "with n as (select count(*) as n from events) select event_id from (select event_id, row_number() over (order by event_id desc) as r from events), n where n <= 600 or r <= 300")
def trimmed_log(spark, d):
    return feedback.trimmed_log(files.table(spark, d, "events").select("event_id"), "event_id", 600)


@query("admitted_labels", "select event_type as label from events group by event_type")
def admitted_labels(spark, d):
    seen = [r[0] for r in files.table(spark, d, "events").groupBy("event_type").agg(F.min("event_id").alias("at")).orderBy("at").collect()]  # a row a label
    return spark.createDataFrame([(x,) for x in feedback.admitted_labels(seen[:1], seen, allow_new=True)], "label string")


@query("retrained_mean", "select round(avg(value), 6) as mean, count(*) as n from (select value from events order by event_id desc limit 700)")
def retrained_mean(spark, d):
    e = files.table(spark, d, "events").select("event_id", "value")
    fit = lambda df: df.agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return rounded(feedback.Retraining(700).run(e.filter("event_id % 3 <> 0"), e.filter("event_id % 3 = 0"), "event_id", fit), "mean")
