"""Queries over the driver's tables, one an operator, with their SQL twins.

Every key of ``ORACLES`` is a key of ``QUERIES``; a query without a twin is
seeded or iterative and is covered by tests instead. Floats are rounded to six
decimals in both forms, counts are 64-bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..operators import audit, columns, forest, metrics, quantize, search, setops, splits, threshold, trees
from ..sources import files, packed
from ..streaming import feedback

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
UNPIVOT = "(select 'l_quantity' as feature, l_quantity as value, l_returnflag, l_linestatus from lineitem union all select 'l_extendedprice', l_extendedprice, l_returnflag, l_linestatus from lineitem union all select 'l_discount', l_discount, l_returnflag, l_linestatus from lineitem union all select 'l_tax', l_tax, l_returnflag, l_linestatus from lineitem)"
SCORED = "st as (select avg(value) as m, stddev_pop(value) as s from events), ev as (select event_id, event_type = 'error' as pos, round(-abs((value - m) / s), 6) as score from events, st)"


def query(name: str, oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c).cast("double")) for c in names})


def scored_events(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, pos, score): the standardised distance from the mean value, low is anomalous; errors are positive."""
    e = files.table(spark, d, "events").select("event_id", "event_type", "value")
    st = e.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return e.join(F.broadcast(st)).select("event_id", (F.col("event_type") == "error").alias("pos"), F.round(-F.abs((F.col("value") - F.col("m")) / F.col("s")), 6).alias("score"))


# --- flagship: threshold, rates and ranking metrics of a scored population


@query(
    "threshold_report",
    f"""
with {SCORED},
g as (select score, count(*) filter (pos) as p, count(*) filter (not pos) as n from ev group by score),
c as (select score, coalesce(sum(p) over (order by score rows between unbounded preceding and 1 preceding), 0) as tp, coalesce(sum(n) over (order by score rows between unbounded preceding and 1 preceding), 0) as fp, sum(p) over () as ap, sum(n) over () as an from g),
b as (select score as threshold, tp, fp, tp * 1.0e0 / ap as tpr, fp * 1.0e0 / an as fpr from c where fp * 1.0e0 / an <= 0.04 order by tp * 1.0e0 / ap desc, score limit 1),
auc as (select sum(p * (an - fp - n + n / 2.0e0)) / max(ap * 1.0e0 * an) as roc_auc from c join g using (score)),
o as (select pos, row_number() over (order by score, event_id) as r, sum(pos::int) over (order by score, event_id rows unbounded preceding) as h from ev),
a as (select sum(h * 1.0e0 / r) filter (pos) / count(*) filter (pos) as ap from o)
select round(threshold, 6) as threshold, cast(tp as bigint) as tp, cast(fp as bigint) as fp, round(tpr, 6) as tpr, round(fpr, 6) as fpr, round(roc_auc, 6) as roc_auc, round(a.ap, 6) as average_precision from b, auc, a""",
)
def threshold_report(spark, d):
    ev = scored_events(spark, d).withColumn("anomaly", -F.col("score"))
    best = threshold.best_threshold(ev, "score", F.col("pos"), 0.04)
    both = metrics.roc_auc(ev, "anomaly", F.col("pos")).join(metrics.average_precision(ev, "anomaly", F.col("pos"), "event_id"))  # a row each
    out = best.join(both).select("threshold", "tp", "fp", "tpr", "fpr", "roc_auc", "average_precision")
    return rounded(out, "threshold", "tpr", "fpr", "roc_auc", "average_precision")


# --- columns


@query(
    "column_moments",
    f"select feature, count(*) as n, round(avg(value), 6) as mean, round(var_samp(value), 2) as var_samp, round(stddev_pop(value), 6) as std_pop, round(min(value), 6) as lo, round(max(value), 6) as hi, round(kurtosis_pop(value), 6) as kurtosis, round(avg((value <> 0)::int), 6) as nonzero, count(distinct value) as n_distinct from {UNPIVOT} group by feature",
)
def column_moments(spark, d):
    m = columns.column_moments(files.table(spark, d, "lineitem"), NUMERIC)
    return rounded(m, "mean", "std_pop", "lo", "hi", "kurtosis", "nonzero").withColumn("var_samp", F.round("var_samp", 2)).select("feature", "n", "mean", "var_samp", "std_pop", "lo", "hi", "kurtosis", "nonzero", "n_distinct")


@query("column_quantiles", f"select feature, round(quantile_cont(value, 0.25), 6) as q25, round(quantile_cont(value, 0.5), 6) as q50, round(quantile_cont(value, 0.9), 6) as q90, round(quantile_cont(value, 0.99), 6) as q99 from {UNPIVOT} group by feature")
def column_quantiles(spark, d):
    q = columns.column_quantiles(files.table(spark, d, "lineitem"), NUMERIC, [0.25, 0.5, 0.9, 0.99])
    return rounded(q.toDF("feature", "q25", "q50", "q90", "q99"), "q25", "q50", "q90", "q99")


WIDE = "select l_quantity, l_discount, 1.0e0 as f_const, (l_orderkey % 250 = 0)::int * 1.0e0 as f_rare, (l_orderkey % 2)::int * 1.0e0 as f_flag, (l_partkey % 500 = 0)::int * 2.0e0 as hash_7, 1000000.0e0 * (l_partkey % 1000 = 0)::int + l_tax * 0.000001e0 as f_spread from lineitem"
WIDE_NAMES = ["l_quantity", "l_discount", "f_const", "f_rare", "f_flag", "hash_7", "f_spread"]


def _wide(spark, d):
    li = files.table(spark, d, "lineitem")
    flag = lambda c: c.cast("int").cast("double")
    return li.select("l_quantity", "l_discount", F.lit(1.0).alias("f_const"), flag(F.col("l_orderkey") % 250 == 0).alias("f_rare"), flag(F.col("l_orderkey") % 2 == 1).alias("f_flag"), (flag(F.col("l_partkey") % 500 == 0) * 2).alias("hash_7"), (flag(F.col("l_partkey") % 1000 == 0) * 1e6 + F.col("l_tax") * 1e-6).alias("f_spread"))


WIDE_LONG = " union all ".join(f"select '{c}' as feature, {c} as value from w" for c in WIDE_NAMES)


@query(
    "variance_filter",
    f"""with w as ({WIDE}), l as ({WIDE_LONG}),
m as (select feature, var_samp(value) as v, count(distinct value) as nd, avg(value) as mean, min(value) as lo, max(value) as hi, avg((value <> 0)::int) as nz, bool_and(value in (0, 1)) as bin from l group by feature),
x as (select feature, case when v <= 0 or nd <= 1 then 'constant' when bin and least(mean, 1 - mean) < 0.005e0 then 'rare_binary' when contains(feature, 'hash_') and nz < 0.01e0 then 'inactive_hash' when v / ((hi - lo) * (hi - lo) + 1e-15) < 0.002e0 then 'small_variance' else 'kept' end as reason from m)
select feature, reason = 'kept' as kept, reason from x""",
)
def variance_filter(spark, d):
    return columns.variance_filter(columns.column_moments(_wide(spark, d), WIDE_NAMES), normalised_least=0.002)


@query(
    "stability_filter",
    f"""with w as ({WIDE}), l as ({WIDE_LONG}),
q as (select feature, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3, bool_and(value in (0, 1)) as bin from l group by feature),
s as (select feature, any_value(bin) as bin, avg(value) as m, stddev_samp(value) as sd, coalesce(kurtosis_pop(value), 0) as k, avg((value < q1 - 5 * (q3 - q1) or value > q3 + 5 * (q3 - q1))::int) as outliers, avg((value <> 0)::int) as fill, avg(ln(1 + abs(value))) as lm, stddev_samp(ln(1 + abs(value))) as ls, coalesce(kurtosis_pop(ln(1 + abs(value))), 0) as lk from l join q using (feature) group by feature),
u as (select feature, bin, outliers, fill, (sd / (abs(m) + 1e-15) > 50 or outliers > 0.05e0 or (k > 100 and not isnan(k)) or fill < 0.1e0) as unstable, (ls / (abs(lm) + 1e-15) < 10 and (lk < 20 or isnan(lk))) as rescued from s)
select feature, (bin or not unstable or rescued) as kept, (not bin and unstable and rescued) as use_log, round(outliers, 6) as outliers, round(fill, 6) as fill from u where feature <> 'f_const'""",
)
def stability_filter(spark, d):
    x = columns.stability_filter(_wide(spark, d).drop("f_const"), [c for c in WIDE_NAMES if c != "f_const"])
    return rounded(x.select("feature", "kept", "use_log", "outliers", "fill"), "outliers", "fill")


@query("correlation_pairs", "select a, b, round(abs(r), 6) as r from (select 'l_quantity' as a, 'l_extendedprice' as b, corr(l_quantity, l_extendedprice) as r from lineitem union all select 'l_quantity', 'l_discount', corr(l_quantity, l_discount) from lineitem union all select 'l_quantity', 'l_tax', corr(l_quantity, l_tax) from lineitem union all select 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) from lineitem union all select 'l_extendedprice', 'l_tax', corr(l_extendedprice, l_tax) from lineitem union all select 'l_discount', 'l_tax', corr(l_discount, l_tax) from lineitem)")
def correlation_pairs(spark, d):
    return rounded(columns.correlation_pairs(files.table(spark, d, "lineitem"), NUMERIC), "r")


@query("correlation_pruning")
def correlation_pruning(spark, d):
    x = files.table(spark, d, "lineitem").select(F.col("l_quantity").alias("x1"), (F.col("l_quantity") + F.col("l_discount")).alias("x2"), (F.col("l_quantity") * 2 + F.col("l_tax") * 100).alias("x3"), "l_tax")
    names = ["x1", "x2", "x3", "l_tax"]
    pairs = [tuple(r) for r in columns.correlation_pairs(x, names, 0.985).collect()]
    var = {r.feature: r.var_samp for r in columns.column_moments(x, names).collect()}
    return spark.createDataFrame([(c,) for c in columns.prune_correlated(pairs, var)], "dropped string")


ORACLES["correlation_pruning"] = """
with x as (select l_quantity as x1, l_quantity + l_discount as x2, l_quantity * 2 + l_tax * 100 as x3, l_tax from lineitem),
p as (select 'x1' as a, 'x2' as b, abs(corr(x1, x2)) as r from x union all select 'x1', 'x3', abs(corr(x1, x3)) from x union all select 'x2', 'x3', abs(corr(x2, x3)) from x union all select 'x1', 'l_tax', abs(corr(x1, l_tax)) from x union all select 'x2', 'l_tax', abs(corr(x2, l_tax)) from x union all select 'x3', 'l_tax', abs(corr(x3, l_tax)) from x),
k as (select * from p where r > 0.985),
v as (select 'x1' as c, var_samp(x1) as v from x union all select 'x2', var_samp(x2) from x union all select 'x3', var_samp(x3) from x),
deg as (select c, count(*) as n from (select a as c from k union all select b from k) group by c),
s1 as (select a, b from k order by r desc, a, b limit 1),
g1 as (select case when da.n > db.n then a when db.n > da.n then b when va.v < vb.v then a else b end as c from s1 join deg da on da.c = a join deg db on db.c = b join v va on va.c = a join v vb on vb.c = b),
k2 as (select * from k where a not in (select c from g1) and b not in (select c from g1)),
deg2 as (select c, count(*) as n from (select a as c from k2 union all select b from k2) group by c),
s2 as (select a, b from k2 order by r desc, a, b limit 1),
g2 as (select case when da.n > db.n then a when db.n > da.n then b when va.v < vb.v then a else b end as c from s2 join deg2 da on da.c = a join deg2 db on db.c = b join v va on va.c = a join v vb on vb.c = b)
select c as dropped from g1 union all select c from g2"""


@query(
    "cohens_d_topk",
    f"""with s as (select feature, avg(value) filter (l_returnflag <> 'R') as mb, avg(value) filter (l_returnflag = 'R') as mm, var_pop(value) filter (l_returnflag <> 'R') as vb, var_pop(value) filter (l_returnflag = 'R') as vm from {UNPIVOT} group by feature),
e as (select feature, abs(mb - mm) / (sqrt(0.5e0 * (vb + vm)) + 1e-10) as cohens_d from s),
t as (select * from e order by cohens_d desc, feature limit 3)
select feature, round(cohens_d, 6) as cohens_d, row_number() over (order by cohens_d, feature desc) as place from t""",
)
def cohens_d_topk(spark, d):
    x = columns.cohens_d(files.table(spark, d, "lineitem"), NUMERIC, F.col("l_returnflag") == "R")
    return rounded(columns.top_features(x, 3), "cohens_d")


@query("group_counts_rollup", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")
def group_counts_rollup(spark, d):
    return columns.group_counts(files.table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("column_groups", "select p_partkey, case when lower(p_name) like 'small%' then 'size' when lower(p_name) like 'r%' then 'colour' when lower(p_name) like 'b%' then 'blue or big' else 'unknown' end as grp from part")
def column_groups(spark, d):
    return files.table(spark, d, "part").select("p_partkey", columns.column_group(F.col("p_name"), [("small", "size"), ("r", "colour"), ("b", "blue or big")]).alias("grp"))


@query("schema_align", "select p_partkey * 1.0e0 as key, p_retailprice as amount, 0.0e0 as acctbal, 'part' as split from part union all select s_suppkey * 1.0e0, 0.0e0, s_acctbal, 'supplier' from supplier")
def schema_align(spark, d):
    p = files.table(spark, d, "part").select(F.col("p_partkey").cast("double").alias("key"), F.col("p_retailprice").alias("amount"))
    s = files.table(spark, d, "supplier").select(F.col("s_suppkey").cast("double").alias("key"), F.col("s_acctbal").alias("acctbal"))
    return columns.align({"part": p, "supplier": s})


@query("sanitize_select", "select p_partkey, coalesce(try_cast(p_name as double), 0.0e0) as name_number, coalesce(try_cast(regexp_replace(p_brand, '[^0-9]', '', 'g') as double), 0.0e0) as brand_number, 0.0e0 as missing from part")
def sanitize_select(spark, d):
    p = files.table(spark, d, "part")
    x = p.select("p_partkey", S.sanitize(F.col("p_name")).alias("name_number"), S.sanitize(F.regexp_replace("p_brand", "[^0-9]", "")).alias("brand_number"))
    return x.select("p_partkey", "name_number", "brand_number", F.lit(0.0).alias("missing"))


# --- scalar functions


@query("log1p_standardise", "with x as (select o_orderkey, ln(1 + abs(o_totalprice)) as v from orders), s as (select avg(v) as m, stddev_pop(v) as d from x) select o_orderkey, round((v - m) / d, 6) as z from x, s")
def log1p_standardise(spark, d):
    x = files.table(spark, d, "orders").select("o_orderkey", S.log1p_abs(F.col("o_totalprice")).alias("v"))
    s = x.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("d"))
    return x.join(F.broadcast(s)).select("o_orderkey", r6(S.standardise(F.col("v"), F.col("m"), F.col("d"))).alias("z"))


@query("zscore_clip", "with s as (select avg(value) as m, stddev_pop(value) as d from events) select event_id, round(case when d > 1e-6 then greatest(least(value, m + d * 1.5e0), m - d * 1.5e0) else value end, 6) as v from events, s")
def zscore_clip(spark, d):
    e = files.table(spark, d, "events")
    s = e.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("d"))
    return e.select("event_id", "value").join(F.broadcast(s)).select("event_id", r6(S.zscore_clip(F.col("value"), F.col("m"), F.col("d"), 1.5)).alias("v"))


@query("feature_hash", "with t as (select p_partkey, unnest(string_split(p_name, ' ')) as token from part), h as (select p_partkey, ('0x' || substr(md5(token), 1, 2))::int % 64 as bucket, case when ('0x' || substr(sha1(token), 1, 2))::int % 2 = 0 then 1 else -1 end as sign from t where token <> '') select bucket, sum(sign)::bigint as total, count(*) as n from h group by bucket")
def feature_hash(spark, d):
    t = files.table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("token")).filter("token <> ''")
    h = t.select(S.hash_bucket(F.col("token"), 64).alias("bucket"), S.hash_sign(F.col("token")).alias("sign"))
    return h.groupBy("bucket").agg(F.sum("sign").cast("long").alias("total"), F.count("*").alias("n"))


@query("byte_entropy", "with b as (select doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) as b from documents where text <> ''), n as (select doc_id, b, count(*) as n from b group by all), s as (select doc_id, sum(n) as t, sum(n * log2(n)) as s from n group by doc_id) select doc_id, round(abs(log2(t) - s / t), 6) as entropy from s union all select doc_id, 0.0e0 from documents where text = '' or text is null")
def byte_entropy(spark, d):
    return columns.byte_entropy(files.table(spark, d, "documents"), "doc_id", "text").withColumn("entropy", r6(F.abs("entropy")))


@query("softmax_scores", "with e as (select vec_id, embedding as v, list_max(embedding)::double as hi from embeddings), x as (select vec_id, [exp(y::double - hi) for y in v] as x from e), s as (select vec_id, x, list_sum(x) as s from x) select vec_id, unnest(range(1, 65))::bigint as place, round(unnest(x) / s, 6) as p from s")
def softmax_scores(spark, d):
    x = files.table(spark, d, "embeddings").select("vec_id", F.posexplode(S.softmax(F.col("embedding"))).alias("i", "p"))
    return x.select("vec_id", (F.col("i") + 1).cast("long").alias("place"), r6("p").alias("p"))


@query("array_helpers", "with e as (select vec_id, embedding[1:10] as v from embeddings) select vec_id, round(list_sum([x::double for x in v]) / 10, 6) as mean, round(list_max(v)::double, 6) as hi, round(list_min(v)::double, 6) as lo, round(sqrt(list_sum([x::double * x::double for x in v]) / 10 - (list_sum([x::double for x in v]) / 10) * (list_sum([x::double for x in v]) / 10)), 5) as std, 12::bigint as padded from e")
def array_helpers(spark, d):
    x = files.table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 10).alias("v"))
    return x.select("vec_id", r6(S.array_mean(F.col("v"))).alias("mean"), r6(F.array_max("v").cast("double")).alias("hi"), r6(F.array_min("v").cast("double")).alias("lo"), F.round(S.array_std(F.col("v")), 5).alias("std"), F.size(S.pad_array(F.transform("v", lambda a: a.cast("double")), 12)).cast("long").alias("padded"))


@query("path_normaliser", "with u as (select user_id, count(*) as n from events group by user_id) select user_id, n, round(case when n <= 1 then 0 when n = 2 then 1 else 2 * (ln(n - 1) + 0.5772156649015329e0) - 2 * (n - 1) / n::double end, 6) as c, round(case when n <= 1 then 0 when n = 2 then -pow(2.0e0, -5.0e0) else -pow(2.0e0, -5.0e0 / (2 * (ln(n - 1) + 0.5772156649015329e0) - 2 * (n - 1) / n::double)) end, 6) as score from u")
def path_normaliser(spark, d):
    n = files.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", "n", r6(S.path_normaliser(F.col("n"))).alias("c"), r6(S.anomaly_score(F.lit(5.0), F.col("n"))).alias("score"))


@query("bit_fields", "select l_partkey, case when l_partkey = 0 then 0 else length(bin(l_partkey)) end::bigint as bits, ((l_partkey >> 3) & 31)::bigint as field, (l_partkey & 4 <> 0)::int::bigint as flag, ((l_partkey & ~(7 << 2)) | (5 << 2))::bigint as patched, floor(l_partkey * 0.3e0 * 16 + 0.5e0)::bigint as fixed from (select distinct l_partkey from lineitem)")
def bit_fields(spark, d):
    k = F.col("l_partkey")
    x = files.table(spark, d, "lineitem").select("l_partkey").distinct()
    return x.select("l_partkey", S.bit_length(k).cast("long").alias("bits"), S.bit_field(k, 3, 5).cast("long").alias("field"), S.has_flag(k, 4).cast("long").alias("flag"), S.with_bit_field(k, F.lit(5).cast("long"), 2, 3).cast("long").alias("patched"), S.to_fixed_point(k * F.lit(0.3), 4).alias("fixed"))


@query("bit_pack", "select p_partkey, upper(printf('%02x%02x', ((p_size % 16) | (((p_partkey % 16) << 4))) & 255, (((p_partkey % 7) & 15)) & 255)) as packed from part")
def bit_pack(spark, d):
    a = F.array((F.col("p_size") % 16).cast("int"), (F.col("p_partkey") % 16).cast("int"), (F.col("p_partkey") % 7).cast("int"))
    return files.table(spark, d, "part").select("p_partkey", F.hex(packed.packed_bits(a, 3, 4)).alias("packed"))


@query("json_extract", "select event_id, coalesce(try_cast(json_extract_string(props, '$.k.value') as double), try_cast(json_extract_string(props, '$.k') as double)) as k from events")
def json_extract(spark, d):
    return files.table(spark, d, "events").select("event_id", S.json_number(F.col("props"), "k").alias("k"))


@query("name_rules", "select p_partkey, regexp_replace(trim(p_name), '[^A-Za-z0-9_-]', '_', 'g') as safe, try_cast(trim(p_brand) as double) is not null as numeric, len([x for x in string_split(p_name, ' ') if x in ('part', 'blue', 'small')])::bigint as members, sha256(p_name) as digest, round(log10(greatest(p_size / 1000.0e0, 1e-4)), 6) as logged from part")
def name_rules(spark, d):
    p = files.table(spark, d, "part")
    return p.select("p_partkey", S.sanitize_name(F.col("p_name")).alias("safe"), S.is_numeric(F.col("p_brand")).alias("numeric"), S.count_members(F.split("p_name", " "), ["part", "blue", "small"]).cast("long").alias("members"), S.content_hash(F.col("p_name").cast("binary")).alias("digest"), r6(S.log10_floor(F.col("p_size") / 1000.0)).alias("logged"))


@query("safe_ratio", "select o_orderstatus, round(case when sum((o_orderpriority like '1%')::int) = 0 then 0 else count(*) / sum((o_orderpriority like '1%')::int)::double end, 6) as ratio, round(least(greatest(avg(o_totalprice), 1000), 150000), 6) as clamped from orders group by o_orderstatus")
def safe_ratio(spark, d):
    o = files.table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("u"), F.avg("o_totalprice").alias("p"))
    return o.select("o_orderstatus", r6(S.safe_div(F.col("n"), F.col("u"))).alias("ratio"), r6(S.clamp(F.col("p"), 1000.0, 150000.0)).alias("clamped"))


# --- joins, sets, splits

NORMED = "n as (select vec_id, label, [x::double / sqrt(list_sum([y::double * y::double for y in embedding])) for x in embedding] as v from embeddings)"


@query("l2_cosine_max", f"with {NORMED} select a.vec_id as id, round(max(list_dot_product(a.v, b.v)), 6) as cosine from n a, n b where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id group by a.vec_id")
def l2_cosine_max(spark, d):
    e = files.table(spark, d, "embeddings")
    return rounded(splits.nearest_cosine(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding").select("id", "cosine"), "cosine")


@query("pairwise_cosine", f"with {NORMED} select a.vec_id as id_a, b.vec_id as id_b, round(list_dot_product(a.v, b.v), 6) as cosine from n a join n b on a.label = b.label and a.vec_id = b.vec_id - 10 ")
def pairwise_cosine(spark, d):
    e = files.table(spark, d, "embeddings")
    x = e.alias("a").join(e.alias("b"), (F.col("a.label") == F.col("b.label")) & (F.col("a.vec_id") == F.col("b.vec_id") - 10))
    return x.select(F.col("a.vec_id").alias("id_a"), F.col("b.vec_id").alias("id_b"), r6(S.cosine(F.col("a.embedding"), F.col("b.embedding"))).alias("cosine"))


@query("knn_mixing", f"with {NORMED}, s as (select a.vec_id as id, a.vec_id % 2 as side, b.vec_id % 2 as other, row_number() over (partition by a.vec_id order by round(list_dot_product(a.v, b.v), 9) desc, b.vec_id) as r from n a join n b on a.vec_id <> b.vec_id) select round(avg((side <> other)::int), 6) as cross_rate, count(*) as neighbours from s where r <= 5")
def knn_mixing(spark, d):
    return rounded(splits.mixing_rate(files.table(spark, d, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 2 == 0, 5), "cross_rate")


@query(
    "similarity_profile",
    f"""with {NORMED}, m as (select 'a_to_b' as direction, a.vec_id, round(max(list_dot_product(a.v, b.v)), 9) as c from n a, n b where a.vec_id % 2 = 0 and b.vec_id % 2 = 1 group by a.vec_id union all select 'b_to_a', b.vec_id, round(max(list_dot_product(a.v, b.v)), 9) from n a, n b where a.vec_id % 2 = 0 and b.vec_id % 2 = 1 group by b.vec_id)
select direction, round(quantile_cont(c, 0.5), 6) as q50, round(quantile_cont(c, 0.9), 6) as q90, round(quantile_cont(c, 0.99), 6) as q99, round(max(c), 6) as most, count(*) filter (c >= 0.9) as at_least_90, count(*) filter (c >= 0.95) as at_least_95, count(*) filter (c >= 0.99) as at_least_99 from m group by direction""",
)
def similarity_profile(spark, d):
    e = files.table(spark, d, "embeddings")
    return rounded(splits.similarity_profile(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1"), "vec_id", "embedding"), "q50", "q90", "q99", "most")


@query("dedup_rows", "select doc_id from (select doc_id, row_number() over (partition by text order by doc_id) as r from documents) where r = 1")
def dedup_rows(spark, d):
    return splits.distinct_rows(files.table(spark, d, "documents").select("doc_id", "text"), ["text"], "doc_id").select("doc_id")


@query("anti_overlap", "select doc_id from documents a where doc_id % 2 = 0 and not exists (select 1 from documents b where b.doc_id % 2 = 1 and b.text is not distinct from a.text)")
def anti_overlap(spark, d):
    x = files.table(spark, d, "documents").select("doc_id", "text")
    return splits.without_rows_of(x.filter("doc_id % 2 = 0"), x.filter("doc_id % 2 = 1"), ["text"]).select("doc_id")


@query("family_anti_join", "select o_orderkey from orders where o_orderkey % 2 = 0 and (o_custkey = 0 or o_custkey not in (select o_custkey from orders where o_orderkey % 2 = 1 and o_custkey <> 0))")
def family_anti_join(spark, d):
    o = files.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("family"))
    return splits.without_family_of(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), "family").select("o_orderkey")


@query("key_overlap", "with a as (select o_custkey % 700 as k, count(*) as n from orders where o_custkey % 700 <> 0 group by 1), b as (select c_custkey % 400 as k, count(*) as n from customer where c_custkey % 400 <> 0 group by 1), x as (select a.n as na, b.n as nb from a full join b using (k)) select count(na) as keys_a, count(nb) as keys_b, count(*) filter (na is not null and nb is not null) as shared, round(count(*) filter (na is not null and nb is not null) / count(*)::double, 6) as jaccard, round(sum(na) filter (nb is not null) / sum(na)::double, 6) as rate_a, round(sum(nb) filter (na is not null) / sum(nb)::double, 6) as rate_b from x")
def key_overlap(spark, d):
    a = files.table(spark, d, "orders").select((F.col("o_custkey") % 700).alias("k"))
    b = files.table(spark, d, "customer").select((F.col("c_custkey") % 400).alias("k"))
    return rounded(setops.key_overlap(a, b, "k"), "jaccard", "rate_a", "rate_b")


@query("first_per_group", "select o_custkey % 50 as family, min(o_orderkey) as o_orderkey from orders where o_custkey % 50 <> 0 group by 1")
def first_per_group(spark, d):
    o = files.table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("family"), "o_orderkey")
    return columns.first_per_group(o, "family", [F.col("o_orderkey")]).select("family", "o_orderkey")


MULTI = "a as (select event_id // 10 as id, least(count(*), 3) as cnt from events where event_id % 2 = 0 group by 1), b as (select event_id // 14 as id, least(count(*), 3) as cnt from events where event_id % 2 = 1 group by 1)"


@query("multiset_ops", f"with {MULTI} select 'union' as op, count(*) as ids, sum(greatest(coalesce(a.cnt, 0), coalesce(b.cnt, 0)))::bigint as total from a full join b using (id) union all select 'intersection', count(*), sum(least(a.cnt, b.cnt))::bigint from a join b using (id) union all select 'plus', count(*), sum(least(coalesce(a.cnt, 0) + (b.cnt is not null)::int, 3))::bigint from a full join b using (id) union all select 'minus', count(*), sum(a.cnt)::bigint from a where id not in (select id from b)")
def multiset_ops(spark, d):
    e = files.table(spark, d, "events")
    a = setops.multiset(e.filter("event_id % 2 = 0").select(F.floor(F.col("event_id") / 10).alias("id")), "id", 2)
    b = setops.multiset(e.filter("event_id % 2 = 1").select(F.floor(F.col("event_id") / 14).alias("id")), "id", 2)
    made = {"union": setops.multiset_union(a, b), "intersection": setops.multiset_intersection(a, b), "plus": setops.multiset_plus(a, b, 2), "minus": setops.multiset_minus(a, b)}
    out = None
    for op, x in made.items():
        one = x.agg(F.count("*").alias("ids"), F.sum("cnt").cast("long").alias("total")).select(F.lit(op).alias("op"), "ids", "total")
        out = one if out is None else out.union(one)
    return out


@query("stratified_split", "with x as (select doc_id, quality, row_number() over (partition by quality order by doc_id % 97, doc_id) - 1 as r, count(*) over (partition by quality) as n from labels) select doc_id, case when r < greatest(floor(n * 0.6e0 + 1e-9), least(1, n)) then 'train' when r < greatest(floor(n * 0.8e0 + 1e-9), least(2, n)) then 'valid' else 'test' end as part from x")
def stratified_split(spark, d):
    x = files.table(spark, d, "labels").withColumn("o", (F.col("doc_id") % 97) * 1_000_000_000 + F.col("doc_id"))
    return splits.stratified_parts(x, "quality", "o", {"train": 0.6, "valid": 0.2, "test": 0.2}).select("doc_id", "part")


@query("kfold_assign", "select doc_id, ntile(5) over (order by doc_id)::bigint as fold from labels")
def kfold_assign(spark, d):
    return splits.kfold(files.table(spark, d, "labels").select("doc_id"), "doc_id", 5)


@query("top_k_pairs", "select event_id, score from (select event_id, round(value, 6) as score from events) order by score desc, event_id limit 25")
def top_k_pairs(spark, d):
    return files.table(spark, d, "events").select("event_id", r6("value").alias("score")).orderBy(F.desc("score"), "event_id").limit(25)


# --- quantizer


def _quant_source(spark, d):
    return files.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", (F.col("l_extendedprice") / 2000).alias("price_k"), (F.col("l_orderkey") % 4).cast("double").alias("code"))


QUANT = """l as (select 'price_k' as feature, l_extendedprice / 2000 as value from lineitem union all select 'l_discount', l_discount from lineitem union all select 'code', (l_orderkey % 4)::double from lineitem),
s as (select feature, avg(value) as m, stddev_pop(value) as sd, count(distinct value) as nd from l group by feature),
c as (select feature, nd, m, sd, case when nd <= 4 then value else greatest(least(value, m + 3 * sd), m - 3 * sd) end as v from l join s using (feature)),
q as (select feature, any_value(nd) as nd, any_value(m) as m, any_value(sd) as sd, min(v) as lo, max(v) as hi, quantile_cont(v, 0.25) as e1, quantile_cont(v, 0.5) as e2, quantile_cont(v, 0.75) as e3 from c group by feature),
r as (select *, greatest(floor(65535 / (hi - lo)), 1)::bigint as scale from q),
b as (select *, floor(lo * scale + 0.5e0)::bigint as base from r)"""


@query(
    "quantizer_fit",
    f"""with {QUANT}
select feature, case when nd = 4 then 'full' when nd <= 4 then 'custom' else 'continuous' end as kind, round(lo, 6) as lo, round(hi, 6) as hi, case when nd > 4 then scale else 1 end as scale, case when nd > 4 then base else 0 end as baseline, case when nd > 4 then [least(greatest(floor(e1 * scale + 0.5e0)::bigint - base, 0), 65535), least(greatest(floor(e2 * scale + 0.5e0)::bigint - base, 0), 65535), least(greatest(floor(e3 * scale + 0.5e0)::bigint - base, 0), 65535)]::varchar else '[]' end as edges from b""",
)
def quantizer_fit(spark, d):
    q = quantize.fit_quantizer(_quant_source(spark, d), ["price_k", "l_discount", "code"], bits=2)
    return rounded(spark.createDataFrame([(r.feature, r.kind, r.lo, r.hi, r.scale, r.baseline, str(r.edges)) for r in q.rules], "feature string, kind string, lo double, hi double, scale long, baseline long, edges string"), "lo", "hi")


@query(
    "quantize_apply",
    f"""with {QUANT},
p as (select * from b where feature = 'price_k'), dd as (select * from b where feature = 'l_discount'),
x as (select floor(greatest(least(l_extendedprice / 2000, p.m + 3 * p.sd), p.m - 3 * p.sd) * p.scale + 0.5e0)::bigint - p.base as ap, floor(greatest(least(l_discount, dd.m + 3 * dd.sd), dd.m - 3 * dd.sd) * dd.scale + 0.5e0)::bigint - dd.base as ad,
 least(greatest(floor(p.e1 * p.scale + 0.5e0)::bigint - p.base, 0), 65535) as p1, least(greatest(floor(p.e2 * p.scale + 0.5e0)::bigint - p.base, 0), 65535) as p2, least(greatest(floor(p.e3 * p.scale + 0.5e0)::bigint - p.base, 0), 65535) as p3,
 least(greatest(floor(dd.e1 * dd.scale + 0.5e0)::bigint - dd.base, 0), 65535) as d1, least(greatest(floor(dd.e2 * dd.scale + 0.5e0)::bigint - dd.base, 0), 65535) as d2, least(greatest(floor(dd.e3 * dd.scale + 0.5e0)::bigint - dd.base, 0), 65535) as d3, l_orderkey % 4 as code from lineitem, p, dd),
y as (select case when ap <= 0 then 0 else (ap >= p1)::int + (ap >= p2)::int + (ap >= p3)::int end as price_k, case when ad <= 0 then 0 else (ad >= d1)::int + (ad >= d2)::int + (ad >= d3)::int end as l_discount, code from x)
select price_k::bigint as price_k, l_discount::bigint as l_discount, code::bigint as code, count(*) as n from y group by all""",
)
def quantize_apply(spark, d):
    x = _quant_source(spark, d)
    q = quantize.fit_quantizer(x, ["price_k", "l_discount", "code"], bits=2)
    y = quantize.quantized(x, q)
    return y.groupBy(*[F.col(c).cast("long").alias(c) for c in ("price_k", "l_discount", "code")]).agg(F.count("*").alias("n"))


@query("drift_signal", "with t as (select min(value) as lo, max(value) as hi from events where event_id % 10 < 3 and value between 20 and 80) select event_id, case when value < lo or value > hi then 'value' end as feature, case when value < lo or value > hi then round(value, 6) end as drifted from events, t")
def drift_signal(spark, d):
    e = files.table(spark, d, "events").select("event_id", "value")
    q = quantize.fit_quantizer(e.filter("event_id % 10 < 3 and value between 20 and 80"), ["value"], bits=3, clip=False)
    return quantize.drift_signals(e, q).select("event_id", F.col("drift.feature").alias("feature"), r6("drift.value").alias("drifted"))


EDGES = "s as (select *, greatest(floor(65535 / (hi - lo)), 1) as k from q), e as (select *, floor(lo * k + 0.5e0) as base from s), g as (select *, [least(greatest(floor(x * k + 0.5e0) - base, 0), 65535) for x in c] as edges from e), r as (select event_id, value, case when floor(value * k + 0.5e0) - base <= 0 then 0 else least(len([x for x in edges if floor(value * k + 0.5e0) - base >= x]), len(edges)) end as bin from events, g)"


@query(
    "drift_rebin",
    f"""with q as (select quantile_cont(value, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) as c, min(value) as lo, max(value) as hi from events where value between 20 and 80), {EDGES},
f as (select min(value) as flo, max(value) as fhi from events),
n as (select [lo] || [(x + base) / k for x in edges] || [hi] as old, least(lo, flo) as lo2, greatest(hi, fhi) as hi2, lo as lo1, hi as hi1 from g, f),
w as (select old, [lo2 + (x - lo1) * ((hi2 - lo2) / (hi1 - lo1)) for x in old] as new from n),
m as (select b, n, least(old[b + 2], new[n + 2]) - greatest(old[b + 1], new[n + 1]) as overlap from w, (select unnest(range(8)) as b), (select unnest(range(8)) as n)),
t as (select b, n as bin from (select *, row_number() over (partition by b order by overlap desc, n) as o from m) where o = 1)
select t.bin::bigint as bin, count(*) as n from r join t on r.bin = t.b group by 1""",
)
def drift_rebin(spark, d):
    e = files.table(spark, d, "events").select("event_id", "value")
    q = quantize.fit_quantizer(e.filter("value between 20 and 80"), ["value"], bits=3, clip=False)
    far = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    rule, m = quantize.rebinned(q.rules[0], [far.lo, far.hi], q.bins)
    old = quantize.quantized(e, q)
    return quantize.remapped(old, {"value": m}).groupBy(F.col("value").cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query(
    "bin_shrink",
    f"""with q as (select quantile_cont(value, [0.0625, 0.125, 0.1875, 0.25, 0.3125, 0.375, 0.4375, 0.5, 0.5625, 0.625, 0.6875, 0.75, 0.8125, 0.875, 0.9375]) as c, min(value) as lo, max(value) as hi from events), {EDGES},
l as (select bin from r where value > 40),
h as (select case when count(*) filter (bin = 0) > 0 then 0 when count(*) filter (bin = 1) > 0 then 1 else 2 end as low, case when count(*) filter (bin = 15) > 0 then 0 when count(*) filter (bin = 14) > 0 then 1 else 2 end as high from l)
select case when low + high = 0 then bin else least(greatest(floor((bin - low) * 16.0e0 / (16 - low - high)), 0), 15) end::bigint as bin, count(*) as n from l, h group by 1""",
)
def bin_shrink(spark, d):
    e = files.table(spark, d, "events").select("event_id", "value")
    q = quantize.fit_quantizer(e, ["value"], bits=4, clip=False)
    late = quantize.quantized(e.filter("value > 40"), q)
    counts = {r["value"]: r.n for r in late.groupBy("value").agg(F.count("*").alias("n")).collect()}  # a row a bin
    _, m = quantize.shrunk(q.rules[0], counts, q.bins)
    return quantize.remapped(late, {"value": m}).groupBy(F.col("value").cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("label_ids", "select n_name, row_number() over (order by n_name) - 1 as label_id from (select distinct n_name from nation)")
def label_ids(spark, d):
    return quantize.label_ids(files.table(spark, d, "nation"), "n_name")


# --- metrics and thresholds


@query("confusion_binary", "with c as (select count(*) filter (quality = 0 and toxic = 1) as tp, count(*) filter (quality = 0 and toxic = 0) as fp, count(*) filter (quality = 1 and toxic = 0) as tn, count(*) filter (quality = 1 and toxic = 1) as fn from labels) select tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn)::double, 6) as accuracy, round(tp / (tp + fp)::double, 6) as precision, round(tp / (tp + fn)::double, 6) as recall, round(2.0e0 * tp / (2 * tp + fp + fn), 6) as f1, round(fp / (fp + tn)::double, 6) as fpr, round(tp / (tp + fn)::double, 6) as tpr, round(tn / (tn + fp)::double, 6) as specificity from c")
def confusion_binary(spark, d):
    x = metrics.binary_rates(metrics.binary_counts(files.table(spark, d, "labels"), F.col("quality") == 0, F.col("toxic") == 1))
    return rounded(x, "accuracy", "precision", "recall", "f1", "fpr", "tpr", "specificity")


LABEL_COUNTS = "p as (select event_id % 5 as a, (event_id % 5 + (event_id % 7 = 0)::int + (user_id % 11 = 0)::int) % 6 as p from events), k as (select label, count(*) filter (a = p and label = p) as tp, count(*) filter (a <> p and label = p) as fp, count(*) filter (a <> p and label = a) as fn from p, (select unnest(range(6)) as label) group by label)"


def _labelled(spark, d):
    e = files.table(spark, d, "events")
    return e.select((F.col("event_id") % 5).alias("a"), ((F.col("event_id") % 5 + (F.col("event_id") % 7 == 0).cast("int") + (F.col("user_id") % 11 == 0).cast("int")) % 6).alias("p"))


@query("classification_report", f"with {LABEL_COUNTS} select label::bigint as label, tp, fp, fn, tp + fn as support, round(case when tp + fp = 0 then 0 else tp / (tp + fp)::double end, 6) as precision, round(case when tp + fn = 0 then 0 else tp / (tp + fn)::double end, 6) as recall, round(case when 2 * tp + fp + fn = 0 or tp = 0 then 0 else 2.0e0 * tp / (2 * tp + fp + fn) end, 6) as f1 from k")
def classification_report(spark, d):
    return rounded(metrics.label_report(metrics.label_counts(_labelled(spark, d), "p", "a")).withColumn("label", F.col("label").cast("long")), "precision", "recall", "f1")


@query(
    "averaged_report",
    f"""with {LABEL_COUNTS}, x as (select *, tp + fn as support, case when tp + fp = 0 then 0 else tp / (tp + fp)::double end as pr, case when tp + fn = 0 then 0 else tp / (tp + fn)::double end as rc, case when tp = 0 then 0 else 2.0e0 * tp / (2 * tp + fp + fn) end as f from k)
select round(sum(tp) / sum(tp + fp)::double, 6) as micro_precision, round(sum(tp) / sum(tp + fn)::double, 6) as micro_recall, round(avg(pr) filter (tp + fp > 0), 6) as macro_precision, round(avg(rc) filter (tp + fn > 0), 6) as macro_recall, round(avg(f) filter (tp + fp > 0 or tp + fn > 0), 6) as macro_f1, round(sum(pr * support) / sum(support), 6) as weighted_precision, round(sum(f * support) / sum(support), 6) as weighted_f1, round(avg(pr), 6) as mean_precision, round(avg(rc), 6) as mean_recall, round(avg(f), 6) as mean_f1 from x""",
)
def averaged_report(spark, d):
    names = ["micro_precision", "micro_recall", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_f1", "mean_precision", "mean_recall", "mean_f1"]
    return rounded(metrics.averaged_report(metrics.label_counts(_labelled(spark, d), "p", "a")).select(*names), *names)


@query("log_loss", "with x as (select quality = 1 as y, least(greatest((doc_id % 101) / 100.0e0, 1e-7), 1 - 1e-7) as p from labels) select round(avg(case when y then -ln(p) else -ln(1 - p) end), 6) as log_loss from x")
def log_loss(spark, d):
    return files.table(spark, d, "labels").agg(r6(metrics.log_loss((F.col("doc_id") % 101) / 100.0, F.col("quality") == 1)).alias("log_loss"))


@query("multi_log_loss", "with x as (select event_id % 3 as y, [0.2e0, 0.3e0, 0.5e0] as p from events) select round(avg(-ln(p[y + 1])), 6) as log_loss from x")
def multi_log_loss(spark, d):
    p = F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5))
    return files.table(spark, d, "events").agg(r6(metrics.multi_log_loss(p, F.col("event_id") % 3)).alias("log_loss"))


@query("regression_metrics", "with x as (select p_retailprice as a, 900 + 20.0e0 * p_size as p from part), e as (select p - a as e, a from x) select round(avg(abs(e)), 6) as mae, round(avg(e * e), 3) as mse, round(sqrt(avg(e * e)), 6) as rmse, round(avg(abs(e) / (abs(a) + 1e-6)), 6) as mape, round(1 - sum(e * e) / (sum(a * a) - sum(a) * sum(a) / count(*)), 6) as r2, round(avg(e), 6) as mean_error, round(max(abs(e)), 6) as max_error from e")
def regression_metrics(spark, d):
    x = metrics.regression_report(files.table(spark, d, "part"), 900 + 20.0 * F.col("p_size"), F.col("p_retailprice"))
    return rounded(x, "mae", "rmse", "mape", "r2", "mean_error", "max_error").withColumn("mse", F.round("mse", 3))


@query("roc_auc", f"with {SCORED}, r as (select pos, rank() over (order by -score) + (count(*) over (partition by score) - 1) / 2.0e0 as rk from ev) select round((sum(rk) filter (pos) - count(*) filter (pos) * (count(*) filter (pos) + 1) / 2.0e0) / (count(*) filter (pos) * 1.0e0 * count(*) filter (not pos)), 6) as roc_auc from r")
def roc_auc(spark, d):
    return rounded(metrics.roc_auc(scored_events(spark, d).withColumn("s", -F.col("score")), "s", F.col("pos")), "roc_auc")


@query("average_precision", f"with {SCORED}, o as (select pos, row_number() over (order by score, event_id) as r, sum(pos::int) over (order by score, event_id rows unbounded preceding) as h from ev) select round(sum(h * 1.0e0 / r) filter (pos) / count(*) filter (pos), 6) as average_precision from o")
def average_precision(spark, d):
    return rounded(metrics.average_precision(scored_events(spark, d).withColumn("s", -F.col("score")), "s", F.col("pos"), "event_id"), "average_precision")


GROUPED = f"{SCORED}, g as (select -score as threshold, count(*) filter (pos) as p, count(*) filter (not pos) as n from ev group by score), c as (select threshold, sum(p) over (order by threshold desc) as tp, sum(n) over (order by threshold desc) as fp, sum(p) over () as ap, sum(n) over () as an from g)"


@query("pr_curve", f"with {GROUPED} select null::double as threshold, 0.0e0 as recall, 1.0e0 as precision union all select round(threshold, 6), round(tp / ap::double, 6), round(tp / (tp + fp)::double, 6) from c")
def pr_curve(spark, d):
    return rounded(metrics.precision_recall_curve(scored_events(spark, d).withColumn("s", -F.col("score")), "s", F.col("pos")), "threshold", "recall", "precision")


@query("roc_curve", f"with {GROUPED} select null::double as threshold, 0.0e0 as fpr, 0.0e0 as tpr union all select round(threshold, 6), round(fp / an::double, 6), round(tp / ap::double, 6) from c")
def roc_curve(spark, d):
    return rounded(metrics.roc_curve(scored_events(spark, d).withColumn("s", -F.col("score")), "s", F.col("pos")), "threshold", "fpr", "tpr")


@query("threshold_fpr", f"with {SCORED}, n as (select floor(count(*) * 0.05e0) as k from ev where not pos), o as (select score, row_number() over (order by score, event_id) as r from ev where not pos), t as (select score as threshold from o, n where r = k) select round(threshold, 6) as threshold, round(count(*) filter (score < threshold and not pos) / count(*) filter (not pos)::double, 6) as fpr, round(count(*) filter (score < threshold and pos) / count(*) filter (pos)::double, 6) as tpr from ev, t group by threshold")
def threshold_fpr(spark, d):
    return rounded(threshold.threshold_at_fpr(scored_events(spark, d), "score", F.col("pos"), 0.05), "threshold", "fpr", "tpr")


CAND = f"{SCORED}, g as (select score, count(*) filter (pos) as p, count(*) filter (not pos) as n from ev group by score), c as (select score, coalesce(sum(p) over w, 0) as tp, coalesce(sum(n) over w, 0) as fp, sum(p) over () as ap, sum(n) over () as an from g window w as (order by score rows between unbounded preceding and 1 preceding))"


@query("threshold_youden", f"with {CAND} select round(score, 6) as threshold, tp::bigint as tp, fp::bigint as fp from c where fp / an::double <= 0.1e0 order by tp / ap::double - fp / an::double desc, score limit 1")
def threshold_youden(spark, d):
    return rounded(threshold.best_threshold(scored_events(spark, d), "score", F.col("pos"), 0.1, "youden").select("threshold", "tp", "fp"), "threshold")


@query("threshold_f1", f"with {CAND} select round(score, 6) as threshold, tp::bigint as tp, fp::bigint as fp from c where fp / an::double <= 0.3e0 order by 2.0e0 * tp / (2 * tp + fp + (ap - tp)) desc, score limit 1")
def threshold_f1(spark, d):
    return rounded(threshold.best_threshold(scored_events(spark, d), "score", F.col("pos"), 0.3, "f1").select("threshold", "tp", "fp"), "threshold")


@query("anomaly_flags", f"with {SCORED} select event_id, score < -1.5e0 as is_anomaly from ev")
def anomaly_flags(spark, d):
    return scored_events(spark, d).select("event_id", threshold.is_anomaly(F.col("score"), -1.5).alias("is_anomaly"))


@query("score_histogram", f"with {SCORED}, e as (select min(score) as lo, max(score) as hi from ev), x as (select least(floor((score - lo) / ((hi - lo) / 29)), 28)::bigint as bin, pos, lo, hi from ev, e) select bin, round(min(lo + bin * ((hi - lo) / 29)), 6) as lo, count(*) filter (pos) as pos, count(*) filter (not pos) as neg from x group by bin")
def score_histogram(spark, d):
    return rounded(metrics.histogram(scored_events(spark, d), "score", F.col("pos")), "lo")


@query("score_summary", f"with {SCORED} select round(avg(score), 6) as mean_score, round(min(score), 6) as min_score, round(max(score), 6) as max_score from ev")
def score_summary(spark, d):
    return rounded(metrics.score_summary(scored_events(spark, d), "score"), "mean_score", "min_score", "max_score")


@query("tpr_at_fpr", f"with {GROUPED}, v as (select 0.0e0 as fpr, 0.0e0 as tpr union all select fp / an::double, tp / ap::double from c), lo as (select max(struct_pack(fpr := fpr, tpr := tpr)) as s from v where fpr <= 0.05e0), hi as (select min(struct_pack(fpr := fpr, tpr := tpr)) as s from v where fpr >= 0.05e0) select round(case when hi.s.fpr = lo.s.fpr then lo.s.tpr else lo.s.tpr + (hi.s.tpr - lo.s.tpr) * (0.05e0 - lo.s.fpr) / (hi.s.fpr - lo.s.fpr) end, 6) as tpr from lo, hi")
def tpr_at_fpr(spark, d):
    return rounded(metrics.tpr_at_fpr(metrics.roc_curve(scored_events(spark, d).withColumn("s", -F.col("score")), "s", F.col("pos")), 0.05), "tpr")


@query("majority_vote", "with v as (select user_id, case event_type when 'click' then 0 when 'error' then 1 else 2 end as label, count(*) as n from events group by all) select user_id, max_by(label, n * 10 - label)::bigint as vote from v group by user_id")
def majority_vote(spark, d):
    e = files.table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "error", 1).otherwise(2).alias("label"))
    return metrics.majority_vote(e, ["user_id"], "label").withColumn("vote", F.col("vote").cast("long"))


@query("smallest_class", "select round(100.0e0 * min(n) / sum(n), 6) as smallest_share from (select quality, count(*) as n from labels group by quality)")
def smallest_class(spark, d):
    return rounded(metrics.smallest_class_share(files.table(spark, d, "labels"), "quality"), "smallest_share")


# --- trees and forests

def _binned(spark, d):
    li = files.table(spark, d, "lineitem")
    return li.select(F.floor(F.col("l_quantity") / 7 + 0.5).cast("int").alias("b1"), F.floor(F.col("l_discount") * 50).cast("int").alias("b2"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


BINNED = "q as (select floor(l_quantity / 7 + 0.5e0)::int as b1, floor(l_discount * 50)::int as b2, (l_returnflag = 'R')::int as y from lineitem)"
CELLS = f"{BINNED}, u as (select 'b1' as feature, b1 as bin, y from q union all select 'b2', b2, y from q), h as (select feature, bin, count(*) filter (y = 0) as c0, count(*) filter (y = 1) as c1 from u group by all), s as (select feature, bin, sum(c0) over w as l0, sum(c1) over w as l1, sum(c0) over (partition by feature) as t0, sum(c1) over (partition by feature) as t1 from h window w as (partition by feature order by bin)), z as (select *, t0 - l0 as r0, t1 - l1 as r1, l0 + l1 as nl, t0 + t1 - l0 - l1 as nr, t0 + t1 as n from s where t0 + t1 > l0 + l1)"


@query("class_histogram", f"with {BINNED} select 'b1' as feature, b1::bigint as bin, y::bigint as y, count(*) as n from q group by all union all select 'b2', b2::bigint, y::bigint, count(*) from q group by all")
def class_histogram(spark, d):
    return trees.class_histogram(_binned(spark, d), ["b1", "b2"], "y").withColumn("y", F.col("y").cast("long"))


@query("gini_split", f"with {CELLS} select feature, bin::bigint as bin, round(1 - pow(t0 / n::double, 2) - pow(t1 / n::double, 2) - nl / n::double * (1 - pow(l0 / nl::double, 2) - pow(l1 / nl::double, 2)) - nr / n::double * (1 - pow(r0 / nr::double, 2) - pow(r1 / nr::double, 2)), 9) as gain from z")
def gini_split(spark, d):
    return trees.split_gains(_binned(spark, d), ["b1", "b2"], "y", [0, 1], "gini").drop("n").withColumn("gain", F.round("gain", 9))


@query("entropy_split", f"with {CELLS}, e as (select feature, bin, n, nl, nr, -(t0 / n::double) * log2(t0 / n::double) - (t1 / n::double) * log2(t1 / n::double) as e, case when l0 = 0 or l1 = 0 then 0 else -(l0 / nl::double) * log2(l0 / nl::double) - (l1 / nl::double) * log2(l1 / nl::double) end as el, case when r0 = 0 or r1 = 0 then 0 else -(r0 / nr::double) * log2(r0 / nr::double) - (r1 / nr::double) * log2(r1 / nr::double) end as er from z) select feature, bin::bigint as bin, round(e - nl / n::double * el - nr / n::double * er, 9) as gain from e")
def entropy_split(spark, d):
    return trees.split_gains(_binned(spark, d), ["b1", "b2"], "y", [0, 1], "entropy").drop("n").withColumn("gain", F.round("gain", 9))


@query("best_split", f"with {CELLS} select feature, bin::bigint as bin, round(1 - pow(t0 / n::double, 2) - pow(t1 / n::double, 2) - nl / n::double * (1 - pow(l0 / nl::double, 2) - pow(l1 / nl::double, 2)) - nr / n::double * (1 - pow(r0 / nr::double, 2) - pow(r1 / nr::double, 2)), 9) as gain from z order by gain desc, feature, bin limit 1")
def best_split(spark, d):
    return trees.best_split(trees.split_gains(_binned(spark, d), ["b1", "b2"], "y", [0, 1]).drop("n").withColumn("gain", F.round("gain", 9)))


@query(
    "boost_split",
    f"""with {BINNED}, u as (select 'b1' as feature, b1 as bin, y from q union all select 'b2', b2, y from q), h as (select feature, bin, sum(0.5e0 - y) as g, sum(0.25e0) as hh, count(*) as n from u group by all),
s as (select feature, bin, sum(g) over w as lg, sum(hh) over w as lh, sum(n) over w as ln, sum(g) over (partition by feature) as tg, sum(hh) over (partition by feature) as th, sum(n) over (partition by feature) as tn from h window w as (partition by feature order by bin))
select feature, bin::bigint as bin, round(0.5e0 * (lg * lg / (lh + 1) + (tg - lg) * (tg - lg) / (th - lh + 1) - tg * tg / (th + 1)), 6) as gain from s where tn > ln""",
)
def boost_split(spark, d):
    x = _binned(spark, d)
    gh = trees.gradients(F.array(F.lit(0.5), F.lit(0.5)), F.col("y"))
    x = x.withColumn("g", gh[0][1]).withColumn("h", gh[1][1])
    return rounded(trees.boost_gains(trees.gradient_histogram(x, ["b1", "b2"], "g", "h")).select("feature", "bin", "gain"), "gain")


@query("iforest_score")
def iforest_score(spark, d):
    o = files.table(spark, d, "orders").join(files.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_totalprice", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"))
    f = forest.fit_forest(o, "o_orderkey", ["o_totalprice", "c_acctbal", "c_nationkey"], forest.ForestConfig(trees=40, continuous=True))
    return forest.scored(o, f, "o_orderkey").select("o_orderkey", r6("score").alias("score"))


def _document_features(spark, d):
    doc = files.table(spark, d, "documents").select("doc_id", "text")
    x = doc.select("doc_id", F.length("text").alias("n"), F.length(F.regexp_replace("text", "[^A-Z]", "")).alias("caps"), F.length(F.regexp_replace("text", "[^!#$%&*|]", "")).alias("marks"), F.size(F.split("text", "\n")).alias("lines"))
    bins = lambda c: F.least(F.floor(F.log2(F.col(c) + 1.0)), F.lit(15)).cast("int")
    share = lambda c: F.least(F.floor(F.col(c) * 30.0 / (F.col("n") + 1)), F.lit(15)).cast("int")
    return x.select("doc_id", bins("n").alias("f_len"), share("caps").alias("f_caps"), share("marks").alias("f_marks"), bins("lines").alias("f_lines"))


@query("rf_vote")
def rf_vote(spark, d):
    x = _document_features(spark, d).join(files.table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    names = ["f_len", "f_caps", "f_marks", "f_lines"]
    f = trees.fit_random_forest(x, "doc_id", names, "quality", trees.RandomForestConfig(trees=15))
    return trees.predicted(x, f, "doc_id")


@query("boost_predict")
def boost_predict(spark, d):
    x = _document_features(spark, d).join(files.table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    names = ["f_len", "f_caps", "f_marks", "f_lines"]
    m = trees.fit_booster(x, names, "quality", trees.BoostConfig(rounds=2, max_depth=3))
    return trees.boosted(x, m, ["doc_id"]).select("doc_id", r6(F.col("probabilities")[1]).alias("p1"), "prediction")


# --- audits, logs, feedback, configurations


@query(
    "centroid_mmd",
    f"""with x as (select vec_id as id, embedding as v, label < 5 as side from embeddings),
p as (select a.id as ia, b.id as ib, a.side as sa, b.side as sb, list_sum([(a.v[i]::double - b.v[i]::double) * (a.v[i]::double - b.v[i]::double) for i in range(1, 65)]) as d2 from x a join x b on a.id <= b.id),
g as (select 1 / quantile_cont(d2, 0.5) as gamma from p where ia < ib),
k as (select sa, sb, exp(-gamma * d2) * case when ia = ib then 1 else 2 end as k, case when ia = ib then 1 else 2 end as n, gamma from p, g)
select round(max(gamma), 6) as gamma, round(sum(k) filter (sa and sb) / sum(n) filter (sa and sb) + sum(k) filter (not sa and not sb) / sum(n) filter (not sa and not sb) - 2 * sum(k) filter (sa <> sb) / sum(n) filter (sa <> sb), 6) as mmd2 from k""",
)
def centroid_mmd(spark, d):
    e = files.table(spark, d, "embeddings")
    return rounded(audit.mmd2(e, "vec_id", "embedding", F.col("label") < 5), "gamma", "mmd2")


@query("fifo_window", "select event_id from (select event_id, row_number() over (order by event_id desc) as r from events) where r <= 500")
def fifo_window(spark, d):
    e = files.table(spark, d, "events").select("event_id")
    return files.bounded_append(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "event_id", 500)[0]


@query("newest_log", "select event_id, event_type from events order by event_id desc limit 50")
def newest_log(spark, d):
    e = files.table(spark, d, "events").select("event_id", "event_type")
    return files.newest_first_log(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "event_id", 50)


@query("pending_feedback", "with e as (select event_id, user_id, event_type from events where event_type in ('click', 'error')), c as (select *, sum((event_type = 'error')::int) over w - sum((event_type = 'click')::int) over w as ahead from e window w as (partition by user_id order by event_id)), i as (select *, greatest(0, max(ahead) over (partition by user_id order by event_id)) as ignored from c), m as (select *, event_type = 'error' and ignored = coalesce(lag(ignored) over (partition by user_id order by event_id), 0) as taken from i), l as (select user_id, event_type || '-' || event_id as actual, row_number() over (partition by user_id order by event_id) as k from m where taken), p as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as k from e where event_type = 'click') select event_id, user_id, actual from p left join l using (user_id, k)")
def pending_feedback(spark, d):
    e = files.table(spark, d, "events")
    p = e.filter("event_type = 'click'").select("event_id", "user_id")
    lab = e.filter("event_type = 'error'").select("event_id", "user_id", F.concat_ws("-", "event_type", F.col("event_id").cast("string")).alias("actual"))
    return feedback.matched_in_order(p, lab, "user_id", "event_id").select("event_id", "user_id", "actual")


@query("label_timeouts", "with g as (select event_id, user_id, epoch(ts) - lag(epoch(ts)) over (partition by user_id order by ts, event_id) as gap, ts from events where event_type = 'error'), s as (select *, coalesce(floor(gap / 86400), 0) as skipped from g) select event_id, skipped::bigint as skipped, (row_number() over w + sum(skipped) over w)::bigint as slot from s window w as (partition by user_id order by ts, event_id rows unbounded preceding)")
def label_timeouts(spark, d):
    e = files.table(spark, d, "events").filter("event_type = 'error'").select("event_id", "user_id", F.struct("ts", "event_id").alias("o"), "ts")
    w = Window.partitionBy("user_id").orderBy("o")
    at = F.col("ts").cast("timestamp").cast("double")
    gap = at - F.lag(at).over(w)
    x = e.withColumn("skipped", F.coalesce(F.floor(gap / 86400.0), F.lit(0)))
    return x.select("event_id", F.col("skipped").cast("long").alias("skipped"), (F.row_number().over(w) + F.sum("skipped").over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("long").alias("slot"))


@query("log_accuracy", "with o as (select user_id % 3 as p, event_id % 3 as a from events order by event_id desc limit 1000) select round(avg((p = a)::int), 6) as accuracy, count(*) as pairs from o")
def log_accuracy(spark, d):
    e = files.table(spark, d, "events").select("event_id", (F.col("user_id") % 3).alias("predicted"), (F.col("event_id") % 3).alias("actual"))
    return rounded(feedback.online_accuracy(e, "event_id", 1000), "accuracy")


@query("best_config", "with g as (select n, t, round(0.03e0 + 0.0004e0 * n, 6) as fpr_val, round(0.8e0 + 0.002e0 * (n % 7) + 0.0001e0 * t, 6) as tpr_val, round(0.9e0 + 0.001e0 * (t % 3), 6) as auc_val, n * t / 100.0e0 as time_s from (select unnest(range(10, 60)) as n), (select unnest(range(1, 20)) as t)) select n::bigint as n, t::bigint as t, fpr_val, tpr_val, auc_val, time_s from g where fpr_val <= 0.05e0 order by tpr_val desc, auc_val desc, abs(fpr_val - 0.045e0), time_s limit 1")
def best_config(spark, d):
    n, t = spark.range(10, 60).withColumnRenamed("id", "n"), spark.range(1, 20).withColumnRenamed("id", "t")
    g = n.join(F.broadcast(t)).select("n", "t", F.round(0.03 + 0.0004 * F.col("n"), 6).alias("fpr_val"), F.round(0.8 + 0.002 * (F.col("n") % 7) + 0.0001 * F.col("t"), 6).alias("tpr_val"), F.round(0.9 + 0.001 * (F.col("t") % 3), 6).alias("auc_val"), (F.col("n") * F.col("t") / 100.0).alias("time_s"))
    return search.best_config(g, 0.05, 0.045)


@query("dataset_params", "select 'quantization_coefficient' as parameter, '4' as value union all select 'num_features', '3' union all select 'num_samples', count(*)::varchar from labels union all select 'num_labels', count(distinct quality)::varchar from labels union all select 'samples_label_' || quality, count(*)::varchar from labels group by quality")
def dataset_params(spark, d):
    return files.dataset_params(files.table(spark, d, "labels"), 3, 4, "quality")


@query("content_dedup", "select sha256(text) as sha256, min(doc_id) as doc_id, count(*) as copies from documents where text is not null group by 1")
def content_dedup(spark, d):
    x = files.table(spark, d, "documents").filter("text is not null").select("doc_id", S.content_hash(F.col("text").cast("binary")).alias("sha256"))
    return x.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("valid_rows", "select p_partkey from part where p_size between 0 and 31 and p_partkey % 40 between 0 and 31")
def valid_rows(spark, d):
    x = files.table(spark, d, "part").select("p_partkey", F.array(F.col("p_size").cast("int"), (F.col("p_partkey") % 40).cast("int")).alias("f"))
    return packed.valid_rows(x, "f", 2, 5).select("p_partkey")
