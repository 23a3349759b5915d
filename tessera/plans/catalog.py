"""Queries of the surrogate-model operators over the driver's tables, each with SQL that an independent engine runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.quantiles import central_z
from tessera.operators import design, estimators, explain, forecast, frames, kernels, metrics, models, neighbours, reduction, tree_shap, umap
from tessera.operators.boosting import QuantileBoosting
from tessera.sources import examples
from tessera.sources.tables import matching_lines
from tessera.streaming.windows import windowed_series

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def line_outputs(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("x"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("charge"))
    return frames.to_long(li, ["l_orderkey", "x"], ["net", "charge"])


def once(fit: DataFrame) -> DataFrame:
    """A fit of one row an output, computed here and now, so that no query that reads predictions twice fits twice."""
    return fit.sparkSession.createDataFrame(fit.collect(), fit.schema)


def line_predictions(spark, d, twice: bool = False) -> DataFrame:
    """Predictions of the test lines; fitted beforehand only where they are read twice."""
    train, test = frames.remainder_split(line_outputs(spark, d), "l_orderkey")
    fit = models.ols_fit(train)
    return models.ols_predict(test, once(fit) if twice else fit).select("output", "x", "y_true", "y_pred", "y_std")


LINE = """with src as (select l_orderkey, l_extendedprice as x, l_extendedprice*(1-l_discount) as net, l_extendedprice*(1-l_discount)*(1+l_tax) as charge from lineitem),
lng as (select l_orderkey, x, 'net' as output, net as y from src union all select l_orderkey, x, 'charge', charge from src),
fit as (select output, regr_intercept(y, x) as a, regr_slope(y, x) as b, sqrt(greatest(regr_syy(y, x)/count(*)*(1-regr_r2(y, x)), 0)) as s from lng where l_orderkey % 4 <> 0 group by output),
p as (select lng.output, x, y as y_true, a+b*x as y_pred, s as y_std from lng join fit using (output) where l_orderkey % 4 = 0)
"""


def part_predictions(spark, d) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.lit("price").alias("output"), F.col("p_partkey").cast("double").alias("x"), F.col("p_retailprice").alias("y_true"))
    train, test = frames.remainder_split(p, "row_id")
    return models.ols_predict(test, models.ols_fit(train))


PART = """with lng as (select p_partkey as row_id, 'price' as output, p_partkey::double as x, p_retailprice as y from part),
fit as (select output, regr_intercept(y, x) as a, regr_slope(y, x) as b, sqrt(greatest(regr_syy(y, x)/count(*)*(1-regr_r2(y, x)), 0)) as s from lng where row_id % 4 <> 0 group by output),
p as (select row_id, lng.output, x, y as y_true, a+b*x as y_pred, s as y_std from lng join fit using (output) where row_id % 4 = 0)
"""
_NLL = "avg(0.5*ln(2*pi()*y_std*y_std)+0.5*((y_true-y_pred)/y_std)*((y_true-y_pred)/y_std))"


@query(LINE + f"select output, count(*)::bigint as n, round(sqrt(avg((y_true-y_pred)*(y_true-y_pred))),6) as rmse, round(avg(abs(y_true-y_pred)),6) as mae, round(1-sum((y_true-y_pred)*(y_true-y_pred))/(var_pop(y_true)*count(*)),6) as r2, round({_NLL},6) as nll, round(sqrt(avg(y_std*y_std)),6) as sharpness, round(avg(y_std),6) as mean_predicted_std from p group by grouping sets ((output), ())")
def ols_multioutput_metrics(spark, d):
    return rounded(metrics.uq_metrics(line_predictions(spark, d)))


@query(LINE + "select output, round(sqrt(avg((y_true-y_pred)*(y_true-y_pred))),6) as rmse, round(avg(abs(y_true-y_pred)),6) as mae, round(avg(y_std),6) as avg_std from p group by output")
def uq_metrics_nested_flat(spark, d):
    flat = frames.flatten_structs(metrics.nested_metrics(line_predictions(spark, d)).select("output", "accuracy", "sharpness"))
    return rounded(flat.select("output", "rmse", "mae", F.col("sharp").alias("avg_std")))


@query("with g as (select l_returnflag, l_linestatus, avg(l_extendedprice) as m, stddev_pop(l_extendedprice) as s from lineitem group by all) select l_returnflag, l_linestatus, count(*)::bigint as n, round(max(m),6) as y_pred, round(max(s),6) as y_std, round(sqrt(avg((l_extendedprice-m)*(l_extendedprice-m))),6) as rmse from lineitem join g using (l_returnflag, l_linestatus) group by all")
def group_mean_surrogate(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.concat_ws("|", "l_returnflag", "l_linestatus").alias("output"), F.lit(0).alias("row_id"), F.col("l_extendedprice").cast("double").alias("y_true"))
    by = ["l_returnflag", "l_linestatus"]
    p = estimators.Mean().fit(rows, []).predict(rows)
    got = p.groupBy("output").agg(F.count("*").alias("n"), F.max("y_pred").alias("y_pred"), F.max("y_std").alias("y_std"), F.sqrt(F.avg(F.pow(F.col("y_true") - F.col("y_pred"), 2))).alias("rmse"))
    return rounded(got.select(*[F.split_part("output", F.lit("|"), F.lit(i + 1)).alias(c) for i, c in enumerate(by)], "n", "y_pred", "y_std", "rmse"))


_LV = ", ".join(f"({p}::double, {central_z(p)!r}::double)" for p in metrics.LEVELS)


@query(LINE + f"select output, level, round(avg((abs(y_true-y_pred)/y_std <= z)::int::double),6) as empirical from p, (values {_LV}) v(level, z) group by output, level")
def coverage_curve(spark, d):
    return rounded(metrics.coverage(line_predictions(spark, d)))


@query(LINE + "select output, round(avg((abs(y_true-y_pred) <= y_std)::int::double),6) as accuracy from p group by output")
def interval_accuracy_1sigma(spark, d):
    return rounded(line_predictions(spark, d).groupBy("output").agg(F.avg((F.abs(F.col("y_true") - F.col("y_pred")) <= F.col("y_std")).cast("double")).alias("accuracy")))


_Z = ", ".join(f"({k}, {central_z(k / 99)!r}::double)" if k < 99 else "(99, 1e300::double)" for k in range(100))


@query(LINE + f", c as (select output, k, k/99.0::double as e, avg((abs(y_true-y_pred)/y_std <= z)::int::double) as o from p, (values {_Z}) v(k, z) group by output, k), s as (select output, e, abs(e-o) as g, lead(e) over w as e2, lead(abs(e-o)) over w as g2 from c window w as (partition by output order by k)) select output, round(sum((e2-e)*(g+g2)/2),6) as miscal_area from s group by output")
def calibration_area(spark, d):
    return rounded(metrics.miscalibration_area(metrics.calibration(line_predictions(spark, d))))


_Z95 = repr(central_z(0.95))


@query(PART + f"select row_id, output, round(y_true,6) as y_true, round(y_pred,6) as y_pred, round(y_pred-{_Z95}*y_std,6) as lower, round(y_pred+{_Z95}*y_std,6) as upper from p")
def confidence_band(spark, d):
    return rounded(metrics.intervals(part_predictions(spark, d)))


@query(PART + "select output, row_number() over (partition by output order by y_true, row_id)-1 as x, row_id, round(y_true,6) as y_true, round(y_pred,6) as y_pred, round(y_pred-2*y_std,6) as lower, round(y_pred+2*y_std,6) as upper from p")
def ordered_intervals(spark, d):
    return rounded(metrics.ordered_intervals(part_predictions(spark, d)))


@query(LINE + ", r as (select output, y_pred, y_true-y_pred as r from p) select output, round(regr_slope(r, y_pred),6) as slope, round(regr_intercept(r, y_pred),6) as intercept, round(min(r)-0.1*(max(r)-min(r)+1e-8),6) as low, round(max(r)+0.1*(max(r)-min(r)+1e-8),6) as high, floor(min(y_pred))::bigint as x_low, ceil(max(y_pred))::bigint as x_high from r group by output")
def residual_trend(spark, d):
    return rounded(metrics.residual_trend(line_predictions(spark, d)))


@query(PART + "select row_id, round(y_true-y_pred,6) as residual, round(y_pred-y_true,6) as error, round((y_true-y_pred)/stddev_pop(y_true-y_pred) over (),6) as z from p")
def residual_table(spark, d):
    p = part_predictions(spark, d)
    r = F.col("y_true") - F.col("y_pred")
    sd = p.groupBy("output").agg(F.stddev_pop(r).alias("sd"))
    return rounded(p.join(F.broadcast(sd), "output").select("row_id", r.alias("residual"), (-r).alias("error"), (r / F.col("sd")).alias("z")))


def _hist_sql(bins: int, value: str) -> str:
    return f", v as (select output, {value} as v from p), e as (select output, min(v) as lo, max(v) as hi from v group by output), c as (select output, least({bins - 1}, floor((v-lo)/((hi-lo)/{bins}))::int) as bin, count(*) as n from v join e using (output) group by all), s as (select output, lo, hi, unnest(range({bins}))::int as bin from e) select output, bin::bigint as bin, round(lo+bin*(hi-lo)/{bins},6) as left_edge, coalesce(n,0)::bigint as n from s left join c using (output, bin)"


@query(LINE + _hist_sql(20, "y_pred-y_true"))
def error_histogram(spark, d):
    return rounded(metrics.histogram(line_predictions(spark, d, True).withColumn("e", F.col("y_pred") - F.col("y_true")), "e", 20))


@query(LINE + _hist_sql(30, "(y_true-y_pred)/y_std"))
def zscore_histogram(spark, d):
    return rounded(metrics.histogram(line_predictions(spark, d, True).withColumn("e", (F.col("y_true") - F.col("y_pred")) / F.col("y_std")), "e", 30))


@query(LINE + ", m as (select output, avg(y) as m from lng where l_orderkey % 4 <> 0 group by output) select output, round(sqrt(avg((y_true-y_pred)*(y_true-y_pred))),6) as ols, round(sqrt(avg((y_true-m)*(y_true-m))),6) as mean from p join m using (output) group by output")
def model_comparison_rmse(spark, d):
    train, test = frames.remainder_split(line_outputs(spark, d), "l_orderkey")
    fit = models.ols_fit(train).join(train.groupBy("output").agg(F.avg("y_true").alias("m")), "output")
    p = test.join(F.broadcast(fit), "output").select("output", "y_true", (F.col("a") + F.col("b") * F.col("x")).alias("ols"), F.col("m").alias("mean"))  # one row an output
    return rounded(metrics.compare_rmse(p, {"ols": "ols", "mean": "mean"}))


@query("with t as (select p_partkey as k, p_size::double as x, p_retailprice::double as y, ('0x' || substr(md5(p_partkey || '|price|0|1'),1,8))::bigint/4294967296.0::double as u, ('0x' || substr(md5(p_partkey || '|price|0|2'),1,8))::bigint/4294967296.0::double as v from part), n as (select *, y+100*sqrt(-2*ln(1-u))*cos(2*pi()*v) as z from t), f as (select regr_intercept(y,x) as a, regr_slope(y,x) as b, regr_intercept(z,x) as c, regr_slope(z,x) as d from n where k % 4 <> 0) select 'price' as output, round(sqrt(avg((y-a-b*x)*(y-a-b*x))),4) as model, round(sqrt(avg((y-c-d*x)*(y-c-d*x))),4) as noisy from t, f where k % 4 = 0")
def noisy_baseline_rmse(spark, d):
    """A line fitted to prices and one fitted to prices with noise, on the same test parts."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.lit("price").alias("output"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y_true"))
    train, test = frames.remainder_split(rows, "row_id")
    return rounded(estimators.compare_with_noisy(estimators.Linear, train, test, ["x"], 100.0), 4)


@query("with x as (select c_name as v, c_nationkey < 12 as a from customer), g as (select v, sum(a::int) as a, sum((not a)::int) as b from x group by 1), c as (select abs(sum(a) over (order by v)/sum(a) over ()::double-sum(b) over (order by v)/sum(b) over ()::double) as g from g) select round(max(g),6) as d from c")
def ks_strings(spark, d):
    c = table(spark, d, "customer").select("c_name", "c_nationkey")
    return rounded(design.ks_two_sample(c.where("c_nationkey < 12"), c.where("c_nationkey >= 12"), "c_name"))


@query("with t as (select p_partkey as k, p_size::double as a, (p_partkey % 1000)::double as b, p_retailprice as y from part), r as (select q.k as row_id, t.y, row_number() over (partition by q.k order by (t.a-q.a)*(t.a-q.a)+(t.b-q.b)*(t.b-q.b), t.k) as n from t, t q where q.k % 100 = 0 and t.k <> q.k) select row_id, round(avg(y),6) as y_pred, round(stddev_pop(y),6) as y_std from r where n <= 3 group by row_id")
def knn_regression_std(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("a"), (F.col("p_partkey") % 1000).cast("double").alias("b"), F.col("p_retailprice").alias("y"))
    return rounded(models.knn(t, t.where("k % 100 = 0"), ["a", "b"], "y", 3, "k"))


@query("with g as (select p_size as x, count(*) as n, sum(p_retailprice) as s from part group by 1), c as (select x as lo, lead(x) over (order by x) as hi, sum(n) over (order by x) as nl, sum(s) over (order by x) as sl, sum(n) over () as nt, sum(s) over () as st from g) select 'price' as output, round((lo+hi)/2.0,6) as threshold, round(sl/nl,6) as left_mean, round((st-sl)/(nt-nl),6) as right_mean from c where hi is not null order by round(sl*sl/nl+(st-sl)*(st-sl)/(nt-nl),6) desc, lo limit 1")
def stump_regression(spark, d):
    return rounded(models.stump(table(spark, d, "part").select(F.lit("price").alias("output"), F.col("p_size").alias("x"), F.col("p_retailprice").alias("y_true"))))


@query("with t as (select p_partkey, p_partkey::double as x, p_retailprice as y, row_number() over (order by p_partkey)-1 as r, count(*) over () as n from part), f as (select *, case when r < (n%3)*(n//3+1) then r//(n//3+1) else n%3+(r-(n%3)*(n//3+1))//(n//3) end as fold from t), m as (select a.fold, regr_intercept(b.y,b.x) as i, regr_slope(b.y,b.x) as s, avg(b.y) as m from (select distinct fold from f) a join f b on a.fold<>b.fold group by 1), e as (select avg((y-i-s*x)*(y-i-s*x)) as ols, avg((y-m)*(y-m)) as mean from f join m using (fold) group by fold) select 'ols' as candidate, round(-avg(ols),6) as score from e union all select 'mean', round(-avg(mean),6) from e")
def kfold_select_best(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("double").alias("x"), F.col("p_retailprice").alias("y_true"))
    folds = frames.kfold(t, "p_partkey", 3)
    apart = folds.withColumn("out", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    train = apart.where("fold <> out")
    fit = models.ols_fit(train, by=("out",)).join(train.groupBy("out").agg(F.avg("y_true").alias("m")), "out")
    e = folds.join(F.broadcast(fit), F.col("fold") == F.col("out")).groupBy("fold").agg(F.avg(F.pow(F.col("y_true") - F.col("a") - F.col("b") * F.col("x"), 2)).alias("ols"), F.avg(F.pow(F.col("y_true") - F.col("m"), 2)).alias("mean"))
    return rounded(e.agg((-F.avg("ols")).alias("ols"), (-F.avg("mean")).alias("mean")).unpivot([], ["ols", "mean"], "candidate", "score"))


@query("select o_orderpriority as level, round(regr_intercept(o_totalprice, o_custkey),6) as a, round(regr_slope(o_totalprice, o_custkey),6) as b, round(sqrt(regr_syy(o_totalprice,o_custkey)/count(*)*(1-regr_r2(o_totalprice,o_custkey))),6) as s from orders group by 1")
def multifidelity_ols(spark, d):
    return rounded(models.ols_fit(table(spark, d, "orders").select(F.col("o_orderpriority").alias("level"), F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("y_true")), by=("level",)))


_U = "(('0x'||substr(md5(p_partkey::varchar||'|'||r::varchar),1,8))::bigint/4294967296.0::double)"
_W = "(" + "+".join(f"({_U} >= {p!r}::double)::int" for p in frames.POISSON) + ")"


@query(f"with t as (select p_partkey as row_id, p_partkey::double as x, p_retailprice as y, r, {_W} as w from part, range(1,21) g(r)), s as (select r, sum(w) as sw, sum(w*x) as wx, sum(w*y) as wy, sum(w*x*x) as wxx, sum(w*x*y) as wxy from t group by r), f as (select r, (sw*wxy-wx*wy)/(sw*wxx-wx*wx) as b, sw, wx, wy from s) select p_partkey as row_id, round(avg((wy-b*wx)/sw+b*p_partkey),5) as y_pred, round(stddev_pop((wy-b*wx)/sw+b*p_partkey),5) as y_std from part, f group by 1")
def bootstrap_ols(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.lit("price").alias("output"), F.col("p_partkey").cast("double").alias("x"), F.col("p_retailprice").alias("y_true"))
    return rounded(models.bootstrap_ols(t, t, frames.poisson_replicates(t, "row_id", 20)).drop("output"), 5)


@query("with n as (select count(*) as n from part), d as (select r as replicate, floor((('0x'||substr(md5(r::varchar||'@'||i::varchar),1,8))::bigint/4294967296.0::double)*n)::bigint as place from n, unnest(range(n)) t(i), range(1,4) g(r)), c as (select replicate, place, count(*) as w from d group by 1, 2), p as (select p_partkey, p_retailprice, row_number() over (order by p_partkey)-1 as place from part) select replicate::bigint as replicate, sum(w)::bigint as draws, count(*)::bigint as rows_drawn, max(w)::bigint as most, round(sum(w*p_retailprice)/sum(w),6) as mean from c join p using (place) group by replicate")
def drawn_replicates(spark, d):
    """Bootstrap means of three replicates of exactly as many draws as there are parts."""
    part = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("price"))
    drawn = frames.drawn_replicates(part, "p_partkey", 3)
    made = drawn.groupBy("replicate").agg(F.sum("weight").alias("draws"), F.count("*").alias("rows_drawn"), F.max("weight").alias("most"), (F.sum(F.col("weight") * F.col("price")) / F.sum("weight")).alias("mean"))
    return rounded(made)


@query()
def model_search(spark, d):
    """Six trials of model-based search over forests on all parts."""
    found = estimators.model_search(_part_xy(spark, d), ["a", "b"], estimators.Tree, {"max_depth": [1, 2, 3, 4, 5, 6, 8], "max_bins": [16, 32, 64]}, trials=6)
    return rounded(found)


@query("select round(1-(select count(*) from (select distinct * from customer))/count(*)::double,6) as duplicate_rate, round(abs(corr(c_nationkey,c_acctbal)),6) as max_abs_corr, round(least(var_samp(c_nationkey),var_samp(c_acctbal)),4) as min_variance, round(greatest(var_samp(c_nationkey),var_samp(c_acctbal)),4) as max_variance, false as duplicate_alert, abs(corr(c_nationkey,c_acctbal))>0.95 as correlation_alert from customer")
def bias_metrics(spark, d):
    b = design.bias_metrics(table(spark, d, "customer"), ["c_nationkey", "c_acctbal"])
    return b.select(F.round("duplicate_rate", 6).alias("duplicate_rate"), F.round("max_abs_corr", 6).alias("max_abs_corr"), F.round("min_variance", 4).alias("min_variance"), F.round("max_variance", 4).alias("max_variance"), "duplicate_alert", "correlation_alert")


_LC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a},{b}),6) as r from lineitem" for i, a in enumerate(_LC) for b in _LC[i + 1 :]))
def pearson_matrix(spark, d):
    return rounded(design.correlation_matrix(table(spark, d, "lineitem"), _LC))


@query("with q as (select l_quantity, rank() over (order by l_quantity)+(count(*) over (partition by l_quantity)-1)/2.0 as a, rank() over (order by l_discount)+(count(*) over (partition by l_discount)-1)/2.0 as b from lineitem) select round(corr(a,b),6) as rho from q")
def spearman_matrix(spark, d):
    return rounded(design.spearman(table(spark, d, "lineitem"), "l_quantity", "l_discount"))


@query("select 'p_size' as feature, count(*) filter (where p_size % 7 = 0)::bigint as n_missing from part")
def missing_data(spark, d):
    return design.missing_counts(table(spark, d, "part").select(F.nullif(F.col("p_size") % 7, F.lit(0)).alias("p_size"), "p_retailprice"))


@query("select count(distinct c_custkey)::bigint as c_custkey, count(distinct c_nationkey)::bigint as c_nationkey, count(distinct c_mktsegment)::bigint as c_mktsegment, (count(distinct c_custkey)=count(c_custkey)) as key_unique from customer")
def unique_counts(spark, d):
    return design.unique_counts(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey")


@query("select c_custkey, c_nationkey from customer")
def constant_columns(spark, d):
    return frames.drop_constant(table(spark, d, "customer").select("c_custkey", "c_nationkey", F.lit(7).alias("seven"))).select("c_custkey", "c_nationkey")


def _line_levels(spark, d) -> dict[str, list[float]]:
    levels = table(spark, d, "lineitem").agg(*[F.sort_array(F.collect_set(F.col(c).cast("double"))).alias(n) for n, c in (("x1", "l_discount"), ("x2", "l_tax"), ("x3", "l_linenumber"))]).first()  # a few levels a column
    return {c: levels[c] for c in ("x1", "x2", "x3")}


@query("select distinct a.l_discount::double as x1, b.l_tax::double as x2, c.l_linenumber::double as x3 from (select distinct l_discount from lineitem) a, (select distinct l_tax from lineitem) b, (select distinct l_linenumber from lineitem) c")
def design_grid(spark, d):
    """The full factorial design over the levels that three columns have."""
    return design.grid_design(spark, _line_levels(spark, d))


@query("with t as (select distinct l_discount, l_tax, l_linenumber from lineitem), c as (select count(*) as n, count(distinct l_discount) as a, count(distinct l_tax) as b, count(distinct l_linenumber) as c from t) select case when a*b*c = n then 'Grid' when a = n and b = n and c = n then 'LHS' else 'Random or other' end as method, n::bigint as n from c")
def sampling_pattern_exact(spark, d):
    """The pattern of the combinations of three columns that occur."""
    return design.exact_pattern(table(spark, d, "lineitem").select("l_discount", "l_tax", "l_linenumber").distinct(), ["l_discount", "l_tax", "l_linenumber"])


@query("with l as (select unnest(range(5))/4.0 as x), c as (select n_nationkey % 6 as i from nation) select count(*) filter (where not exists (select 1 from l where abs(l.x-i/4.0)<=1e-6))::bigint as n_off_grid from c")
def grid_membership(spark, d):
    points = table(spark, d, "nation").select(((F.col("n_nationkey") % 6) / 4.0).alias("x"))
    return design.off_grid(points, {"x": [k / 4 for k in range(5)]}).agg(F.count("*").alias("n_off_grid"))


@query("with m as (select min(c_acctbal) as al, max(c_acctbal) as ah, min(c_nationkey) as nl, max(c_nationkey) as nh from customer), s as (select (c_acctbal-al)/(ah-al) as x, (c_nationkey-nl)/(nh-nl)::double as y from customer, m) select round(pow(13/12.0::double,2)-2.0/count(*)*sum((1-x*x)*(1-y*y)-(0.5-abs(0.5-x))*(0.5-abs(0.5-y))),6) as discrepancy from s")
def discrepancy(spark, d):
    return rounded(design.discrepancy(design.minmax(table(spark, d, "customer").select("c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey")), ["c_acctbal", "c_nationkey"]), ["c_acctbal", "c_nationkey"]))


@query("with s as (select s_suppkey k, s_acctbal x, s_nationkey::double*100 y from supplier) select round(min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))),6) as distance from s a join s b on a.k<b.k")
def maximin(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 100.0).alias("y"))
    return rounded(design.closest_pair(s, "s_suppkey", ["x", "y"]))


_NN = "with n as (select q.vec_id, min(list_distance(q.embedding::double[], e.embedding::double[])) as d from embeddings q join embeddings e on q.vec_id<>e.vec_id where q.vec_id % 100 = 0 group by 1) "


@query(_NN + "select count(*)::bigint as n, round(avg(d),6) as mean, round(stddev_pop(d),6) as std, round(min(d),6) as least from n")
def nn_distance_stats(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(design.nearest_distances(e, e.where("vec_id % 100 = 0")).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.min("d").alias("least")))


_RULE = "case when std<0.05 and sil>0.6 then 'Grid' when std>0.2 and sil<0.3 then 'Random' when std between 0.05 and 0.15 then case when ent<2 then 'Sobol' else 'LHS' end else 'Uncertain' end"


@query(f"with t as (select abs(c_acctbal)/30000::double as std, c_nationkey/24.0::double as sil, (c_custkey % 40)/10.0::double as ent from customer) select {_RULE} as method, count(*)::bigint as n from t group by 1")
def sampling_rule_table(spark, d):
    """How often each method is found where the rule's three figures are read off the columns of customer."""
    t = table(spark, d, "customer").select((F.abs("c_acctbal") / 30000).alias("std"), (F.col("c_nationkey") / 24).alias("sil"), ((F.col("c_custkey") % 40) / 10).alias("ent"))
    return t.groupBy(design.sampling_rule(F.col("std"), F.col("sil"), F.col("ent")).alias("method")).agg(F.count("*").alias("n"))


@query("with g as (select l_quantity as v, sum((l_returnflag='A')::int) as a, sum((l_returnflag='R')::int) as b from lineitem where l_returnflag in ('A','R') group by 1), c as (select abs(sum(a) over (order by v)/sum(a) over ()::double-sum(b) over (order by v)/sum(b) over ()::double) as g from g) select round(max(g),6) as d from c")
def ks_two_sample(spark, d):
    li = table(spark, d, "lineitem")
    return rounded(design.ks_two_sample(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), "l_quantity"))


@query("select c_custkey, round((c_acctbal-avg(c_acctbal) over ())/stddev_pop(c_acctbal) over (),6) as c_acctbal from customer")
def standard_scale(spark, d):
    return rounded(design.standardise(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]))


@query("select c_custkey, round((c_acctbal-min(c_acctbal) over ())/(max(c_acctbal) over ()-min(c_acctbal) over ()),6) as c_acctbal from customer")
def minmax_scale(spark, d):
    return rounded(design.minmax(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]))


@query("with s as (select var_samp(l_quantity) as a, var_samp(l_discount*100) as b, covar_samp(l_quantity,l_discount*100) as c from lineitem), e as (select (a+b)/2+sqrt((a-b)*(a-b)/4+c*c) as l1, (a+b)/2-sqrt((a-b)*(a-b)/4+c*c) as l2 from s) select 1::bigint as k, round(l1,6) as eigenvalue, round(l1/(l1+l2),6) as ratio, round(l1/(l1+l2),6) as cumulative from e union all select 2, round(l2,6), round(l2/(l1+l2),6), 1.0 from e")
def pca_2col(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    return rounded(reduction.fit_components(li, ["x", "y"]).scree(spark).drop("selected"))


@query("with m as (select regr_slope(p_retailprice, p_partkey) as b, avg(p_partkey) as m from part) select 'p_partkey' as feature, round(avg(abs(b*(p_partkey-m))),6) as mean_abs_shap from part, m")
def shap_linear(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("double").alias("p_partkey"), "p_retailprice")
    return rounded(explain.linear_shap(p, {"p_partkey": p.agg(F.regr_slope("p_retailprice", "p_partkey")).first()[0]}))


@query("with f as (select regr_slope(p_retailprice, p_partkey) as b, regr_intercept(p_retailprice, p_partkey) as a, quantile_cont(p_partkey::double, 0.05) as lo, quantile_cont(p_partkey::double, 0.95) as hi from part) select 'p_partkey' as feature, k::bigint as k, round(lo+k*(hi-lo)/99,6) as value, round(a+b*(lo+k*(hi-lo)/99),6) as mean_prediction from f, range(100) g(k)")
def pdp_linear(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("double").alias("p_partkey"), "p_retailprice")
    w = p.agg(F.regr_slope("p_retailprice", "p_partkey"), F.regr_intercept("p_retailprice", "p_partkey")).first()
    return rounded(explain.linear_pdp(p, w[1], {"p_partkey": w[0]}, "p_partkey"))


_DAILY = "with s as (select event_type as series_id, date_trunc('day', ts) as t, sum(value) as value from events group by 1, 2), f as (select *, lag(value) over (partition by series_id order by t) as forecast from s), g as (select * from f where forecast is not null), h as (select *, abs(value-lag(value) over (partition by series_id order by t)) as dd from g) "


def daily_naive(spark, d, every: bool = False) -> DataFrame:
    s = table(spark, d, "events").groupBy(F.col("event_type").alias("series_id"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("t")).agg(F.sum("value").alias("value"))
    return s.withColumn("forecast", F.lag("value").over(Window.partitionBy("series_id").orderBy("t"))).where(F.lit(every) | F.col("forecast").isNotNull())


@query(_DAILY + "select series_id, round(avg(abs(value-forecast)),6) as mae, round(100*avg(2*abs(value-forecast)/(abs(value)+abs(forecast)+1e-8)),6) as smape, round(avg(abs(value-forecast))/(avg(dd)+1e-12),6) as mase from h group by 1")
def ts_metrics(spark, d):
    return rounded(forecast.series_metrics(daily_naive(spark, d)))


@query(_DAILY + "select series_id, round(quantile_cont(value-forecast, 0.1),6) as q10, round(quantile_cont(value-forecast, 0.5),6) as q50, round(quantile_cont(value-forecast, 0.9),6) as q90 from g group by 1")
def forecast_quantiles(spark, d):
    return rounded(forecast.residual_quantiles(daily_naive(spark, d)))


@query("select date_trunc('hour', ts)::timestamp as t, event_type as series_id, round(sum(value),6) as value from events group by all")
def event_windows(spark, d):
    w = windowed_series(table(spark, d, "events"))
    return w.select(F.col("t").cast("timestamp_ntz").alias("t"), "series_id", F.round("value", 6).alias("value"))


@query("select count(*)::bigint as n from documents where regexp_matches(lower(text), 'licensed under')")
def log_scan(spark, d):
    return matching_lines(table(spark, d, "documents"), "licensed under", "text").agg(F.count("*").alias("n"))


@query("select event_type as label, count(*)::bigint as n from events group by 1 union all select l_returnflag, count(*)::bigint from lineitem group by 1")
def label_union(spark, d):
    return frames.count_labels((table(spark, d, "events"), "event_type"), (table(spark, d, "lineitem"), "l_returnflag"))


@query("select distinct l_returnflag as label from lineitem intersect select distinct substr(o_orderstatus,1,1) from orders union select 'none'")
def metric_set_ops(spark, d):
    a, b = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("label")), table(spark, d, "orders").select(F.substring("o_orderstatus", 1, 1).alias("label"))
    return frames.common_labels(a, b).union(spark.createDataFrame([("none",)], "label string")).distinct()


def _part_xy(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.lit("price").alias("output"), F.col("p_size").cast("double").alias("a"), (F.col("p_partkey") % 1000).cast("double").alias("b"), F.col("p_retailprice").alias("y_true"))


def _fitted(make: Callable) -> Callable:
    def run(spark, d):
        train, test = frames.remainder_split(_part_xy(spark, d), "row_id")
        return rounded(metrics.uq_metrics(make().fit(train, ["a", "b"]).predict(test).withColumn("y_std", F.coalesce("y_std", F.lit(0.0)))))

    return run


for _name, _make in {"gp_metrics": lambda: estimators.gaussian_process(1e-2), "svr_metrics": lambda: estimators.support_vectors(10.0), "gbt_metrics": lambda: estimators.Boosting(20, 3), "rf_metrics": lambda: estimators.Forest(10, 8)}.items():
    _QUERIES[_name] = _fitted(_make)


_STUMP = """with t as (select p_size::double as x, p_retailprice::double as y from part), lv(level) as (values (0.05::double), (0.5::double), (0.95::double)),
o as (select y, row_number() over (order by y) as r, count(*) over () as n from t), b as (select level, min(y) as base from o, lv where r >= ceil(level*n) group by level),
g as (select level, x, count(*) as n, sum((y > base)::int) as up from t, b group by level, x),
c as (select level, x, sum(n) over w as nl, sum(up) over w as ul, sum(n) over (partition by level) as nt, sum(up) over (partition by level) as ut from g window w as (partition by level order by x)),
k as (select level, x, row_number() over (partition by level order by pow(ul-(1-level)*nl,2)/nl+pow((ut-ul)-(1-level)*(nt-nl),2)/(nt-nl) desc, x) as place from c where nl >= 2 and nt-nl >= 2),
r as (select level, y, base, y-base as r, t.x <= k.x as low from t, b join k using (level) where place = 1),
q as (select *, row_number() over (partition by level, low order by r) as i, count(*) over (partition by level, low) as n from r),
v as (select level, low, min(r) as leaf from q where i >= ceil(level*n) group by level, low)
select level, count(*)::bigint as n, round(avg(case when y >= base+leaf then level*(y-base-leaf) else (level-1)*(y-base-leaf) end),6) as pinball from r join v using (level, low) group by level"""


@query(_STUMP)
def quantile_stump(spark, d):
    """Quantile boosting of one round and one cut over all parts, whose pinball loss has a closed form."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.lit("price").alias("output"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").cast("double").alias("y_true"))
    made = QuantileBoosting(0.95, 1, 1, 1.0).fit(rows, ["size"]).predict_quantiles(rows)
    return rounded(metrics.pinball(made, {0.05: "lower", 0.5: "middle", 0.95: "upper"}))


@query()
def quantile_boosting_metrics(spark, d):
    """Ten rounds of depth three on all training parts; metrics of the test parts."""
    train, test = frames.remainder_split(_part_xy(spark, d), "row_id")
    return rounded(metrics.uq_metrics(QuantileBoosting(0.95, 10).fit(train, ["a", "b"]).predict(test)))


@query("with t as (select (p_size % 5)::bigint as g, p_retailprice::double as y from part), m as (select avg(y) as m from t) select g, count(*)::bigint as n, round(max(m)+count(*)*(avg(y)-max(m))/(count(*)+0.500000001),5) as y_pred, round(sqrt(0.500000001/(0.500000001+count(*))),6) as y_std from t, m group by g")
def gp_group_shrinkage(spark, d):
    """A process over five values that lie far apart: groups do not know of each other, so each mean is drawn to the whole's by the noise."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.lit("price").alias("output"), (F.col("p_size") % 5 * 1000.0).alias("x"), F.col("p_retailprice").cast("double").alias("y_true"))
    p = kernels.GaussianProcess(0.5, scale=1.0).fit(rows, ["x"]).predict(rows).join(rows.select("row_id", "x"), "row_id")
    return p.groupBy((F.col("x") / 1000).cast("long").alias("g")).agg(F.count("*").alias("n"), F.round(F.max("y_pred"), 5).alias("y_pred"), F.round(F.max("y_std"), 6).alias("y_std"))


@query("select (15*count(*))::bigint as edges, true as recall_at_least_nine_tenths from embeddings")
def umap_recall(spark, d):
    """The neighbour graph of all embeddings by descent, held against the exact one."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    graph = umap.neighbour_graph(e, 15)
    exact = neighbours.nearest(e, e, "i", ["x"], 15).select(F.col("row_id").alias("i"), F.col("other").alias("j"), F.sqrt("d").alias("d"))
    return graph.agg(F.count("*").alias("edges"), F.lit(umap.graph_recall(graph, exact) >= 0.9).alias("recall_at_least_nine_tenths"))


@query()
def umap_embedding(spark, d):
    """All suppliers in two dimensions."""
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double").alias("x"), (F.col("s_nationkey") * 100).cast("double").alias("y"))
    return umap.umap(s, ["x", "y"], "s_suppkey", epochs=10)


_XY = "with t as (select p_partkey as k, p_size::double as a, (p_partkey % 1000)::double as b, p_retailprice as y from part)"


@query(_XY + ", r as (select q.k as row_id, q.y as y_true, t.y, row_number() over (partition by q.k order by (t.a-q.a)*(t.a-q.a)+(t.b-q.b)*(t.b-q.b), t.k) as n from t, t q where q.k % 4 = 0 and t.k % 4 <> 0), p as (select row_id, y_true, avg(y) as y_pred, stddev_pop(y) as y_std from r where n <= 5 group by 1, 2) select 'price' as output, count(*)::bigint as n, round(sqrt(avg((y_true-y_pred)*(y_true-y_pred))),6) as rmse, round(avg(abs(y_true-y_pred)),6) as mae, round(avg(y_std),6) as mean_predicted_std from p")
def knn_metrics(spark, d):
    train, test = frames.remainder_split(_part_xy(spark, d), "row_id")
    m = metrics.uq_metrics(estimators.Neighbours(5).fit(train, ["a", "b"]).predict(test)).where("output is not null")
    return rounded(m.select("output", "n", "rmse", "mae", "mean_predicted_std"))


@query()
def auto_detect(spark, d):
    """Least squares, neighbours, a tree and boosting, by three folds over all rows."""
    search = estimators.AutoDetect([estimators.Linear, estimators.Neighbours, estimators.Tree, estimators.Boosting], [{}, {"n_neighbors": [3, 5]}, {"max_depth": [1, 5]}, {"n_estimators": [10], "max_depth": [3]}])
    return rounded(search.fit(_part_xy(spark, d), ["a", "b"]).scores_.select("output", "estimator", "settings", "score"))


_FOLDS = "with t as (select p_partkey as k, 'price' as output, p_size::double as a, p_retailprice as y from part union all select p_partkey, 'flat', p_size::double, (p_partkey % 7)::double from part), i as (select p_partkey as k, row_number() over (order by p_partkey)-1 as r, count(*) over () as n from part), f as (select t.*, case when r < (n%3)*(n//3+1) then r//(n//3+1) else n%3+(r-(n%3)*(n//3+1))//(n//3) end as fold from t join i using (k)), m as (select a.output, a.fold, regr_intercept(b.y,b.a) as i, regr_slope(b.y,b.a) as s, avg(b.y) as m from (select distinct output, fold from f) a join f b on a.output=b.output and a.fold<>b.fold group by all), e as (select output, fold, avg((y-i-s*a)*(y-i-s*a)) as lin, avg((y-m)*(y-m)) as mean from f join m using (output, fold) group by all), c as (select output, -avg(lin) as lin, -avg(mean) as mean from e group by 1), w as (select output, lin >= mean as linear from c), z as (select output, regr_intercept(y,a) as i, regr_slope(y,a) as s, avg(y) as m from t group by 1)"


@query(_FOLDS + " select output, case when linear then 'Linear' else 'Mean' end as estimator, round(sum(case when linear then i+s*a else m end),4) as total, count(*)::bigint as n from t join w using (output) join z using (output) group by 1, 2")
def auto_detect_closed(spark, d):
    """The search over closed forms, the winner of each output fitted on all rows, and what it predicts."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").cast("double").alias("price"), (F.col("p_partkey") % 7).cast("double").alias("flat"))
    rows = frames.to_long(part, ["row_id", "a"], ["price", "flat"])
    model = estimators.AutoDetect([estimators.Linear, estimators.Mean], [{}, {}]).fit(rows, ["a"])
    names = spark.createDataFrame([(o, type(m).__name__) for o, m in model.estimators_.items()], "output string, estimator string")
    return rounded(model.predict(rows).groupBy("output").agg(F.sum("y_pred").alias("total"), F.count("*").alias("n")).join(names, "output").select("output", "estimator", "total", "n"), 4)


_MANY = "with t as (select l_orderkey as k, l_quantity::double as a, l_discount::double as b, l_extendedprice::double as y from lineitem), s as (select var_pop(a) as va, var_pop(b) as vb, covar_pop(a,b) as ab, covar_pop(y,a) as ya, covar_pop(y,b) as yb, avg(a) as ma, avg(b) as mb, avg(y) as my from t where k % 4 <> 0), w as (select (ya*vb-yb*ab)/(va*vb-ab*ab) as wa, (yb*va-ya*ab)/(va*vb-ab*ab) as wb, ma, mb, my from s)"


@query(_MANY + " select 'price' as output, count(*)::bigint as n, round(sqrt(avg(pow(y-(my+wa*(a-ma)+wb*(b-mb)),2))),4) as rmse, round(avg(abs(y-(my+wa*(a-ma)+wb*(b-mb)))),4) as mae from t, w where k % 4 = 0")
def ols_two_features(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.lit("price").alias("output"), F.col("l_quantity").cast("double").alias("a"), F.col("l_discount").cast("double").alias("b"), F.col("l_extendedprice").cast("double").alias("y_true"))
    train, test = frames.remainder_split(rows, "row_id")
    r = F.col("y_true") - F.col("y_pred")
    return rounded(estimators.Linear().fit(train, ["a", "b"]).predict(test).groupBy("output").agg(F.count("*").alias("n"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(F.abs(r)).alias("mae")), 4)


@query(LINE + f", u as (select * from p union all select null, x, y_true, y_pred, y_std from p), c as (select output, k, k/99.0::double as e, avg((abs(y_true-y_pred)/y_std <= z)::int::double) as o from u, (values {_Z}) v(k, z) group by output, k), s as (select output, e, abs(e-o) as g, lead(e) over w as e2, lead(abs(e-o)) over w as g2 from c window w as (partition by output order by k)), a as (select output, sum((e2-e)*(g2+g)/2) as miscal_area from s group by output), m as (select output, sqrt(avg((y_true-y_pred)*(y_true-y_pred))) as rmse, avg(abs(y_true-y_pred)) as mae, {_NLL} as nll from u group by output) select m.output, round(rmse,6) as rmse, round(mae,6) as mae, round(nll,6) as nll, round(miscal_area,6) as miscal_area from m join a on m.output is not distinct from a.output")
def uq_flexible(spark, d):
    return rounded(metrics.flat_metrics(line_predictions(spark, d)))


@query(LINE + "select output, 'mae' as metric, round(avg(abs(y_true-y_pred)),6) as value from p group by 1 union all select output, 'rmse', round(sqrt(avg((y_true-y_pred)*(y_true-y_pred))),6) from p group by 1")
def metric_bars(spark, d):
    return rounded(frames.choose_metrics(metrics.uq_metrics(line_predictions(spark, d)).where("output is not null"), ["rmse", "mae", "no such metric"]))


@query(LINE + "select floor(min(y_pred-2*y_std))::bigint as low, ceil(max(y_pred+2*y_std))::bigint as high from p")
def plot_limits(spark, d):
    return metrics.plot_limits(line_predictions(spark, d), 2.0)


@query()
def scoring_rules(spark, d):
    return rounded(metrics.scoring_rules(line_predictions(spark, d)))


@query(PART + f", u as (select row_id, output, abs(y_true-y_pred)/y_std as z, draw, least(10, floor((('0x'||substr(md5(row_id::varchar||'#'||draw::varchar),1,8))::bigint/4294967296.0::double)*10)+1)::int as size from p, range(10) d(draw)), g as (select u.output, u.draw, s.size, u.z from u join range(1,11) s(size) on u.size <= s.size), e as (select output, draw, size, k, abs(k/99.0::double-avg((z <= zz)::int::double)) as e from g, (values {_Z}) v(k, zz) group by output, draw, size, k), m as (select output, draw, size, sum(e)/100 as e from e group by output, draw, size) select output, size/10.0::double as share, round(max(e),6) as ma_cal from m group by output, size")
def worst_group_calibration(spark, d):
    return rounded(metrics.adversarial_calibration(part_predictions(spark, d)))


@query("with h as (select p_partkey, (('0x'||substr(md5(p_partkey::varchar||':0'),1,8))::bigint/4294967296.0::double) < 0.25 as test from part) select test, count(*)::bigint as n, sum(p_partkey)::bigint as total from h group by 1")
def hash_split_counts(spark, d):
    train, test = frames.hash_split(table(spark, d, "part"), "p_partkey")
    both = train.select(F.lit(False).alias("test"), "p_partkey").unionByName(test.select(F.lit(True).alias("test"), "p_partkey"))
    return both.groupBy("test").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("total"))


_RANKS = "with q as (select " + ", ".join(f"rank() over (order by {c})+(count(*) over (partition by {c})-1)/2.0 as {c}" for c in _LC) + " from lineitem)"


@query(_RANKS + " ".join(["", " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a},{b}),6) as rho from q" for i, a in enumerate(_LC) for b in _LC[i + 1 :])]))
def spearman_all(spark, d):
    return rounded(design.spearman_matrix(table(spark, d, "lineitem"), _LC))


@query(_RANKS + " select round((" + "+".join(f"abs(corr({a},{b}))" for i, a in enumerate(_LC) for b in _LC[i + 1 :]) + ")/6,6) as mean_abs from q")
def mean_rank_correlation(spark, d):
    return rounded(design.mean_absolute(design.spearman_matrix(table(spark, d, "lineitem"), _LC)))


@query("with e as (select min(d) as lo, max(d) as hi from (" + _NN + "select d from n)), n as (select q.vec_id, min(list_distance(q.embedding::double[], e.embedding::double[])) as d from embeddings q join embeddings e on q.vec_id<>e.vec_id where q.vec_id % 100 = 0 group by 1), b as (select least(29, floor((d-lo)/((hi-lo)/30))::int) as bin, count(*) as c from n, e group by 1) select round(-sum(c/t*ln(c/t)),6) as entropy from b, (select sum(c)::double as t from b)")
def nn_entropy(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(design.distance_entropy(design.nearest_distances(e, e.where("vec_id % 100 = 0"))))


@query("with t as (select s_suppkey as k, s_acctbal::double as x, (s_nationkey*100)::double as y, (s_acctbal > 4000)::int as c from supplier), m as (select q.k, q.c as own, t.c, avg(sqrt((t.x-q.x)*(t.x-q.x)+(t.y-q.y)*(t.y-q.y))) as d from t q join t on t.k<>q.k group by all), s as (select k, max(case when c=own then d end) as a, min(case when c<>own then d end) as b from m group by 1) select count(*)::bigint as n, round(avg((b-a)/greatest(a,b)),6) as silhouette from s")
def silhouette_score(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double").alias("x"), (F.col("s_nationkey") * 100).cast("double").alias("y"), (F.col("s_acctbal") > 4000).cast("int").alias("c"))
    return rounded(design.silhouette(s, s, "s_suppkey", ["x", "y"], "c").agg(F.count("*").alias("n"), F.avg("s").alias("silhouette")))


@query()
def sampling_classifier(spark, d):
    return rounded(design.classify_sampling(table(spark, d, "customer"), ["c_acctbal", "c_nationkey"], "c_custkey"))


_FIGURES = "avg(l_discount)::double as discrepancy, avg(l_tax)*5::double as maximin, avg(l_tax)*2::double as random_discrepancy, avg(l_discount)*2::double as random_maximin, avg(l_discount*l_tax)*40::double as mean_abs"


@query(f"with f as (select {_FIGURES} from lineitem) select round(discrepancy,6) as discrepancy, round(maximin,6) as maximin, round(random_discrepancy,6) as random_discrepancy, round(random_maximin,6) as random_maximin, round(mean_abs,6) as mean_abs, discrepancy < 0.9*random_discrepancy and maximin > 1.1*random_maximin and mean_abs < 0.2 as lhs_like from f")
def lhs_rule_table(spark, d):
    """The rule's three comparisons on figures read off the columns of lineitem."""
    li = table(spark, d, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in ("l_discount", "l_tax")])
    compared = li.agg(F.avg("l_discount").alias("discrepancy"), (F.avg("l_tax") * 5).alias("maximin"), (F.avg("l_tax") * 2).alias("random_discrepancy"), (F.avg("l_discount") * 2).alias("random_maximin"))
    return rounded(design.is_lhs(compared, li.agg((F.avg(F.col("l_discount") * F.col("l_tax")) * 40).alias("mean_abs"))))


@query()
def lhs_decision(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return rounded(design.is_lhs(design.compare_with_random(s, ["x", "y"], "s_suppkey", 3), design.mean_absolute(design.spearman_matrix(s, ["x", "y"]))))


@query("select 'c_nationkey' as feature, max(n)::bigint as most from (select count(*) as n from customer group by c_nationkey) union all select 'c_custkey', max(n)::bigint from (select count(*) as n from customer group by c_custkey)")
def multiplicity(spark, d):
    return design.max_multiplicity(table(spark, d, "customer"), ["c_nationkey", "c_custkey"])


@query(" union all ".join(f"select '{c}' as feature, min({c})::double as low, round(quantile_cont({c}::double, 0.25),6) as q1, round(quantile_cont({c}::double, 0.5),6) as median, round(quantile_cont({c}::double, 0.75),6) as q3, max({c})::double as high from customer" for c in ("c_acctbal", "c_nationkey")))
def box_numbers(spark, d):
    return rounded(metrics.box_numbers(table(spark, d, "customer"), ["c_acctbal", "c_nationkey"]))


@query("with e as (select min(l_quantity) as la, max(l_quantity) as ha, min(l_discount) as lb, max(l_discount) as hb from lineitem), t as (select least(7, floor((l_quantity-la)/((ha-la)/8)))::bigint as x, least(7, floor((l_discount-lb)/((hb-lb)/8)))::bigint as y from lineitem, e) select 'l_quantity' as a, 'l_quantity' as b, x as bin_a, x as bin_b, count(*)::bigint as n from t group by all union all select 'l_quantity', 'l_discount', x, y, count(*)::bigint from t group by all union all select 'l_discount', 'l_discount', y, y, count(*)::bigint from t group by all")
def pair_histograms(spark, d):
    return rounded(design.pair_histogram(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], 8))


@query("with s as (select var_samp(l_quantity) as a, var_samp(l_discount*100) as b, covar_samp(l_quantity,l_discount*100) as c, avg(l_quantity) as mx, avg(l_discount*100) as my from lineitem), e as (select *, (a+b)/2+sqrt((a-b)*(a-b)/4+c*c) as l1 from s) select count(*)::bigint as n, round(var_samp(p1),4) as v1, round(var_samp(p2),4) as v2 from (select (c*(l_quantity-mx)+(l1-a)*(l_discount*100-my))/sqrt(c*c+(l1-a)*(l1-a)) as p1, ((l1-a)*(l_quantity-mx)-c*(l_discount*100-my))/sqrt(c*c+(l1-a)*(l1-a)) as p2 from lineitem, e)")
def pca_projection(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    p = reduction.fit_components(li, ["x", "y"]).transform(li, 2, [])
    return rounded(p.agg(F.count("*").alias("n"), F.var_samp("PC1").alias("v1"), F.var_samp("PC2").alias("v2")), 4)


@query("with n as (select greatest(2, floor(sqrt(count(*))))::bigint as k from nation), x as (select i//k as a, i%k as b, k from n, unnest(range(k*k)) r(i)) select count(*)::bigint as n, round(sum(a/(k-1)::double*(b/(k-1)::double)),6) as cross_sum, round(sum(pow(a/(k-1)::double,2)),6) as square_sum from x")
def grid_example(spark, d):
    """A square grid of as many points as nations, about."""
    g = examples.square_grid(spark, max(2, int(table(spark, d, "nation").count() ** 0.5)))
    return rounded(g.agg(F.count("*").alias("n"), F.sum("x0_x1").alias("cross_sum"), F.sum("x0_squared").alias("square_sum")))


@query("with s as (select min(s_acctbal)::double as lo, max(s_acctbal)::double as hi, avg(s_acctbal)::double as m, var_pop(s_acctbal)::double as v from supplier), v as (select 'u' as name, lo, hi from s union all select 'n', m-2*sqrt(v), m+2*sqrt(v) from s union all select 'g', lo+sqrt(v)*4-2*2*sqrt(v), lo+sqrt(v)*4+2*2*sqrt(v) from s) select name, round(lo+k*(hi-lo)/3,4) as level from v, range(4) r(k)")
def grid_descriptor_levels(spark, d):
    """Levels of a grid over descriptors whose parameters are those of supplier's balances."""
    r = table(spark, d, "supplier").agg(F.min("s_acctbal").cast("double").alias("lo"), F.max("s_acctbal").cast("double").alias("hi"), F.avg("s_acctbal").cast("double").alias("m"), F.var_pop("s_acctbal").cast("double").alias("v")).first()
    made = {"u": {"kind": "uniform", "stat1": r["lo"], "stat2": r["hi"]}, "n": {"kind": "normal", "stat1": r["m"], "stat2": r["v"]}, "g": {"kind": "gamma", "stat1": r["lo"], "stat2": r["v"] ** 0.5, "stat3": 4}}
    g = design.descriptor_grid(spark, [{"name": k, **v} for k, v in made.items()], 64)
    return rounded(g.unpivot([], list(made), "name", "level").distinct(), 4)


@query("with p as (select p_partkey::double as x, p_size::double as z, p_retailprice as y, (p_partkey % 2)::int as o from part), f as (select o, var_pop(x) as vx, var_pop(z) as vz, covar_pop(x,z) as xz, covar_pop(y,x) as yx, covar_pop(y,z) as yz, avg(x) as mx, avg(z) as mz, avg(y) as my from p group by o) select case o when 0 then 'even' else 'odd' end as output, 'p_size' as feature, k::bigint as k, round((k+1)::double,6) as value, round(my + (yz*vx-yx*xz)/(vx*vz-xz*xz)*((k+1)-mz),4) as mean_prediction from f, range(50) r(k)")
def pdp_general(spark, d):
    """Partial dependence of any estimator; here least squares on two features, whose mean prediction has a closed form."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.when(F.col("p_partkey") % 2 == 0, "even").otherwise("odd").alias("output"), F.col("p_partkey").cast("double").alias("x"), F.col("p_size").cast("double").alias("p_size"), F.col("p_retailprice").cast("double").alias("y_true"))
    model = estimators.Linear().fit(rows, ["x", "p_size"])
    return rounded(explain.partial_dependence(model.predict, rows, ["x", "p_size"], "p_size"), 4)


@query("with t as (select p_partkey as k, p_size::double as a, (p_partkey % 1000)::double as b from part), m as (select avg(a) as ma, avg(b) as mb from (select * from t order by md5(k::varchar), k limit 100)) select 'a' as feature, round(avg(abs(3*(a-ma))),6) as mean_abs_shap from t, m union all select 'b', round(avg(abs(-2*(b-mb))),6) from t, m")
def shap_exact(spark, d):
    """Coalitions of all rows against a background of 100; of a linear function the values have a closed form."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_size").cast("double").alias("a"), (F.col("p_partkey") % 1000).cast("double").alias("b"))
    background = explain.background_rows(rows, ["a", "b"])
    return rounded(explain.mean_absolute_shap(explain.shap_values(lambda x: 3 * x[:, 0] - 2 * x[:, 1], rows, ["a", "b"], background), ["a", "b"]))


_CUT = """with t as (select p_partkey as k, p_size::double as x, p_retailprice::double as y from part), g as (select x, count(*) as n, sum(y) as s from t group by x),
c as (select x, lead(x) over (order by x) as hi, sum(n) over (order by x) as nl, sum(s) over (order by x) as sl, sum(n) over () as nt, sum(s) over () as st from g),
m as (select (x+hi)/2 as cut, nl, nt, sl/nl as l, (st-sl)/(nt-nl) as r, st/nt as e from c where hi is not null order by round(sl*sl/nl+(st-sl)*(st-sl)/(nt-nl),4) desc, x limit 1)"""


@query(_CUT + " select 'price' as output, 'size' as feature, round(avg(abs(case when x <= cut then l else r end - e)),6) as mean_abs_shap from t, m")
def shap_tree_stump(spark, d):
    """Tree Shapley values of a forest of one tree of one cut over all parts: what the leaf is off the mean."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.lit("price").alias("output"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").cast("double").alias("y_true"))
    return rounded(tree_shap.mean_absolute_shap(estimators.Tree(1, 64).fit(rows, ["size"]), rows))


@query()
def shap_forest(spark, d):
    """Mean absolute tree Shapley values of a forest over all line items, by output."""
    li = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_id"), *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax")], F.col("l_extendedprice").cast("double").alias("price"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double").alias("net"))
    features = ["l_quantity", "l_discount", "l_tax"]
    rows = frames.to_long(li, ["row_id", *features], ["price", "net"])
    model = estimators.Forest(5, 4).fit(rows, features)
    return rounded(tree_shap.mean_absolute_shap(model, rows), 4)


@query(_DAILY + "select series_id, count(*)::bigint as n, round(quantile_cont(value, 0.5),6) as middle from s group by 1")
def series_medians(spark, d):
    s = daily_naive(spark, d, True)
    return rounded(s.groupBy("series_id").agg(F.count("*").alias("n"), F.percentile("value", 0.5).alias("middle")))


@query(_DAILY + "select series_id as id, (row_number() over (partition by series_id order by t)-count(*) over (partition by series_id))::bigint as step, round(value,6) as value from s")
def forecast_history(spark, d):
    s = daily_naive(spark, d, True).select("series_id", "t", "value")
    none = spark.createDataFrame([], "id string, step int, quantile double, value double")
    return rounded(forecast.fan(s, none).drop("quantile"))


@query(_DAILY + ", l as (select series_id, value, row_number() over (partition by series_id order by t desc) as r from s) select series_id, round(sum(value),4) as total, 400::bigint as length from l where r <= 400 group by 1")
def forecast_context(spark, d):
    c = forecast.left_padded(daily_naive(spark, d, True).select("series_id", "t", "value"), 400)
    return rounded(c.select("series_id", F.aggregate("context", F.lit(0.0), lambda s, v: s + v).alias("total"), F.size("context").alias("length")), 4)


@query()
def forecast_tidy(spark, d):
    s = daily_naive(spark, d).select("series_id", "t", "value")
    return forecast.Forecaster().fit(s).predict(7)


@query("select c_custkey, c_nationkey from customer order by c_custkey limit 5")
def preview_rows(spark, d):
    return frames.preview(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")


@query("select least(200, count(*))::bigint as n, least(200, count(*))::bigint as distinct_keys from customer")
def sampled_rows(spark, d):
    return frames.sample_rows(table(spark, d, "customer").select("c_custkey"), "c_custkey", 200).agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("distinct_keys"))


@query("select event_type as series_id, round(quantile_cont(value, 0.1),6) as q10, round(quantile_cont(value, 0.9),6) as q90 from events group by 1")
def exact_quantiles(spark, d):
    from tessera.operators.order import quantiles

    q = quantiles(table(spark, d, "events"), "value", [0.1, 0.9], ("event_type",))
    return rounded(q.select(F.col("event_type").alias("series_id"), F.col("q")[0].alias("q10"), F.col("q")[1].alias("q90")))


@query("with x as (select distinct p_size::double/10.0::double as x from part) select x, round(sin(x),9) as sine, round(cos(x),9) as cosine, round((exp(x)-exp(-x))/(exp(x)+exp(-x)),9) as tanh, round(ln(1+x),9) as log1p, round(log10(x),9) as log10, round(radians(x),9) as radians, round(cbrt(x),9) as cbrt from x")
def scalar_functions(spark, d):
    x = table(spark, d, "part").select((F.col("p_size").cast("double") / 10).alias("x")).distinct()
    made = {"sine": F.sin("x"), "cosine": F.cos("x"), "tanh": F.tanh("x"), "log1p": F.log1p("x"), "log10": F.log10("x"), "radians": F.radians("x"), "cbrt": F.cbrt("x")}
    return x.select("x", *[F.round(v, 9).alias(k) for k, v in made.items()])


@query("with s as (select var_samp(l_quantity) as a, var_samp(l_discount*100) as b, covar_samp(l_quantity,l_discount*100) as c from lineitem), e as (select (a+b)/2+sqrt((a-b)*(a-b)/4+c*c) as l1, a+b as t from s) select p::double as threshold, case when l1/t >= p then 1 else 2 end::bigint as k from e, (values (0.7), (0.9), (0.99)) v(p)")
def first_component_over_threshold(spark, d):
    """How many components of two columns of lineitem reach each share of the variance."""
    li = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    made = reduction.fit_components(li, ["x", "y"])
    return spark.createDataFrame([(p, made.choose("Explained variance threshold", threshold=p)) for p in (0.7, 0.9, 0.99)], "threshold double, k long")
