"""Commands: python -m tessera.cli COMMAND ... (detect_sampling, compare_sample_methods, grid_search, grid_search_auto_detect, ts-forecast, run_example, describe)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import design, estimators, explain, metrics
from tessera.operators.forecast import Forecaster, parse_quantiles
from tessera.operators.frames import hash_split, last_part, numeric_columns, split_names, to_long
from tessera.operators.reduction import fit_components
from tessera.report import report, sections
from tessera.sources.examples import linear_problem
from tessera.sources.tables import in_file_order, read_csv, read_descriptors, read_series, status_line, write_csv


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("tessera").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _numbered(table: DataFrame) -> DataFrame:
    """A table read from files with its rows' places in them, which no split changes."""
    return in_file_order(table, "row_id")


def detect_sampling(a: argparse.Namespace) -> int:
    table = read_csv(_spark(), a.file)
    columns = numeric_columns(table)
    if not columns:
        print("No numeric columns found in dataset")
        return 1
    found = design.classify_sampling(_numbered(table), columns, "row_id").first()
    text = design.EXPLANATIONS[found["method"]]
    said = _spark().range(1).select(last_part(F.lit(text))).first()[0]
    print(f"Detected sampling: {said if '->' in text else 'Uncertain'}")
    print(f"Justification: {text}")
    return 0


def compare_sample_methods(a: argparse.Namespace) -> int:
    spark, descriptors = _spark(), read_descriptors(a.yaml)
    table = read_csv(spark, a.csv)
    missing = [d["name"] for d in descriptors if d["name"] not in table.columns]
    if missing:
        print(f"columns not found: {', '.join(missing)}")
        return 1
    found = design.compare_methods(spark, table, descriptors, a.samples).collect()  # one row a method
    print(f"KS D-statistics: { {r['method']: round(r['d'], 6) for r in found} }")
    print(f"The data most closely match the '{found[0]['method']}' sampling technique.")
    return 0


def _prepared(a: argparse.Namespace):
    spark = _spark()
    table = read_csv(spark, a.data)
    inputs, outputs = split_names(a.inputs), split_names(a.outputs)
    missing = [c for c in (*inputs, *outputs) if c not in table.columns]
    if missing:
        raise SystemExit(f"columns not found: {', '.join(missing)}")
    table = _numbered(table).select("row_id", *inputs, *outputs).na.drop("any")
    train, test = hash_split(table, "row_id")
    components = selected = None
    features = inputs
    if a.use_pca:
        components = fit_components(train, inputs)
        selected = components.choose(a.pca_method, a.n_components, a.pca_threshold)
        train, test = (components.transform(t, selected, ["row_id", *outputs]) for t in (train, test))
        features = [f"PC{k + 1}" for k in range(selected)]
    longs = [to_long(t, ["row_id", *features], outputs) for t in (train, test)]
    return spark, features, train, *longs, components, selected


def _finish(a, spark, features, wide, train, test, model, scores, components, selected) -> int:
    predictions = model.predict(test, return_std=True) if isinstance(model, estimators.AutoDetect) else model.predict(test)
    predictions = predictions.withColumn("y_std", F.coalesce("y_std", F.lit(0.0))).cache()
    dependence = lambda: explain.partial_dependence(model.predict, test, features, features[0], 20)
    made = sections(spark, predictions, wide, features, scores, components, selected, dependence)
    report(a.out_html, "Model report", a.description, made)
    overall = metrics.flat_metrics(predictions).where("output is null").first()
    print(status_line(report=a.out_html, rmse=round(overall["rmse"], 6), mae=round(overall["mae"], 6)))
    predictions.unpersist()
    return 0


def grid_search_auto_detect(a: argparse.Namespace) -> int:
    spark, features, wide, train, test, components, selected = _prepared(a)
    model = estimators.AutoDetect.with_defaults(cv=a.cv) if not a.quick else estimators.AutoDetect([estimators.Linear, estimators.Neighbours], [{}, {"n_neighbors": [3, 5]}], cv=a.cv)
    model.fit(train, features)
    return _finish(a, spark, features, wide, train, test, model, model.scores_, components, selected)


#: Estimators of the plain search, each with its settings.
PLAIN = {"gpr": (estimators.gaussian_process, {"alpha": [1e-4], "matern": [False, True]}), "rf": (estimators.Forest, {"n_estimators": [50], "max_depth": [3, None]}), "gb": (estimators.quantile_boosting, {"alpha": [0.95], "n_estimators": [50]}), "knn": (estimators.Neighbours, {"n_neighbors": [3]}), "blr": (lambda **s: estimators.Bagging(estimators.Linear, **s), {"n_estimators": [20]})}


def plain_search(train: DataFrame, test: DataFrame, features: list[str], kinds: list[str]) -> tuple[estimators.PerOutput, DataFrame]:
    """Every setting of every kind, judged by the mean squared error of each output on the test rows; the best of each output."""
    rows, fitted = [], {}
    for kind in kinds:
        make, space = PLAIN[kind]
        for s in estimators.settings_grid(space):
            model = make(**s).fit(train, features)
            for r in model.predict(test).groupBy("output").agg(F.avg(F.pow(F.col("y_true") - F.col("y_pred"), 2)).alias("mse")).collect():  # the outputs
                rows.append((r["output"], kind, str(s), -r["mse"]))
                if r["output"] not in fitted or r["mse"] < fitted[r["output"]][0]:
                    fitted[r["output"]] = (r["mse"], model)
    best = estimators.PerOutput({o: (lambda: None) for o in fitted}, missing=0.0)
    best.estimators_ = {o: m for o, (_, m) in fitted.items()}
    return best, train.sparkSession.createDataFrame(rows, "output string, estimator string, settings string, score double")


def grid_search(a: argparse.Namespace) -> int:
    spark, features, wide, train, test, components, selected = _prepared(a)
    kinds = split_names(a.surrogates)
    unknown = [k for k in kinds if k not in PLAIN]
    if unknown or not kinds:
        print(f"unknown surrogate {unknown[0] if unknown else ''!r}; known: {', '.join(PLAIN)}")
        return 1
    model, scores = plain_search(train, test, features, kinds)
    return _finish(a, spark, features, wide, train, test, model, scores, components, selected)


def ts_forecast(a: argparse.Namespace) -> int:
    try:
        levels = parse_quantiles(a.quantiles)
    except ValueError as e:
        print(e)
        return 2
    if a.horizon < 1:
        print("horizon must be at least 1")
        return 2
    try:
        series = read_series(_spark(), a.csv, a.time_col, a.value_cols)
    except ValueError as e:
        print(e)
        return 1
    forecast = Forecaster(quantiles=levels).fit(series).predict(a.horizon)
    write_csv(forecast.orderBy("id", "quantile", "step"), a.out, single=True)
    print(status_line(out=a.out, horizon=a.horizon, quantiles=list(levels)))
    return 0


def run_example(a: argparse.Namespace) -> int:
    spark = _spark()
    table, _ = linear_problem(spark, a.rows, noise=1.0)
    train, test = hash_split(to_long(table, ["row_id", *[f"x{j}" for j in range(5)]], ["y0", "y1", "y2"]), "row_id")
    model = estimators.BayesianRidge().fit(train, [f"x{j}" for j in range(5)])
    for r in estimators.flexible_metrics(model, test).orderBy(F.col("output").asc_nulls_last()).collect():
        print(status_line(output=r["output"], rmse=round(r["rmse"], 4), mae=round(r["mae"], 4), nll=round(r["nll"], 4), miscal_area=round(r["miscal_area"], 4)))
    return 0


def describe(a: argparse.Namespace) -> int:
    table = read_csv(_spark(), a.file)
    columns = numeric_columns(table)
    for name, made in (("box", lambda: metrics.box_numbers(table, columns)), ("missing", lambda: design.missing_counts(table)), ("bias", lambda: design.bias_metrics(table, columns))):
        print(name)
        for r in made().collect():  # a row a column
            print(status_line(**r.asDict()))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, run, *arguments):
        c = sub.add_parser(name)
        for names, options in arguments:
            c.add_argument(*names, **options)
        c.set_defaults(run=run)

    arg = lambda *names, **options: (names, options)
    add("detect_sampling", detect_sampling, arg("file"))
    add("compare_sample_methods", compare_sample_methods, arg("--csv", required=True), arg("--yaml", required=True), arg("--samples", type=int))
    searched = [arg("data"), arg("inputs"), arg("outputs"), arg("--use-pca", action="store_true"), arg("--pca-method"), arg("--n-components", type=int), arg("--pca-threshold", type=float), arg("--description", default="")]
    add("grid_search", grid_search, *searched, arg("--surrogates", default="gpr,rf,gb,knn,blr"), arg("--out-html", default="model_report.html"))
    add("grid_search_auto_detect", grid_search_auto_detect, *searched, arg("--cv", type=int, default=3), arg("--quick", action="store_true", help="least squares and neighbours only"), arg("--out-html", default="model_report_auto.html"))
    add("ts-forecast", ts_forecast, arg("csv"), arg("--time-col"), arg("--value-cols"), arg("--horizon", type=int, required=True), arg("--quantiles", default="0.1,0.5,0.9"), arg("--out", default="forecast.csv"))
    add("run_example", run_example, arg("--rows", type=int, default=200))
    add("describe", describe, arg("file"))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
