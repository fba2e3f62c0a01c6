"""Model jobs on the department frames (ML1-ML17).

Deterministic parts (encoding, scaling, split, metrics on relational
predictions) have SQL oracles; model fits (forests, k-means, PCA, search)
depend on Spark ML's random initialisation and are checked by shape.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.functions import month_bucket, weekday_mon0
from kpiforge.ml import cluster, coreset, forest, halving, search
from kpiforge.ml.metrics import classification_report, regression_metrics
from kpiforge.ml.neighbours import nearest_rows
from kpiforge.ml.oversample import oversample
from kpiforge.ml.prepare import label_encode, zscore
from kpiforge.ml.silhouette import silhouettes
from kpiforge.ml.split import is_train
from kpiforge.ml.store import ModelStore
from kpiforge.operators.derive import delay_days, efficiency_rate, total_active_time
from kpiforge.session import ensure_checkpoint_dir
from kpiforge.sources import testbed
from kpiforge.sources.tables import Tables
from kpiforge.staging import staged

HR_NUMERIC = ["salary", "performance", "training_hours", "leave_days", "overtime_hours",
              "active_time"]
SEED = 42


def _hr(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = testbed.hr(spark, sf_dir)
    df = src.frame("employee_id", "department", "position", "salary", "performance",
                   "training_hours", "leave_days", "overtime_hours", "resigned", "hired")
    return df.withColumn("active_time",
                         total_active_time("training_hours", "overtime_hours", "leave_days"))


# ------------------------------------------------------------ deterministic (oracle-checked)
def label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML1: HR position and department codes in sorted label order."""
    df = testbed.hr(spark, sf_dir).frame("employee_id", "position", "department")
    return label_encode(df, ["position", "department"])


def part_name_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML1 on a column with as many labels as rows: codes of every part's name."""
    return label_encode(Tables(spark, sf_dir)("part").select("p_partkey", "p_name"), ["p_name"])


def hr_zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML3: population z-scores of the HR numeric columns (rounded to 6)."""
    z = zscore(_hr(spark, sf_dir), HR_NUMERIC)
    return z.select("employee_id", *[F.round(f"z_{c}", 6).alias(f"z_{c}") for c in HR_NUMERIC])


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML4: hash split of every order -> (split, n)."""
    o = Tables(spark, sf_dir)("orders")
    side = F.when(is_train("o_orderkey", SEED), "train").otherwise("test")
    return o.groupBy(side.alias("split")).agg(F.count(F.lit(1)).alias("n"))


def _it(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = testbed.it_support(spark, sf_dir).frame("ticket_id", "system", "issue", "reported_at",
                                                 "hours")
    return df.withColumns({"month": month_bucket("reported_at", "month_of_year"),
                           "weekday": weekday_mon0("reported_at")})


def it_baseline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML10 on relational predictions: train-split mean hours per system, scored on test."""
    df = _it(spark, sf_dir).withColumn("train", is_train("ticket_id", SEED))
    means = (df.where("train").groupBy("system").agg(F.avg("hours").alias("prediction")))
    test = df.where(~F.col("train")).join(means, "system", "left").na.fill(0.0, ["prediction"])
    m = regression_metrics(test, "hours", "prediction")
    return m.select(F.round("mse", 6).alias("mse"), F.round("r2", 6).alias("r2"), "n")


def supply_baseline_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML9 on relational predictions: delayed iff the category's train-split delay rate > 0.5."""
    src = testbed.supply_chain(spark, sf_dir)
    df = src.frame("order_key", "line_number", "category", "order_date", "delivery_date")
    df = df.withColumns({
        "label": (delay_days("delivery_date", "order_date") > 0).cast("int"),
        "train": is_train(F.concat_ws("-", "order_key", "line_number"), SEED)})
    rates = df.where("train").groupBy("category").agg(F.avg("label").alias("r"))
    test = (df.where(~F.col("train")).join(rates, "category", "left")
              .withColumn("prediction", F.coalesce((F.col("r") > 0.5).cast("int"), F.lit(0))))
    rep = classification_report(test, "label", "prediction")
    return rep.select("cls", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                      "support")


# ------------------------------------------------------------ model fits (shape-checked)
def _rows(df: DataFrame) -> DataFrame:
    """``df`` written once, as a fit and its scores read it often; a table that is fitted row by row is read
    as it is, so that its bootstrap, which follows from the partitions, stays the same."""
    kept = staged(df, "forest-rows")
    return kept if kept.count() > forest.WHOLE_ROWS else df


def it_resolution_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML6: resolution hours from system, issue, month, weekday (100 trees)."""
    _, m = forest.fit_evaluate_regression(staged(_it(spark, sf_dir), "forest-rows"), "ticket_id", "hours",
                                          ["month", "weekday"], ["system", "issue"], scale=True,
                                          max_depth=8)
    return m


def production_efficiency_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML6: efficiency from product, line, shift, month, weekday."""
    df = testbed.production(spark, sf_dir).frame("production_id", "product", "line", "shift",
                                                 "date", "units", "defects")
    df = df.withColumns({"efficiency": efficiency_rate("units", "defects"),
                         "month": month_bucket("date", "month_of_year"),
                         "weekday": weekday_mon0("date")})
    df = df.where(F.col("efficiency").isNotNull()).drop("date", "units", "defects")
    _, m = forest.fit_evaluate_regression(staged(df, "forest-rows"), "production_id",
                                          "efficiency", ["month", "weekday"],
                                          ["product", "line", "shift"], scale=True, max_depth=8)
    return m


def supply_delay_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML5: delayed flag from quantity and unit cost (delay itself left out, Q7)."""
    df = testbed.supply_chain(spark, sf_dir).frame("order_key", "line_number", "quantity",
                                                   "unit_cost", "order_date", "delivery_date")
    df = df.withColumns({"delayed": (delay_days("delivery_date", "order_date") > 0).cast("int"),
                         "rid": F.concat_ws("-", "order_key", "line_number")})
    df = staged(df.select("rid", "quantity", "unit_cost", "delayed"), "forest-rows")
    _, rep = forest.fit_evaluate_classification(df, "rid", "delayed", ["quantity", "unit_cost"],
                                                max_depth=8)
    return rep


COST_FEATURES = ["quantity", "unit_cost", "delay"]


def _supply_cost(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, PipelineModel]:
    """Lines with the cost model's features, and the model: fitted once for a table, then taken from the store."""
    df = testbed.supply_chain(spark, sf_dir).frame("order_key", "line_number", "quantity", "unit_cost", "total_cost",
                                                   "order_date", "delivery_date")
    df = df.select(F.concat_ws("-", "order_key", "line_number").alias("rid"), "quantity", "unit_cost",
                   delay_days("delivery_date", "order_date").alias("delay"), F.col("total_cost").cast("double").alias("total_cost"))
    df = staged(df, "forest-rows")
    train = df.where(is_train("rid", SEED))
    rf = {"num_trees": 100, "max_depth": 8, "seed": SEED}
    model, _ = ModelStore(spark).fit_once("supply_cost", train, {**rf, "whole_rows": forest.WHOLE_ROWS}, lambda: forest.fit(
        train, "rid", "total_cost", COST_FEATURES, [], forest.regressor("total_cost", **rf)))
    return df, model


def supply_cost_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML6: total cost from quantity, unit cost and delay."""
    df, model = _supply_cost(spark, sf_dir)
    return regression_metrics(forest.predicted(model, df.where(~is_train("rid", SEED))), "total_cost", "prediction")


def sales_revenue_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML6: revenue from units, month, year."""
    df = testbed.sales(spark, sf_dir).frame("order_key", "line_number", "units", "date",
                                            "revenue")
    df = df.withColumns({"month": F.month("date"), "year": F.year("date"),
                         "rid": F.concat_ws("-", "order_key", "line_number")})
    df = staged(df.select("rid", "units", "month", "year", "revenue"), "forest-rows")
    _, m = forest.fit_evaluate_regression(df, "rid", "revenue", ["units", "month", "year"],
                                          max_depth=8)
    return m


def hr_performance_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML6: performance from the other z-scored HR columns and codes."""
    feats = [c for c in HR_NUMERIC if c != "performance"]
    hr = _rows(_hr(spark, sf_dir))
    df = zscore(hr, feats, fit_on=hr.where(is_train("employee_id", SEED)))
    _, m = forest.fit_evaluate_regression(df, "employee_id", "performance",
                                          [f"z_{c}" for c in feats] + ["resigned"],
                                          ["department", "position"], max_depth=5)
    return m


def hr_attrition_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML5 + ML8: attrition classifier, 4 sampled grid points x 3-fold CV.

    Class imbalance is handled with inverse-frequency row weights (exact,
    one aggregation) instead of synthetic oversampling. On the test binding
    ``resigned`` is derived from the account balance that also feeds
    ``salary``, so salary is left out of the features (it would leak).
    """
    feats = [c for c in HR_NUMERIC if c != "salary"]
    hr = staged(_hr(spark, sf_dir), "hr-rows")
    side = is_train("employee_id", SEED)
    df = zscore(hr, feats, fit_on=hr.where(side)).withColumn("label", F.col("resigned").cast("double"))
    pos_rate = df.where(side).agg(F.avg("label")).scalar()
    df = df.withColumn("w", F.when(F.col("label") == 1, 0.5 / pos_rate)
                       .otherwise(0.5 / (F.lit(1.0) - pos_rate)))
    df = df.withColumn("fold", F.pmod(F.xxhash64("employee_id"), F.lit(3)).cast("int"))
    train, test = df.where(side), df.where(~side)
    rf = forest.classifier("label", seed=SEED, weight_col="w")
    pipe = forest.pipeline([f"z_{c}" for c in feats], ["department", "position"], rf)
    grid = {"numTrees": [100, 150], "maxDepth": [3, 5], "minInstancesPerNode": [1, 2]}
    cv = search.random_search(pipe, rf, grid, "label", n_iter=4, folds=3, seed=SEED, fold_col="fold")
    best = cv.fit(train).bestModel
    return classification_report(best.transform(test), "label", "prediction")


SEARCH_GRID = [{"num_trees": t, "max_depth": d, "min_instances": m} for t, d, m in ((100, 3, 1), (100, 5, 2), (150, 5, 1), (150, 3, 2))]


def hr_performance_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML6 + ML8: performance forest by successive halving (r2, three folds); every rung's scores, then rung 9: r2 on the test side."""
    feats = [c for c in HR_NUMERIC if c != "performance"]
    hr = _hr(spark, sf_dir)
    df = zscore(hr, feats, fit_on=hr.where(is_train("employee_id", SEED))).select(
        "employee_id", "performance", "department", "position", "resigned", *[f"z_{c}" for c in feats])
    model, table = halving.forest_search(df.where(is_train("employee_id", SEED)), "employee_id", "performance",
                                         [f"z_{c}" for c in feats] + ["resigned"], ["department", "position"], SEARCH_GRID, seed=SEED)
    test = regression_metrics(model.transform(df.where(~is_train("employee_id", SEED))), "performance", "prediction")
    return table.unionByName(test.select(F.lit(9).alias("rung"), F.lit(None).cast("int").alias("candidate"), F.lit("test side").alias("params"),
                                         F.lit(1.0).alias("share"), F.col("r2").alias("score"), F.lit(True).alias("kept")))


def search_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML8 checked: employees that every rung of the search scores in each fold."""
    rows = halving.dealt(_hr(spark, sf_dir).where(is_train("employee_id", SEED)), "employee_id", SEED)
    out = [halving.at_rung(rows, s).groupBy("fold").agg(F.lit(s).alias("share"), F.count("*").alias("n")) for s in halving.RUNGS]
    return reduce(DataFrame.unionByName, out)


MEAN_BY = ["resigned", "department", "position", "leave_days", "training_hours"]


def search_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML8 checked: the search chooses among predictions without random numbers (mean performance by one column)."""
    hr = _hr(spark, sf_dir).where(is_train("employee_id", SEED))
    rows = staged(halving.dealt(hr, "employee_id", SEED).select(F.col("performance").cast("double").alias("label"), "fold", "part", *MEAN_BY), "search-rows")

    def means(candidate, share, fitted, scored):
        by = candidate["by"]
        found = fitted.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("_by")).agg(F.avg("label").alias("_mean"))
        overall = fitted.agg(F.avg("label")).scalar()
        return scored.join(found, F.col(by) == F.col("_by"), "left").withColumn("prediction", F.coalesce("_mean", overall))

    _, table = halving.search(rows, [{"by": c} for c in MEAN_BY], means, "regression")
    return table.select("rung", "candidate", "params", "share", F.round("score", 6).alias("score"), "kept")


def transport_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML17: delivery time, fuel and maintenance models; metrics in original units (Q9)."""
    df = testbed.transport(spark, sf_dir).frame("employee_id", "deliveries", "condition",
                                                "entry_date", "delivery_time", "fuel",
                                                "maintenance")
    df = df.withColumns({"month": F.month("entry_date"), "year": F.year("entry_date"),
                         "day": F.dayofmonth("entry_date")})
    df = _rows(df.drop("entry_date"))
    base = ["deliveries", "condition", "month", "year", "day"]
    targets = {"delivery_time": base, "fuel_consumption": base,
               "maintenance_cost": ["deliveries", "condition", "fuel", "month", "year", "day"]}
    label_of = {"delivery_time": "delivery_time", "fuel_consumption": "fuel",
                "maintenance_cost": "maintenance"}
    out = None
    for target, feats in targets.items():
        _, m = forest.fit_evaluate_regression(df, "employee_id", label_of[target], feats,
                                              scale=True, max_depth=8)
        m = m.select(F.lit(target).alias("target"), F.round("mse", 2).alias("mse"),
                     F.round("r2", 2).alias("r2"), "n")
        out = m if out is None else out.unionByName(m)
    return out


SUPPLY_COLS = ["quantity", "unit_cost"]
LINE = ["order_key", "line_number", "quantity", "unit_cost"]


def supply_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML11 + ML14: k=3 on quantity and unit cost -> (cluster, n, centres, mean squared distance); rows without a feature are cluster -1."""
    df = testbed.supply_chain(spark, sf_dir).frame(*LINE)
    return coreset.sizes(df, SUPPLY_COLS, _supply_centres(df))


def _supply_centres(df: DataFrame) -> np.ndarray:
    """The three centres of the lines: fitted once for a table, then taken from the store."""
    found, _ = ModelStore(df.sparkSession).fit_once(
        "supply_clusters", df, {"ks": [3], "seeds": list(coreset.SEEDS), "size": coreset.CORE_ROWS},
        lambda: coreset.fit(df, SUPPLY_COLS, LINE, [3]), coreset.save_centres, coreset.load_centres)
    return found[3]


def _cost(sizes: DataFrame) -> float:
    return sizes.agg(F.sum(F.col("n") * F.col("mean_square"))).first()[0] or 0.0


def supply_cluster_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML11 checked: rows in all clusters and empty ones; whether the fit costs at most 2 % more than k-means
    steps over all lines, from a start of their own and from the fit's centres; and whether every centre is the
    mean of its rows (within 5 % of a column's deviation)."""
    df = testbed.supply_chain(spark, sf_dir).frame(*LINE)
    centres = _supply_centres(df)
    own = coreset.sizes(df, SUPPLY_COLS, centres).persist()
    steps = coreset.spread_start(df, SUPPLY_COLS, 3)
    for _ in range(3):
        steps = coreset.lloyd_step(df, SUPPLY_COLS, steps)
    onward = coreset.lloyd_step(df, SUPPLY_COLS, centres)
    least = min(_cost(coreset.sizes(df, SUPPLY_COLS, c)) for c in (steps, onward))
    spread = df.agg(*[F.stddev_pop(c) for c in SUPPLY_COLS]).first()
    moved = max((abs(a - b) / (s or 1.0) for old, new in zip(centres, onward) for a, b, s in zip(old, new, spread)), default=0.0)
    return own.agg(F.sum("n").cast("long").alias("clustered"), F.count_if(F.col("n") <= 0).alias("empty"),
                   F.lit(_cost(own) <= 1.02 * least).alias("cheap"), F.lit(moved <= 0.05).alias("centred"))


def supply_lloyd_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML11 checked: three k-means steps over all lines from a start without random numbers; sizes, centres and cost."""
    df = testbed.supply_chain(spark, sf_dir).frame(*SUPPLY_COLS)
    centres = coreset.spread_start(df, SUPPLY_COLS, 3)
    for _ in range(2):
        centres = coreset.lloyd_step(df, SUPPLY_COLS, centres)
    return coreset.sizes(df, SUPPLY_COLS, centres).where(F.col("cluster") != coreset.INVALID).select(
        "cluster", "n", *[F.round(c, 4).alias(c) for c in ("centre_quantity", "centre_unit_cost", "mean_square")])


def supply_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML14: quantity, unit cost and cluster of every line that has both."""
    df = testbed.supply_chain(spark, sf_dir).frame(*LINE)
    out = coreset.assign(df, SUPPLY_COLS, _supply_centres(df))
    return out.where(F.col("cluster") != coreset.INVALID).select(
        "order_key", "line_number", "quantity", F.round("unit_cost", 6).alias("unit_cost"), "cluster")


def supply_scatter_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML14 checked: rows, quantity sum, rows without a cluster, and whether the groups explain over half of the spread."""
    rows = supply_scatter(spark, sf_dir)
    ss = reduce(lambda a, b: a + b, [F.var_pop(c) * F.count(c) for c in SUPPLY_COLS])
    groups = rows.groupBy("cluster").agg(ss.alias("inner")).agg(F.sum("inner")).scalar()
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("quantity"), 2).alias("quantity"),
                    F.count_if(F.col("cluster").isNull() | ~F.col("cluster").between(0, 2)).alias("unclustered"),
                    (groups < 0.5 * ss).alias("separated"))


def supply_cost_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML15/ML16 checked: the stored cost model scores every line. Rows, rows without a prediction; whether predictions
    stay in the range of the costs it was fitted on, explain 90 % of the test side's variance, and have its mean within 1 %."""
    df, model = _supply_cost(spark, sf_dir)
    side, cost = is_train("rid", SEED), F.col("total_cost")
    rows = forest.score(model, df, ["rid", "total_cost"]).select("total_cost", "prediction", side.alias("train"))
    test, err = ~F.col("train"), cost - F.col("prediction")
    on = lambda cond, x: F.when(cond, x)
    return rows.agg(
        F.count("*").alias("n"), F.count_if(F.col("prediction").isNull()).alias("missing"),
        ((F.min("prediction") >= F.min(on(F.col("train"), cost)) - 0.01) & (F.max("prediction") <= F.max(on(F.col("train"), cost)) + 0.01)).alias("in_range"),
        (F.sum(on(test, err * err)) < 0.1 * F.var_pop(on(test, cost)) * F.count(on(test, cost))).alias("accurate"),
        (F.abs(F.avg(on(test, F.col("prediction"))) / F.avg(on(test, cost)) - 1) < 0.01).alias("unbiased"))


def model_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK8: what a fresh store fits and what it reuses: the lines' centres asked for again, in other partitions,
    with another k, with one line's quantity changed, and the first ones once more."""
    df = testbed.supply_chain(spark, sf_dir).frame(*LINE)
    first = df.agg(F.min(F.struct("order_key", "line_number")).alias("m")).first().m
    other = df.withColumn("quantity", F.when((F.col("order_key") == first.order_key) & (F.col("line_number") == first.line_number),
                                             F.col("quantity") + 1).otherwise(F.col("quantity")))
    store = ModelStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/models-{uuid.uuid4().hex}")
    rows = []
    for i, (step, data, k) in enumerate([("first", df, 3), ("again", df, 3), ("other partitions", df.repartition(7), 3),
                                         ("other k", df, 4), ("a line changed", other, 3), ("first again", df, 3)]):
        centres, reused = store.fit_once("lines", data, {"k": k}, lambda: coreset.fit(data, SUPPLY_COLS, LINE, [k]),
                                         coreset.save_centres, coreset.load_centres)
        rows.append((i, step, reused, len(centres[k]), store.log().count()))
    return spark.createDataFrame(rows, "step int, what string, reused boolean, centres int, fits long").withColumn(
        "lines", df.agg(F.count("*")).scalar())


def test_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each model is tested on: rows per side, the label's mean and variance on the test side."""
    sc = testbed.supply_chain(spark, sf_dir).frame("order_key", "line_number", "total_cost", "order_date", "delivery_date")
    sc = sc.withColumn("rid", F.concat_ws("-", "order_key", "line_number"))
    sa = testbed.sales(spark, sf_dir).frame("order_key", "line_number", "revenue").withColumn(
        "rid", F.concat_ws("-", "order_key", "line_number"))
    hr = _hr(spark, sf_dir)
    jobs = [("ml5_supply_delay", sc, "rid", (delay_days("delivery_date", "order_date") > 0).cast("double")),
            ("ml6_supply_cost", sc, "rid", F.col("total_cost")), ("ml6_sales_revenue", sa, "rid", F.col("revenue")),
            ("ml6_it_resolution", _it(spark, sf_dir), "ticket_id", F.col("hours")),
            ("ml6_hr_performance", hr, "employee_id", F.col("performance")),
            ("ml8_hr_attrition", hr, "employee_id", F.col("resigned")),
            ("ml19_hr_salary", hr, "employee_id", F.col("salary"))]
    out = None
    for name, df, rid, label in jobs:
        d = df.select(is_train(rid, SEED).alias("train"), label.cast("double").alias("y"))
        y = F.when(~F.col("train"), F.col("y"))
        row = d.agg(F.lit(name).alias("job"), F.count_if("train").alias("n_train"), F.count_if(~F.col("train")).alias("n_test"),
                    F.round(F.avg(y), 4).alias("test_mean"), F.round(F.var_pop(y) / F.avg(F.abs(y)), 4).alias("test_spread"))
        out = row if out is None else out.unionByName(row)
    return out


def oversampled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML7: training rows per label after oversampling, and how many are synthetic."""
    hr = _hr(spark, sf_dir).where(is_train("employee_id", SEED))
    out = oversample(hr, "employee_id", "resigned", [c for c in HR_NUMERIC if c != "salary"], seed=SEED)
    return out.groupBy("resigned").agg(F.count("*").alias("n"),
                                       F.count_if(F.col("employee_id").startswith("synthetic-")).alias("synthetic"))


HR_Z = [f"z_{c}" for c in HR_NUMERIC]


def _hr_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The HR rows' z-scores with their groups, written once: clusters, silhouettes and components read them again and again."""
    z = zscore(staged(_hr(spark, sf_dir), "hr-rows"), HR_NUMERIC)
    return staged(z.select("employee_id", "department", "resigned", *HR_Z), "hr-zscores")


def _hr_sweep(z: DataFrame) -> tuple[DataFrame, dict]:
    """(k, n, silhouette, error_bound) for k = 2..5, and each k's centres."""
    centres = coreset.fit(z, HR_Z, ["employee_id"], (2, 3, 4, 5))
    for k, points in centres.items():
        z = coreset.assign(z, HR_Z, points, f"k{k}")
    found = silhouettes(z, HR_Z, [f"k{k}" for k in centres], ["employee_id"])
    return found.select(F.substring("labelling", 2, 9).cast("int").alias("k"), "n", "silhouette", "error_bound"), centres


def minority_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML7 checked: the five nearest leavers of every leaver on the training side, which oversampling interpolates between."""
    hr = _hr(spark, sf_dir).where(is_train("employee_id", SEED) & (F.col("resigned") == 1))
    near = nearest_rows(hr, "employee_id", [c for c in HR_NUMERIC if c != "salary"])
    return near.select(F.col("id").alias("employee_id"), F.posexplode("near").alias("rank", "near")).select(
        "employee_id", (F.col("rank") + 1).alias("rank"), F.col("near.id").alias("neighbour_id"), F.round("near.d", 6).alias("distance"))


def hr_attrition_oversampled(spark: SparkSession, sf_dir: str, resample_before_split: bool = False) -> DataFrame:
    """ML5 + ML7: attrition forest on oversampled rows, codes and numbers alike, reported on the test side.

    Only the training side is oversampled, unless ``resample_before_split`` (Q18) asks for the
    reference's order, in which synthetic rows reach the test side.
    """
    feats = [c for c in HR_NUMERIC if c != "salary"]
    hr = label_encode(_hr(spark, sf_dir), ["department", "position"])
    hr = zscore(hr, feats, fit_on=hr.where(is_train("employee_id", SEED)))
    cols = [f"z_{c}" for c in feats] + ["department_code", "position_code"]
    rows = hr.select(F.col("employee_id").cast("string").alias("employee_id"), F.col("resigned").cast("int").alias("resigned"), *[F.col(c).cast("double").alias(c) for c in cols])
    if resample_before_split:
        rows = oversample(rows, "employee_id", "resigned", cols, seed=SEED)
        train, test = (rows.where(side) for side in (is_train("employee_id", SEED), ~is_train("employee_id", SEED)))
    else:
        train, test = rows.where(is_train("employee_id", SEED)), rows.where(~is_train("employee_id", SEED))
        train = oversample(train, "employee_id", "resigned", cols, seed=SEED)
    rf = forest.classifier("resigned", num_trees=100, max_depth=5, seed=SEED)
    model = forest.pipeline(cols, [], rf).fit(train)
    return classification_report(model.transform(test), "resigned", "prediction")


def hr_cluster_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML12: silhouette in Euclidean distance for k = 2..5 on the z-scored HR columns."""
    return _hr_sweep(_hr_z(spark, sf_dir))[0]


def hr_group_silhouettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML12 checked: how well departments and leavers are separated on the z-scored HR columns."""
    z = _hr_z(spark, sf_dir)
    return silhouettes(z, HR_Z, ["department", "resigned"], ["employee_id"]).select(
        "labelling", "groups", "n", F.round("silhouette", 6).alias("silhouette"), "error_bound")


def hr_cluster_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML11 + ML13: best-k groups with 2-D PCA coordinates (plot-ready)."""
    z = _hr_z(spark, sf_dir)
    sweep, centres = _hr_sweep(z)
    data = cluster.assemble(coreset.assign(z, HR_Z, centres[cluster.best_k(sweep)]), HR_Z)
    return cluster.pca_2d(data, ["employee_id", "cluster"])


def hr_tenure_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML18: k=4 groups on the z-scored HR columns plus days since hired (PRJ15)."""
    from kpiforge.functions import days_since
    from kpiforge.plans.hr import AS_OF
    cols = HR_NUMERIC + ["tenure_days"]
    z = zscore(_hr(spark, sf_dir).withColumn("tenure_days", days_since("hired", AS_OF)), cols)
    zs = [f"z_{c}" for c in cols]
    return coreset.sizes(z, zs, coreset.fit(z, zs, ["employee_id"], [4])[4])


def hr_salary_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML19: salary regression from the other HR columns (actual vs predicted metrics)."""
    feats = [c for c in HR_NUMERIC if c != "salary"]
    hr = _rows(_hr(spark, sf_dir))
    df = zscore(hr, feats, fit_on=hr.where(is_train("employee_id", SEED)))
    _, m = forest.fit_evaluate_regression(df, "employee_id", "salary",
                                          [f"z_{c}" for c in feats],
                                          ["department", "position"], max_depth=5)
    return m
