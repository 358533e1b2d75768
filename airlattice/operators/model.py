"""Models: training frames, regressors, random search, best-model selection,
registry and recursive / direct forecasting (M8-M14, S17, F3).

Models are Spark ML estimators fitted on DataFrames. Instead of one tiny fit per
(city, sensor, pollutant) as the reference does, one model per family is fitted over
every series at once (series statistics and the pollutant enter as features), so the
number of jobs does not grow with the number of sensors. Predictions of a pooled
model are not claimed to equal per-sensor fits.
"""

from __future__ import annotations

import math
import random
import uuid
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   LinearRegressionModel, RandomForestRegressor)
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlattice.constants import (FORECAST_STEPS, SEARCH_DRAWS, SEARCH_FOLDS, SEARCH_SEED)
from airlattice.functions import timefeat as T
from airlattice.operators import direct
from airlattice.operators import evaluate as E
from airlattice.operators import linear as L
from airlattice.operators import trees
from airlattice.operators.forecast import non_negative
from airlattice.operators.series import chrono_split
from airlattice.session import cut_lineage, delete_at_exit, ensure_checkpoint_dir

# model families by name; the two gradient-boosting families of the reference both map to
# Spark's GBT, tuned over grids of their own (``grid``). Unknown names raise KeyError.
FAMILIES = {
    "Linear": LinearRegression,
    "DecisionTree": DecisionTreeRegressor,
    "RandomForest": RandomForestRegressor,
    "LightGBM": GBTRegressor,
    "XGBoost": GBTRegressor,
    "ElasticNet": L.ElasticNet,
}
# Families whose loss is ``linear``'s: their draws are scored from fold sums.
FROM_SUMS = {"Linear", "ElasticNet"}
TREE_ROWS = 20_000      # rows of a task that grows trees
SEARCH_THREADS = 8      # draws that are fitted side by side


# Every grid has more points than a search draws (50), so no draw is lost.
GRIDS = {
    "Linear": {"regParam": [0.0, 1e-4, 1e-3, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0], "elasticNetParam": [0.0, 0.25, 0.5, 0.75, 1.0]},
    "DecisionTree": {"maxDepth": [2, 3, 4, 5, 6, 8, 10, 12], "minInstancesPerNode": [1, 2, 5, 10, 20, 50, 100]},
    "RandomForest": {"numTrees": [100, 300, 500], "maxDepth": [4, 6, 8, 10], "minInstancesPerNode": [1, 2, 5],
                     "featureSubsetStrategy": ["onethird", "sqrt"]},
    # shallow, slow learners with sampled rows, and deeper ones that prune by gain
    "LightGBM": {"maxIter": [100, 300, 500], "maxDepth": [3, 4, 5], "stepSize": [0.01, 0.05, 0.1], "subsamplingRate": [0.6, 0.8]},
    "XGBoost": {"maxIter": [100, 300, 500], "maxDepth": [6, 8, 10], "stepSize": [0.1, 0.2, 0.3], "minInfoGain": [0.0, 0.1]},
}

GRIDS["ElasticNet"] = GRIDS["Linear"]


def register_family(name: str, estimator, params: dict[str, list]) -> None:
    """add a family. ``estimator`` is a class of the pipeline contract: it takes featuresCol and labelCol, has ``setSeed``
    and a param per key of ``params``, and its model has a writer; then it is searched, saved and loaded as the others."""
    lacking = [p for p in params if not hasattr(estimator, p)]
    if lacking:
        raise ValueError(f"{estimator.__name__} lacks the params {lacking}")
    if name in FAMILIES:
        raise ValueError(f"there is a family {name!r} already")
    FAMILIES[name], GRIDS[name] = estimator, dict(params)


def make(name: str, features: str = "features", label: str = "label"):
    """M9: an estimator of the named family."""
    cls = FAMILIES[name]
    est = cls(featuresCol=features, labelCol=label)
    if cls is LinearRegression:
        # normal equations: one pass over the data builds the Gram matrix, then the
        # (elastic-net) solve runs on p x p numbers
        return est.setSolver("normal")
    return est.setSeed(SEARCH_SEED)


def grid(name: str, est) -> list:
    """M9: the parameter grid of a family."""
    g = ParamGridBuilder()
    for param, values in GRIDS[name].items():
        g = g.addGrid(est.getParam(param), values)
    return g.build()


def random_search(name: str, df: DataFrame, keys: list[str], ts: str, features: list[str], n: int = SEARCH_DRAWS,
                  folds: int = SEARCH_FOLDS, seed: int = SEARCH_SEED, parallelism: int = 4, every: bool = False):
    """``n`` seeded draws from the family grid, scored by R^2 over unshuffled folds (blocks of time of each
    series); returns the best fitted model on all of ``df``. Linear families read the rows once for all
    draws (``linear.search``), decision trees are grown once for all depths (``tree_scores``) unless ``every`` draw shall be
    fitted on every fold, others are cross-validated."""
    est = make(name)
    maps = grid(name, est)
    draws = random.Random(seed).sample(maps, min(n, len(maps)))
    data = trees.folds(df, keys, ts, folds)
    if name in FROM_SUMS:
        sums = L.fold_sums(data, [], "_fold", features, "label")
        points = [(d[est.regParam], d[est.elasticNetParam]) for d in draws]
        best_params = draws[L.search(sums, [], features, "label", points).where("is_best").first()["draw"]]
        return est.fit(df, best_params), best_params
    if isinstance(est, DecisionTreeRegressor) and not every:
        scores = tree_scores(est, draws, data, folds, parallelism)
        best_params = draws[max(range(len(scores)), key=lambda i: scores[i])]
        return est.fit(df, best_params), best_params
    cv = CrossValidator(estimator=est, estimatorParamMaps=draws, numFolds=folds, seed=seed,
                        evaluator=RegressionEvaluator(metricName="r2", labelCol="label"),
                        foldCol="_fold", parallelism=parallelism)
    data = data.select(est.getFeaturesCol(), est.getLabelCol(), "_fold").persist()
    try:
        fitted = cv.fit(in_tasks(data, data.count()))
    finally:
        data.unpersist()
    scores = fitted.avgMetrics
    best_params = draws[max(range(len(scores)), key=lambda i: scores[i])]
    return fitted.bestModel, best_params


def in_tasks(data: DataFrame, rows: int) -> DataFrame:
    """Tasks of about TREE_ROWS rows: a level of a tree is a job of its own."""
    return data.coalesce(max(1, -(-rows // TREE_ROWS)))


def tree_scores(est: DecisionTreeRegressor, draws: list[dict], data: DataFrame, folds: int, parallelism: int = 4) -> list[float]:
    """Mean R^2 over the folds (column ``_fold``) of every draw.

    A tree grows level by level and a node's split does not depend on the depth allowed, so a shallower tree is the top of a
    deeper one. One tree is grown per fold and setting of the other parameters, to the largest depth drawn for it; the
    values of the nodes on a row's way are its predictions at every depth."""
    depth, settings = est.maxDepth, {}
    for i, d in enumerate(draws):
        settings.setdefault(tuple(sorted((p.name, v) for p, v in d.items() if p != depth)), []).append(i)
    data = data.select(est.getFeaturesCol(), est.getLabelCol(), "_fold").persist()
    try:
        sizes = [r["count"] for r in data.groupBy("_fold").count().collect()]
        if len(sizes) < folds:
            raise ValueError(f"too few rows for {folds} folds")
        marked = in_tasks(data, sum(sizes))

        def score(job) -> list[tuple[int, float]]:
            fold, own = job
            model = est.fit(marked.where(F.col("_fold") != fold), max((draws[i] for i in own), key=lambda d: d[depth]))
            ways = data.sparkSession.createDataFrame(leaf_ways(data.sparkSession, model), "_leaf double, _way array<double>")
            # a tree's leaves: at most 2 to the power of its depth, whatever the rows
            rows = model.setLeafCol("_leaf").transform(marked.where(F.col("_fold") == fold)).join(F.broadcast(ways), "_leaf")
            label, at = F.col(est.getLabelCol()), sorted({draws[i][depth] for i in own})
            off = [F.sum(F.pow(label - F.get("_way", F.lit(d)), 2)).alias(f"d{d}") for d in at]
            r = rows.agg((F.var_pop(label) * F.count(label)).alias("spread"), *off).first()
            return [(i, 1 - r[f"d{draws[i][depth]}"] / r["spread"] if r["spread"] else -math.inf) for i in own]
        jobs = [(fold, own) for fold in range(folds) for own in settings.values()]
        with ThreadPool(parallelism) as pool:
            found = pool.map(inheritable_thread_target(score), jobs, chunksize=1)
    finally:
        data.unpersist()
    scores = [0.0] * len(draws)
    for part in found:
        for i, r2 in part:
            scores[i] += r2 / folds
    return scores


def leaf_ways(spark: SparkSession, model) -> list[tuple[float, list[float]]]:
    """Per leaf of a saved tree, from the left: the values of the nodes on its way, the leaf's own down to the model's full depth."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tree-{uuid.uuid4().hex}"
    model.write().save(path)
    delete_at_exit(spark, path)
    nodes = {r["id"]: r for r in spark.read.parquet(f"{path}/data").select("id", "prediction", "leftChild", "rightChild").collect()}
    deepest, ways, open_ = model.getMaxDepth(), [], [(0, [])]
    while open_:
        at, way = open_.pop()
        node = nodes[at]
        way = [*way, node["prediction"]]
        if node["leftChild"] < 0:
            ways.append((float(len(ways)), way + [way[-1]] * (deepest + 1 - len(way))))
        else:
            open_ += [(node["rightChild"], way), (node["leftChild"], way)]
    return ways


@dataclass
class TrainResult:
    errors: DataFrame
    models: dict
    best: str


def feature_frame(series: DataFrame, keys: list[str], ts: str, value: str, lags: int,
                  categories: dict[str, list[str]] | None = None) -> tuple[DataFrame, list[str]]:
    """M3/M8: lags 1..lags, cyclic hour / weekday, one-hot categories; label = value."""
    w = Window.partitionBy(*keys).orderBy(ts)
    df = series.withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in range(1, lags + 1)})
    hc, hs = T.cyclic(F.hour(ts), 24)
    dc, ds = T.cyclic(F.weekday(ts), 7)
    df = df.withColumns({"hour_cos": hc, "hour_sin": hs, "dow_cos": dc, "dow_sin": ds})
    cols = [f"lag_{k}" for k in range(1, lags + 1)] + ["hour_cos", "hour_sin", "dow_cos", "dow_sin"]
    for c, values in (categories or {}).items():
        for v in values:
            df = df.withColumn(f"{c}_{v}", (F.col(c) == v).cast("double"))
            cols.append(f"{c}_{v}")
    df = df.withColumn("label", F.col(value)).dropna(subset=cols + ["label"])
    return df, cols


def project(frame: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """The saved feature list of a model, in its order, beside the ``keep`` columns.
    A feature the frame does not have is an error, as the model cannot do without it."""
    lacking = [c for c in features if c not in frame.columns]
    if lacking:
        raise ValueError(f"the frame lacks the saved features {lacking}")
    return frame.select(*keep, *features)


def train_best(frame: DataFrame, feature_cols: list[str], keys: list[str], ts: str,
               families: list[str], draws: int = SEARCH_DRAWS, folds: int = SEARCH_FOLDS) -> TrainResult:
    """Split each series chronologically (a frame with ``is_train`` is split already), tune and fit every family on the
    training rows, every draw on every fold, score the holdout per series (A5), mark each series' smallest MAE
    (A6), and refit the family with the smallest pooled MAE on every row.

    Returns errors keyed by (*keys, model) with ``is_best`` per series."""
    asm = VectorAssembler(inputCols=feature_cols, outputCol="features")
    data = asm.transform(frame)
    data = (data if "is_train" in frame.columns else chrono_split(data, keys, ts)).persist()
    rows = in_tasks(data, data.count())
    train, test = rows.filter("is_train"), rows.filter("NOT is_train")
    models, preds = {}, []
    for i, name in enumerate(families):
        m, params = random_search(name, train, keys, ts, feature_cols, draws, folds, parallelism=SEARCH_THREADS, every=True)
        models[name] = (m, params)
        preds.append(m.transform(test).select(*keys, F.lit(name).alias("model"), F.lit(i).alias("family_order"),
                                              F.col("label").alias("actual"), F.col("prediction").alias("predicted")))
    pred = preds[0]
    for p in preds[1:]:
        pred = pred.unionByName(p)
    pred = pred.persist()
    errors = E.metrics(pred, keys + ["model", "family_order"])
    pooled = E.metrics(pred, ["model", "family_order"]).withColumn("_k", F.lit(1))
    best_name = E.best(pooled, ["_k"], order="family_order").first()["model"]
    per_series = E.best(errors, keys, order="family_order").withColumn("is_best", F.lit(True))
    errors = (errors.join(per_series, on=keys + ["model"], how="left")
                    .withColumn("is_best", F.coalesce("is_best", F.lit(False))).drop("family_order"))
    # the pooled winner is fitted once more, on every row, with its tuned parameters
    # (a parameter belongs to the estimator it was drawn for, so they are set anew by name)
    fresh = make(best_name)
    refit = fresh.fit(asm.transform(frame), {fresh.getParam(p.name): v for p, v in models[best_name][1].items()})
    models["_best"] = PipelineModel(stages=[asm, refit])
    models["_best_raw"] = refit
    errors = cut_lineage(errors)   # read while the predictions are still cached
    pred.unpersist()
    data.unpersist()
    return TrainResult(errors=errors, models=models, best=best_name)


def register(spark, model, features: list[str], path: str, meta: dict) -> DataFrame:
    """Save a fitted model (overwrite) under ``path`` and return its registry row
    (``meta`` keys such as city / sensor / pollutant / model, plus path, features and
    trained_at) for upserting into the registry table."""
    from datetime import datetime, timezone

    model.write().overwrite().save(path)
    row = {**{k: str(v) for k, v in meta.items()}, "path": path, "features": list(features),
           "trained_at": datetime.now(timezone.utc).replace(tzinfo=None)}
    schema = ", ".join(f"`{k}` string" for k in meta) + ", path string, features array<string>, trained_at timestamp"
    return spark.createDataFrame([tuple(row.values())], schema)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


@dataclass
class Coefficients:
    """A linear model by its numbers; features it does not name count as 0."""
    intercept: float
    weights: dict


def _linear_terms(model, feat_cols: list[str]):
    """(intercept, [(column, coefficient)]) of a linear model, else None."""
    if isinstance(model, Coefficients):
        return float(model.intercept), [(c, float(model.weights.get(c, 0.0))) for c in feat_cols]
    if isinstance(model, LinearRegressionModel):
        return float(model.intercept), list(zip(feat_cols, map(float, model.coefficients.toArray())))
    return None


def _linear_sql(linear, lags: int, cats: dict, step, hist: str = "hist") -> str:
    """SQL text of a linear model's prediction from ``hist`` (the last ``lags`` values)
    for the step ``step`` (a number or an SQL variable)."""
    b0, coef = linear
    c = dict(coef)
    t = f"(_t0 + make_interval(0, 0, 0, 0, {step}, 0, 0))"
    terms = [repr(b0)]
    terms += [f"{c[f'lag_{k}']!r} * try_element_at({hist}, -{k})" for k in range(1, lags + 1)]
    for name, part, m in (("hour", f"hour({t})", 24), ("dow", f"weekday({t})", 7)):
        ang = f"((2.0D * pi() * CAST({part} AS DOUBLE)) / {float(m)!r}D)"
        terms += [f"{c[f'{name}_cos']!r} * cos({ang})", f"{c[f'{name}_sin']!r} * sin({ang})"]
    for col, vals in cats.items():
        whens = " ".join(f"WHEN '{v}' THEN {c[f'{col}_{v}']!r}" for v in vals)
        terms.append(f"(CASE `{col}` {whens} ELSE 0.0D END)")
    return " + ".join(f"({x})" for x in terms)


def recursive_forecast(spark, history: DataFrame, model, keys: list[str], ts: str, value: str,
                       lags: int, categories: dict[str, list[str]] | None = None,
                       steps: int = FORECAST_STEPS, checkpoint_every: int = 5, as_of=None) -> DataFrame:
    """Every series forecast together, one step at a time.

    Each series is one state row: its last ``lags`` values (``hist``) and the
    predictions so far (``preds``, at most ``steps`` numbers). A step builds the
    feature row from ``hist``, predicts with ``model`` and shifts the prediction in.
    For a linear model the whole recursion is a fold (``aggregate``) over the steps
    inside one projection. Other models loop ``steps`` times whatever the number of
    series; every ``checkpoint_every`` steps the state is written to the shared
    checkpoint folder and read back, so the plan never grows beyond that many steps. The
    result is the final state exploded: a negative or invalid prediction becomes null
    for that step (later steps still use the raw value), and the first step is dropped
    as in the reference. A series with fewer than ``lags`` values keeps its rows, with
    null predictions. With ``as_of`` every series starts at that hour, also one whose
    last value is older, and later values are not used; otherwise at its own last row.
    """
    if as_of is not None:
        history = history.filter(F.col(ts) <= F.lit(as_of).cast(history.schema[ts].dataType))
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    tailrows = history.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= lags)
    state = (tailrows.groupBy(*keys)
                     .agg(F.max(ts).alias("_t0"),
                          F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))))
                          .alias("_h"))
                     .withColumn("hist", F.transform("_h", lambda s: s["v"])).drop("_h")
                     # a series shorter than the lags stays, with null steps
                     .withColumn("hist", F.expr(f"concat(array_repeat(CAST(NULL AS DOUBLE), {lags} - size(hist)), hist)"))
                     .withColumn("preds", F.array().cast("array<double>")))
    if as_of is not None:
        state = state.withColumn("_t0", F.date_trunc("hour", F.lit(as_of).cast("timestamp")))
    cats = categories or {}
    feat_cols = [f"lag_{k}" for k in range(1, lags + 1)] + ["hour_cos", "hour_sin", "dow_cos", "dow_sin"] + \
        [f"{c}_{v}" for c, vals in cats.items() for v in vals]
    asm = VectorAssembler(inputCols=feat_cols, outputCol="features", handleInvalid="keep")
    linear = _linear_terms(model, feat_cols)
    if linear is not None:
        # A linear model's recursion is one expression per series: a fold over the
        # steps whose accumulator carries (hist, preds). One projection, one pass, no
        # loop of jobs and no lineage growth.
        p = _linear_sql(linear, lags, cats, "s", "acc.hist")
        # the prediction is computed once per step: a one-element array carries it into the state
        fold = (f"aggregate(sequence(1, {steps}), named_struct('hist', hist, 'preds', CAST(array() AS array<double>)), "
                f"(acc, s) -> element_at(transform(array({p}), p -> named_struct("
                f"'hist', slice(concat(acc.hist, array(p)), 2, {lags}), 'preds', concat(acc.preds, array(p)))), 1)"
                f").preds AS preds")
        state = state.selectExpr(*keys, "_t0", fold)
    else:
        for step in range(1, steps + 1):
            t = F.col("_t0") + F.make_interval(hours=F.lit(step))
            hc, hs = T.cyclic(F.hour(t), 24)
            dc, ds = T.cyclic(F.weekday(t), 7)
            feats = state.withColumns({f"lag_{k}": F.element_at("hist", -k) for k in range(1, lags + 1)})
            feats = feats.withColumns({"hour_cos": hc, "hour_sin": hs, "dow_cos": dc, "dow_sin": ds})
            for c, vals in cats.items():
                for v in vals:
                    feats = feats.withColumn(f"{c}_{v}", (F.col(c) == v).cast("double"))
            step_value = "IF(forall(hist, x -> x IS NOT NULL), prediction, CAST(NULL AS DOUBLE))"
            state = model.transform(asm.transform(feats)).selectExpr(
                *keys, "_t0", f"slice(concat(hist, array({step_value})), 2, {lags}) AS hist",
                f"concat(preds, array({step_value})) AS preds")
            if step % checkpoint_every == 0:
                state = cut_lineage(state)
    out = state.select(*keys, "_t0", F.posexplode("preds").alias("_i", "_p"))
    return out.select(*keys, (F.col("_i") + 1).alias("step"),
                      (F.col("_t0") + F.make_interval(hours=F.col("_i") + 1)).alias(ts),
                      non_negative("_p").alias("value")).filter("step > 1")


def direct_forecast(series: DataFrame, keys: list[str], ts: str, value: str, lags: int,
                    steps: int = FORECAST_STEPS - 1) -> DataFrame:
    """One linear model per horizon h (label = value h rows ahead), fitted on every series at
    once and applied to each series' last row; see ``operators.direct``."""
    return direct.direct_forecast(series, keys, ts, value, lags, steps)
