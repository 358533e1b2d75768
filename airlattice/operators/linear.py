"""Elastic-net models of every series from the sums of its folds.

The rows are read once: ``fold_sums`` reduces each (series, fold) to its cross-products. What a draw trains on is the sum
of the other folds, and its error on the held fold follows from that fold's sums, so 50 draws on 5 folds never read a row
again. A series is one row of k small matrices by then, solved in the task that holds it; the keys pass by as Arrow columns.

The loss is the one Spark ML's ``LinearRegression`` documents, so a draw means the same there:
    |y - b0 - Xb|^2 / (2 n sy) + reg (alpha |s b|_1 + (1 - alpha) |s b|^2 / (2 sy)),
with s and sy the population deviations of the training rows. Ridge draws are solved directly, others by
coordinate descent, all draws and folds of a series side by side.

Defined cases: rows with a null feature or label are left out; a constant feature has coefficient 0; a training part with a
constant label or without rows predicts its mean (0 without rows); a held fold without spread has no R^2 and does not count;
a series where no fold counts has null scores and its first draw is best; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasElasticNetParam, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasRegParam
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlattice.operators.series import gram_sums
from airlattice.session import ship_package

SWEEPS = 5000         # rounds of coordinate descent at most
TOLERANCE = 1e-10     # largest change of a standardised coefficient in the last round

FOUND = "array<struct<draw: int, r2: double, is_best: boolean, intercept: double, coefficients: array<double>>>"


def fold_sums(rows: DataFrame, keys: list[str], fold: str, x: list[str], y: str, scale: int | None = None,
              digits: int | None = None) -> DataFrame:
    """``series.gram_sums`` of every (series, fold): one grouped aggregation with partial sums in the tasks."""
    return gram_sums(rows, [*keys, fold], x, y, scale, digits)


def _entries(x: list[str], y: str) -> list[str]:
    """The sum columns of the matrix over (1, x..., y), row by row."""
    names = ["", *x, y]

    def entry(i: int, j: int) -> str:
        a, b = names[min(i, j)], names[max(i, j)]
        return "n" if not b else f"s_{b}" if not a else f"s_{a}_{b}"
    return [entry(i, j) for i in range(len(names)) for j in range(len(names))]


def solve(gram: np.ndarray, reg: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Coefficients, the constant first: ``gram`` holds a matrix over (1, x..., y) per problem."""
    n = np.maximum(gram[:, 0, 0], 1.0)
    mean = gram[:, 0, :] / n[:, None]
    cov = gram / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    spread = np.einsum("dii->di", cov)
    flat = spread <= 1e-12 * np.maximum(np.einsum("dii->di", gram) / n[:, None], 1e-300)
    dev = np.where(flat, 1.0, np.sqrt(np.maximum(spread, 0.0)))
    unit = cov / dev[:, :, None] / dev[:, None, :]
    unit[flat[:, :, None] | flat[:, None, :]] = 0.0
    a, b, sy = unit[:, :-1, :-1][:, 1:, 1:], unit[:, 1:-1, -1], dev[:, -1]
    l1, l2 = reg * alpha / sy, reg * (1.0 - alpha) / sy
    beta = np.zeros_like(b)
    for d in np.flatnonzero(l1 == 0):
        beta[d] = np.linalg.pinv(a[d] + l2[d] * np.eye(b.shape[1]), rcond=1e-12, hermitian=True) @ b[d]
    open_ = np.flatnonzero(l1 > 0)
    for _ in range(SWEEPS):
        if not len(open_):
            break
        g, t, z = a[open_], b[open_], beta[open_]
        before = z.copy()
        for j in range(z.shape[1]):
            own = g[:, j, j]
            r = t[:, j] - (g[:, j] * z).sum(1) + own * z[:, j]
            z[:, j] = np.sign(r) * np.maximum(np.abs(r) - l1[open_], 0.0) / np.where(own > 0, own + l2[open_], 1.0)
        beta[open_] = z
        open_ = open_[np.abs(z - before).max(1) > TOLERANCE]
    beta = np.where(flat[:, 1:-1] | flat[:, -1:], 0.0, beta * sy[:, None] / dev[:, 1:-1])
    return np.column_stack([mean[:, -1] - (beta * mean[:, 1:-1]).sum(1), beta])


def held_r2(gram: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """R^2 of coefficients on held rows from their sums; NaN where the label has no spread."""
    w = np.column_stack([-beta, np.ones(len(beta))])
    off = np.einsum("di,dij,dj->d", w, gram, w)
    n = np.maximum(gram[:, 0, 0], 1.0)
    total = gram[:, -1, -1] - gram[:, 0, -1] ** 2 / n
    ok = total > 1e-12 * np.maximum(np.abs(gram[:, -1, -1]), 1e-300)
    return np.where(ok, 1.0 - off / np.where(ok, total, 1.0), np.nan)


def score(grams: np.ndarray, draws: list[tuple[float, float]]) -> tuple[np.ndarray, int, np.ndarray]:
    """Of one series' fold matrices: the mean R^2 of every draw, the best draw, its coefficients on all folds."""
    k, d = len(grams), len(draws)
    reg, alpha = np.array(draws, float).reshape(-1, 2).T
    total = grams.sum(0)
    beta = solve(np.repeat(total - grams, d, 0), np.tile(reg, k), np.tile(alpha, k))
    r2 = held_r2(np.repeat(grams, d, 0), beta).reshape(k, d)
    counted = ~np.isnan(r2).any(1)
    mean = r2[counted].mean(0) if counted.any() else np.full(d, np.nan)
    best = int(np.argmax(mean)) if counted.any() else 0
    return mean, best, solve(total[None], reg[best:best + 1], alpha[best:best + 1])[0]


def search(sums: DataFrame, keys: list[str], x: list[str], y: str, draws: list[tuple[float, float]]) -> DataFrame:
    """Every (reg, alpha) draw of every series from ``fold_sums``: keys, draw, r2, is_best, and for the best draw the
    intercept and coefficients (in the order of ``x``) of the model refitted on all folds."""
    ship_package(sums.sparkSession)
    m = len(x) + 2
    held = sums.groupBy(*keys).agg(F.collect_list(F.array(*[F.col(c) for c in _entries(x, y)])).alias("_grams"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for grams in batch.column("_grams"):
                mean, best, beta = score(np.array(grams.as_py(), float).reshape(-1, m, m), draws)
                found.append([{"draw": i, "r2": None if np.isnan(v) else float(v), "is_best": i == best,
                               "intercept": float(beta[0]) if i == best else None,
                               "coefficients": beta[1:].tolist() if i == best else None} for i, v in enumerate(mean)])
            kind = pa.list_(pa.struct([("draw", pa.int32()), ("r2", pa.float64()), ("is_best", pa.bool_()),
                                       ("intercept", pa.float64()), ("coefficients", pa.list_(pa.float64()))]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], pa.array(found, kind)], [*keys, "_found"])
    schema = ", ".join([f"`{c}` {held.schema[c].dataType.simpleString()}" for c in keys] + [f"_found {FOUND}"])
    return held.mapInArrow(work, schema).select(*keys, F.inline("_found"))


def predict(rows: DataFrame, models: DataFrame, keys: list[str], x: list[str]) -> DataFrame:
    """Each row with its series' best model: the row's columns and ``prediction``, null without a model or a feature."""
    best = models.where("is_best").select(*[F.col(k).alias(f"_k_{k}") for k in keys], "intercept", "coefficients")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    terms = [F.col(c) * F.get("coefficients", F.lit(i)) for i, c in enumerate(x)]
    return rows.join(best, same, "left").withColumn("prediction", sum(terms, F.col("intercept"))).drop(
        *[f"_k_{k}" for k in keys], "intercept", "coefficients")


class _NetParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasRegParam, HasElasticNetParam):
    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(regParam=0.0, elasticNetParam=0.0)


class ElasticNet(Estimator, _NetParams, DefaultParamsReadable, DefaultParamsWritable):
    """a family outside Spark ML that meets its contract: fitted on a features vector from one pass of sums, saved and
    loaded by its params, usable in pipelines, searches and the registry."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", regParam=0.0, elasticNetParam=0.0):
        super().__init__()
        self._set(**self._input_kwargs)

    def setSeed(self, value: int) -> ElasticNet:
        """Families are made with a seed; this one draws nothing."""
        return self

    def _fit(self, df: DataFrame) -> ElasticNetModel:
        rows = df.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))
        first = rows.select(F.size("x").alias("p")).first()
        p = first["p"] if first else 0
        names = [f"x{i}" for i in range(p)]
        total = gram_sums(rows.select("y", *[F.col("x")[i].alias(c) for i, c in enumerate(names)]), [], names, "y").first()
        gram = np.array([total[c] or 0.0 for c in _entries(names, "y")]).reshape(1, p + 2, p + 2)
        beta = solve(gram, np.array([self.getRegParam()]), np.array([self.getElasticNetParam()]))[0]
        made = ElasticNetModel(intercept=float(beta[0]), coefficients=beta[1:].tolist())
        return self._copyValues(made)


class ElasticNetModel(Model, _NetParams, DefaultParamsReadable, DefaultParamsWritable):
    """The numbers are params, so the default writer saves them; the prediction is a JVM expression."""

    intercept = Param(Params._dummy(), "intercept", "constant term", TypeConverters.toFloat)
    coefficients = Param(Params._dummy(), "coefficients", "one per feature", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, intercept=0.0, coefficients=()):
        super().__init__()
        self._set(intercept=float(intercept), coefficients=list(coefficients))

    def _transform(self, df: DataFrame) -> DataFrame:
        weights = F.array(*[F.lit(float(v)) for v in self.getOrDefault(self.coefficients)]).cast("array<double>")
        parts = F.zip_with(vector_to_array(self.getFeaturesCol()), weights, lambda a, b: a * b)
        return df.withColumn(self.getPredictionCol(), F.aggregate(parts, F.lit(float(self.getOrDefault(self.intercept))), lambda s, v: s + v))
