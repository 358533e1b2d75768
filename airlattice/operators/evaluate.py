"""Evaluation operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlattice.constants import MODEL_LIFETIME_SECONDS

METRICS = ["mae", "mape", "mse", "rmse"]


def finite(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != F.lit(float("inf")))


def valid(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Drop pairs where either side is null, NaN or infinite."""
    return df.filter(finite(actual) & finite(predicted))


def nan_to_null(c) -> Column:
    """P20: NaN -> null at the edge."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(col), col)


def metrics(df: DataFrame, keys: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """A5: MAE, MAPE (percent), MSE, RMSE per key over valid pairs.

    MAPE is null when any actual value is 0 (the reference's mean becomes infinite
    or NaN there); MAE is null if infinite."""
    v = valid(df, actual, predicted)
    err = F.col(actual) - F.col(predicted)
    has_zero = F.max(F.when(F.col(actual) == 0, 1).otherwise(0)) == 1
    ape = F.abs(err / F.when(F.col(actual) != 0, F.col(actual)))
    agg = v.groupBy(*keys).agg(
        F.avg(F.abs(err)).alias("mae"),
        F.when(~has_zero, F.avg(ape) * 100).alias("mape"),
        F.avg(err * err).alias("mse"),
    )
    return agg.withColumn("rmse", F.sqrt("mse")).withColumn(
        "mae", F.when(F.abs(F.col("mae")) != F.lit(float("inf")), F.col("mae")))


def best(errors: DataFrame, keys: list[str], model: str = "model", order: str | None = None,
         metric: str = "mae") -> DataFrame:
    """Per key the model with the strictly smallest metric; ties go to the first
    model in registry order (``order`` column, else the model name)."""
    tie = F.col(order) if order else F.col(model)
    ranked = errors.filter(F.col(metric).isNotNull())
    return ranked.groupBy(*keys).agg(F.min_by(F.col(model), F.struct(F.col(metric), tie)).alias(model))


def best_rows(errors: DataFrame, other: DataFrame, keys: list[str], model: str = "model", **kw) -> DataFrame:
    """Rows of ``other`` (e.g. holdout series) that belong to each key's best model."""
    return other.join(best(errors, keys, model, **kw), on=keys + [model], how="inner")


def best_error_rows(errors: DataFrame, keys: list[str], model: str = "model", order: str | None = None,
                    metric: str = "mae") -> DataFrame:
    """Each key's best-model error row, chosen in one pass (window over the key's
    few model rows) instead of joining the errors with their own minimum."""
    tie = F.col(order) if order else F.col(model)
    w = Window.partitionBy(*keys).orderBy(F.col(metric).asc(), tie)
    ranked = errors.filter(F.col(metric).isNotNull()).withColumn("_r", F.row_number().over(w))
    return ranked.filter("_r = 1").drop("_r")


def leaderboard(errors: DataFrame, keys: list[str], model: str = "model") -> DataFrame:
    """Per key and metric, models ranked by value (largest first), the axis limit
    (max + 10 - max % 10) and a one-decimal label; null metrics are left out."""
    long = errors.unpivot([*keys, model], METRICS, "metric", "value")
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    w = Window.partitionBy(*keys, "metric")
    mx = F.max("value").over(w)
    return long.select(
        *keys, "metric", model, "value",
        F.row_number().over(w.orderBy(F.col("value").desc(), F.col(model))).alias("rank"),
        (mx + 10 - mx % 10).alias("axis_limit"),
        F.round("value", 1).alias("label"))


def tally(outcomes: DataFrame, keys: list[str], outcome: str = "outcome", unit: str = "unit",
          plural: str | None = None) -> DataFrame:
    """Per job total / done / failed / skipped, severity and a summary line."""
    plural = plural or f"{unit}s"
    agg = outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(outcome) == "done").alias("done"),
        F.count_if(F.col(outcome) == "failed").alias("failed"),
        F.count_if(F.col(outcome) == "skipped").alias("skipped"))
    severity = (F.when(F.col("failed") == 0, "info")
                 .when(F.col("failed") == F.col("total"), "error").otherwise("warning"))
    unit_txt = F.when(F.col("total") == 1, F.lit(unit)).otherwise(F.lit(plural))
    line = F.concat(F.col(keys[0]).cast("string"), F.lit(": "), F.col("total").cast("string"), F.lit(" "),
                    unit_txt, F.lit(" -- "), F.col("done").cast("string"), F.lit(" done, "),
                    F.col("failed").cast("string"), F.lit(" failed"),
                    F.when(F.col("skipped") > 0, F.concat(F.lit(", "), F.col("skipped").cast("string"),
                                                          F.lit(" skipped"))).otherwise(F.lit("")),
                    F.when(F.col("failed") == F.col("total"),
                           F.lit(f" (every {unit} failed)")).otherwise(F.lit("")))
    return agg.withColumn("severity", severity).withColumn("summary", line)


def worklist(units: DataFrame, pollutants: list[str], registry: DataFrame, with_data: DataFrame,
             keys: list[str], as_of_epoch: int, trained_col: str = "trained_at",
             lifetime_s: int = MODEL_LIFETIME_SECONDS) -> DataFrame:
    """Every (unit, pollutant) with a status: 'fresh' (model younger than its
    lifetime: skipped), 'no_data' (no readings: skipped) or 'train'.

    The pollutant list is a fixed short constant, expanded with ``explode`` rather than
    a cross join; registry and data presence are joined on the full key."""
    work = units.select(*keys, F.explode(F.array(*[F.lit(p) for p in pollutants])).alias("pollutant"))
    k = keys + ["pollutant"]
    newest = registry.groupBy(*k).agg(F.max(trained_col).alias("_t"))
    age = F.lit(as_of_epoch) - F.unix_seconds(F.col("_t").cast("timestamp"))
    present = with_data.select(*k).distinct().withColumn("_has", F.lit(True))
    j = work.join(newest, on=k, how="left").join(present, on=k, how="left")
    status = (F.when(F.col("_t").isNotNull() & (age < lifetime_s), "fresh")
               .when(F.col("_has").isNull(), "no_data").otherwise("train"))
    return j.select(*k, F.col("_t").alias("trained_at"), status.alias("status"))


def write_errors(errors: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Store the error table; only the partitions present are replaced."""
    (errors.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy(*(partition_by or [])).parquet(path))


def write_holdout(predictions: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Store holdout predictions (time, actual, predicted per series and model)."""
    (predictions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy(*(partition_by or [])).parquet(path))


def best_series_rows(holdout: DataFrame, keys: list[str], model: str = "model", actual: str = "actual",
                     predicted: str = "predicted", digits: int | None = None) -> DataFrame:
    """Each series' holdout rows of the model with the smallest MAE over valid pairs
    (ties: smaller model name).

    The MAE is a grouped mean (combined before the shuffle), the best model a grouped
    minimum over the few models of a series, and the rows are joined to it, where a
    series with very many rows is split by the skew join.
    """
    ok = finite(actual) & finite(predicted)
    mae = F.avg(F.when(ok, F.abs(F.col(actual) - F.col(predicted))))
    if digits is not None:
        mae = F.round(mae, digits)
    errors = holdout.groupBy(*keys, model).agg(mae.alias("_mae")).filter(F.col("_mae").isNotNull())
    best_model = errors.groupBy(*keys).agg(F.min(F.struct("_mae", model)).alias("_best")).select(*keys, F.col(f"_best.{model}"))
    return holdout.join(best_model, [*keys, model], "left_semi")
