"""Queries of the tree models of every series.

Rows are the hours of the sensors' series and of the network's (sensor -1) that have all 24 lags.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from airlattice.constants import TRAIN_FRACTION, TRAIN_LAGS
from airlattice.operators import series as S
from airlattice.operators import trees as T
from airlattice.plans import views as V
from airlattice.plans.registry import query

K = ["sensor_id", "pollutant"]
LAGGED = [f"lag_{k}" for k in range(1, TRAIN_LAGS + 1)]
FEATURES = [*LAGGED, "hour", "dow"]
# The families at a size that one node grows in about a minute; the defaults in ``trees.FAMILIES`` have 100 trees.
FEW = {
    "RandomForest": T.Growth(trees=10, depth=4, forest=True, min_leaf=2, columns=1 / 3),
    "LightGBM": T.Growth(trees=3, depth=3, rate=0.5, min_leaf=20, leaves=6),
    "XGBoost": T.Growth(trees=3, depth=3, rate=0.5, l2=1.0),
}
FIRST = T.Growth(trees=1, depth=1, l2=1.0, min_leaf=20)

SQL_HISTORY = f"{V.SQL_SERIES_LONG} UNION ALL SELECT -1, pollutant, ts, value FROM ({V.SQL_NETWORK_SERIES}) w"


def history(spark, sf_dir):
    """The sensors' series and, as sensor -1, the network's."""
    network = V.network_series(spark, sf_dir).select(F.lit(-1).cast("long").alias("sensor_id"), "pollutant", "ts", "value")
    return V.series_long(spark, sf_dir).select(*K, "ts", "value").unionByName(network)


def frame(spark, sf_dir):
    """keys, ts, value, FEATURES and is_train, complete rows only."""
    rows = S.lags(history(spark, sf_dir), K, "ts", "value", TRAIN_LAGS).dropna(subset=[*LAGGED, "value"])
    rows = rows.withColumns({"hour": F.hour("ts").cast("double"), "dow": F.weekday("ts").cast("double")})
    return S.chrono_split(rows, K, "ts")


_LAGS = ", ".join(f"lag(value, {k}) OVER w AS lag_{k}" for k in range(1, TRAIN_LAGS + 1))
SQL_FRAME = f"""
SELECT *, row_number() OVER (PARTITION BY sensor_id, pollutant ORDER BY ts)
       <= floor(count(*) OVER (PARTITION BY sensor_id, pollutant) * {TRAIN_FRACTION}) AS is_train
FROM (SELECT *, CAST(hour(ts) AS DOUBLE) AS hour, CAST(isodow(ts) - 1 AS DOUBLE) AS dow, {_LAGS}
      FROM ({SQL_HISTORY}) h WINDOW w AS (PARTITION BY sensor_id, pollutant ORDER BY ts)) l
WHERE value IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL" for c in LAGGED)}
"""


@query("split_gains", f"""
WITH t AS (SELECT *, CAST(round(value / CAST(1e-6 AS DOUBLE)) AS BIGINT) AS y FROM ({SQL_FRAME}) f WHERE is_train),
m AS (SELECT sensor_id, pollutant, CAST(round(CAST(sum(y) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM t GROUP BY ALL),
u AS (SELECT t.sensor_id, t.pollutant, y - m AS g, unnest([{", ".join(FEATURES)}]) AS x, unnest([{", ".join(f"'{f}'" for f in FEATURES)}]) AS feature
      FROM t JOIN m ON m.sensor_id = t.sensor_id AND m.pollutant = t.pollutant),
e AS (SELECT sensor_id, pollutant, feature, min(x) AS lo, (max(x) - min(x)) / CAST({T.BINS} AS DOUBLE) AS width FROM u GROUP BY ALL),
h AS (SELECT u.sensor_id, u.pollutant, u.feature,
        CASE WHEN width = 0 THEN 0 ELSE CAST(least({T.BINS - 1}, greatest(0, floor((x - lo) / width))) AS INT) END AS bin, sum(g) AS g, count(*) AS n
      FROM u JOIN e ON e.sensor_id = u.sensor_id AND e.pollutant = u.pollutant AND e.feature = u.feature GROUP BY ALL),
r AS (SELECT *, sum(g) OVER w AS gl, sum(n) OVER w AS nl, sum(g) OVER p AS ga, sum(n) OVER p AS na FROM h
      WINDOW w AS (PARTITION BY sensor_id, pollutant, feature ORDER BY bin), p AS (PARTITION BY sensor_id, pollutant, feature)),
s AS (SELECT *, pow(CAST(gl AS DOUBLE) * 1e-6, 2) / (nl + {FIRST.l2}) + pow(CAST(ga - gl AS DOUBLE) * 1e-6, 2) / (na - nl + {FIRST.l2})
        - pow(CAST(ga AS DOUBLE) * 1e-6, 2) / (na + {FIRST.l2}) AS gain
      FROM r WHERE nl >= {FIRST.min_leaf} AND na - nl >= {FIRST.min_leaf})
SELECT sensor_id, pollutant, feature, bin, CAST(nl AS BIGINT) AS n_left, round(gain, 4) AS gain FROM s
QUALIFY row_number() OVER (PARTITION BY sensor_id, pollutant, feature ORDER BY gain DESC, bin) = 1
""")
def split_gains(spark, sf_dir):
    """M9: the best first split of every feature, per series, of a boosted tree with a penalty."""
    found = T.split_gains(frame(spark, sf_dir).where("is_train"), K, FEATURES, "value", FIRST)
    return found.withColumn("gain", F.round("gain", 4))


@query("train_families")
def train_families(spark, sf_dir):
    """M9 + M11: a random forest and both boosters per series, scored on the holdout; the smallest MAE is best."""
    return T.train(frame(spark, sf_dir), K, "ts", FEATURES, "value", FEW)[0]


# Draws of the boosters' grids and the forest's, each on five folds: 45 models per series grow together.
DRAWS = {
    "RandomForest": [T.Growth(trees=4, depth=d, forest=True, min_leaf=m, columns=c) for d, m, c in ((3, 1, 1.0), (4, 4, 1 / 3), (3, 2, 1 / 3))],
    "LightGBM": [T.Growth(trees=2, depth=d, rate=r, min_leaf=20, leaves=n, rows=s) for d, r, n, s in ((3, 0.5, 6, 0.8), (2, 0.3, 4, 1.0), (3, 0.8, 8, 0.6))],
    "XGBoost": [T.Growth(trees=2, depth=d, rate=r, l2=p, columns=c) for d, r, p, c in ((3, 0.5, 0.1, 0.8), (2, 0.8, 0.5, 1.0), (3, 0.3, 0.0, 0.6))],
}


@query("tree_search")
def tree_search(spark, sf_dir):
    """Every draw of every family over five unshuffled folds, per series, by mean R^2."""
    rows = frame(spark, sf_dir).where("is_train")
    return T.search(rows, K, "ts", FEATURES, "value", DRAWS)
