"""Queries of the linear models of every series."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from airlattice.constants import SEARCH_DRAWS, SEARCH_FOLDS, SEARCH_SEED, SIGNIFICANCE_LEVEL
from airlattice.functions import timefeat
from airlattice.operators import linear as L
from airlattice.operators import model as M
from airlattice.operators import select as SEL
from airlattice.operators import series as S
from airlattice.operators import sweep as W
from airlattice.operators import trees as T
from airlattice.plans import q_trees as Q
from airlattice.plans import views as V
from airlattice.plans.registry import query

K = Q.K
SHOWN = ["lag_1", "lag_24", "hour", "dow"]
_X = [*SHOWN, "value"]


def _sums() -> str:
    def d(c):
        return f"CAST({c} AS DECIMAL(18,6))"

    def t(e):
        return f"CAST(round(sum({e}), 4) AS DOUBLE)"
    parts = [f"{t(d(a))} AS s_{a}" for a in _X]
    parts += [f"{t(f'{d(a)} * {d(b)}')} AS s_{a}_{b}" for i, a in enumerate(_X) for b in _X[i:]]
    return ", ".join(parts)


@query("fold_sums", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, pollutant ORDER BY ts) - 1 AS i,
                  count(*) OVER (PARTITION BY sensor_id, pollutant) AS n FROM ({Q.SQL_FRAME}) f WHERE is_train),
m AS (SELECT *, CAST(CASE WHEN i < (n % {SEARCH_FOLDS}) * (n // {SEARCH_FOLDS} + 1) THEN i // (n // {SEARCH_FOLDS} + 1)
        ELSE n % {SEARCH_FOLDS} + (i - (n % {SEARCH_FOLDS}) * (n // {SEARCH_FOLDS} + 1)) // greatest(n // {SEARCH_FOLDS}, 1) END AS INTEGER) AS fold FROM r)
SELECT sensor_id, pollutant, fold, CAST(count(*) AS DOUBLE) AS n, {_sums()} FROM m GROUP BY ALL
""")
def fold_sums(spark, sf_dir):
    """The sums that a search draws on, per series and fold, here of four features."""
    marked = T.folds(Q.frame(spark, sf_dir).where("is_train"), K, "ts", SEARCH_FOLDS)
    return L.fold_sums(marked, K, "_fold", SHOWN, "value", scale=6, digits=4).withColumnRenamed("_fold", "fold")


@query("linear_search")
def linear_search(spark, sf_dir):
    """M10 + M11: 50 draws of the linear grid on five folds of every series, all from one pass over the rows; the best
    draw's coefficients on all training rows."""
    grid = [(r, a) for r in M.GRIDS["Linear"]["regParam"] for a in M.GRIDS["Linear"]["elasticNetParam"]]
    draws = random.Random(SEARCH_SEED).sample(grid, SEARCH_DRAWS)
    marked = T.folds(Q.frame(spark, sf_dir).where("is_train"), K, "ts", SEARCH_FOLDS)
    found = L.search(L.fold_sums(marked, K, "_fold", Q.FEATURES, "value"), K, Q.FEATURES, "value", draws)
    at = F.col("draw")
    return found.withColumns({c: F.get(F.array(*[F.lit(float(d[i])) for d in draws]), at) for i, c in enumerate(("reg", "alpha"))})


# M6, M7 on the network's series: lags 1-6 and the hour's encoding.
CANDIDATES = [*[f"lag_{k}" for k in range(1, 7)], "hour_cos", "hour_sin"]
_M = len(CANDIDATES) + 2


def _sql_matrix() -> str:
    names = ["1", *CANDIDATES, "value"]

    def entry(i, j):
        if i == j == 0:
            return "CAST(count(*) AS DOUBLE)"
        parts = [f"CAST({names[k]} AS DECIMAL(18,6))" for k in sorted((i, j)) if k]
        return f"CAST(round(sum({' * '.join(parts)}), 4) AS DOUBLE)"
    return "[" + ", ".join(entry(i, j) for i in range(_M) for j in range(_M)) + "]"


def _sql_swept(a: str, k: str) -> str:
    d = f"{a}[{k} * {_M + 1} + 1]"
    return (f"list_transform(range({_M * _M}), lambda e: CASE WHEN e // {_M} = {k} AND e % {_M} = {k} THEN 1.0 / {d} "
            f"WHEN e // {_M} = {k} THEN {a}[e + 1] / {d} WHEN e % {_M} = {k} THEN -{a}[e + 1] / {d} "
            f"ELSE {a}[e + 1] - {a}[(e // {_M}) * {_M} + {k} + 1] * {a}[{k} * {_M} + e % {_M} + 1] / {d} END)")


def _sql_p(t: str, dof: str) -> str:
    """The two-sided p-value, with SQL's own lgamma."""
    a, sq = f"({dof} / 2.0)", f"({t} * {t} / {dof})"
    low = f"1.0 / (1.0 + {sq}) <= ({a} + 1.0) / ({a} + 2.5)"
    scale = f"exp(lgamma({a} + 0.5) - lgamma({a}) - {a} * ln(1.0 + {sq})) * sqrt({sq} / (1.0 + {sq})) / sqrt(pi())"
    p, q, x = (f"(CASE WHEN {low} THEN {u} ELSE {v} END)" for u, v in ((a, "0.5"), ("0.5", a), (f"1.0 / (1.0 + {sq})", f"{sq} / (1.0 + {sq})")))
    term = (f"CASE WHEN j % 2 = 1 THEN -({p} + j // 2) * ({p} + {q} + j // 2) / (({p} + 2 * (j // 2)) * ({p} + 2 * (j // 2) + 1)) "
            f"ELSE (j // 2) * ({q} - j // 2) / (({p} + 2 * (j // 2) - 1) * ({p} + 2 * (j // 2))) END")
    fraction = f"list_reduce(list_transform(range({W.DEPTH}, 0, -1), lambda j: ({term}) * {x}), lambda s, v: 1.0 + v / s, 1.0)"
    return (f"CASE WHEN {t} IS NULL OR {dof} <= 0 THEN NULL WHEN {t} = 0 THEN 1.0 WHEN isinf({t}) THEN 0.0 "
            f"WHEN {low} THEN {scale} / ({a} * {fraction}) ELSE 1.0 - {scale} / (0.5 * {fraction}) END")


def _sql_t(k: str, a: str, kept: str) -> str:
    beta, spread = f"{a}[{k} * {_M} + {_M}]", f"({a}[{k} * {_M + 1} + 1] * {a}[{_M * _M}])"
    return (f"CASE WHEN n - 1 - len({kept}) <= 0 THEN NULL WHEN {beta} = 0 THEN 0.0 WHEN {spread} <= 0 THEN CAST('inf' AS DOUBLE) "
            f"ELSE {beta} / sqrt({spread} / (n - 1 - len({kept}))) END")


_NAMES = "[" + ", ".join(f"'{c}'" for c in CANDIDATES) + "]"
_FITTED = f"""
l AS (SELECT *, {", ".join(f"lag(value, {k}) OVER (PARTITION BY pollutant ORDER BY ts) AS lag_{k}" for k in range(1, 7))},
        cos(2 * pi() * hour(ts) / 24.0) AS hour_cos, sin(2 * pi() * hour(ts) / 24.0) AS hour_sin FROM ({V.SQL_NETWORK_SERIES}) s),
g AS (SELECT pollutant, CAST(count(*) AS DOUBLE) AS n, {_sql_matrix()} AS a0 FROM l
      WHERE value IS NOT NULL AND {" AND ".join(f"lag_{k} IS NOT NULL" for k in range(1, 7))} GROUP BY pollutant),
w AS (SELECT pollutant, n, 0 AS k, a0, a0 AS a, CAST([] AS INTEGER[]) AS kept FROM g
      UNION ALL
      SELECT pollutant, n, k + 1, a0, CASE WHEN a[k * {_M + 1} + 1] > {W.ALIASED!r} * a0[k * {_M + 1} + 1] THEN {_sql_swept("a", "k")} ELSE a END,
             CASE WHEN k > 0 AND a[k * {_M + 1} + 1] > {W.ALIASED!r} * a0[k * {_M + 1} + 1] THEN list_append(kept, k) ELSE kept END
      FROM w WHERE k <= {len(CANDIDATES)}),
f AS (SELECT * FROM w WHERE k = {len(CANDIDATES) + 1})
"""


def candidates(spark, sf_dir):
    rows = S.lags(V.network_series(spark, sf_dir), ["pollutant"], "ts", "value", 6)
    hc, hs = timefeat.cyclic(F.hour("ts"), 24)
    return rows.withColumns({"hour_cos": hc, "hour_sin": hs})


@query("ols_statistics", f"""
WITH RECURSIVE {_FITTED},
u AS (SELECT *, unnest(range(1, {len(CANDIDATES) + 1})) AS i FROM f),
t AS (SELECT pollutant, {_NAMES}[i] AS feature, n - 1 - len(kept) AS dof, CASE WHEN list_contains(kept, i) THEN a[i * {_M} + {_M}] END AS coefficient,
             CASE WHEN list_contains(kept, i) THEN {_sql_t("i", "a", "kept")} END AS t FROM u)
SELECT pollutant, feature, round(coefficient, 6) + 0.0 AS coefficient, round(t, 5) + 0.0 AS t, round({_sql_p("t", "dof")}, 6) + 0.0 AS p FROM t
""")
def ols_statistics(spark, sf_dir):
    """M6: coefficient, t and p-value of every candidate feature, per network series."""
    out = SEL.feature_statistics(candidates(spark, sf_dir), ["pollutant"], CANDIDATES, "value", scale=6, digits=4)
    return out.withColumns({c: F.round(c, d) + F.lit(0.0) for c, d in (("coefficient", 6), ("t", 5), ("p", 6))})


@query("backward_elimination", f"""
WITH RECURSIVE {_FITTED},
e AS (SELECT pollutant, n, 0 AS round, a, kept, true AS go FROM f
      UNION ALL
      SELECT pollutant, n, round + 1, CASE WHEN out THEN {_sql_swept("a", "weakest")} ELSE a END,
             CASE WHEN out THEN list_filter(kept, lambda z: z <> weakest) ELSE kept END, out
      FROM (SELECT *, coalesce({_sql_p("least_t", "dof")}, 2.0) > {SIGNIFICANCE_LEVEL} AS out
            FROM (SELECT *, list_min(ts) AS least_t, kept[coalesce(list_position(ts, list_min(ts)), 1)] AS weakest, n - 1 - len(kept) AS dof
                  FROM (SELECT *, list_transform(kept, lambda z: abs({_sql_t("z", "a", "kept")})) AS ts FROM e WHERE go AND len(kept) > 0) x) y) v)
SELECT pollutant, list_transform(kept, lambda z: {_NAMES}[z]) AS selected, list_transform(ps, lambda v: round(v, 6) + 0.0) AS p_values
FROM (SELECT pollutant, kept, list_transform(list_transform(kept, lambda z: {_sql_t("z", "a", "kept")}), lambda t: {_sql_p("t", "(n - 1 - len(kept))")}) AS ps
      FROM e QUALIFY row_number() OVER (PARTITION BY pollutant ORDER BY round DESC) = 1) d
""")
def backward_elimination(spark, sf_dir):
    """M6 + M7 per network series: candidate features lags 1-6 and hour encodings."""
    out = SEL.select_features(candidates(spark, sf_dir), ["pollutant"], CANDIDATES, "value", scale=6, digits=4)
    return out.withColumn("p_values", F.transform("p_values", lambda v: F.round(v, 6) + F.lit(0.0)))
