"""Series queries."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from airlattice.constants import LOOKBACK_WEEKS, PACF_THRESHOLD, TAIL_ROWS, TRAIN_LAGS
from airlattice.functions.stats import sql_exact_avg
from airlattice.operators import series as S
from airlattice.plans import views as V
from airlattice.plans.registry import query

K = ["sensor_id", "pollutant"]
AS_OF = "2024-01-20 12:00:00"
LOOKBACK_AS_OF = "2024-01-25 00:00:00"
L = TRAIN_LAGS


def _epoch(text: str) -> int:
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp())


@query("summary_join", f"""
WITH w AS (SELECT user_id AS sensor_id, date_trunc('hour', ts) AS ts,
                  CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS DOUBLE) / count(*) AS temp
           FROM events GROUP BY 1, 2),
p AS ({V.SQL_HOURLY_WIDE})
SELECT w.sensor_id, w.ts, temp, co, no2, o3, pm2_5, pm10, so2 FROM w JOIN p ON w.sensor_id = p.sensor_id AND w.ts = p.ts
""")
def summary_join(spark, sf_dir):
    ev = V.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    weather = (ev.groupBy(F.col("user_id").alias("sensor_id"), F.date_trunc("hour", "ts").alias("ts"))
                 .agg((F.sum(k).cast("double") / F.count(F.lit(1))).alias("temp")))
    return S.summary(weather, V.hourly_wide(spark, sf_dir), ["sensor_id", "ts"])


@query("training_cutoff", f"SELECT * FROM ({V.SQL_SERIES_LONG}) s WHERE ts <= TIMESTAMP '{AS_OF}'")
def training_cutoff(spark, sf_dir):
    return S.cutoff(V.series_long(spark, sf_dir, until=_epoch(AS_OF)), "ts", AS_OF)


@query("lookback_window", f"""SELECT * FROM ({V.SQL_SERIES_LONG}) s
WHERE ts >= TIMESTAMP '{LOOKBACK_AS_OF}' - INTERVAL 364 DAY AND ts <= TIMESTAMP '{LOOKBACK_AS_OF}'""")
def lookback_window(spark, sf_dir):
    end = _epoch(LOOKBACK_AS_OF)
    long = V.series_long(spark, sf_dir, end - LOOKBACK_WEEKS * 7 * 86400, end)
    return S.lookback(long, "ts", LOOKBACK_AS_OF)


@query("lag_features", f"""
SELECT sensor_id, pollutant, ts, value, {", ".join(f"lag(value, {k}) OVER (PARTITION BY sensor_id, pollutant ORDER BY ts) AS lag_{k}" for k in range(1, L + 1))}
FROM ({V.SQL_SERIES_LONG}) n
""")
def lag_features(spark, sf_dir):
    return S.lags(V.series_long(spark, sf_dir), K, "ts", "value", L)


@query("lead_align", f"""
WITH s AS (SELECT sensor_id, pollutant, ts, value,
             lead(value) OVER (PARTITION BY sensor_id, pollutant ORDER BY ts) AS f_value,
             lead(CAST(hour(ts) AS INTEGER)) OVER (PARTITION BY sensor_id, pollutant ORDER BY ts) AS f_hour,
             row_number() OVER (PARTITION BY sensor_id, pollutant ORDER BY ts DESC) AS rl
           FROM ({V.SQL_SERIES_LONG}) x)
SELECT sensor_id, pollutant, ts, value, f_value, f_hour FROM s WHERE rl > 1
""")
def lead_align(spark, sf_dir):
    s = V.series_long(spark, sf_dir).withColumns({"f_value": F.col("value"), "f_hour": F.hour("ts")})
    return S.lead_align(s, K, "ts", ["f_value", "f_hour"])


@query("tail_n", f"""
SELECT sensor_id, pollutant, ts, value FROM (
  SELECT *, row_number() OVER (PARTITION BY sensor_id, pollutant ORDER BY ts DESC) AS rn FROM ({V.SQL_SERIES_LONG}) n) t
WHERE rn <= {TAIL_ROWS}
""")
def tail_n(spark, sf_dir):
    return S.tail(V.series_long(spark, sf_dir), K, "ts", TAIL_ROWS)


@query("chrono_split", f"""
SELECT sensor_id, pollutant, ts, value,
  row_number() OVER (PARTITION BY sensor_id, pollutant ORDER BY ts)
    <= floor(count(*) OVER (PARTITION BY sensor_id, pollutant) * 0.75) AS is_train
FROM ({V.SQL_SERIES_LONG}) s
""")
def chrono_split(spark, sf_dir):
    return S.chrono_split(V.series_long(spark, sf_dir), K, "ts")


SQL_ACOV = f"""
n AS ({V.SQL_SERIES_LONG}),
m AS (SELECT sensor_id, pollutant, {sql_exact_avg('value', 6)} AS mu, count(value) AS cnt FROM n GROUP BY ALL),
d AS (SELECT n.sensor_id, n.pollutant, ts, value - mu AS d, cnt FROM n JOIN m ON n.sensor_id = m.sensor_id AND n.pollutant = m.pollutant),
l AS (SELECT sensor_id, pollutant, cnt, ts, d, {", ".join(f"lag(d, {k}) OVER (PARTITION BY sensor_id, pollutant ORDER BY ts) AS l{k}" for k in range(1, L + 1))} FROM d),
s AS (SELECT sensor_id, pollutant, any_value(cnt) AS cnt, sum(d * d ORDER BY ts) AS s0, {", ".join(f"sum(d * l{k} ORDER BY ts) AS s{k}" for k in range(1, L + 1))}
      FROM l GROUP BY ALL),
acov AS ({" UNION ALL ".join(f"SELECT sensor_id, pollutant, cnt, {k} AS k, CASE WHEN cnt > {k} THEN coalesce(s{k}, 0.0) / (cnt - {k}) END AS r FROM s" for k in range(0, L + 1))})
"""


@query("autocovariance", f"WITH {SQL_ACOV} SELECT sensor_id, pollutant, k, round(r + 1e-8, 6) AS r_k FROM acov")
def autocovariance(spark, sf_dir):
    a = S.autocov(V.series_long(spark, sf_dir), K, "ts", "value", L)
    e = a.select(*K, F.posexplode("acov").alias("k", "r"))
    return e.select(*K, F.col("k").cast("int").alias("k"), F.round(F.col("r") + 1e-8, 6).alias("r_k"))


# Durbin-Levinson over lists: one row per series and lag, phi holds the coefficients so far.
SQL_PACF = f"""
RECURSIVE {SQL_ACOV.strip()},
a AS (SELECT sensor_id, pollutant, list(r ORDER BY k) AS r, any_value(CASE WHEN {L} < cnt // 2 THEN {L} ELSE cnt // 2 - 1 END) AS lags
      FROM acov GROUP BY ALL),
t AS (
  SELECT sensor_id, pollutant, r, lags, 0 AS k, CAST([] AS DOUBLE[]) AS phi, CAST(1.0 AS DOUBLE) AS p FROM a
  UNION ALL
  SELECT sensor_id, pollutant, r, lags, k + 1,
         list_append(list_transform(range(1, k + 1), lambda j: phi[j] - kk * phi[k + 1 - j]), kk), kk
  FROM (SELECT *, CASE WHEN r[1] = 0 OR r[1] - den = 0 THEN CAST('nan' AS DOUBLE) ELSE (r[k + 2] - num) / (r[1] - den) END AS kk
        FROM (SELECT *, coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j])), 0.0) AS num,
                     coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j + 1])), 0.0) AS den
              FROM t WHERE k < lags) x) y)
"""


@query("pacf_values", f"WITH {SQL_PACF} SELECT sensor_id, pollutant, k, round(p, 5) AS pacf FROM t")
def pacf_values(spark, sf_dir):
    """Partial autocorrelations per sensor and pollutant, as many as the series allows."""
    a = S.autocov(V.series_long(spark, sf_dir), K, "ts", "value", L)
    e = S.pacf(a, K, L).select(*K, F.posexplode("pacf").alias("k", "p"))
    return e.select(*K, F.col("k").cast("int").alias("k"), F.round("p", 5).alias("pacf"))


@query("pacf_lags", f"""
WITH {SQL_PACF},
sel AS (SELECT sensor_id, pollutant, list(k ORDER BY k) FILTER (WHERE k >= 1 AND NOT isnan(p) AND abs(p) >= {PACF_THRESHOLD}) AS lags FROM t GROUP BY ALL)
SELECT n.sensor_id, n.pollutant, ts, value, coalesce(list_aggregate(sel.lags, 'string_agg', ','), '') AS lags,
  {", ".join(f"CASE WHEN list_contains(sel.lags, {k}) THEN lag(value, {k}) OVER (PARTITION BY n.sensor_id, n.pollutant ORDER BY ts) END AS lag_{k}" for k in range(1, L + 1))}
FROM n JOIN sel ON sel.sensor_id = n.sensor_id AND sel.pollutant = n.pollutant
""")
def pacf_lags(spark, sf_dir):
    """A7 + W1 + M3: PACF-selected lag features per sensor and pollutant."""
    lf = S.lag_features(V.series_long(spark, sf_dir), K, "ts", "value", L, PACF_THRESHOLD)
    return lf.select(*K, "ts", "value", F.concat_ws(",", F.col("lags").cast("array<string>")).alias("lags"),
                     *[f"lag_{k}" for k in range(1, L + 1)])


def _scale_sql(kind: str) -> str:
    if kind == "min_max":
        a, b = "min(value)", "max(value) - min(value)"
    elif kind == "standard":
        a, b = sql_exact_avg("value", 6), "stddev_pop(value)"
    else:
        a, b = "quantile_cont(value, 0.5)", "quantile_cont(value, 0.75) - quantile_cont(value, 0.25)"
    return f"""
WITH s AS ({V.SQL_SERIES_LONG}),
st AS (SELECT sensor_id, pollutant, {a} AS a, {b} AS b FROM s GROUP BY sensor_id, pollutant)
SELECT s.sensor_id, s.pollutant, ts,
  round((value - a) / CASE WHEN b = 0 THEN 1.0 ELSE b END, 9) + 0.0 AS value
FROM s JOIN st ON s.sensor_id = st.sensor_id AND s.pollutant = st.pollutant
"""


def _scaled(kind):
    def run(spark, sf_dir):
        out = S.scale(V.series_long(spark, sf_dir), K, ["value"], kind, scale_digits=6)
        return out.withColumn("value", F.round("value", 9) + F.lit(0.0))
    run.__name__ = f"scale_{kind}"
    return run


query("scale_minmax", _scale_sql("min_max"))(_scaled("min_max"))
query("scale_standard", _scale_sql("standard"))(_scaled("standard"))
query("scale_robust", _scale_sql("robust"))(_scaled("robust"))



@query("scale_robust_bounded", _scale_sql("robust"))
def scale_robust_bounded(spark, sf_dir):
    """A4 + M4: the robust scaler from exact quantiles by counted bins, for series of any length."""
    from airlattice.operators.quantiles import robust_stats
    rows = V.series_long(spark, sf_dir)
    out = S.apply_scale(rows.select(*K, "ts", "value"), robust_stats(rows, K, ["value"]), K, ["value"])
    return out.withColumn("value", F.round("value", 9) + F.lit(0.0))

_X = ["lag_1", "lag_2", "lag_3"]


def _gram_terms():
    def d(c):
        return f"CAST({c} AS DECIMAL(18,6))"

    def t(e):
        return f"CAST(round(sum({e}), 4) AS DOUBLE)"

    terms = [("n", "count(*)::DOUBLE"), ("s_value", t(d("value"))), ("s_value_value", t(f"{d('value')} * {d('value')}"))]
    for i, a in enumerate(_X):
        terms.append((f"s_{a}", t(d(a))))
        terms.append((f"s_{a}_value", t(f"{d(a)} * {d('value')}")))
        for b in _X[i:]:
            terms.append((f"s_{a}_{b}", t(f"{d(a)} * {d(b)}")))
    return terms


@query("gram_sums", f"""
WITH l AS (SELECT sensor_id, pollutant, ts, value, {", ".join(f"lag(value, {k}) OVER (PARTITION BY sensor_id, pollutant ORDER BY ts) AS lag_{k}" for k in (1, 2, 3))}
           FROM ({V.SQL_SERIES_LONG}) n)
SELECT sensor_id, pollutant, {", ".join(f"{e} AS {n}" for n, e in _gram_terms())}
FROM l WHERE lag_1 IS NOT NULL AND lag_2 IS NOT NULL AND lag_3 IS NOT NULL GROUP BY sensor_id, pollutant
""")
def gram_sums(spark, sf_dir):
    l = S.lags(V.series_long(spark, sf_dir), K, "ts", "value", 3)
    return S.gram_sums(l, K, _X, "value", scale=6, digits=4)


_FRAME_LAGS = ", ".join(f"round((CASE WHEN list_contains(sel.lags, {k}) THEN lag(value, {k}) OVER w END - va) / CASE WHEN vb = 0 THEN 1.0 ELSE vb END, 9) + 0.0 AS lag_{k}"
                        for k in range(1, L + 1))


@query("training_frame", f"""
WITH {SQL_PACF},
sel AS (SELECT sensor_id, pollutant, list(k ORDER BY k) FILTER (WHERE k >= 1 AND NOT isnan(p) AND abs(p) >= {PACF_THRESHOLD}) AS lags FROM t GROUP BY ALL),
wx AS (SELECT user_id AS sensor_id, date_trunc('hour', ts) AS ts,
              CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS DOUBLE) / count(*) AS temp FROM events GROUP BY 1, 2),
x AS (SELECT n.*, wx.temp, row_number() OVER v <= floor(count(*) OVER (PARTITION BY n.sensor_id, n.pollutant) * 0.75) AS is_train
      FROM n LEFT JOIN wx ON wx.sensor_id = n.sensor_id AND n.ts = wx.ts + INTERVAL 1 HOUR WHERE n.ts <= TIMESTAMP '{AS_OF}'
      WINDOW v AS (PARTITION BY n.sensor_id, n.pollutant ORDER BY n.ts)),
st AS (SELECT sensor_id, pollutant, min(value) AS va, max(value) - min(value) AS vb, min(temp) AS ta, max(temp) - min(temp) AS tb
       FROM x WHERE is_train GROUP BY ALL)
SELECT x.sensor_id, x.pollutant, ts, value AS label, is_train, {_FRAME_LAGS},
       round((temp - ta) / CASE WHEN tb = 0 THEN 1.0 ELSE tb END, 9) + 0.0 AS temp,
       round(cos(2 * pi() * hour(ts) / 24.0), 9) + 0.0 AS hour_cos, round(sin(2 * pi() * hour(ts) / 24.0), 9) + 0.0 AS hour_sin,
       round(cos(2 * pi() * (isodow(ts) - 1) / 7.0), 9) + 0.0 AS day_of_week_cos
FROM x JOIN sel ON sel.sensor_id = x.sensor_id AND sel.pollutant = x.pollutant
LEFT JOIN st ON st.sensor_id = x.sensor_id AND st.pollutant = x.pollutant
WINDOW w AS (PARTITION BY x.sensor_id, x.pollutant ORDER BY ts)
""".replace(f"n AS ({V.SQL_SERIES_LONG})", f"n AS (SELECT * FROM ({V.SQL_SERIES_LONG}) s0 WHERE ts <= TIMESTAMP '{AS_OF}')"))
def training_frame(spark, sf_dir):
    """M8: PACF lags, weather of the hour before, time features, split, scaling by training rows, cut at as_of."""
    from airlattice.operators.frame import training_frame as build
    from airlattice.plans.q_serve import weather
    f = build(V.series_long(spark, sf_dir, until=_epoch(AS_OF)), weather(spark, sf_dir), K, "ts", "value", L, PACF_THRESHOLD,
              weather_keys=["sensor_id"], as_of=AS_OF)
    lags_ = [c for c in f.features if c.startswith("lag_")]
    shown = [*lags_, "temp", "hour_cos", "hour_sin", "day_of_week_cos"]
    return f.rows.select(*K, "ts", "label", "is_train", *[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in shown])
