"""Distance and nearest-row imputation queries.

Pairs are never a full product: distance queries measure every row of a key block against
the block's first row (keys may have gaps), and the KNN queries use the search in
``operators.impute``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from airlattice.functions import distance as D
from airlattice.operators import impute
from airlattice.plans import views as V
from airlattice.plans.registry import query

DIM = 64
NUM = [f"e{i}" for i in range(DIM)]
CAT = ["p_brand", "p_type"]
KNN_K = 5

SQL_EMB = "SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(DIM)) + \
          ", CASE WHEN vec_id % 7 = 0 THEN NULL ELSE label END AS target FROM embeddings"


def emb(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(DIM)],
                    F.when(F.col("vec_id") % 7 == 0, F.lit(None)).otherwise(F.col("label")).alias("target"))


BLOCK = 16


def block_pairs(df, key: str, cols: list[str]):
    """Pair each row with the row of the smallest key in its block of ``BLOCK`` key values."""
    rows = df.select(F.floor(F.col(key) / BLOCK).alias("_block"), F.col(key).alias("b_key"), *[F.col(c).alias(f"b_{c}") for c in cols])
    first = (df.groupBy(F.floor(F.col(key) / BLOCK).alias("_block"))
             .agg(F.min_by(F.struct(F.col(key).alias("a_key"), *[F.col(c).alias(f"a_{c}") for c in cols]), key).alias("_a"))
             .select("_block", "_a.*"))
    return first.join(rows, "_block").filter("b_key > a_key").drop("_block")


def _sql_pairs(src: str, key: str, cols: list[str]) -> str:
    sel_a = ", ".join(f"a.{c} AS a_{c}" for c in cols)
    sel_b = ", ".join(f"b.{c} AS b_{c}" for c in cols)
    return (f"SELECT a.{key} AS a_key, b.{key} AS b_key, {sel_a}, {sel_b} FROM (SELECT * FROM ({src}) s0 "
            f"QUALIFY row_number() OVER (PARTITION BY {key} // {BLOCK} ORDER BY {key}) = 1) a "
            f"JOIN ({src}) b ON b.{key} // {BLOCK} = a.{key} // {BLOCK} AND b.{key} > a.{key}")


def _sql_euclid(cols):
    return "sqrt(" + " + ".join(f"(a_{c} - b_{c}) * (a_{c} - b_{c})" for c in cols) + ")"


@query("dist_euclid", f"SELECT a_key, b_key, round({_sql_euclid(NUM)}, 12) AS dist FROM ({_sql_pairs(SQL_EMB, 'vec_id', NUM)}) p")
def dist_euclid(spark, sf_dir):
    p = block_pairs(emb(spark, sf_dir), "vec_id", NUM)
    return p.select("a_key", "b_key", F.round(D.numeric([f"a_{c}" for c in NUM], [f"b_{c}" for c in NUM]), 12).alias("dist"))


@query("dist_cityblock", f"SELECT a_key, b_key, round({' + '.join(f'abs(a_{c} - b_{c})' for c in NUM)}, 12) AS dist "
       f"FROM ({_sql_pairs(SQL_EMB, 'vec_id', NUM)}) p")
def dist_cityblock(spark, sf_dir):
    p = block_pairs(emb(spark, sf_dir), "vec_id", NUM)
    return p.select("a_key", "b_key", F.round(D.numeric([f"a_{c}" for c in NUM], [f"b_{c}" for c in NUM],
                                                        "cityblock"), 12).alias("dist"))


SQL_PART = "SELECT p_partkey, p_brand, p_type, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part"
_D = "(" + " + ".join(f"CASE WHEN a_{c} IS NOT DISTINCT FROM b_{c} THEN 0 ELSE 1 END" for c in CAT) + ")"


def _part(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", *CAT, F.col("p_size").cast("double").alias("p_size"),
                                                 "p_retailprice")


@query("dist_hamming", f"SELECT a_key, b_key, CAST({_D} AS DOUBLE) / 2.0 AS dist, 2.0 * {_D} / (2.0 + {_D}) AS jac "
       f"FROM ({_sql_pairs(SQL_PART, 'p_partkey', CAT)}) p")
def dist_hamming(spark, sf_dir):
    p = block_pairs(_part(spark, sf_dir), "p_partkey", CAT)
    a, b = [f"a_{c}" for c in CAT], [f"b_{c}" for c in CAT]
    return p.select("a_key", "b_key", D.categorical(a, b, "hamming").alias("dist"),
                    D.categorical(a, b, "jaccard").alias("jac"))


@query("dist_jaccard", f"SELECT a_key, b_key, 2.0 * {_D} / (2.0 + {_D}) AS dist, round(sqrt(2.0 * {_D}), 12) AS euc "
       f"FROM ({_sql_pairs(SQL_PART, 'p_partkey', CAT)}) p")
def dist_jaccard(spark, sf_dir):
    p = block_pairs(_part(spark, sf_dir), "p_partkey", CAT)
    a, b = [f"a_{c}" for c in CAT], [f"b_{c}" for c in CAT]
    return p.select("a_key", "b_key", D.categorical(a, b, "jaccard").alias("dist"),
                    F.round(D.categorical(a, b, "euclidean"), 12).alias("euc"))


def _freq_sql(c):
    return f"(SELECT {c}, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM part) AS f FROM part GROUP BY {c})"


@query("dist_weighted_hamming", f"""
WITH p AS ({_sql_pairs(SQL_PART, 'p_partkey', CAT)}),
fb AS {_freq_sql('p_brand')}, ft AS {_freq_sql('p_type')}
SELECT a_key, b_key, round(2.0 / (1.0 / CASE WHEN a_p_brand = b_p_brand THEN fb.f ELSE 1.0 END
                              + 1.0 / CASE WHEN a_p_type = b_p_type THEN ft.f ELSE 1.0 END), 12) AS dist
FROM p JOIN fb ON fb.p_brand = p.a_p_brand JOIN ft ON ft.p_type = p.a_p_type
""")
def dist_weighted_hamming(spark, sf_dir):
    part = _part(spark, sf_dir)
    p = block_pairs(part, "p_partkey", CAT)
    for c in CAT:
        f = impute.relative_frequency(part, c, f"f_{c}").withColumnRenamed(c, f"a_{c}")
        p = p.join(f, on=f"a_{c}", how="left")
    a, b = [f"a_{c}" for c in CAT], [f"b_{c}" for c in CAT]
    return p.select("a_key", "b_key", F.round(D.weighted_hamming(a, b, [f"f_{c}" for c in CAT]), 12).alias("dist"))


GNUM = ["p_size", "p_retailprice"]


@query("dist_gower", f"""
WITH s AS (SELECT avg(p_size) AS m1, max(p_size) - min(p_size) AS r1, avg(p_retailprice) AS m2,
                  max(p_retailprice) - min(p_retailprice) AS r2 FROM ({SQL_PART}) x),
z AS (SELECT p_partkey, p_brand, p_type, (p_size - m1) / r1 AS p_size, (p_retailprice - m2) / r2 AS p_retailprice
      FROM ({SQL_PART}) x, s),
p AS ({_sql_pairs('SELECT * FROM z', 'p_partkey', CAT + GNUM)})
SELECT a_key, b_key, round((1.0 * ({_sql_euclid(GNUM)} * 2 + (2.0 * {_D} / (2.0 + {_D})) * 2)) / 4, 9) AS dist FROM p
""")
def dist_gower(spark, sf_dir):
    part = _part(spark, sf_dir)
    st = part.agg(*[F.avg(c).alias(f"m_{c}") for c in GNUM],
                  *[(F.max(c) - F.min(c)).alias(f"r_{c}") for c in GNUM]).first()  # one row of 4 numbers
    z = part.withColumns({c: (F.col(c) - F.lit(st[f"m_{c}"])) / F.lit(st[f"r_{c}"]) for c in GNUM})
    p = block_pairs(z, "p_partkey", CAT + GNUM)
    num = D.numeric([f"a_{c}" for c in GNUM], [f"b_{c}" for c in GNUM])
    cat = D.categorical([f"a_{c}" for c in CAT], [f"b_{c}" for c in CAT], "jaccard")
    return p.select("a_key", "b_key", F.round(D.gower(num, cat, len(GNUM), len(CAT)), 9).alias("dist"))


def _knn_sql(how: str) -> str:
    agg = {"mean": "avg(t)", "median": "median(t)",
           "mode": "min(t) FILTER (WHERE cnt = maxcnt)"}[how]
    mode_cte = ""
    src = "nb"
    if how == "mode":
        mode_cte = (", mc AS (SELECT q, t, count(*) AS cnt FROM nb WHERE t IS NOT NULL GROUP BY q, t), "
                    "mm AS (SELECT q, t, cnt, max(cnt) OVER (PARTITION BY q) AS maxcnt FROM mc)")
        src = "mm"
    return f"""
WITH e AS ({SQL_EMB}),
d AS (SELECT a.vec_id AS q, b.vec_id AS j, b.target AS t,
        sqrt({" + ".join(f"(a.e{i} - b.e{i}) * (a.e{i} - b.e{i})" for i in range(DIM))}) AS dist
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.target IS NULL),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, j) AS r FROM d) x WHERE r <= {KNN_K}),
ms AS (SELECT q, count(*) FILTER (WHERE t IS NULL) AS missing FROM nb GROUP BY q){mode_cte},
ag AS (SELECT q, {agg} AS v FROM {src} GROUP BY q)
SELECT e.vec_id, e.target, coalesce(CAST(e.target AS DOUBLE),
       CASE WHEN ms.missing < {KNN_K * 0.5} THEN CAST(ag.v AS DOUBLE) END) AS filled
FROM e LEFT JOIN ms ON e.vec_id = ms.q LEFT JOIN ag ON e.vec_id = ag.q
"""


def _knn(how):
    def run(spark, sf_dir):
        e = emb(spark, sf_dir)
        r = impute.knn(e, "vec_id", "target", NUM, KNN_K, how=how, out="filled")
        return r.select("vec_id", "target", "filled")
    run.__name__ = f"knn_{how}"
    return run


for _how in ("mean", "median", "mode"):
    query(f"knn_{_how}", _knn_sql(_how))(_knn(_how))


# Mixed attributes: a number and two categories, scaled and weighted by their counts.
_MIXED_DIST = f"((abs(a.x - b.x) * 1 + (2.0 * {_D.replace('a_p', 'a.p').replace('b_p', 'b.p')} / (2.0 + {_D.replace('a_p', 'a.p').replace('b_p', 'b.p')})) * 2) / 3)"


@query("knn_mixed", f"""
WITH p AS (SELECT p_partkey, p_brand, p_type, p_retailprice, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size END AS target FROM part),
s AS (SELECT avg(p_retailprice) AS m, max(p_retailprice) - min(p_retailprice) AS r FROM p),
z AS (SELECT p.*, (p_retailprice - m) / r AS x FROM p, s),
d AS (SELECT a.p_partkey AS q, b.p_partkey AS j, b.target AS t, {_MIXED_DIST} AS dist
      FROM z a JOIN z b ON a.p_partkey <> b.p_partkey WHERE a.target IS NULL),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, j) AS r FROM d) x WHERE r <= {KNN_K}),
ag AS (SELECT q, count(*) FILTER (WHERE t IS NULL) AS missing, median(t) AS v FROM nb GROUP BY q)
SELECT z.p_partkey, z.target, coalesce(CAST(z.target AS DOUBLE), CASE WHEN ag.missing < {KNN_K * 0.5} THEN CAST(ag.v AS DOUBLE) END) AS filled
FROM z LEFT JOIN ag ON z.p_partkey = ag.q
""")
def knn_mixed(spark, sf_dir):
    """M5 over a number and two categories."""
    part = V.table(spark, sf_dir, "part").select(
        "p_partkey", *CAT, "p_retailprice", F.when(F.col("p_partkey") % 9 != 0, F.col("p_size")).alias("target"))
    r = impute.knn(part, "p_partkey", "target", ["p_retailprice"], KNN_K, how="median", categorical=CAT, out="filled")
    return r.select("p_partkey", "target", "filled")
