"""op11: integer centroid clusters of all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from airlattice.llm.clusters import cluster, summary
from airlattice.llm.common import Scratch
from airlattice.llm.queries import query, table


def _round(n: int) -> str:
    """Assignment to the centroids of ``c{n}``, and those that follow."""
    return f"""
near{n} AS (SELECT vec_id, row_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT v.vec_id, v.row_id, k.c, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - k.x[i]) * (v.x[i] - k.x[i]))) AS d
  FROM v CROSS JOIN c{n} k) GROUP BY vec_id, row_id),
mean{n} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
  SELECT near{n}.c, i, sum(v.x[i]) AS s, count(*) AS n FROM v JOIN near{n} USING (row_id), range(1, 65) r(i) GROUP BY near{n}.c, i) GROUP BY c),
c{n + 1} AS (SELECT k.c, coalesce(m.x, k.x) AS x FROM c{n} k LEFT JOIN mean{n} m ON m.c = k.c),"""


SQL = f"""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS HUGEINT)) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (
  SELECT sha256('1:' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h LIMIT 16)),{''.join(_round(n) for n in range(4))}
last AS (SELECT vec_id, c, d FROM near3)
SELECT vec_id, CAST(last.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY last.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(k.x, lambda e: CAST(e AS VARCHAR)), ',')) AS centroid_sha256
FROM last JOIN c3 k ON k.c = last.c
"""


@query("op11_clusters", SQL)
def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    return summary(*cluster(table(spark, sf_dir, "embeddings"), Scratch(spark)))
