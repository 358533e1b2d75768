"""op4: mixing all documents to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from airlattice.llm.common import Scratch
from airlattice.llm.mixing import BLOCK, SEED, SHARD_WORDS, mix
from airlattice.llm.queries import query, table

SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mark
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS idx, sum(source_size) OVER () AS total FROM s0),
s2 AS (SELECT *, CASE (idx - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s1),
s3 AS (SELECT *, coalesce(sum(source_size * 2) OVER (ORDER BY source_size / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
         sum(weight) OVER (ORDER BY source_size / weight, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest FROM s2),
s4 AS (SELECT *, total * 3 - stopped * 2 AS l, (total * 3 - stopped * 2) * weight < source_size * 4 * w_rest AS free FROM s3),
f AS (SELECT source_size / weight AS r, idx AS i, l, w_rest AS w FROM s4 WHERE free ORDER BY 1, 2 LIMIT 1),
src AS (
  SELECT source, source_size, idx, greatest(1, CAST(ceil(source_size / {SHARD_WORDS}) AS BIGINT)) AS n_shards,
         CASE WHEN f.r IS NULL OR source_size / weight < f.r OR (source_size / weight = f.r AND idx < f.i)
              THEN CAST(source_size * 2 AS DOUBLE)
              ELSE CAST(weight AS BIGINT) * CAST(f.l AS BIGINT) / (2.0::DOUBLE * CAST(f.w AS BIGINT)) END AS target
  FROM s4 LEFT JOIN f ON true),
spread AS (
  SELECT doc_id, size, mark, idx, CAST('0x' || substr(mark, 1, 8) AS BIGINT) % n_shards AS shard
  FROM sized JOIN src ON sized.source IS NOT DISTINCT FROM src.source),
shards AS (
  SELECT idx, shard, CAST(sum(size) AS BIGINT) AS shard_size, CAST(ceil(sum(size) / {BLOCK}) AS BIGINT) AS n_blocks
  FROM spread GROUP BY ALL HAVING sum(size) > 0),
votes AS (
  SELECT src.idx, target * n / source_size AS votes
  FROM src JOIN (SELECT idx, CAST(sum(n_blocks) AS BIGINT) AS n FROM shards GROUP BY idx) b ON b.idx = src.idx),
seats AS (SELECT CAST(round(sum(votes)) AS BIGINT) AS m, sum(votes) AS all_votes FROM votes),
quotients AS (
  SELECT idx, row_number() OVER (ORDER BY votes / (2 * k + 1) DESC, idx) AS place
  FROM (SELECT idx, votes, unnest(range(CAST(ceil(votes) AS BIGINT) + (SELECT count(*) FROM votes))) AS k FROM votes)),
won AS (SELECT idx, count(*) AS seats FROM quotients, seats WHERE place <= m GROUP BY idx),
shard_quotients AS (
  SELECT idx, shard, seats, row_number() OVER (PARTITION BY idx ORDER BY n_blocks / (2 * k + 1) DESC, shard) AS place
  FROM (SELECT s.idx, shard, n_blocks, seats, unnest(range(2 * n_blocks + 2)) AS k FROM shards s JOIN won ON won.idx = s.idx)),
quota AS (
  SELECT s.idx, s.shard, n_blocks, least(2 * n_blocks, coalesce(q, 0)) AS quota
  FROM shards s LEFT JOIN (SELECT idx, shard, count(*) AS q FROM shard_quotients WHERE place <= seats GROUP BY ALL) x
    ON x.idx = s.idx AND x.shard = s.shard),
placed AS (
  SELECT p.*, n_blocks AS n, quota, quota % n_blocks AS again,
         CAST('0x' || substr(md5('{SEED}|' || p.idx || '|' || p.shard), 1, 7) AS BIGINT) % n_blocks AS turn,
         p.stop - size AS start
  FROM (SELECT *, CAST(sum(size) OVER (PARTITION BY idx, shard ORDER BY mark, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
        FROM spread WHERE size > 0) p
  JOIN quota ON quota.idx = p.idx AND quota.shard = p.shard),
ends AS (
  SELECT *, stop // {BLOCK} AS k1, start // {BLOCK} AS k0 FROM placed),
picks AS (
  SELECT *, (k1 * again + turn) // n AS a1, ((k1 + 1) * again + turn) // n AS b1,
         (k0 * again + turn) // n AS a0, ((k0 + 1) * again + turn) // n AS b0 FROM ends),
taken AS (
  SELECT doc_id, size, idx, (quota // n) * size
         + a1 * {BLOCK} + (b1 - a1) * (stop - k1 * {BLOCK}) - a0 * {BLOCK} - (b0 - a0) * (start - k0 * {BLOCK}) AS taken
  FROM picks
  UNION ALL SELECT doc_id, size, idx, 0 FROM spread WHERE size = 0)
SELECT t.doc_id, CAST(t.size AS BIGINT) AS size, source, source_size, target, CAST(taken AS BIGINT) AS taken
FROM taken t JOIN src ON src.idx = t.idx
"""


@query("op4_mixing", SQL)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source, source_size, target, taken of every document."""
    return mix(table(spark, sf_dir, "documents"), Scratch(spark))
