"""op12: documents resampled towards the benchmark's word pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from airlattice.llm.common import Scratch
from airlattice.llm.queries import query, table
from airlattice.llm.resample import resample

# crc32 works on the bits of the UTF-8 bytes, lowest first.
SQL = """
WITH texts AS (
  SELECT 's' AS side, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 't', row_number() OVER (), text FROM benchmark),
ids AS (SELECT row_number() OVER () AS r, doc_id FROM documents),
w AS (SELECT side, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
f AS (SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM w),
c AS (SELECT side, r, g, count(*) AS n FROM f GROUP BY side, r, g),
h AS (SELECT DISTINCT g, hex(encode(g)) AS x FROM c),
b AS (SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, 4 * length(x)), lambda i:
        (CAST('0x' || substr(x, 1 + 2 * (i // 8), 2) AS BIGINT) >> (i % 8)) & 1)),
        lambda a, bit: CASE WHEN xor(a, bit) & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 10000 AS bucket FROM h),
n AS (SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t
      FROM c JOIN b ON b.g = c.g GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM n),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST(n.t + 1 AS DOUBLE) * CAST(total.s + 10000 AS DOUBLE)
           / (CAST(n.s + 1 AS DOUBLE) * CAST(total.t + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM n, total),
sums AS (SELECT r, sum(n) AS k, sum(n * gain) AS g FROM c JOIN b ON b.g = c.g JOIN gain ON gain.bucket = b.bucket WHERE side = 's' GROUP BY r),
doc AS (SELECT ids.r, doc_id, len(w) AS words, CAST(coalesce(k, 0) AS BIGINT) AS n_features,
          CAST(CASE WHEN k > 0 THEN (g - ((g % k) + k) % k) // k ELSE 0 END AS BIGINT) AS weight,
          CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
        FROM ids JOIN w ON w.r = ids.r AND w.side = 's' LEFT JOIN sums ON sums.r = ids.r),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM doc),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS rank, count(*) OVER () AS n FROM scored WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked ON ranked.r = scored.r
"""


@query("op12_resample", SQL)
def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark))
