"""op13: passages of at least 50 bytes that an earlier document holds, removed from all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlattice.llm.common import Scratch
from airlattice.llm.queries import query, table
from airlattice.llm.repeats import without_repeats

# Two hexadecimal digits are one byte; ``p`` counts bytes from 0.
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT r, doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM d, range(0, greatest(length(h) // 2 - 49, 0)) t(p)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT w.r, w.p, lag(w.p) OVER (PARTITION BY w.r ORDER BY w.p) AS before FROM w JOIN f ON f.s = w.s AND f.first < w.doc_id),
run AS (SELECT r, p, sum(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS g FROM hit),
span AS (SELECT r, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY r, g),
piece AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS c FROM span),
cut AS (SELECT d.r, count(*) AS n_spans, sum(b - a) AS n_removed,
          string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
        FROM piece JOIN d ON d.r = piece.r GROUP BY d.r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut ON cut.r = d.r
"""


@query("op13_repeats", SQL)
def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    found = without_repeats(table(spark, sf_dir, "documents"), Scratch(spark), length=50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
