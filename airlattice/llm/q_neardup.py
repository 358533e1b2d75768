"""op3: near-duplicate components of all documents (4-word shingles, similarity 0.8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from airlattice.llm.common import Scratch
from airlattice.llm.neardup import near_duplicates
from airlattice.llm.queries import query, table


SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1),
                          lambda i: array_to_string(w[i:i + 3], ' '))) END AS sh FROM t),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
b AS (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS shared FROM e l JOIN e r ON l.x = r.x AND l.doc_id <> r.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT n.doc_id, n.n AS n_shingles, min(reach.b) AS component_id, n.doc_id = min(reach.b) AS kept
FROM n JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n
"""


@query("op3_neardup", SQL)
def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark), words=4, percent=80)
