"""op2: all pages written to WARC archives, read back, and indexed in global order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlattice.llm.common import Scratch
from airlattice.llm.queries import query, table
from airlattice.llm.warc import capture_history

# Captures a second apart, in the order of their ids; the pages carry no time of their own.
EPOCH = 1_700_000_000


_CHUNK = "CAST('0x' || substr(hex, {0}, 5) AS INTEGER)"
# Five hexadecimal digits are four base-32 digits; the alphabet is a fixed value.
_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_CHUNK.format(5 * i + 1)} >> {shift}) & 31) + 1, 1)"
                      for i in range(8) for shift in (15, 10, 5, 0))

SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, url, octet_length(body) AS payload_bytes, {_DIGITS} AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d),
h AS (SELECT *, regexp_replace(split_part(url, '#', 1), '^[^/]*?://', '') AS rest FROM f),
n AS (SELECT *, regexp_extract(rest, '^[^/?]*') AS host,
             list_filter(string_split(lower(regexp_extract(rest, '^[^/?:]*')), '.'), lambda x: x <> '') AS labels FROM h),
k AS (SELECT *, array_to_string(list_reverse(CASE WHEN len(labels) > 2 AND labels[1] = 'www' THEN labels[2:] ELSE labels END), ',')
             || ')/' || regexp_replace(substr(rest, length(host) + 1), '^/', '') AS url_key,
             make_timestamp(({EPOCH} + page_id % 1000000000) * 1000000) AS captured FROM n)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, url_key, captured, 0 AS range,
       CAST(row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS INTEGER) AS position
FROM k
"""


# The SQL numbers one key range: up to RANGE_ROWS pages, as in the tables it is compared on.
@query("op2_warc", SQL)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; the place in the merged index follows."""
    pages = table(spark, sf_dir, "pages")
    scratch = Scratch(spark)
    history = capture_history(pages.select(
        F.col("page_id").cast("long").alias("id"), "url", F.col("html").alias("payload"),
        F.timestamp_seconds(F.lit(EPOCH) + F.coalesce("page_id", F.lit(0)) % 1_000_000_000).alias("captured")), scratch)
    scratch.close(keep=("history",))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                          "url_key", "captured", "range", "position")
