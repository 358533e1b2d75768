"""Reading-file scans (S1) and bulk backfill of dropped files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlattice.operators import clean


def read_readings(spark: SparkSession, path: str, schema, fmt: str = "csv", time_col: str = "time",
                  keys: list[str] | None = None) -> DataFrame:
    """Scan reading files with a fixed schema; ``time`` (epoch seconds) becomes a
    timestamp (bad values -> null) and full duplicates are removed. With ``keys``, of the
    rows of one reading the last one stays: by file time, then file name, then place in
    the file. Sorting is left to the sink."""
    reader = spark.read.schema(schema)
    df = reader.option("header", "true").csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    if keys is None:
        return df.withColumn("ts", clean.to_ts(time_col)).dropDuplicates()
    placed = df.select("*", F.col("_metadata.file_modification_time").alias("_mtime"), F.col("_metadata.file_path").alias("_file"),
                       F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    last = clean.latest_per_key(placed, keys + [time_col], ["_mtime", "_file", "_block", "_row"])
    return last.select(*df.columns).withColumn("ts", clean.to_ts(time_col))


PATH_KEYS = {"sensor": r"sensor=([^/]+)", "collection": r"collection=([^/]+)"}


def backfill(spark: SparkSession, root: str, schema, path_keys: dict[str, str] | None = None) -> DataFrame:
    """Every reading file below ``root``; the collection (and the sensor, where files
    are kept per sensor) come from the file's path (``_metadata.file_path``), so no
    listing loop runs on the driver. ``path_keys``: column -> pattern of its part."""
    path_keys = PATH_KEYS if path_keys is None else path_keys
    df = (spark.read.schema(schema).option("header", "true").option("recursiveFileLookup", "true")
               .csv(root).select("*", F.col("_metadata.file_path").alias("_path")))
    return df.select(*[F.regexp_extract("_path", pattern, 1).alias(c) for c, pattern in path_keys.items()],
                     *[c for c in df.columns if c != "_path"])
