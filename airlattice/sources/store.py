"""Keyed table store (S6, S10-S13, S15-S16) over DataFrames and parquet folders.

The reference keeps documents in a document store and CSV copies; here a store is a
parquet folder partitioned by a coarse key (city), and every operation is a
DataFrame plan: upsert = union + newest-per-key, delete = left anti join, lookup =
pushed-down equality filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlattice.operators import clean

# Partitions of a store that one batch may name in a filter; above, they are joined.
MAX_PARTITION_FILTER = 1000


def newest(new: DataFrame, keys: list[str], order=None) -> DataFrame:
    """One row per key of an incoming batch: the latest by ``order`` (ingest order).

    Without an ingest order, or on ties in it, the largest row by its values wins, so
    the result never depends on how the rows were read.
    """
    first = [] if order is None else [order] if isinstance(order, str) else list(order)
    rest = [c for c in new.columns if c not in keys and c not in first
            and new.schema[c].dataType.typeName() not in ("map", "variant")]
    return clean.latest_per_key(new, keys, first + rest) if first + rest else new.dropDuplicates(keys)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], mode: str = "replace", order=None) -> DataFrame:
    """Insert new keys, and for existing keys either replace the whole row
    (``mode='replace'``, document-store behaviour) or merge fields, keeping stored
    values where the new record has none (``mode='merge'``). A key that ``new`` repeats
    is first reduced to its newest record (``order``), in both modes."""
    new = newest(new, keys, order)
    if mode == "replace":
        both = stored.withColumn("_src", F.lit(0)).unionByName(
            new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
        return clean.latest_per_key(both, keys, "_src").drop("_src")
    if mode == "merge":
        s, n = stored.alias("s"), new.alias("n")
        joined = s.join(n, on=[F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], how="full_outer")
        cols = [c for c in stored.columns if c not in keys]
        extra = [c for c in new.columns if c not in keys and c not in cols]
        return joined.select(*[F.coalesce(F.col(f"s.{k}"), F.col(f"n.{k}")).alias(k) for k in keys],
                             *[F.coalesce(F.col(f"n.{c}"), F.col(f"s.{c}")).alias(c)
                               if c in new.columns else F.col(f"s.{c}") for c in cols],
                             *[F.col(f"n.{c}") for c in extra])
    raise ValueError(f"unknown upsert mode {mode!r}")


def find(df: DataFrame, filter: dict | None = None, exclude=(), one: bool = False,
         order: list[str] | None = None) -> DataFrame:
    """Rows matching every ``column == value`` pair, minus ``exclude`` columns.

    ``one=True`` returns at most the first match in ``order`` (load order)."""
    out = df
    if filter:
        out = out.filter(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in filter.items()]))
    if one:
        out = (out.orderBy(*order) if order else out).limit(1)
    return out.drop(*exclude) if exclude else out


def delete(df: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    """Drop rows whose key appears in ``doomed`` (null keys match null keys)."""
    gone = doomed.select(*[F.col(k).alias(f"_gone_{k}") for k in keys]).distinct()
    return df.join(gone, on=[F.col(k).eqNullSafe(F.col(f"_gone_{k}")) for k in keys], how="left_anti")


def insert(df: DataFrame, path: str, partition_by: list[str] | None = None,
           with_id: str | None = None) -> None:
    """Append rows; ``with_id`` adds a generated unique id column."""
    if with_id:
        df = df.withColumn(with_id, F.expr("uuid()"))
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_sorted(df: DataFrame, path: str, keys: list[str], order: str, partition_by: list[str] | None = None) -> None:
    """Rows of a series together and by ``order`` in their file: one shuffle by the
    series, a sort inside each task, no global sort."""
    ordered = df.repartition(*(partition_by or []), *keys).sortWithinPartitions(*(partition_by or []), *keys, order)
    writer = ordered.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, asked of the path's own Hadoop file system (local,
    HDFS or object store alike)."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def read_store(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """Read a store folder; None when it does not exist yet."""
    if not path_exists(spark, path):
        return None
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def same_partitions(stored: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """The part of a store that lies in the partitions ``new`` names: a partition filter
    while these are few (pruned before any file is opened), a semi join otherwise."""
    named = new.select(*columns).distinct()
    rows = named.limit(MAX_PARTITION_FILTER + 1).collect()
    if len(rows) > MAX_PARTITION_FILTER:
        return stored.join(named, [stored[c].eqNullSafe(named[c]) for c in columns], "left_semi")

    def one(row) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(row[c]).cast(stored.schema[c].dataType)) for c in columns])
    if len(columns) == 1:
        values = [r[0] for r in rows if r[0] is not None]
        hit = F.col(columns[0]).isin(values) if values else F.lit(False)
        return stored.filter(hit | F.col(columns[0]).isNull() if len(values) < len(rows) else hit)
    return stored.filter(reduce(lambda a, b: a | b, map(one, rows))) if rows else stored.limit(0)


def append_new(spark: SparkSession, new: DataFrame, path: str, keys: list[str],
               partition_by: list[str] | None = None, order=None) -> None:
    """Append only rows whose key is not stored yet (exactly-once by key).

    The batch is reduced to the newest row per key, and keys compare null-safe, so a
    replay adds nothing even where a key is null. Partition columns that belong to the
    key bound the look-up: only the partitions that the batch names are read, and of
    these the key columns only. The write is the action.
    """
    new = newest(new, keys, order)
    stored = read_store(spark, path)
    if stored is not None:
        bound = [c for c in partition_by or [] if c in keys]
        known = same_partitions(stored, new, bound) if bound else stored
        new = clean.unseen(new, known, keys)
    insert(new, path, partition_by)


def overwrite(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite only the partitions present in ``df`` (dynamic partition overwrite)."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
