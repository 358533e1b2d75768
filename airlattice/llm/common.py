"""Helpers shared by the corpus operators: words, folds, saved tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from airlattice.session import delete_at_exit, ensure_checkpoint_dir, ship_package

# A word is a run of anything but space, tab, newline, vertical tab, form feed and return.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
# Rows of one Arrow batch: documents may be very long, so batches stay small.
BATCH_ROWS = 256


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased (other letters keep their case); null has none.

    ``bytes.lower`` and ``bytes.split`` work on ASCII only, which is exactly the rule.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % modulus


def small_batches(spark: SparkSession) -> None:
    """Before Python tasks over texts: ship the package, keep Arrow batches small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def rated(rows: DataFrame, results: str, rate: Callable[[], Callable[[list[str | None]], list[pa.Array]]]) -> DataFrame:
    """All columns but ``text``, as they are, and the columns ``results`` that a function of the texts gives.

    ``rate`` is called once a task. The other columns stay Arrow arrays: numbers keep all their digits beside nulls.
    """
    keep = [f for f in rows.schema.fields if f.name != "text"]
    more = StructType.fromDDL(results)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = rate()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], *of(batch.column("text").to_pylist())],
                                             names=[f.name for f in [*keep, *more.fields]])
    return rows.mapInArrow(work, StructType([*keep, *more.fields]))


def kept(docs: DataFrame, choose: Callable[[list[str | None]], np.ndarray]) -> DataFrame:
    """The rows whose texts are chosen, with all their columns as they are."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(np.asarray(choose(batch.column("text").to_pylist()), bool)))
    return docs.mapInArrow(work, docs.schema)


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = "_" + name
    return name


class Scratch:
    """Tables written to the shared checkpoint folder; ``drop`` removes those not kept, and what is
    left goes when the application ends.

    A saved table cuts the lineage: it survives the loss of any executor, and whatever
    is read from it later is read the same way again.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        self.made: dict[str, str] = {}
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        self.made[name] = f"{self.root}/{self.count:03d}-{name}"
        return self.made[name]

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back; an earlier table of this name is removed afterwards."""
        old = self.made.get(name)
        path = self.path(name)
        df.write.parquet(path)
        delete_at_exit(self.spark, path)
        if old:
            self._remove(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.made:
                self._remove(self.made.pop(name))

    def close(self, keep: tuple[str, ...] = ()) -> None:
        self.drop(*[n for n in self.made if n not in keep])

    def _remove(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
