"""Importance resampling towards a target distribution, by hashed n-grams.

A document's features are its runs of one to ``ngram`` words; each falls in a bucket. A bucket's gain is the log ratio of its
smoothed share of the target's features to its share of the corpus'. A document's weight is the mean gain of
its features; with Gumbel noise from its id added, the highest scores are a draw without replacement in proportion to the weights.

The n-grams of a batch are interned in an open-addressed table (``interning``). The first pass adds up the counts of
the slots by bucket in each task; only one number per bucket and task is shuffled. In the second the gains are looked up once
per slot and gathered by the occurrences' slot ids. Ranks need no global sort: counts per score
(whose range is bounded by the gains and the noise) give the rank before each score, and rows are ordered
only among equal scores.

Defined cases: null, empty and wordless texts have no feature and weight 0; a null id counts as empty text for the noise and comes
after all ids; rows that repeat an id share its noise and are ranked by features, then weight; an
empty target gives gains by the corpus' shares alone; an empty table gives an empty result; other
columns are ignored. Long texts are cut between words; no n-gram is lost or counted twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlattice.llm.common import Scratch, small_batches
from airlattice.llm.interning import Interned, blocks

BUCKETS = 10_000


def bucket_counts(texts: DataFrame, ngram: int, buckets: int) -> np.ndarray:
    """Features of all texts per bucket."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in blocks(batch["text"].cast(pa.binary()).to_pylist()):
                held = Interned(block, ngram, buckets)
                taken = np.flatnonzero(held.count)
                np.add.at(total, held.bucket[taken], held.count[taken])
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["bucket", "n"])
    found = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[r["bucket"]] = r["n"]
    return found


def gains(corpus: np.ndarray, target: np.ndarray, buckets: int) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) per bucket."""
    of, to = float(corpus.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log((t + 1) * of / ((s + 1) * to))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, ngram: int) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    buckets = len(gain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for block in blocks(batch["text"].cast(pa.binary()).to_pylist()):
                held = Interned(block, ngram, buckets)
                words += np.bincount(held.words, minlength=batch.num_rows)
                n += np.bincount(held.row, minlength=batch.num_rows)
                np.add.at(total, held.row, gain[held.bucket][held.slot])
            yield pa.record_batch([batch["doc_id"], pa.array(words), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))],
                                  names=["doc_id", "n_words", "n_features", "weight"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        work, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, scratch: Scratch, *, ngram: int = 2, buckets: int = BUCKETS, least_words: int = 20,
             percent: int = 25, seed: int = 7) -> DataFrame:
    """(doc_id, text) and (text) -> doc_id, n_features, weight, score, rank (null: not drawn)."""
    small_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs, ngram, buckets), bucket_counts(target, ngram, buckets), buckets)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = scratch.save(weigh(docs, gain, ngram).withColumn("score", F.col("weight") + noise), "weighed")
    able = F.col("n_words") >= least_words
    at = rows.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    at = at.withColumn("before", F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n"))
    quota = percent * rows.where(able).count() // 100
    # Gains and noise are logarithms of bounded numbers, so there are about 100,000 scores at most.
    at = F.broadcast(scratch.save(at.where(F.col("before") < quota).select("score", "before"), "score-counts"))
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight")
    near = rows.where(able).join(at, "score").withColumn("rank", F.col("before") + F.row_number().over(order))
    columns = ["doc_id", "n_features", "weight", "score"]
    near = near.select(*columns, F.when(F.col("rank") <= quota, F.col("rank")).alias("rank"))
    rest = rows.join(at, (rows["score"] == at["score"]) & able, "left_anti").select(*columns, F.lit(None).cast("long").alias("rank"))
    return near.unionByName(rest)
