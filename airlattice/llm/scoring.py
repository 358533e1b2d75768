"""LM scoring by subword lattice likelihood.

A word is spelled by the pieces of an existing vocabulary in every possible way; its probability is the
sum over all segmentations, by forward recursion in log space. No piece spans two words, so
the marginal probability of a text is the product over its words and one end. The vocabulary's
own scores weight the segmentations; their counts over the training words (one
expectation step, smoothed towards those scores) give the final piece probabilities. The baseline
is the add-one unigram over whole words.

Each distinct word is evaluated once. Words with at least a ``HEAVY``-th of all training tokens, at most so
many, are sent to the tasks; the others are joined by word.

Defined cases: null, empty and wordless texts are one end token; without training texts all
counts are 0 and the pieces keep the vocabulary's scores; a null id counts as empty text for the
fold; repeated rows are separate rows; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlattice.llm.common import Scratch, small_batches, words
from airlattice.llm.lattice import Vocabulary, marginals, prior

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
HEAVY = 200_000          # words at most that travel to every task
TOGETHER = 32_768        # distinct words evaluated together
HELD = 250_000           # distinct words counted in a task before they are handed on
STRENGTH = 50_000.0      # tokens that the vocabulary's own scores count for
LN10 = float(np.log(10))


def count_words(docs: DataFrame, train: Column) -> DataFrame:
    """(word, c): every distinct word of all texts with its count in training texts."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned: Counter = Counter()
        others: set[bytes] = set()

        def out() -> pa.RecordBatch:
            more = [w for w in others if w not in learned]
            return pa.record_batch([
                pa.array([w.decode("utf-8", "replace") for w in itertools.chain(learned, more)], pa.string()),
                pa.array(itertools.chain(learned.values(), [0] * len(more)), pa.int64())], names=["word", "c"])
        for batch in batches:
            for text, learn in zip(batch["text"].to_pylist(), batch["learn"].to_pylist()):
                (learned if learn else others).update(words(text))
            if len(learned) + len(others) > HELD:
                yield out()
                learned.clear()
                others.clear()
        yield out()
    return (docs.select("text", train.alias("learn")).mapInArrow(work, "word string, c long")
            .groupBy("word").agg(F.sum("c").alias("c")))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Larger batches, so that words of one length are many; bounded in rows and bytes."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        size += batch.nbytes
        if rows >= TOGETHER or size >= 64 * TOGETHER:
            yield pa.concat_batches(held)
            held, rows, size = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def learn_pieces(lexicon: DataFrame, vocabulary: Vocabulary, ends: int) -> tuple[Vocabulary, float]:
    """Vocabulary with probabilities re-estimated from the training words, and the end's log-probability."""
    pieces, byte_ids, logp = vocabulary.pieces, vocabulary.byte_ids, vocabulary.logp[:-1]

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(pieces, byte_ids, logp)
        expected = np.zeros(len(pieces))
        for batch in gathered(batches):
            marginals(batch["word"].to_pylist(), v, batch["c"].to_numpy().astype(float), expected)
        used = np.flatnonzero(expected)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(expected[used])], names=["piece", "n"])
    rows = lexicon.where("c > 0").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    expected = np.zeros(len(pieces))       # one number per piece of a fixed vocabulary
    for r in rows:
        expected[r["piece"]] = r["n"]
    # The end is one more event; alone, it has the vocabulary's mean word probability.
    total = expected.sum() + ends + STRENGTH
    with np.errstate(divide="ignore"):
        new = np.log((expected + STRENGTH * 0.9 * np.exp(logp)) / total)
    return Vocabulary(pieces, byte_ids, new), float(np.log((ends + STRENGTH * 0.1) / total))


def score(docs: DataFrame, held_out: Column, scratch: Scratch, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    small_batches(docs.sparkSession)
    out = F.coalesce(held_out, F.lit(False))
    ends = docs.where(~out).count()
    lexicon = scratch.save(count_words(docs, ~out), "words")
    sums = lexicon.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, v = (sums["n"] or 0) + ends, sums["v"] + (1 if ends else 0)
    pieces, end = learn_pieces(lexicon, prior(vocabulary), ends)
    names, byte_ids, logp = pieces.pieces, pieces.byte_ids, pieces.logp[:-1]
    floor = float(n + v + 1)

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(names, byte_ids, logp)
        for batch in gathered(batches):
            base = np.log10((batch["c"].to_numpy().astype(float) + 1) / floor)
            lm = marginals(batch["word"].to_pylist(), own) / LN10
            yield pa.record_batch([batch["word"], batch["c"], pa.array(base), pa.array(lm)],
                                  names=["word", "c", "base", "lm"])
    valued = scratch.save(lexicon.mapInArrow(value, "word string, c long, base double, lm double"), "valued")
    scratch.drop("words")
    # At most HEAVY words hold a HEAVY-th of the training tokens each.
    heavy = {r["word"].encode(): (r["c"], r["base"], r["lm"]) for r in
             valued.where(F.col("c") >= max(1, -(-n // HEAVY))).collect()}

    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                        ("known", pa.int64()), ("base", pa.float64()), ("lm", pa.float64()),
                        ("word", pa.string()), ("n", pa.int64())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            heads, rows, rest, times = [], [], [], []
            for doc, held, text in zip(*[batch[c].to_pylist() for c in ("doc_id", "held_out", "text")]):
                known, base, lm, size = 0, 0.0, 0.0, 0
                for w, k in Counter(words(text)).items():
                    size += k
                    hit = heavy.get(w)
                    if hit is None:
                        rows.append(row), rest.append(w.decode("utf-8", "replace")), times.append(k)
                    else:
                        known += k
                        base += k * hit[1]
                        lm += k * hit[2]
                heads.append((row, doc, held, size, known, base, lm, None, 0))
                row += 1
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*heads), schema)], schema=schema)
            own = {"row": rows, "word": rest, "n": times}
            yield pa.record_batch([pa.array(own[f.name], f.type) if f.name in own else pa.nulls(len(rows), f.type)
                                   for f in schema], schema=schema)
    parts = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text").mapInArrow(
        split, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, lm double, word string, n long"),
        "split")
    rare = (parts.where("word IS NOT NULL").select("row", "word", "n")
            .join(valued.hint("shuffle_hash"), "word").groupBy("row")
            .agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"),
                 F.sum(F.col("n") * F.col("base")).alias("base_rest"), F.sum(F.col("n") * F.col("lm")).alias("lm_rest")))
    end_base = float(np.log10((ends + 1) / floor))
    zero = F.lit(0.0)
    found = parts.where("word IS NULL").drop("word", "n").join(rare, "row", "left").select(
        "doc_id", "held_out", (F.col("n_tokens") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0)) + (1 if ends else 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rest", zero) + end_base).alias("base_score"),
        (F.col("lm") + F.coalesce("lm_rest", zero) + end / LN10).alias("score"))
    found = scratch.save(found, "scores")
    scratch.close(keep=("scores",))
    return found
