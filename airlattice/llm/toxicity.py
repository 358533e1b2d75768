"""Toxicity by weak supervision: lexicon and pattern voters, a label model, a linear classifier.

1. Lexicons are learned: word and word-beginning hashes that mark toxic labelled texts, by kind.
2. Voters (one per lexicon kind and strength, plus patterns) vote toxic, clean or abstain on every text.
3. The label model is generative: a text has a hidden class, each voter votes by its own rates
   given the class. Expectation-maximisation over the counts of vote patterns of the whole
   corpus estimates the rates (accuracies); correlation beyond the class, measured in the
   same counts, shrinks the weight of voters that repeat each other.
4. A ridge logistic regression on lexicon hits and shape learns the posterior labels.

Defined cases: null and empty texts have no hits and get the score of a text without any; without
both labels every score is 0; ties are equal scores; repeated rows are separate rows; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlattice.llm.common import Scratch, rated, small_batches
from airlattice.llm.graph import Forest
from airlattice.llm.labelled import sample
from airlattice.llm.lexical import PREFIXES, Lookup, blocks, hashed_words, newton_logistic
from airlattice.llm.shingles import shingle_minima

PER_CLASS = 6000          # sampled labelled texts per class
LEXICON = 400             # entries per kind at most
KINDS = 1 + len(PREFIXES)
VOTERS = 2 * KINDS + 4    # per kind: strict and wide; repeated, dense, shouting, distinct hits
ABSTAIN, CLEAN, TOXIC = 0, 1, 2
SHAPE = 4


def hits(texts, lookups: list[Lookup]) -> tuple[list[list[tuple[int, int, int]]], np.ndarray]:
    """Of each text: (kind, entry, times) of the lexicon entries it holds; and how many words it has."""
    found: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    n_words = np.zeros(len(texts), np.int64)
    for block in blocks(texts):
        doc, runs, hashes = hashed_words(block)
        np.add.at(n_words, doc, 1)
        for kind, (own, h) in enumerate(zip(runs, hashes)):
            pos, entry = lookups[kind].find(h)
            for d, e in zip(doc[own[pos]].tolist(), entry.tolist()):
                found[d][kind, e] = found[d].get((kind, e), 0) + 1
    return [[(k, e, t) for (k, e), t in f.items()] for f in found], n_words


def independent(some: DataFrame) -> DataFrame:
    """The sampled texts with copies and near copies of one another removed: (doc_id, label, fake, text).

    Words of one text that was copied are no evidence of a lexicon. Two texts are taken as copies
    when they share both minima of one of four pairs of shingle hashes; ``fake`` deals the labels out
    anew at random, as a measure of what chance alone gives. The sample is bounded, and
    only its ids and hashes come to the driver.
    """
    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            low = [shingle_minima(t, 8) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "low": low})
    rows = (some.mapInPandas(sketch, "doc_id long, label int, low array<long>").toPandas()
            .sort_values("doc_id", ignore_index=True))
    forest, first = Forest(len(rows)), {}
    for i, low in enumerate(rows["low"]):
        for band in range(len(low) // 2):
            forest.union(first.setdefault((band, low[2 * band], low[2 * band + 1]), i), i)
    kept = rows[[forest.find(i) == i for i in range(len(rows))]].copy()
    kept["fake"] = np.random.default_rng(23).permutation(kept["label"].to_numpy())
    ids = some.sparkSession.createDataFrame(kept[["doc_id", "fake"]].astype({"doc_id": "int64", "fake": "int32"}),
                                            "doc_id long, fake int")
    return some.join(F.broadcast(ids), "doc_id")


def learn_lexicons(some: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per kind: hashes of the entries and their log-odds, from the labelled sample.

    Document counts by class of every feature, combined before the shuffle. An entry must tell
    the classes apart better (likelihood ratio) than any feature does under the
    labels dealt at random; the best ``LEXICON`` entries of a kind come to the driver.
    """
    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            label, fake = pdf["label"].to_numpy(np.int64), pdf["fake"].to_numpy(np.int64)
            parts: dict[int, list[pd.DataFrame]] = {k: [] for k in range(KINDS)}
            for block in blocks(pdf["text"].tolist()):
                doc, runs, hashes = hashed_words(block)
                for kind, (own, h) in enumerate(zip(runs, hashes)):
                    parts[kind].append(pd.DataFrame({"doc": doc[own], "h": h.view(np.int64)}).drop_duplicates())
            for kind, frames_of in parts.items():
                if frames_of:
                    each = pd.concat(frames_of).drop_duplicates()
                    each["toxic"], each["fake"], each["n"] = label[each["doc"]], fake[each["doc"]], 1
                    out = each.groupby("h", as_index=False)[["toxic", "fake", "n"]].sum()
                    out.insert(0, "kind", np.int32(kind))
                    yield out
    size = {r["label"]: r["n"] for r in some.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos or not neg:
        return []
    counted = (independent(some).mapInPandas(partial, "kind int, h long, toxic long, fake long, n long")
               .groupBy("kind", "h").agg(*[F.sum(c).alias(c) for c in ("toxic", "fake", "n")]))
    base = pos / (pos + neg)

    def ratio(t):
        rest = F.col("n") - t
        part = lambda k, p: F.when(k > 0, k * F.log(k / (F.col("n") * p))).otherwise(0.0)
        return F.when(t > F.col("n") * base, 2 * (part(t, base) + part(rest, 1 - base))).otherwise(0.0)
    # Odds as if one more clean text held it: rare entries must earn their place.
    odds = F.log((F.col("toxic") + 0.2) / (pos + 0.4)) - F.log((F.col("n") - F.col("toxic") + 1.0) / (neg + 1.0))
    scored = counted.select("kind", "h", "toxic", odds.alias("odds"), ratio(F.col("toxic")).alias("gain"),
                            ratio(F.col("fake")).alias("chance"))
    per_kind = scored.groupBy("kind").agg(F.max("chance").alias("chance_most"))
    best = (scored.join(F.broadcast(per_kind), "kind")
            .where("toxic >= 3 and odds > 3 and gain > chance_most")
            .withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("gain"), "h")))
            .where(F.col("place") <= LEXICON).collect())
    out = []
    for kind in range(KINDS):
        rows = [r for r in best if r["kind"] == kind]
        h = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
        w = np.array([r["odds"] for r in rows], np.float64)
        order = np.argsort(h)
        out.append((h[order], w[order]))
    return out


def votes(found: list[tuple[int, int, int]], n_words: int, shouted: bool, lexicons) -> np.ndarray:
    """The voters' opinions of one text.

    Per kind a strict voter (toxic on an entry of high odds, else clean) and a wide one (toxic on any
    entry, clean without, abstaining when all hits are weak). Patterns: hits repeated, hits
    dense among the words, shouted hits, several distinct hits; these abstain when unsure.
    """
    v = np.zeros(VOTERS, np.int8)
    times = np.zeros(KINDS)
    for kind in range(KINDS):
        odds = [lexicons[kind][1][e] for k, e, _ in found if k == kind]
        v[2 * kind] = TOXIC if odds and max(odds) > 4 else CLEAN
        v[2 * kind + 1] = CLEAN if not odds else TOXIC if sum(odds) > 4 else ABSTAIN
        times[kind] = sum(t for k, _, t in found if k == kind)
    most = int(times.max())
    v[-4] = TOXIC if most >= 3 else CLEAN if most == 0 else ABSTAIN
    v[-3] = TOXIC if n_words and most / n_words > 0.02 else CLEAN if most == 0 else ABSTAIN
    v[-2] = TOXIC if most and shouted else ABSTAIN
    v[-1] = TOXIC if len(found) >= 3 else CLEAN if not found else ABSTAIN
    return v


def shouting(text: str | None) -> bool:
    return bool(text) and text.isupper()


def label_model(patterns: np.ndarray, counts: np.ndarray, start: np.ndarray, prior: float,
                rounds: int = 50) -> dict:
    """EM over distinct vote patterns: class prior, vote rates by class, correlation weights.

    ``start`` is the first belief that a pattern is toxic. Correlation: for each pair of voters the
    agreement beyond what the class-wise rates predict, averaged over the patterns; a voter's
    log-likelihood counts 1 / (1 + sum of its excess agreements), so repeated voices share one.
    """
    v = patterns.shape[1]
    onehot = np.stack([(patterns == k) for k in (ABSTAIN, CLEAN, TOXIC)], 2).astype(float)
    q = start.astype(float)
    weight = np.full(v, 1.0 / 3)
    for step in range(rounds):
        rates = []
        for belief in (1 - q, q):
            c = counts * belief
            rates.append(((onehot * c[:, None, None]).sum(0) + 0.5) / (c.sum() + 1.5))
        prior = float(np.clip((counts * q).sum() / max(counts.sum(), 1), 1e-4, 0.9))
        if step == 2 or step == rounds // 2:
            excess = np.zeros((v, v))
            for belief, rate in zip((1 - q, q), rates):
                c = counts * belief
                expect = np.einsum("vk,wk->vw", rate, rate)
                seen = np.einsum("pvk,pwk,p->vw", onehot, onehot, c) / max(c.sum(), 1e-9)
                excess += 0.5 * np.clip((seen - expect) / np.maximum(1 - expect, 1e-6), 0, 1)
            np.fill_diagonal(excess, 0)
            weight = 1 / (1 + excess.sum(1))
        odds = np.log(prior / (1 - prior)) + ((np.log(rates[1]) - np.log(rates[0])) * onehot).sum(2) @ weight
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        if np.abs(new - q).max() < 1e-7 and step > rounds // 2:
            break
        q = new
    return {"prior": prior, "rates": rates, "weight": weight, "posterior": q}


def _row(found, n_words: int, lexicons, offsets: np.ndarray) -> np.ndarray:
    """Features of the linear classifier: entries present, and four sums that carry over to rare entries."""
    x = np.zeros(int(offsets[-1]) + SHAPE)
    for k, e, _ in found:
        x[offsets[k] + e] = 1.0
    odds = np.array([lexicons[k][1][e] for k, e, _ in found])
    x[-4] = min(4.0, odds.max() / 2) if len(odds) else 0.0
    x[-3] = np.log1p(len(found))
    x[-2] = np.log1p(odds.sum()) if len(odds) else 0.0
    x[-1] = min(1.0, 20 * sum(t for _, _, t in found) / max(1, n_words))
    return x


def learn(docs: DataFrame, labels: DataFrame, scratch: Scratch, *, label: str = "toxic",
          per_class: int = PER_CLASS) -> dict | None:
    """Fit everything; labels are used only from ``labels``, votes are counted over all texts."""
    small_batches(docs.sparkSession)
    some = scratch.save(sample(docs, labels, label, per_class), "toxic-sample")
    lexicons = learn_lexicons(some)
    if not lexicons:
        return None

    def vote(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookups = [Lookup(h) for h, _ in lexicons]
        total: dict[bytes, int] = {}
        for pdf in frames:
            texts = pdf["text"].tolist()
            found, n = hits(texts, lookups)
            for f, k, t in zip(found, n, texts):
                p = votes(f, int(k), shouting(t), lexicons).tobytes()
                total[p] = total.get(p, 0) + 1
        yield pd.DataFrame({"pattern": list(total), "n": list(total.values())})
    # Distinct patterns are few (the voters share their lexicons); their counts come to the driver.
    rows = (docs.select("text").mapInPandas(vote, "pattern binary, n long")
            .groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect())
    patterns = np.array([np.frombuffer(bytes(r["pattern"]), np.int8) for r in rows])
    counts = np.array([r["n"] for r in rows], float)
    said = (patterns == TOXIC).sum(1)
    start = np.clip(said / 4, 0.02, 0.98)
    model = label_model(patterns, counts, start, 0.1)
    belief = {p.tobytes(): float(q) for p, q in zip(patterns, model["posterior"])}

    texts = some.select("doc_id", "text").orderBy("doc_id").toPandas()["text"].tolist()   # bounded sample
    lookups = [Lookup(h) for h, _ in lexicons]
    found, n = hits(texts, lookups)
    offsets = np.cumsum([0, *[len(h) for h, _ in lexicons]])
    x, y = [], []
    for f, k, t in zip(found, n, texts):
        x.append(_row(f, int(k), lexicons, offsets).astype(np.float32))
        y.append(belief.get(votes(f, int(k), shouting(t), lexicons).tobytes(), model["prior"]))
    x, y = np.vstack(x).astype(np.float64), np.array(y)
    w = newton_logistic(x, y, ridge=0.3)
    return {"lexicons": lexicons, "offsets": offsets, "w": w, "label_model": model}


def predict(docs: DataFrame, model: dict | None, *extra: Column) -> DataFrame:
    """doc_id, extra columns, score and predicted of every whole text."""
    if model is not None:
        lexicons, offsets, w = model["lexicons"], model["offsets"], model["w"]

    def scorer():
        lookups = [Lookup(h) for h, _ in lexicons] if model is not None else []

        def score(texts: list[str | None]) -> list[pa.Array]:
            p = np.zeros(len(texts))
            if model is not None:
                found, n = hits(texts, lookups)
                for i, (f, k) in enumerate(zip(found, n)):
                    z = float(_row(f, int(k), lexicons, offsets) @ w[:-1] + w[-1]) if f else float(w[-1])
                    p[i] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            return [pa.array(p), pa.array((p >= 0.3).astype(np.int32))]
        return score
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *extra, "text")
    return rated(rows, "score double, predicted int", scorer)
