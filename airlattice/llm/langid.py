"""Language identification: nearest TF-IDF character n-gram centroids by cosine.

Texts are lower-cased, everything but letters becomes one gap, and n-grams of 1 to 3 letters
are hashed to ``DIM`` bins. Weights are (1 + log tf) * idf with idf from all training texts;
every language has several centroids, found by spherical k-means on a bounded sample.

Defined cases: a null text, an empty one and one without a letter are ``und`` with score 0;
texts with a null language are never learned from; without any training text everything is
``und``; ties between languages go to the lower name; repeated rows are separate rows; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlattice.llm.common import rated, small_batches

DIM = 4096
PER_LANGUAGE = 400     # sampled training texts per language for the centroids
CENTROIDS = 4          # per language
TEMPERATURE = 0.05
REJECT_QUANTILE = 0.001
BLOCK = 1 << 18        # code points worked on at once


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> is it a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _count(text: str) -> np.ndarray:
    """n-gram counts of one whole text, block by block (blocks overlap by two letters)."""
    total = np.zeros(DIM, np.int64)
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    tail = np.zeros(1, np.uint64)
    for start in range(0, len(code), BLOCK):
        c = code[start:start + BLOCK]
        c = np.where(_letters()[c], c, 0)
        if start + BLOCK >= len(code):
            c = np.append(c, 0)
        c = c[np.append(True, (c[1:] != 0) | (c[:-1] != 0))].astype(np.uint64)
        if tail[-1] == 0 and len(c) and c[0] == 0:
            c = c[1:]
        x = np.concatenate([tail, c])
        new = len(tail)
        m1, m2, m3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
        one = x * m1
        grams = [one[new:][x[new:] != 0]]
        lo = max(1, new)
        two = one[lo:] + x[lo - 1:-1] * m2
        grams.append(two + np.uint64(1))
        if len(x) > 2:
            lo3 = max(2, new)
            mid = x[lo3 - 1:-1] != 0
            grams.append((one[lo3:] + x[lo3 - 1:-1] * m2 + x[lo3 - 2:-2] * m3 + np.uint64(2))[mid])
        h = np.concatenate(grams)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        total += np.bincount((h >> np.uint64(52)).astype(np.int64), minlength=DIM)
        tail = x[-2:]
    return total


def counts(text: str | None) -> np.ndarray | None:
    """n-gram counts, or None for a text without any letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    return _count(text)


def vector(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0.0) * idf
    size = np.linalg.norm(v)
    return (v / size if size else v).astype(np.float32)


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many training texts each bin occurs, over all of them: one partial vector per task."""
    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(DIM + 1, np.int64), 0
        for pdf in frames:
            for text in pdf["text"]:
                tf = counts(text)
                if tf is not None:
                    df[:DIM] += tf > 0
                    n += 1
        df[DIM] = n
        used = np.flatnonzero(df)
        yield pd.DataFrame({"bin": used.astype(np.int32), "n": df[used]})
    out = np.zeros(DIM + 1, np.int64)
    for row in train.select("text").mapInPandas(partial, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        out[row["bin"]] = row["n"]     # DIM + 1 rows at most
    return out[:DIM], int(out[DIM])


def cluster(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Spherical k-means; the start is one far point after another."""
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    c = x[[int(rng.integers(len(x)))]]
    while len(c) < k:
        c = np.vstack([c, x[np.argmin((x @ c.T).max(1))]])
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        for j in range(k):
            if (own == j).any():
                m = x[own == j].sum(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def fit(train: DataFrame, *, lang: str = "lang", per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> dict:
    """(doc_id, text, lang) -> names, idf, centroids, the centroids' languages and rejection bounds.

    idf covers every training text; the centroids come from a seeded sample of at most about
    ``per_language`` texts of each language, clustered in one task per language.
    """
    train = train.where(F.col(lang).isNotNull()).select("doc_id", "text", F.col(lang).alias("lang"))
    df, n = document_frequencies(train)
    idf = np.log((n + 1) / (df + 1)) + 1
    sizes = train.groupBy("lang").agg((F.lit(float(per_language)) / F.count(F.lit(1))).alias("part"))
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    some = (train.withColumn("draw", draw).join(F.broadcast(sizes), "lang").where("draw < part")
            .select("lang", "text"))

    def centres(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = [vector(tf, idf) for tf in map(counts, pdf["text"]) if tf is not None]
        if not x:
            return pd.DataFrame({"lang": [], "centroid": [], "low": []})
        x = np.vstack(x)
        c = cluster(x, centroids)
        low = float(np.quantile((x @ c.T).max(1), REJECT_QUANTILE)) * 0.8
        return pd.DataFrame({"lang": [key[0]] * len(c), "centroid": [r.tolist() for r in c], "low": low})
    rows = some.groupBy("lang").applyInPandas(centres, "lang string, centroid array<float>, low double").collect()
    rows.sort(key=lambda r: (r["lang"], r["centroid"]))
    names = sorted({r["lang"] for r in rows})
    return {"names": names, "idf": idf,
            "centroids": np.array([r["centroid"] for r in rows], np.float32).reshape(-1, DIM),
            "own": np.array([names.index(r["lang"]) for r in rows], np.int64),
            "low": np.array([next(r["low"] for r in rows if r["lang"] == m) for m in names])}


def predict(docs: DataFrame, model: dict, *extra: Column) -> DataFrame:
    """doc_id, lang_pred, score and rejected (too far from every centroid) of every text."""
    names, idf = model["names"], model["idf"].astype(np.float64)
    centroids, own, low = model["centroids"], model["own"], model["low"]

    def score(texts: list[str | None]) -> list[pa.Array]:
        best, conf, far = [], [], []
        for text in texts:
            tf = counts(text) if names else None
            if tf is None:
                best.append("und"), conf.append(0.0), far.append(True)
                continue
            near = centroids @ vector(tf, idf)
            each = np.array([near[own == j].max() for j in range(len(names))], np.float64)
            j = int(np.argmax(each))
            p = np.exp((each - each[j]) / TEMPERATURE)
            best.append(names[j]), conf.append(float(p[j] / p.sum())), far.append(bool(each[j] < low[j]))
        return [pa.array(best, pa.string()), pa.array(conf, pa.float64()), pa.array(far, pa.bool_())]
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *extra, "text")
    return rated(rows, "lang_pred string, score double, rejected boolean", lambda: score)


def identify(docs: DataFrame, train: DataFrame, *extra: Column) -> DataFrame:
    small_batches(docs.sparkSession)
    return predict(docs, fit(train), *extra)
