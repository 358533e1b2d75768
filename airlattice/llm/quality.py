"""Quality classifier: Bradley-Terry scores from preference pairs, cut at a score quantile.

A labelled good text is preferred to a labelled bad one. The strength of a text is linear in its
features, and the weights minimise the logistic loss of feature differences over all pairs of a
good and a bad text, summed through moments by strength. The quantile of the labelled strengths that separates the classes best becomes the
cut; the reported score is a logistic curve that passes 0.3 exactly there.

Defined cases: null and empty texts are scored from zero features; without both labels every
score is the share of label 1 (0.5 without labels); ties of strength get equal scores; repeated
rows are separate rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlattice.llm.common import Scratch, kept, rated, small_batches

PAIRS = 60_000         # weight of all preference pairs together, against the ridge
RIDGE = 5.0
ROUNDS = 25            # Newton steps at most
CUT = 0.3              # score at the cut
FEATURES = 20
MOMENTS = np.triu_indices(FEATURES + 1)
GRID = 1 << 16         # features are learned from in whole steps of 1 / GRID
BINS_PER_UNIT = 32     # strength bins of the pair sums
TOP_BIN = 1024
CELLS = 1 << 12        # strength steps that are counted for the cut, per unit
TOP_CELL = 1 << 18
PIECE = 1 << 20        # bytes counted at once


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Byte -> 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 stop or comma, 6 ! or ?, 7 bar, 8 symbol, 9 beyond ASCII."""
    kind = np.zeros(256, np.uint8)
    kind[128:] = 9
    for chars, k in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3),
                     (" \t\n\r\v\f", 4), (".,;:", 5), ("!?", 6), ("|", 7), ("#$%&*+=<>@^_~\\/{}[]", 8)):
        for c in chars:
            kind[ord(c)] = k
    return kind


def features(text: str | None) -> np.ndarray:
    """Shape of a whole text: sizes, shares of character kinds, repetition of words and lines."""
    x = np.zeros(FEATURES)
    words = text.split() if text else []
    if not words:
        return x
    raw = text.encode("utf-8", "surrogatepass")
    kinds = sum(np.bincount(_kinds()[np.frombuffer(raw, np.uint8, min(PIECE, len(raw) - at), at)], minlength=10)
                for at in range(0, len(raw), PIECE))
    lines = [s for s in map(str.strip, text.split("\n")) if s]
    n, chars = len(words), len(raw)
    letters = max(1, int(kinds[1] + kinds[2]))
    distinct = len(set(words))
    same = sum(map(str.__eq__, words, words[1:]))
    marks = np.minimum(1.0, kinds[5:9] / n)
    x[0] = 1.0
    x[1] = np.log1p(n) / 10
    x[2] = min(20, chars / n) / 20
    x[3] = kinds[2] / letters
    x[4] = kinds[3] / chars
    x[5:9] = marks
    x[9:13] = marks > 0.25
    x[13] = distinct / n
    x[14] = 1.0 if distinct / n < 0.3 else 0.0
    x[15] = same / n
    x[16] = 1.0 if same / n > 0.1 else 0.0
    x[17] = 1 - len(set(lines)) / max(1, len(lines))
    x[18] = 1.0 if kinds[2] / letters > 0.4 else 0.0
    # Repetition beyond what the length explains: distinct words against a root law.
    x[19] = min(2.0, distinct / (n ** 0.85 + 1))
    return x


def _binned(s: np.ndarray) -> np.ndarray:
    """The strength bins of the pair sums."""
    return np.clip(np.rint(s * BINS_PER_UNIT), -TOP_BIN, TOP_BIN).astype(np.int64)


def _moments(q: np.ndarray) -> np.ndarray:
    """Rows, sums and sums of products of whole-number features: exact in doubles, as in longs."""
    x = np.hstack([np.ones((len(q), 1)), q])
    return (x.T @ x)[MOMENTS].astype(np.int64)


def moments(rows: DataFrame, model: dict) -> pd.DataFrame:
    """Per label and strength bin the moments of all rows; without weights one bin. Sums are of whole numbers, so
    they do not depend on the order of rows."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            q = batch.column("q").flatten().to_numpy().reshape(-1, FEATURES).astype(float)
            y = batch.column("label").to_numpy()
            of = _binned(_strengths(q / GRID, model)) if "w" in model else np.zeros(len(q), np.int64)
            order = np.lexsort((of, y))
            first = np.flatnonzero(np.diff(y[order], prepend=-1) | np.diff(of[order], prepend=TOP_BIN + 1))
            for rows_of in np.split(order, first[1:]):
                key = int(y[rows_of[0]]), int(of[rows_of[0]])
                held[key] = held.get(key, 0) + _moments(q[rows_of])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int64()),
                                              pa.array(list(held.values()), pa.list_(pa.int64()))], names=["label", "bin", "m"])

    def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for pdf in frames:
            for label, place, m in zip(pdf["label"], pdf["bin"], pdf["m"]):
                held[label, place] = held.get((label, place), 0) + m
        if held:
            yield pd.DataFrame({"label": [k[0] for k in held], "bin": [k[1] for k in held], "m": list(held.values())})
    kind = "label int, bin long, m array<long>"
    # at most two labels and 2 * TOP_BIN + 1 bins of 231 numbers come to the driver, whatever the rows
    return rows.mapInArrow(work, kind).repartition("bin").mapInPandas(total, kind).toPandas().sort_values(["label", "bin"])


def _by_label(found: pd.DataFrame, model: dict) -> list[tuple[np.ndarray, ...]]:
    """Per label: strengths of the bins, rows, sums and sums of products of the standardised features."""
    out = []
    for label in (0, 1):
        own = found[found["label"] == label]
        full = np.zeros((len(own), FEATURES + 1, FEATURES + 1))
        full[:, MOMENTS[0], MOMENTS[1]] = np.vstack(own["m"].to_numpy()).astype(float)
        full = full + np.triu(full, 1).transpose(0, 2, 1)
        # x = (1, q) -> (1, z), z = (q / GRID - mean) / spread
        turn = np.eye(FEATURES + 1)
        turn[1:, 1:] = np.diag(1 / (GRID * model["spread"]))
        turn[1:, 0] = -model["mean"] / model["spread"]
        z = turn @ full @ turn.T
        out.append((own["bin"].to_numpy() / BINS_PER_UNIT, z[:, 0, 0], z[:, 0, 1:], z[:, 1:, 1:]))
    return out


def pair_step(bad: tuple, good: tuple) -> tuple[np.ndarray, np.ndarray, float]:
    """Slope, curvature and number of the Bradley-Terry loss over every pair of a good and a bad row."""
    (sb, nb, xb, xxb), (sg, ng, xg, xxg) = bad, good
    p = 1 / (1 + np.exp(-np.clip(sg[:, None] - sb[None, :], -30, 30)))
    miss, curve = 1 - p, np.maximum(p * (1 - p), 1e-6)
    slope = (miss @ nb) @ xg - (ng @ miss) @ xb
    cross = xg.T @ curve @ xb
    second = np.tensordot(curve @ nb, xxg, 1) + np.tensordot(ng @ curve, xxb, 1) - cross - cross.T
    return slope, second, float(ng.sum() * nb.sum())


def fit(rows: DataFrame, *, pairs: int = PAIRS) -> dict:
    """All (label, q) rows -> weights, scale and cut.

    The loss is over every pair of a good and a bad row, with the total weight of ``pairs`` pairs against the ridge. A
    pair's slope and curvature depend on its two strengths alone, so the sums over all pairs follow from the
    moments of the rows by label and strength bin (1/32 of a unit): each Newton step is one pass over the rows.
    """
    found = moments(rows, {})
    n = {int(r.label): int(r.m[0]) for r in found.itertuples()}
    if len(n) < 2:
        return {"share": float(next(iter(n))) if n else 0.5}
    both = np.zeros((FEATURES + 1, FEATURES + 1), object)
    both[MOMENTS] = sum(np.array([int(v) for v in m], object) for m in found["m"])
    size, sums, squares = both[0, 0], both[0, 1:], np.diag(both)[1:]      # whole numbers, so the variance does not cancel
    mean = np.array([float(a) / size / GRID for a in sums])
    spread = np.array([float(size * b - a * a) ** 0.5 / size / GRID for a, b in zip(sums, squares)]) + 1e-6
    model = {"w": np.zeros(FEATURES), "mean": mean, "spread": spread}
    for _ in range(ROUNDS):
        slope, second, count = pair_step(*_by_label(found, model))
        slope = slope * (pairs / count) - RIDGE * model["w"]
        step = np.linalg.solve(second * (pairs / count) + RIDGE * np.eye(FEATURES), slope)
        largest = np.abs(step).max()
        model["w"] = model["w"] + step * min(1.0, 5.0 / max(largest, 1e-12))
        if largest < 1e-3:
            break
        found = moments(rows, model)
    return model | cut_of(rows, model)


def cut_of(rows: DataFrame, model: dict) -> dict:
    """The cut is a quantile of the strengths of all rows: the one where both classes are told apart best."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column("q").flatten().to_numpy().reshape(-1, FEATURES).astype(float)
            s = np.clip(np.rint(_strengths(q / GRID, model) * CELLS), -TOP_CELL, TOP_CELL).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(s)], names=["label", "cell"])
    # counted by strength in steps of 1 / CELLS: at most 2 * TOP_CELL + 1 cells come to the driver
    counts = (rows.select("label", "q").mapInArrow(work, "label int, cell long").groupBy("cell")
              .agg(F.count_if(F.col("label") == 0).alias("bad"), F.count_if(F.col("label") == 1).alias("good")).toPandas().sort_values("cell"))
    at, bad, good = counts["cell"].to_numpy() / CELLS, counts["bad"].to_numpy(), counts["good"].to_numpy()
    upto = np.cumsum(bad + good)

    def quantile(level):
        place = np.asarray(level) * (upto[-1] - 1)
        low = np.floor(place).astype(np.int64)
        a, b = (at[np.searchsorted(upto, i, "right")] for i in (low, np.minimum(low + 1, upto[-1] - 1)))
        return a + (b - a) * (place - low)
    levels = np.linspace(0.001, 0.999, 999)
    below = np.searchsorted(at, quantile(levels), "left")
    bad_below, good_below = (np.concatenate([[0], np.cumsum(c)])[below] for c in (bad, good))
    right = (good.sum() - good_below) / good.sum() + bad_below / bad.sum()
    level = float(levels[right >= right.max() - 1e-12].mean())
    return {"cut": float(quantile(level)), "level": level}


def _strengths(x: np.ndarray, model: dict) -> np.ndarray:
    return ((x - model["mean"]) / model["spread"]) @ model["w"]


def strength_to_score(s: np.ndarray, cut: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s - cut + np.log(CUT / (1 - CUT)), -40, 40)))


def rate(texts: list[str | None], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Scores and predictions (1 from the cut on) of whole texts."""
    if "w" not in model or not len(texts):
        p = np.full(len(texts), model.get("share", 0.5))
        return p, (p >= CUT).astype(np.int32)
    x = np.vstack([features(t) for t in texts])
    s = _strengths(x, model)
    said = (s >= model["cut"]).astype(np.int32)
    p = strength_to_score(s, model["cut"])
    return np.where(said == 1, np.maximum(p, CUT), np.minimum(p, np.nextafter(CUT, 0))), said


def keep_good(docs: DataFrame, model: dict) -> DataFrame:
    """The documents from the cut on, with all their columns."""
    return kept(docs, lambda texts: rate(texts, model)[1] == 1)


def predict(docs: DataFrame, model: dict, *extra: Column) -> DataFrame:
    """doc_id, extra columns, score and predicted of every whole text."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *extra, "text")
    return rated(rows, "score double, predicted int",
                 lambda: lambda texts: [pa.array(a, t) for a, t in zip(rate(texts, model), (pa.float64(), pa.int32()))])


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "quality") -> dict:
    """Fit on every labelled document; the caller withholds rows by filtering ``labels``.

    Only classes 0 and 1 count; conflicting repeated labels of a document keep the largest, and a
    repeated document counts once. Texts stay where they are read: only their features are joined.
    """
    small_batches(docs.sparkSession)
    y = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))

    def shape(texts: list[str | None]) -> list[pa.Array]:
        q = np.rint(np.vstack([features(t) for t in texts]) * GRID).astype(np.int64) if texts else np.zeros((0, FEATURES), np.int64)
        return [pa.array(list(q), pa.list_(pa.int64()))]
    shapes = rated(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), "q array<bigint>", lambda: shape)
    rows = y.join(shapes, "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min("q").alias("q")).select("label", "q")
    scratch = Scratch(docs.sparkSession)
    model = fit(scratch.save(rows, "shapes"))
    scratch.close()
    return model
