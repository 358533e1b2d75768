"""Integer centroid clustering by an incremental distance matrix.

Every vector keeps its exact integer dot product with each centroid in a written table. When the
centroids move, only the components that changed are multiplied in: the dot product with
centroid j grows by the sum over its changed components of component times change. The nearest centroid is then the
smallest of |c|^2 - 2 x.c. All sums are integers, so results do not depend on the order of rows or on partitions.

The driver holds the centroids and one sum per centroid and component; sums are combined in the tasks and by
Spark before they arrive. A round reads and writes the table once, so a lost executor costs only its tasks.

Arithmetic is in 64-bit integers while no component passes 2^27 (then no distance passes 2^63). Rows
beyond that are worked out in Python integers from scratch each round.

Defined cases: a vector that is null, of another length, or holds null or non-finite components is left out,
and so is one with a component of 2^62 or more after scaling; distances or inertias that do not fit a long are null; rows that
repeat an id are separate vectors; rows without an id are clustered but are no starting centroid; fewer vectors than
centroids give fewer centroids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlattice.llm.common import Scratch
from airlattice.session import ship_package

NARROW = 1 << 27       # components up to this size cannot overflow 64 bits
WIDEST = 1 << 62
ROWS = "vec_id long, x binary, dots binary, cluster int, distance decimal(38,0)"


def integers(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id and the components floor(scale * x) of the vectors that are kept."""
    v = F.col("embedding").cast("array<double>")
    whole = F.transform("v", lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
            .where(F.coalesce((F.size("v") == dim) & F.forall(
                "v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * F.lit(float(scale)) < float(WIDEST))), F.lit(False)))
            .select("vec_id", whole.alias("x")))


def starts(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors of smallest hash, in its order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id IS NOT NULL").select(key.alias("key"), "x").orderBy("key", "x").limit(k)
    return [list(r["x"]) for r in sorted(first.collect(), key=lambda r: (r["key"], r["x"]))]


def packed(row: np.ndarray) -> bytes:
    """A row of integers in the narrowest type that holds it."""
    top = max(int(row.max()), -int(row.min()) - 1)
    return row.astype("<i1" if top < 1 << 7 else "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8").tobytes()


def unpacked(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob, f"<i{len(blob) // dim}").astype(np.int64)


class Move:
    """Centroids and what changed since the dot products were last written."""

    def __init__(self, old: list[list[int]] | None, new: list[list[int]]):
        self.centroids = new
        self.changes = []          # per centroid: changed components, differences
        for j, c in enumerate(new):
            diff = [b - (old[j][i] if old else 0) for i, b in enumerate(c)]
            at = [i for i, d in enumerate(diff) if d]
            self.changes.append((at, [diff[i] for i in at]))
        self.narrow = all(abs(v) <= NARROW for c in new for v in c) and all(abs(d) <= 2 * NARROW for _, ds in self.changes for d in ds)

    def assign(self, x: np.ndarray, dots: np.ndarray | None) -> tuple[np.ndarray | None, np.ndarray, list[int]]:
        """(dot products, nearest centroid, squared distance) of rows; ``dots`` None: rows in Python integers."""
        c = np.array(self.centroids, object if dots is None else np.int64)
        if dots is None:
            product = x.astype(object) @ c.T
        else:
            product = dots
            for j, (at, by) in enumerate(self.changes):
                if at:
                    product[:, j] += x[:, at] @ np.array(by, np.int64)
        gap = (c * c).sum(1) - 2 * product
        own = np.array([min(range(len(c)), key=r.__getitem__) for r in gap.tolist()]) if dots is None else gap.argmin(1)
        square = (x.astype(object if dots is None else np.int64) ** 2).sum(1)
        return (None if dots is None else product), own, [int(v) for v in square + gap[np.arange(len(x)), own]]


def assigned(rows: DataFrame, move: Move, dim: int) -> DataFrame:
    """Dot products brought up to date, and the nearest centroid of every row."""
    k = len(move.centroids)
    fresh = "dots" not in rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if fresh:
                flat = batch["x"].flatten().to_numpy(zero_copy_only=False)
                x = flat.reshape(batch.num_rows, dim).astype(np.int64)
                kept = [None] * batch.num_rows
                blobs = [packed(r) for r in x]
            else:
                blobs, kept = batch["x"].to_pylist(), batch["dots"].to_pylist()
                x = np.stack([unpacked(b, dim) for b in blobs])
            small = np.abs(x).max(1) <= NARROW if move.narrow else np.zeros(len(x), bool)
            if not fresh:     # a row once worked out in Python integers stays so
                small &= np.array([d is not None for d in kept])
            dots, own, far = [None] * len(x), np.zeros(len(x), np.int32), [0] * len(x)
            for wide in (False, True):
                at = np.flatnonzero(small != wide)
                if not len(at):
                    continue
                had = None
                if not wide:
                    had = np.zeros((len(at), k), np.int64) if fresh else np.stack([np.frombuffer(kept[i], "<i8") for i in at])
                product, near, square = move.assign(x[at], None if wide else had.copy())
                own[at] = near
                for n, i in enumerate(at.tolist()):
                    far[i] = square[n]
                    dots[i] = None if wide else product[n].astype("<i8").tobytes()
            yield pa.record_batch([batch["vec_id"], pa.array(blobs, pa.binary()), pa.array(dots, pa.binary()), pa.array(own, pa.int32()),
                                   pa.array(far, pa.decimal128(38, 0))], names=["vec_id", "x", "dots", "cluster", "distance"])
    return rows.mapInArrow(work, ROWS)


def sums(rows: DataFrame, dim: int) -> dict[int, tuple[int, list[int]]]:
    """Per cluster that has rows: their number and the sum of every component."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([unpacked(b, dim) for b in batch["x"].to_pylist()])
            own = batch["cluster"].to_numpy()
            exact = x if np.abs(x).max() <= NARROW else x.astype(object)
            for j in np.unique(own).tolist():
                part = exact[own == j]
                held = total.setdefault(j, [0, [0] * dim])
                held[0] += len(part)
                held[1] = [a + int(b) for a, b in zip(held[1], part.sum(0))]
        flat = [(j, i, n, s) for j, (n, row) in total.items() for i, s in enumerate(row)]
        columns = list(zip(*flat)) or [()] * 4
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)))],
                              names=["cluster", "i", "n", "s"])
    found: dict[int, tuple[int, list[int]]] = {}
    for r in (rows.select("x", "cluster").mapInArrow(work, "cluster int, i int, n long, s decimal(38,0)")
              .groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()):
        found.setdefault(r["cluster"], (int(r["n"]), [0] * dim))[1][r["i"]] = int(r["s"])
    return found


def cluster(vectors: DataFrame, scratch: Scratch, *, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64,
            seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, embedding) -> rows (vec_id, x, dots, cluster, distance) and the final centroids."""
    ship_package(vectors.sparkSession)
    rows = integers(vectors, dim, scale)
    centroids = starts(rows, k, seed)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], ROWS), []
    rows = scratch.save(assigned(rows, Move(None, centroids), dim), "assigned")
    for _ in range(rounds):
        found = sums(rows, dim)
        moved = [[s // found[j][0] for s in found[j][1]] if j in found else c for j, c in enumerate(centroids)]
        rows = scratch.save(assigned(rows, Move(centroids, moved), dim), "assigned")
        centroids = moved
    return rows, centroids


def summary(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance, the inertia of its cluster and of all, and the digest of its centroid."""
    spark = rows.sparkSession
    inertia = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(inertia.values())

    def fits(v: int) -> int | None:
        return v if v < 1 << 63 else None
    facts = [(j, fits(inertia[j]), fits(total), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
             for j, c in enumerate(centroids) if j in inertia]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.select("vec_id", "cluster", F.expr("try_cast(distance AS long)").alias("distance")).join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
