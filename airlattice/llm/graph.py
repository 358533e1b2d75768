"""Connected components of a link table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlattice.llm.common import Scratch

PER_FILE = 500_000     # links of a task and a file


class Forest:
    """Disjoint sets over 0..n-1, used inside one task on one bounded group."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def components(edges: DataFrame, scratch: Scratch, name: str = "labels") -> DataFrame:
    """(a, b) links -> (id, component): the smallest id reachable from each linked id.

    Each round every vertex points to its smallest neighbour (or itself), pointers are followed to
    their ends, and the links are rewritten to those ends and made distinct; at most half of the
    vertices are left, so links shrink fast and about log n rounds are enough. Tables are
    written each round. Neighbours are never gathered, only their minimum is (combined before the
    shuffle), so a vertex with very many links stays cheap. Self links and null ends are
    ignored, repeated links are harmless, and no links give an empty table.
    """
    def tidy(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    open_ = scratch.save(tidy(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))),
                         f"{name}-links")
    # All later tables have at most twice as many rows: a file per PER_FILE of them.
    files = 1 + open_.count() // PER_FILE
    labels = None
    while True:
        ends = open_.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(
            open_.select(F.col("b").alias("id"), F.col("a").alias("other")))
        points = scratch.save(ends.groupBy("id").agg(F.min("other").alias("m"))
                              .select("id", F.least("id", "m").alias("to")).coalesce(files), f"{name}-points")
        while True:
            onward = points.select(F.col("id").alias("to"), F.col("to").alias("end"))
            step = points.join(onward, "to").select("id", "to", "end")
            step = scratch.save(step.coalesce(files), f"{name}-points")
            points = step.select("id", F.col("end").alias("to"))
            if step.where("to <> end").isEmpty():
                break
        labels = points.select("id", F.col("to").alias("component")) if labels is None else labels.join(
            points.select(F.col("id").alias("component"), "to"), "component", "left").select(
            "id", F.coalesce("to", "component").alias("component"))
        labels = scratch.save(labels.coalesce(files), name)
        from_, to_ = (points.select(F.col("id").alias(c), F.col("to").alias(f"{c}_end")) for c in "ab")
        open_ = scratch.save(tidy(open_.join(from_, "a").join(to_, "b")
                                  .select(F.col("a_end").alias("a"), F.col("b_end").alias("b"))).coalesce(files), f"{name}-links")
        if open_.isEmpty():
            return labels
