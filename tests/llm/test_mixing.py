import heapq
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from airlattice.llm.common import Scratch
from airlattice.llm.mixing import mix, sainte_lague, targets
from tests.llm.util import docs


def brute_targets(sizes, weights, num=3, den=2, cap=2):
    """Reshare the excess of stopped targets until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()) * num / den, set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total >= cap * sizes[s]]
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = cap * sizes[s]
            open_.discard(s)
        left = sum(sizes.values()) * num / den - sum(out.values())
    return out


def test_targets_against_resharing(spark):
    rng = random.Random(3)
    for n in (1, 2, 5, 23):
        sizes = {(f"s{i}" if i else None): rng.choice([0, 1, 7, 100, 10_000, 10_000]) for i in range(n)}
        got = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = brute_targets(sizes, (3, 1, 2))
        for r in got:
            assert abs(r["target"] - want[r["source"]]) <= 1e-6 * max(1, want[r["source"]]), (sizes, r)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=25), st.integers(0, 400))
def test_sainte_lague_against_heap(spark, votes, seats):
    heap = [(-v, i, 0) for i, v in enumerate(votes) if v]
    heapq.heapify(heap)
    won = [0] * len(votes)
    for _ in range(seats if heap else 0):
        _, i, k = heapq.heappop(heap)
        won[i] += 1
        heapq.heappush(heap, (-votes[i] / (2 * k + 3), i, k + 1))
    df = spark.createDataFrame([("g", i, float(v), seats) for i, v in enumerate(votes)], "g string, i int, v double, seats long")
    got = {r["i"]: r["quota"] for r in sainte_lague(df, ["g"], "v", "seats", "i").collect()}
    assert [got[i] for i in range(len(votes))] == won


def test_mix_awkward_rows(spark):
    d = docs(spark)
    got = mix(d, Scratch(spark)).toPandas()
    assert len(got) == d.count()
    words = {r["doc_id"]: len(r["text"].encode().split()) if r["text"] else 0 for r in d.collect()}
    known = got[got.doc_id.notna()]
    assert all(words[int(i)] == s for i, s in zip(known["doc_id"], known["size"]))
    assert (got.taken >= 0).all() and (got.taken <= 2 * got["size"]).all()
    per = got.assign(source=got.source.fillna("~")).groupby("source").agg(
        size=("size", "sum"), said=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (per["size"] == per.said).all()
    assert ((per.taken - per.target).abs() <= 40).all()
    again = mix(d.repartition(7), Scratch(spark)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))


def test_mix_many_shards_and_empty(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 50)), "en", "hot" if i % 3 else f"s{i % 5}", 0) for i in range(600)]
    got = mix(docs(spark, rows), Scratch(spark), shard_words=500).toPandas()
    per = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("size", "sum"))
    assert ((per.taken - per.target).abs() <= 0.03 * per.target + 40).all()
    assert (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    assert mix(docs(spark, []), Scratch(spark)).where(F.lit(True)).count() == 0
