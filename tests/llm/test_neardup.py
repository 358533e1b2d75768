import random

import numpy as np

from airlattice.llm import neardup
from airlattice.llm.common import Scratch
from airlattice.llm.graph import components
from airlattice.llm.neardup import near_duplicates
from airlattice.llm.shingles import minima, shingles
from tests.llm.util import awkward, docs


def brute(rows, k, percent=80):
    sets = {}
    for i, text, *_ in rows:
        if i is not None:
            w = text.encode().lower().split() if text else []
            sets[i] = frozenset(tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def found(df, scratch, **how):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, scratch, **how).collect()}


def families(seed, n_bases, copies, length, edits):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, i = [], 0
    for _ in range(n_bases):
        base = [word() for _ in range(length)]
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(length)] = word()
            rows.append((i, " ".join(text), "en", "s", 0))
            i += 1
    rng.shuffle(rows)
    return rows


def test_awkward_rows(spark):
    for k in (4, 5):
        assert found(docs(spark), Scratch(spark), words=k) == brute(awkward(), k)


def test_families_against_all_pairs(spark):
    rows = families(2, 25, 12, 60, 6)
    assert found(docs(spark, rows, clash=False), Scratch(spark), words=4) == brute(rows, 4)


def test_hot_family_in_blocks(spark, monkeypatch):
    """Nodes and groups far above their bounds go the block way with the same result."""
    rows = families(3, 2, 150, 40, 4) + [(1000 + r[0], *r[1:]) for r in families(4, 10, 2, 40, 2)]
    for name, value in (("NODE", 8), ("GROUP_WORDS", 600), ("BLOCK_WORDS", 300), ("LEVELS", 2)):
        monkeypatch.setattr(neardup, name, value)
    assert found(docs(spark, rows, clash=False), Scratch(spark), words=4) == brute(rows, 4)


def test_id_repeated_with_other_texts_is_one_document(spark):
    rows = [(1, "a b c d e f", None, None, 0), (1, "q r s t u v", None, None, 0), (2, "a b c d e f", None, None, 0)]
    got = found(docs(spark, rows), Scratch(spark), words=4)
    assert set(got) == {1, 2} and got[1][0] == 3


def test_empty_table(spark):
    assert found(docs(spark, []), Scratch(spark)) == {}


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (200, 201), (201, 200), (300, None)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)} | {200: 200, 201: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_components_random(spark):
    rng = np.random.default_rng(4)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 400, (300, 2))]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}


def test_minima_estimate_similarity():
    a = shingles(" ".join(f"w{i}" for i in range(500)), 4)
    b = shingles(" ".join(f"w{i}" for i in range(100, 600)), 4)
    real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((minima(a, 1024) == minima(b, 1024)).mean() - real) < 0.06


def test_short_copies_inside_a_large_family_of_long_documents(spark, monkeypatch):
    """Nodes that stay large because of a shared passage are compared whole, also far from their pivots."""
    for name, value in (("NODE", 2), ("PIVOTS", 1), ("TREES", 3), ("PART", 16)):
        monkeypatch.setattr(neardup, name, value, raising=False)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join([*passage, *(word() for _ in range(45))]), "en", "s", 0) for i in range(1200)]
    rows += [(5000 + i, " ".join([*passage, word(), word()]), "en", "s", 0) for i in range(3)]
    got = found(docs(spark, rows, clash=False), Scratch(spark))
    assert {got[5000 + i][1] for i in range(3)} == {5000}
    assert all(got[i][1] == i for i in range(1200))
