import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from airlattice.llm import decontam, lexical
from airlattice.llm.decontam import Index, Postings, find_leaks, hashes, question_and_answer, shingled, without_leaks
from tests.llm.util import awkward, docs, sentence

ITEMS = "item_id long, text string"


def brute(texts, items, overlap=0.8):
    found = set()
    for d, text in texts:
        h = hashes(text)
        for i, item in items:
            if len(hashes(item)):
                parts = [p for p in map(hashes, question_and_answer(item)) if len(p)]
                held = [(shingled(p, min(5, len(p))), shingled(h, min(5, len(p))) if len(h) >= min(5, len(p)) else []) for p in parts]
                if all(np.isin(p, t).mean() >= overlap for p, t in held):
                    found.add((d, i))
    return found


def leaky(seed=1):
    rng = random.Random(seed)
    items = [(i, ". ".join(sentence(rng, rng.randint(6, 30)) for _ in range(2)) + ".") for i in range(30)]
    items += [(90, sentence(rng, 300) + ". " + sentence(rng, 20)), (91, None), (92, ""), (93, "!!! 12"), (94, items[3][1])]
    rows = awkward(seed)
    for n in range(40):
        text = [sentence(rng, rng.randint(0, 120)), sentence(rng, rng.randint(0, 120))]
        inside = items[rng.randrange(31)][1]
        if n % 4 == 1:
            w = inside.split()
            w[rng.randrange(len(w))] = "changed"
            inside = " ".join(w)
        if n % 4 == 2:
            inside = " ".join(inside.split()[: len(inside.split()) // 2])
        if n % 4 == 3:
            inside = inside.upper().replace(" ", "!! ")
        rows.append((200 + n, f"{text[0]}\n{inside} {text[1]}", "en", "a", 0))
    # Across the border of a text's pieces, in a very long text.
    rows.append((300, sentence(rng, 118_000) + " " + items[30][1] + " " + sentence(rng, 30_000), "en", "a", 0))
    return rows, items


def test_leaks_against_brute_force(spark):
    rows, items = leaky()
    df = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 AS part", "2 AS doc_id")
    got = find_leaks(docs(spark, rows), df).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute([(r[0], r[1]) for r in rows], items)
    assert len({r["doc_id"] for r in got}) >= 25
    leaks = {r["doc_id"] for r in got}
    d = docs(spark, rows)
    kept = without_leaks(d, df)
    assert kept.columns == d.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[0] not in leaks)


def test_every_border_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(lexical.blocks, "__defaults__", (2_000, 0))
    rows, items = leaky(2)
    index = Index([i for i in items if i[1]])
    texts = [r[1] for r in rows if r[0] is None or r[0] < 300]
    got = {(d, index.items[i][0]) for d, i, *_ in decontam.leaks_in(index, texts, 0.8)}
    assert got == brute(list(enumerate(texts)), items)


def test_slices_and_empty_tables(spark, monkeypatch):
    rows, items = leaky()
    whole = find_leaks(docs(spark, rows[:60]), spark.createDataFrame(items, ITEMS)).collect()
    monkeypatch.setattr(decontam, "SLICE", 200)
    many = find_leaks(docs(spark, rows[:60]), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in whole} == {(r["doc_id"], r["item_id"]) for r in many}
    assert find_leaks(docs(spark, []), spark.createDataFrame(items, ITEMS)).count() == 0
    assert find_leaks(docs(spark), spark.createDataFrame([], ITEMS)).count() == 0
    assert without_leaks(docs(spark), spark.createDataFrame([], ITEMS)).count() == len(awkward())


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.floats(0.05, 0.95))
def test_block_max_wand_finds_all(seed, least):
    rng = np.random.default_rng(seed)
    parts, weight = [], {}
    for number in range(int(rng.integers(1, 120))):
        terms = np.unique(rng.integers(0, 60, int(rng.integers(1, 12))))
        w = rng.random(len(terms)) + 0.01
        parts.append((number, terms, w / w.sum()))
        weight[number] = dict(zip(terms.tolist(), (w / w.sum()).tolist()))
    asked = np.unique(rng.integers(0, 60, 15)).tolist()
    scores = {n: sum(w.get(t, 0.0) for t in asked) for n, w in weight.items()}
    got = dict(Postings(parts).search(asked, least))
    clear = {n for n, s in scores.items() if s >= least + 1e-9}
    assert clear <= set(got) <= {n for n, s in scores.items() if s >= least - 1e-9}
    assert all(got[n] == pytest.approx(scores[n]) for n in got)


def test_numbers_are_words(spark):
    """Items that differ only in numbers are different items, a number is an answer, and so may a whole item be."""
    asked = "Tom has {} apples and buys {} more at the market, so how many apples has he got now? {}"
    items = [(1, asked.format(12, 30, 42)), (2, asked.format(57, 99, 156)), (3, "What is half of seven written with a point? 3.5"),
             (4, "1618 0339 8874 9894. 8482")]
    rows = [(10, f"as the book says: {items[0][1]} and so on", "en", "a", 0),
            (11, "as the book says: " + asked.format(57, 99, "nobody knows"), "en", "a", 0),
            (12, "\u201cWhat is half of seven written with a point?\u201d \u2013 \u201c3.5\u201d", "en", "a", 0),
            (13, "half of seven? What is half of seven written with a point? 5", "en", "a", 0),
            (14, "golden 1618 0339 8874 9894 8482", "en", "a", 0)]
    df = spark.createDataFrame(items, ITEMS)
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs(spark, rows), df).collect()}
    assert got == {(10, 1), (12, 3), (14, 4)}
    assert {r["doc_id"] for r in without_leaks(docs(spark, rows), df).collect()} == {11, 13}
