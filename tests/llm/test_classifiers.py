import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlattice.llm import langid, lexical, quality, toxicity
from airlattice.llm.common import Scratch
from airlattice.llm.labelled import sample
from airlattice.llm.queries import QUERIES, load_all
from tests.llm.util import SF, awkward, docs, labels, sentence

load_all()


def learned(spark, name, label, fold):
    """Held-out accuracy of a registered query on the given tables."""
    got = QUERIES[name](spark, SF.replace("0.001", "0.01")).toPandas()
    y = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet").toPandas().set_index("doc_id")[label]
    rows = got[got.held_out & got.doc_id.isin(y.index)]
    return (rows.predicted.to_numpy() == y.loc[rows.doc_id].to_numpy()).mean(), got


def test_quality_held_out(spark):
    right, got = learned(spark, "op5_quality", "quality", 5)
    assert right >= 0.98 and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_toxicity_held_out(spark):
    right, got = learned(spark, "op9_toxicity", "toxic", 4)
    assert right >= 0.9 and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_language_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    got = QUERIES["op10_langid"](spark, sf).toPandas().set_index("doc_id")
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    held = got[got.held_out]
    assert (held.lang_pred == lang.loc[held.index]).mean() >= 0.98 and got.score.between(0, 1).all()


def test_languages_of_awkward_texts(spark):
    d = docs(spark)
    train = d.where("lang IS NOT NULL")
    got = langid.identify(d, train).collect()
    assert len(got) == len(awkward())
    letters = {r[0]: bool(r[1]) and any(c.isalpha() for c in r[1]) for r in awkward()}
    for r in got:
        if r["doc_id"] is not None:
            assert (r["lang_pred"] != "und") == letters[r["doc_id"]] and 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in got} <= {"en", "de", "fr", "und"}
    nothing = langid.identify(d, train.where("false")).collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in nothing)
    assert langid.identify(docs(spark, []), train).count() == 0


def test_ngram_counts_do_not_depend_on_blocks(monkeypatch):
    text = sentence(random.Random(3), 400) + "  Ünï-cödé, 12 x"
    whole = langid.counts(text)
    for size in (3, 7, 64):
        monkeypatch.setattr(langid, "BLOCK", size)
        assert (langid.counts(text) == whole).all()


def test_quality_of_awkward_texts(spark):
    d = docs(spark)
    y = labels(spark, [(i, int(i % 2), 0) for i in range(20, 50)] + [(1, None, None), (1, 1, None), (None, 0, 0), (777, 0, 0)])
    model = quality.learn(d, y)
    got = quality.predict(d, model).collect()
    assert len(got) == len(awkward()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert quality.keep_good(d, model).columns == d.columns
    one = quality.learn(d, y.where("quality = 1"))
    assert {r["score"] for r in quality.predict(d, one).collect()} == {1.0}
    assert {r["score"] for r in quality.predict(d, quality.learn(d, y.where("false"))).collect()} == {0.5}
    assert quality.predict(docs(spark, []), model).count() == 0


def test_bradley_terry_recovers_an_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    strength = x @ np.array([2.0, -1.0, 0.0])
    a, b = rng.integers(0, 400, (2, 8000))
    first = rng.random(8000) < 1 / (1 + np.exp(-(strength[a] - strength[b])))
    win, lose = np.where(first, a, b), np.where(first, b, a)
    w = lexical.newton_logistic(x[win] - x[lose], np.ones(8000), ridge=0.1, intercept=False)
    assert w == pytest.approx([2.0, -1.0, 0.0], abs=0.15)


def toxic_rows(seed=1, n=240):
    rng = random.Random(seed)
    rows, y = [], []
    for i in range(n):
        text = sentence(rng, 60).split()
        bad = i % 4 == 0
        for _ in range(4 if bad else 0):
            text[rng.randrange(60)] = rng.choice(["zorgwat", "zorgbla", "quxxish", "vrunkel"])
        rows.append((i, " ".join(text), "en", "a", 0))
        y.append((i, 1, int(bad)))
    return rows, y


def test_toxicity_learns_words_and_beginnings(spark):
    rows, y = toxic_rows()
    d = docs(spark, rows + [(1000, sentence(random.Random(9), 50) + " zorgneu", "en", "a", 0), *[(2000 + i, *r[1:]) for i, r in enumerate(awkward())]])
    model = toxicity.learn(d, labels(spark, y[:160]), Scratch(spark))
    got = {r["doc_id"]: r for r in toxicity.predict(d, model).collect()}
    assert all(got[i]["predicted"] == t for i, _, t in y)
    assert got[1000]["predicted"] == 1          # a new word with a known beginning
    assert all(got[2000 + i]["predicted"] == 0 and 0 <= got[2000 + i]["score"] <= 1 for i in range(len(awkward())))
    none = toxicity.learn(d, labels(spark, [(1, 1, 0)]), Scratch(spark))
    assert none is None and {r["score"] for r in toxicity.predict(d, none).collect()} == {0.0}
    assert toxicity.predict(docs(spark, []), model).count() == 0


def test_label_model_recovers_accuracies_and_discounts_echoes():
    """Five voters of known accuracy; three more repeat the first one."""
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.3
    right = [0.95, 0.85, 0.8, 0.75, 0.7]
    cols = [np.where(rng.random(20_000) < p, truth, ~truth) for p in right]
    cols += [cols[0]] * 3
    votes = np.where(np.stack(cols, 1), toxicity.TOXIC, toxicity.CLEAN).astype(np.int8)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    start = np.clip((patterns == toxicity.TOXIC).mean(1), 0.05, 0.95)
    model = toxicity.label_model(patterns, counts.astype(float), start, 0.3)
    assert model["prior"] == pytest.approx(0.3, abs=0.08)
    assert ((model["posterior"][inverse.ravel()] > 0.5) == truth).mean() > 0.9
    assert model["weight"][5] < 0.6 * model["weight"][1]


def test_sample_is_bounded_and_repeatable(spark):
    rows = [(i, f"t{i}", None, None, 0) for i in range(500)]
    y = labels(spark, [(i, i % 2, 0) for i in range(500)] + [(3, None, 0), (4, 7, 0)])
    some = sample(docs(spark, rows), y, "quality", 50)
    n = {r["label"]: r["count"] for r in some.groupBy("label").count().collect()}
    assert all(20 <= n[k] <= 90 for k in (0, 1))
    again = sample(docs(spark, rows).repartition(5), y.repartition(3), "quality", 50)
    assert sorted(r["doc_id"] for r in some.collect()) == sorted(r["doc_id"] for r in again.collect())


def test_word_hashes_and_blocks():
    text = "One two-three FOUR " * 50
    h = []
    for block in lexical.blocks([None, "", text], size=64):
        doc, _, found = lexical.hashed_words(block, (), 1)
        assert set(doc.tolist()) <= {2}
        h += found[0].tolist()
    assert len(h) == 200 and len(set(h)) == 4
    table = lexical.Lookup(np.array(sorted(set(h)), np.uint64))
    assert len(table.find(np.array(h, np.uint64))[0]) == 200
    assert len(table.find(np.arange(1000, dtype=np.uint64))[0]) == 0


def test_quality_learns_from_every_labelled_text(spark):
    """More labelled texts per class than were once sampled: means, spreads and the cut are those of all of them."""
    rng = random.Random(5)
    rows = [(i, sentence(rng, 4 + i % 9) + (" ALL CAPS!!! 99" if i % 2 and i % 5 else ""), "en", "a", 0) for i in range(7000)]
    model = quality.learn(docs(spark, rows), labels(spark, [(i, 1 - i % 2, 0) for i in range(7000)]))
    x = np.vstack([quality.features(r[1]) for r in rows])
    assert np.abs(model["mean"] - x.mean(0)).max() < 1e-5 and np.abs(model["spread"] - x.std(0)).max() < 1e-4
    said = quality.rate([r[1] for r in rows], model)[1]
    y = np.array([1 - i % 2 for i in range(7000)])
    s = ((x - model["mean"]) / model["spread"]) @ model["w"]
    # no cut anywhere tells the classes of all rows better apart
    best = max((s[y == 1] >= c).mean() + (s[y == 0] < c).mean() for c in np.quantile(s, np.linspace(0.001, 0.999, 999)))
    assert said[y == 1].mean() + 1 - said[y == 0].mean() >= best - 5e-3


def test_bradley_terry_over_all_pairs(spark):
    """Weights from moments by strength equal those of all pairs, one by one; the order of rows does not matter."""
    rng = np.random.default_rng(2)
    x = np.zeros((120, quality.FEATURES))
    x[:, :4] = rng.random((120, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.4 * rng.normal(size=120) > 0.8).astype(int)
    q = np.rint(x * quality.GRID).astype(int)
    df = spark.createDataFrame([(int(a), [int(v) for v in b]) for a, b in zip(y, q)], "label int, q array<long>")
    model = quality.fit(df.repartition(3))
    again = quality.fit(df.orderBy(F.desc("q")).repartition(5))
    assert (model["w"] == again["w"]).all() and model["cut"] == again["cut"]
    z = (q / quality.GRID - model["mean"]) / model["spread"]
    win, lose = (a.ravel() for a in np.meshgrid(np.flatnonzero(y == 1), np.flatnonzero(y == 0)))
    w = lexical.newton_logistic(z[win] - z[lose], np.ones(len(win)), np.full(len(win), quality.PAIRS / len(win)), ridge=quality.RIDGE, intercept=False)
    assert model["w"] == pytest.approx(w, abs=5e-3)
    assert quality.fit(df.where("label = 1")) == {"share": 1.0} and quality.fit(df.where("false")) == {"share": 0.5}
