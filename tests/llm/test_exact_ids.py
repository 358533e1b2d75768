"""Ids above 2^53 beside a null id, and foreign columns, come back as they were; long texts are cut between words."""

import datetime
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlattice.llm import decontam, langid, lexical, quality, toxicity
from airlattice.llm.common import Scratch, fold
from airlattice.llm.secrets import candidates, redact, scan
from airlattice.llm.warc import capture_history

from tests.llm.util import SF, sentence

BIG = [2 ** 53 + 1, 2 ** 53 + 3, None, 2 ** 62 + 1]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, at timestamp, tags array<long>, more struct<a: long, b: string>"


def rows(text="plain words here"):
    at = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    return [(i, f"{text} {k}", "en", "a", 2 ** 53 + 5 if k else None, at if k % 2 else None, [2 ** 53 + 7, None], (2 ** 53 + 9, None if k else "x"))
            for k, i in enumerate(BIG)]


@pytest.fixture(scope="module")
def big(spark):
    return spark.createDataFrame(rows(), SCHEMA).coalesce(1)


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=str)


def test_ids_of_scores(spark, big):
    want = sorted(BIG, key=str)
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.learn(docs, labels)
    extra = F.col("n_chars").alias("n_chars")
    found = quality.predict(big, model, extra)
    assert ids(found) == want and sorted({r["n_chars"] for r in found.collect()}, key=str) == sorted({2 ** 53 + 5, None}, key=str)
    assert ids(langid.identify(big, docs.where("lang IS NOT NULL"), fold(F.col("doc_id"), 3).alias("f"))) == want
    assert ids(toxicity.predict(big, None)) == want


def test_rows_that_stay_are_unchanged(spark, big):
    model = {"share": 0.9}                               # nothing learned: all stay
    assert sorted(map(str, quality.keep_good(big, model).collect())) == sorted(map(str, big.collect()))
    items = spark.createDataFrame([(2 ** 53 + 1, "Question: what is the tall red tower by the river called? Answer: the old lighthouse of the north")], "item_id long, text string")
    assert sorted(map(str, decontam.without_leaks(big, items).collect())) == sorted(map(str, big.collect()))


def test_ids_of_leaks(spark):
    item = "Question: which animal crosses the frozen lake at night in winter? Answer: a grey wolf with one white paw"
    docs = spark.createDataFrame(rows("some words before. " + item + " and after"), SCHEMA).coalesce(1)
    items = spark.createDataFrame([(2 ** 53 + 1, item)], "item_id long, text string")
    found = decontam.find_leaks(docs, items).collect()
    assert sorted((r["doc_id"] for r in found), key=str) == sorted(BIG, key=str)
    assert {r["item_id"] for r in found} == {2 ** 53 + 1}


def test_ids_of_captures(spark):
    pages = [(2 ** 53 + 1, "http://a.example/x", "<p>same</p>"), (2 ** 53 + 3, "http://a.example/y", "<p>same</p>"),
             (2 ** 53 + 5, "http://b.example/", "<p>same</p>"), (2 ** 53 + 7, "http://c.example/", "<p>other</p>")]
    df = spark.createDataFrame(pages, "id long, url string, payload string").withColumn("captured", F.lit(None).cast("timestamp")).coalesce(1)
    found = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in capture_history(df, Scratch(spark)).collect()}
    assert found == {2 ** 53 + 1: ("response", None), 2 ** 53 + 3: ("revisit", 2 ** 53 + 1), 2 ** 53 + 5: ("revisit", 2 ** 53 + 1),
                     2 ** 53 + 7: ("response", None)}


@pytest.mark.parametrize("gap", [" ", "\n", "\t", ", ", "|", "\r\n\r\n"])
def test_blocks_keep_words_and_overlap(gap):
    rng = random.Random(5)
    text = gap.join("".join(rng.choice("abcdé9") for _ in range(rng.randint(1, 9))) for _ in range(3000))
    plain, cut = [], []
    for out, size in ((plain, 1 << 20), (cut, 500)):
        for block in lexical.blocks([text, None, "x"], size):
            doc, runs, hashes = lexical.hashed_words(block, (), 1, True)
            out += list(zip(doc.tolist(), hashes[0].tolist()))
    assert cut == plain
    runs = re.compile(rb"[a-z0-9\x80-\xff]+").findall
    words = runs(text.lower().encode())
    pieces = [p for block in lexical.blocks([text], 500, overlap=7) for _, p in block]
    at = 0
    for k, piece in enumerate(pieces):
        own = runs(piece)
        at -= 7 if k else 0
        assert own == words[at:at + len(own)]
        at += len(own)
    assert at == len(words)


def test_a_run_longer_than_a_block_is_whole():
    text = "世" * (lexical.BLOCK // 2) + " end"
    found = [lexical.hashed_words(b, (), 1) for b in lexical.blocks([text, "世" * (lexical.BLOCK // 2)])]
    doc = np.concatenate([f[0] for f in found]).tolist()
    h = np.concatenate([f[2][0] for f in found]).tolist()
    assert doc == [0, 0, 1] and h[0] == h[2] != h[1]


@pytest.mark.parametrize("gap", ["\n", "\t", ""])
def test_leaks_beside_every_border(spark, gap):
    item = "Question: which animal crosses the frozen lake at night in winter? Answer: a grey wolf with one white paw"
    rng = random.Random(2)
    words = gap or " "
    lines = words.join("".join(rng.choice("ghijklm") for _ in range(6)) for _ in range(90_000))
    docs = []
    for k in range(8):
        at = lexical.BLOCK - 110 + 15 * k
        at = lines.index(words, at)
        docs.append((k, lines[:at] + words + item + lines[at:], "en", "a", 1))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontam.find_leaks(df, items).collect()) == list(range(8))


def test_candidates_of_a_text_with_many_runs(spark):
    rng = random.Random(3)
    parts = []
    for k in range(3000):
        parts.append(rng.choice([" ", "\n", "; ", "é "]))
        parts.append(f"{rng.randrange(10 ** 14):014d}x{k}")
    text = "".join(parts) + "."
    df = spark.createDataFrame([(1, text, "p"), (2, "token = 'a1b2c3d4e5f6g7h8'", "p"), (3, None, "p")], "doc_id long, text string, path string")
    found = candidates(df, "doc_id").collect()
    one = sorted((r["start"], r["value"], r["left"], r["right"]) for r in found if r["doc_id"] == 1)
    assert len(one) == 3000
    ends = 0
    for k, (start, value, left, right) in enumerate(one):
        assert text[start:start + len(value)] == value
        last = one[k - 1][0] if k else 0          # the run before belongs to the left context, no more
        assert left == text[last:start][-48:]
        nxt = one[k + 1][0] if k + 1 < len(one) else len(text)
        assert right == text[start + len(value):nxt][:24]
        assert start >= ends
        ends = start + len(value)
    assert [r["start"] for r in found if r["doc_id"] == 2] == [9]


def test_redact_by_another_key_and_a_clashing_name(spark):
    secret = "ghp_" + "a1B2c3D4e5F6" * 3
    df = spark.createDataFrame([(k, None, f"key {secret} end", "s") for k in range(3)], "row_id long, doc_id long, text string, source string") \
        .withColumn("_secrets", F.lit("mine"))
    found = scan(df.withColumn("doc_id", F.col("row_id")), Scratch(spark))
    out = redact(df, found, "row_id").collect()
    assert len(out) == 3 and all(r["text"] == "key [SECRET] end" and r["_secrets"] == "mine" and r["doc_id"] is None for r in out)
