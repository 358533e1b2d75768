import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from airlattice.llm import interning
from airlattice.llm.common import Scratch
from airlattice.llm.interning import Interned, blocks, pieces, xxhash64
from airlattice.llm.resample import resample

from tests.llm.util import awkward, docs

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def test_xxhash64_of_every_length():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 256, 4000, dtype=np.uint8).tobytes() + b" " * 40
    lanes = np.ndarray(len(text) - 7, "<u8", text, 0, (1,)).copy()
    start = rng.integers(0, 3800, 600)
    size = np.concatenate([np.arange(1, 131), rng.integers(1, 200, 470)])
    got = xxhash64(lanes, start, size)
    assert [int(h) for h in got] == [xxhash.xxh64_intdigest(text[a:a + n]) for a, n in zip(start.tolist(), size.tolist())]


def counted(texts, size):
    got, rows = Counter(), Counter()
    for block in blocks([None if t is None else t.encode() for t in texts], size):
        held = Interned(block, 2, 1000)
        for slot in np.flatnonzero(held.count):
            at = int(np.flatnonzero(held.slot == slot)[0])
            g = held.text[int(held.start[at]):int(held.start[at] + held.size[at])].decode()
            got[g] += int(held.count[slot])
            assert held.bucket[slot] == zlib.crc32(g.encode()) % 1000
        rows.update(held.row.tolist())
    return got, rows


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_interned_counts(size):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "B", "the ", "Über", " ", "--", "\n", "word ", "x" * 45, "9", "世界 "]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [None, "", "  ", "one", "ein Wort" + " " * 300 + "danach", "y" * 500 + " z"]
    got, rows = counted(texts, size)
    assert got == sum((Counter(grams(t)[1]) for t in texts), Counter())
    assert rows == Counter({i: len(grams(t)[1]) for i, t in enumerate(texts) if grams(t)[1]})


def test_equal_keys_are_told_apart_by_bytes(monkeypatch):
    monkeypatch.setattr(interning, "xxhash64", lambda lanes, start, size: np.full(len(start), 5, np.uint64))
    texts = ["aa ab aa ab ba aaaaaaaab aaaaaaaac aaaaaaaab", "ab abc ab"]
    assert counted(texts, 1 << 20)[0] == sum((Counter(grams(t)[1]) for t in texts), Counter())


def test_pieces_lose_no_word():
    rng = random.Random(8)
    for _ in range(50):
        text = "".join(rng.choice(["ab", "c", " ", "   ", "defgh"]) for _ in range(200)).encode()
        found = list(pieces(text, 30))
        assert b" ".join(b" ".join(p.split()[1 if again else 0:]) for p, again in found).split() == text.split()
        for (a, _), (b, again) in zip(found, found[1:]):
            assert not again or not a.split() or b.split()[0] == a.split()[-1]


def brute(rows, target, buckets, least, percent, seed):
    crc = lambda g: zlib.crc32(g.encode()) % buckets
    of, to = Counter(), Counter()
    for r in rows:
        of.update(crc(g) for g in grams(r[1])[1])
    for t in target:
        to.update(crc(g) for g in grams(t)[1])
    s, t = sum(of.values()), sum(to.values())
    gain = [math.floor(1000 * math.log((to[b] + 1) * float(s + buckets) / ((of[b] + 1) * float(t + buckets)))) for b in range(buckets)]
    out, able = [], []
    for n, r in enumerate(rows):
        w, g = grams(r[1])
        weight = sum(gain[crc(x)] for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([r[0], len(g), weight, score, None])
        if len(w) >= least:
            able.append(n)
    able.sort(key=lambda n: (-out[n][3], out[n][0] is None, out[n][0] or 0, out[n][1], out[n][2]))
    for k, n in enumerate(able[:percent * len(able) // 100]):
        out[n][4] = k + 1
    return sorted(map(tuple, out), key=str)


def run(spark, rows, target, **how):
    b = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, score string")
    return sorted((tuple(r) for r in resample(docs(spark, rows).repartition(3), b, Scratch(spark), **how).collect()), key=str)


@pytest.mark.parametrize("percent", [25, 100])
def test_equals_brute_force(spark, percent):
    rows = awkward() + [(2 ** 53 + 1, "many words " * 30, "en", "a", 1), (2 ** 53 + 3, "many words " * 30, "en", "a", 1), (2 ** 53 + 3, "other words " * 15, "en", "a", 1)]
    target = [rows[0][1], "many good words", None, ""]
    assert run(spark, rows, target, percent=percent) == brute(rows, target, 10_000, 20, percent, 7)


def test_few_buckets_and_empty_tables(spark):
    rows = awkward()
    assert run(spark, rows, [], buckets=3, percent=50, seed=1) == brute(rows, [], 3, 20, 50, 1)
    assert run(spark, [], ["a b c"]) == []
