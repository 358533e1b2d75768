import hashlib
import random

import numpy as np
import pytest

from airlattice.llm.common import Scratch
from airlattice.llm.repeats import LAST, repeat_groups, without_repeats
from airlattice.llm.suffixes import PIECE, contexts, intervals, suffix_array

from tests.llm.util import awkward, docs


def brute(rows, length):
    """Every window of every text, by a dictionary."""
    texts = [(LAST if r[0] is None else r[0], r[0], (r[1] or "").encode()) for r in rows]
    first = {}
    for key, _, b in texts:
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            first[w] = min(first.get(w, key), key)
    out = []
    for key, i, b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < key:
                gone[p:p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, length=50, **limits):
    found = without_repeats(docs(spark, rows).repartition(3), Scratch(spark), length=length, **limits)
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in found.collect()), key=str)


def pieces(rng, n):
    """Texts made of shared and of fresh parts over few letters, with runs of one letter, line ends, zeros and wide letters."""
    shared = ["".join(rng.choice(al) for _ in range(rng.randint(5, 150))) for al in ["ab", "abcdefgh \n", "xyé世", "a\x00"] for _ in range(4)]
    shared += ["a" * 120, "ab" * 70, "abc" * 40]
    return ["".join(rng.choice(shared) if rng.random() < 0.6 else "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(1, 80)))
                    for _ in range(rng.randint(0, 6))) for _ in range(n)]


@pytest.mark.parametrize("limits", [{}, {"parcel": 300, "bucket": 64}, {"parcel": 500, "bucket": 200, "heavy": 3}, {"heavy": 0}])
def test_equals_brute_force(spark, limits):
    rng = random.Random(len(limits))
    rows = [(2 ** 53 + i if i % 7 else None, t, "en", "a", 1) for i, t in enumerate(pieces(rng, 50))]
    rows += [(2 ** 53 + 3, t, "en", "a", 1) for t in pieces(rng, 3)] + rows[:2]     # ids that repeat
    assert run(spark, rows, **limits) == brute(rows, 50)


def test_other_lengths(spark):
    rng = random.Random(9)
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(pieces(rng, 25))]
    for length in (9, 16, 33):
        assert run(spark, rows, length, parcel=400) == brute(rows, length)


def test_awkward_rows(spark):
    rows = awkward()
    found = run(spark, rows)
    assert len(found) == len(rows)
    short = [r for r in rows if len(r[1] or "") < 150_000]
    assert run(spark, short) == brute(short, 50)
    assert without_repeats(docs(spark, []), Scratch(spark)).count() == 0


def test_long_texts_are_whole(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3 * PIECE))
    rows = [(1, long, "en", "a", 1)]
    # a passage across every border of a piece, and one at the very end
    for k, at in enumerate([PIECE - 60, PIECE - 25, 2 * PIECE - 49, 2 * PIECE - 1, 3 * PIECE - 50]):
        rows.append((2 + k, "<" + long[at:at + 70] + ">", "en", "a", 1))
    got = {r[0]: r[1:4] for r in run(spark, rows)}
    assert got[1][1:] == (0, 0)
    assert all(got[i][1:] == (min(70, got[i][0] - 2), 1) for i in range(2, 7))


def test_suffix_array_and_intervals():
    rng = random.Random(2)
    for _ in range(20):
        strings = sorted({bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(8, 30))) for _ in range(30)})
        string, place, common, _ = suffix_array(strings, 8)
        got = [strings[s][p:] for s, p in zip(string, place)]
        assert got == sorted(got)
        every = sorted(s[p:] for s in strings for p in range(len(s) - 7))
        assert len(got) == sum(1 for k, t in enumerate(every) if (k and every[k - 1][:8] == t[:8]) or (k + 1 < len(every) and every[k + 1][:8] == t[:8]))
        for k in range(1, len(got)):
            n = 0
            while n < min(len(got[k]), len(got[k - 1])) and got[k][n] == got[k - 1][n]:
                n += 1
            assert common[k] == n
    # the tree of [aab, aac, ad, ad]: {0,1} of depth 2 within {0..3} of depth 1, and {2,3} of depth 2
    assert sorted(intervals([0, 2, 1, 2], [1, 2, 3, 4], [1, 2, 3, 4], [-1] * 4, 1)) == [(0, 1, 2, 1), (0, 3, 1, 1), (2, 3, 2, 3)]
    assert intervals([0, 2, 1, 2], [1, 2, 3, 4], [1, 2, 3, 4], [97] * 4, 1) == []
    assert intervals([0, 2, 1, 2], [1, 1, 3, 3], [1, 1, 3, 3], [-1] * 4, 2) == []


def test_equal_windows_have_equal_contexts_anchors():
    rng = np.random.default_rng(1)
    buf = rng.integers(97, 100, 3000).astype(np.uint8)
    buf[1000:1400] = buf[:400]
    doc = np.zeros(3000, np.int32)
    start, end, sig = contexts(buf, doc, 50)
    window = {int(p): int(s) for a, b, s in zip(start, end, sig) for p in range(a, b - 49)}
    assert sorted(window) == list(range(2951))
    assert all(window[p] == window[p + 1000] for p in range(351))


def test_groups_hold_all_occurrences(spark):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(60))
    rows = [(i, "".join(rng.choice("klmnop ") for _ in range(rng.randint(5, 40))) + passage + "".join(rng.choice("qrstuv ") for _ in range(20)), "en", "a", 1)
            for i in range(12)]
    rows += [(50, "unlike " * 3 + "anything else here", "en", "a", 1)]
    found = repeat_groups(docs(spark, rows), Scratch(spark)).collect()
    at = {r[0]: r[1].index(passage) for r in rows[:12]}
    text = {r[0]: r[1].encode() for r in rows}
    members = {}
    for r in found:
        part = text[r["doc_id"]][r["start"]:r["start"] + r["n_bytes"]]
        assert hashlib.sha1(part).hexdigest() == r["repeat_id"]
        members.setdefault(r["repeat_id"], set()).add((r["doc_id"], r["start"] - at[r["doc_id"]]))
    covered = set()
    for where in members.values():
        if {d for d, _ in where} == set(range(12)):
            covered |= {o for _, o in where}
    assert covered       # groups of all twelve documents, at equal places of the passage
    full = [w for w in members.values() if {d for d, _ in w} == set(range(12))]
    assert all(len({o for _, o in w}) == 1 for w in full)
    union = np.zeros(60, bool)
    for r in found:
        if r["doc_id"] == 11:
            o = r["start"] - at[11]
            union[max(o, 0):o + r["n_bytes"]] = True
    assert union.all()


def test_messages_follow_the_parcels(spark, monkeypatch):
    """A parcel and a shelf exchange one message a step, however many buckets there are; the result stays that of brute force."""
    from airlattice.llm import repeats as R

    class Counted(Scratch):
        def save(self, df, name):
            saved = super().save(df, name)
            counts[name] = saved.count()
            return saved
    monkeypatch.setattr(R, "SHELVES", 4, raising=False)
    rng = random.Random(11)
    shared = ["".join(rng.choice("abcdefghij ") for _ in range(90)) for _ in range(150)]
    rows = [(i, "".join(rng.sample(shared, 12)), "en", "a", 1) for i in range(40)]
    counts = {}
    found = without_repeats(docs(spark, rows).repartition(2), Counted(spark), parcel=6000, bucket=64).collect()
    buckets = -(-4 * sum(len(t) for _, t, *_ in rows) // (50 * 64))
    assert buckets > 40 and counts["parcels"] < 12
    assert counts["states"] <= 4 * counts["parcels"] and counts["found"] <= 4 * counts["parcels"]
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in found), key=str)
    assert got == brute(rows, 50)


def test_spans_that_meet_are_one(spark):
    from airlattice.llm.repeats import _covered
    rng = np.random.default_rng(3)
    for n in (0, 1, 40):
        start = rng.integers(0, max(n, 1), 8 if n else 0)
        end = np.minimum(start + rng.integers(1, 6, len(start)), n)
        want = np.zeros(n, bool)
        for a, b in zip(start, end):
            want[a:b] = True
        assert (_covered(start, end, n) == want).all()
    assert _covered(np.array([0, 3, 3]), np.array([3, 9, 5]), 9).all()
