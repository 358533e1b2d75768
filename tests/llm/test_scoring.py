import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlattice.llm import lattice, scoring
from airlattice.llm.common import Scratch, fold
from airlattice.llm.lattice import SPACE, Vocabulary, marginals
from airlattice.llm.scoring import score
from tests.llm.util import awkward, docs


def tiny():
    pieces = [f"<0x{b:02X}>" for b in range(256)] + [SPACE, SPACE + "a", "a", "b", "ab", "ba", "aba", "bab"]
    p = np.full(len(pieces), 0.001)
    p[256:] = [0.1, 0.2, 0.15, 0.1, 0.05, 0.07, 0.03, 0.04]
    return Vocabulary(pieces, list(range(256)), np.log(p))


def by_enumeration(word, v):
    """Every way to cut the word; (total probability, expected uses)."""
    text, total, uses = SPACE + word, 0.0, Counter()
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        parts, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(text[at:i])
                at = i
        parts.append(text[at:])
        ids, p = [], 1.0
        for s in parts:
            own = [v.ids[s]] if s in v.ids else v.bytes_of(s) if len(s) == 1 else None
            if own is None:
                p = 0.0
                break
            ids += own
            p *= math.prod(math.exp(v.logp[i]) for i in own)
        total += p
        for i in ids if p else []:
            uses[i] += p
    return total, uses


@pytest.mark.parametrize("limit", [40, 0])     # by matrix, one by one
def test_marginals_and_expected_uses(monkeypatch, limit):
    monkeypatch.setattr(lattice, "MATRIX", limit)
    v, words = tiny(), ["", "a", "ab", "abab", "baabb", "xa", "é", "abaß"]
    expected = np.zeros(len(v.pieces))
    got = marginals(words, v, np.full(len(words), 2.0), expected)
    want = np.zeros(len(v.pieces))
    for w, lp in zip(words, got):
        total, uses = by_enumeration(w, v)
        assert lp == pytest.approx(math.log(total), rel=1e-9)
        for i, u in uses.items():
            want[i] += 2 * u / total
    assert np.allclose(expected, want)


def test_long_words_do_not_underflow():
    v = tiny()
    lp = marginals(["ab" * 20_000], v)[0]
    assert np.isfinite(lp) and lp < -10_000


def test_prior_is_a_distribution():
    v = lattice.prior(scoring.VOCABULARY)
    assert math.exp(np.logaddexp.reduce(v.logp)) == pytest.approx(1.0)


def test_scores_against_brute_force(spark):
    rows = awkward()
    got = score(docs(spark), fold(F.col("doc_id"), 7) == 2, Scratch(spark)).toPandas()
    assert len(got) == len(rows)
    counts, held = Counter(), {}
    for i, text, *_ in rows:
        out = zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
        w = (text.encode().lower().split() if text else []) + [b"\0end"]
        held.setdefault(i, []).append((out, w))
        if not out:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = sorted((out, len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6))
                  for each in held.values() for out, w in each)
    have = sorted((bool(r.held_out), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got.itertuples())
    for a, b in zip(want, have):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) <= 1e-6 * max(1, abs(a[3]))
    assert (got.train_tokens == n).all() and np.isfinite(got.score).all() and (got.score < 0).all()
    # The same text has the same score in every row, a longer one a lower score.
    assert got[got.doc_id.isin([1, 2])].score.nunique() == 1


def test_nothing_learned_and_empty(spark):
    got = score(docs(spark, [(1, "one two", None, None, 0)]), F.lit(True), Scratch(spark)).first()
    assert got["base_score"] == 0.0 and got["train_tokens"] == 0 and got["n_known"] == 0 and got["score"] < 0
    assert score(docs(spark, []), F.lit(False), Scratch(spark)).count() == 0
