import base64
import datetime as dt
import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from airlattice.llm import warc
from airlattice.llm.common import Scratch
from airlattice.llm.warc import LoserTree, capture_history, url_key, walk

SCHEMA = "id long, url string, payload string, captured timestamp"
T0 = dt.datetime(2024, 1, 1)


def expected(rows, least=0):
    first = {}
    for i, _, text, _ in rows:
        p = (text or "").encode()
        if i is not None and len(p) >= least:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, _, text, _ in rows:
        p = (text or "").encode()
        again = len(p) >= least and p in first and first[p] != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(),
                    "revisit" if again else "response", first[p] if again else None))
    return sorted(out, key=str)


def history(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS bytes", "2 AS digest", "3 AS n", "4 AS range")
    return capture_history(df, Scratch(spark), **how).collect()


def digest(rows):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str)


AWKWARD = [(1, "http://a.example/x", "<p>one</p>", T0), (2, "http://a.example/x", "<p>one</p>", T0),
           (3, None, None, None), (4, "", "", T0), (5, "http://b.example/ü ?q=\n1", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nb", T0),
           (6, "https://www.a.example:443/x#top", "ünïcode" * 50_000, T0), (None, "http://c.example", "no id", T0),
           (None, "http://c.example", "<p>one</p>", T0), (7, "http://a.example/x", "\r\n", T0), (2, "http://a.example/x", "<p>one</p>", T0)]


def test_round_trip_of_awkward_captures(spark):
    assert digest(history(spark, AWKWARD)) == expected(AWKWARD)
    assert digest(history(spark, AWKWARD, min_bytes=5)) == expected(AWKWARD, 5)


def test_empty(spark):
    assert history(spark, []) == []


def test_global_order_over_ranges_and_a_hot_url(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, "http://hot.example/same" if i % 3 == 0 else f"http://h{rng.randint(0, 9)}.example/{rng.randint(0, 30)}",
             f"text {rng.randint(0, 200)}", T0 + dt.timedelta(seconds=rng.randint(0, 50))) for i in range(600)]
    monkeypatch.setattr(warc, "RANGE_ROWS", 40)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    got = history(spark, rows)
    assert digest(got) == expected(rows)
    placed = sorted(got, key=lambda r: (r["range"], r["position"]))
    keys = [(r["url_key"], r["captured"], r["archive"], r["offset"]) for r in placed]
    assert keys == sorted(keys) and len({r["range"] for r in got}) > 5
    most = max(sum(r["range"] == k for r in got) for k in {r["range"] for r in got})
    assert most < 150


@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree_merges(runs):
    tagged = [[(x, r, i) for i, x in enumerate(sorted(run))] for r, run in enumerate(runs)]
    assert list(LoserTree([iter(t) for t in tagged])) == sorted(x for t in tagged for x in t)


def test_url_keys():
    assert url_key("https://www.News.example.co.uk:443/a/b?x=1#frag") == "uk,co,example,news)/a/b?x=1"
    assert url_key("http://example.org:8080") == "org,example:8080)/"
    assert url_key("http://user@example.org/") == "org,example)/"


def test_damaged_archive_is_an_error():
    with pytest.raises(ValueError):
        list(walk(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nshort\r\n\r\n"))
    with pytest.raises(ValueError):
        list(walk(b"something else"))
