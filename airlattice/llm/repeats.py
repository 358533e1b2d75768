"""Repeated passages by a suffix array and its common-prefix interval tree.

Documents are packed in parcels, a written table. Every window of ``length`` bytes belongs to a context (see
``suffixes``). Four steps:

1. Each parcel sends the distinct hashes of its anchors, dealt in buckets that stand on shelves; a shelf finds those that
   occur in several documents and answers each parcel.
2. Each parcel sends its distinct contexts around such anchors, with the smallest and largest document they occur in.
3. For each bucket a shelf builds the enhanced suffix array of its distinct contexts. A stack scan walks the common-prefix
   interval tree; an interval in several documents whose members follow different bytes (or begin
   their context) is a repeat, and every member of it, not just neighbours, is answered to the parcels.
4. Each parcel maps the answers back to its places.

A parcel and a shelf exchange one message a step. Buckets grow in number with the text and so do parcels, but shelves do
not before each holds ``FULL`` buckets, so there are no messages for every parcel and bucket.

A repeat longer than a context comes as a chain of overlapping groups, one for each context on its way. A
hash only decides where strings meet; repeats are found by comparing bytes.

Hot passages: a parcel sends a hash or context once, however often it holds it. An anchor with more than
``HEAVY`` occurrences is not dealt by its hash: each of its windows becomes a context of its own, dealt by its bytes,
so that equal windows merge and different ones go to different buckets. Nothing is dropped.

Defined cases: null and empty texts and texts shorter than ``length`` hold no repeat; rows that repeat an id are one document to each other
(no repeat among them); rows without an id count as the largest id; a repeat within one document alone is none; an
empty table gives an empty result; other columns are ignored. Texts are UTF-8 bytes, of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlattice.functions.grouped import groups
from airlattice.llm.common import Scratch, small_batches
from airlattice.llm.suffixes import contexts, repeats

PARCEL = 1 << 22         # bytes of text that are packed together (a longer text is a parcel of its own)
BUCKET = 1 << 17         # anchors whose contexts are compared in one task at a time, about
SHELVES = 256            # groups of buckets that get messages of their own
FULL = 16                # buckets of a shelf from which there are more shelves
HEAVY = 50_000           # occurrences from which an anchor's windows are dealt by their own bytes
LAST = (1 << 63) - 1     # stands for a missing id


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, compressed together."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // sum(np.dtype(t).itemsize for t in types)
    out, at = [], 0
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def parcels(docs: DataFrame, parcel: int = PARCEL) -> DataFrame:
    """(parcel, n_bytes, ids, known, sizes, body): documents packed together, texts compressed."""
    names = ["parcel", "n_bytes", "ids", "known", "sizes", "body"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        ids: list[int | None] = []
        texts: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            row = (number, size, np.array([LAST if i is None else i for i in ids], "<i8").tobytes(), bytes(i is not None for i in ids),
                   np.array([len(t) for t in texts], "<i8").tobytes(), zstandard.ZstdCompressor(level=3).compress(b"".join(texts)))
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, types)], names=names)
        for batch in batches:
            for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
                if ids and size + len(t or b"") > parcel:
                    yield out()
                    number += 1
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t or b"")
                size += len(t or b"")
        if ids:
            yield out()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        work, "parcel long, n_bytes long, ids binary, known binary, sizes binary, body binary")


@dataclass(frozen=True)
class Deal:
    """How anchors are dealt: ``buckets`` in all, each shelf holds ``each`` neighbouring ones."""
    length: int
    buckets: int
    each: int

    def of(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.int32)


def dealt(total: int, length: int, bucket: int, shelves: int) -> Deal:
    """The deal for ``total`` bytes of text."""
    buckets = max(1, -(-4 * total // (length * bucket)))
    return Deal(length, buckets, -(-buckets // max(min(buckets, shelves), -(-buckets // FULL))))


@dataclass
class Shared:
    """The distinct contexts of a parcel that are told, ordered by bucket; occurrences in the order of their contexts."""
    bucket: np.ndarray       # of a context
    start: np.ndarray        # of a context's first occurrence
    end: np.ndarray
    head: np.ndarray         # place of a context's first occurrence in ``place``, and the number of all at the end
    place: np.ndarray        # of an occurrence
    doc: np.ndarray


def _runs(n: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The places of runs of lengths ``n`` that begin at ``head``, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(head, n)


def _parts(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, behind the last) place of every run of equal numbers."""
    edge = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.empty(0, np.int64)
    return edge, np.r_[edge[1:], len(sorted_)] if len(edge) else edge


class Parcel:
    """The texts of one parcel and their contexts."""

    def __init__(self, row: dict, deal: Deal):
        self.number, self.deal = row["parcel"], deal
        self.ids, self.sizes = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["sizes"], "<i8")
        self.known = row["known"]
        self.body = zstandard.ZstdDecompressor().decompress(row["body"]) if row["n_bytes"] else b""
        buf = np.frombuffer(self.body, np.uint8)
        doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.start, self.end, sig = contexts(buf, doc, deal.length)
        self.id = self.ids[doc[self.start]] if len(self.start) else self.ids[:0]
        self.sigs, self.which = np.unique(sig, return_inverse=True)
        bucket = deal.of(self.sigs)
        self.order = np.argsort(bucket, kind="stable")     # distinct anchors as they are sent
        self.shelf = bucket[self.order] // deal.each

    def anchors(self) -> Iterator[tuple[int, bytes]]:
        """(shelf, anchors): the low 6 bytes of each hash, its occurrences (as far as 65535) and whether several documents hold it."""
        n = np.bincount(self.which, minlength=len(self.sigs))
        lo, hi = np.full(len(n), LAST), np.full(len(n), -LAST - 1)
        np.minimum.at(lo, self.which, self.id)
        np.maximum.at(hi, self.which, self.id)
        low = self.sigs.view(np.uint8).reshape(-1, 8)[:, :6]
        for a, b in zip(*(e.tolist() for e in _parts(self.shelf))):
            at = self.order[a:b]
            yield int(self.shelf[a]), b"".join((low[at].tobytes(), np.minimum(n[at], 65535).astype("<u2").tobytes(),
                                                 (lo[at] < hi[at]).astype(np.uint8).tobytes()))

    def shared(self, states: list[tuple[int, bytes]]) -> Shared:
        """The distinct contexts given the shelves' answers; those of one bucket in the order of their first places."""
        state = np.zeros(len(self.sigs), np.uint8)
        for shelf, blob in states:
            a, b = np.searchsorted(self.shelf, [shelf, shelf + 1])
            state[self.order[a:b]] = unpack(blob, "u1")[0]
        state = state[self.which]
        body, length = self.body, self.deal.length
        own = np.flatnonzero(state == 1)
        # Equal contexts have one anchor, so those of an anchor that comes once are alone.
        anchor = self.which[own]
        group = np.arange(len(own))
        seen: dict[bytes, int] = {}
        for k in np.flatnonzero(np.bincount(anchor, minlength=len(self.sigs))[anchor] > 1).tolist():
            group[k] = seen.setdefault(body[self.start[own[k]]:self.end[own[k]]], k)
        start, end, doc, bucket = self.start[own], self.end[own], self.id[own], self.deal.of(self.sigs[anchor])
        heavy = np.flatnonzero(state == 2)
        if len(heavy):
            n = self.end[heavy] - self.start[heavy] - length + 1
            at = _runs(n, self.start[heavy])
            seen, same, home = {}, [], []
            for k, s in enumerate(at.tolist(), len(own)):
                window = body[s:s + length]
                held = seen.setdefault(window, k)
                same.append(held)
                home.append((xxhash.xxh3_64_intdigest(window) >> 40) % self.deal.buckets if held == k else home[held - len(own)])
            start, end = np.concatenate([start, at]), np.concatenate([end, at + length])
            doc, bucket = np.concatenate([doc, np.repeat(self.id[heavy], n)]), np.concatenate([bucket, np.array(home, np.int32)])
            group = np.concatenate([group, np.array(same, np.int64)])
        order = np.lexsort((group, bucket))
        first, stop = _parts(group[order])
        lead = order[first]
        return Shared(bucket[lead], start[lead], end[lead], np.r_[first, len(order)], start[order], doc[order])


def _in_parcels(rows: DataFrame, deal: Deal, schema: str, out: Callable) -> DataFrame:
    """Rows of ``out(parcel, row)`` for each parcel."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                yield out(Parcel(row, deal), row)
    return rows.mapInArrow(work, schema)


def _answered(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("parcel").agg(F.collect_list(F.struct("shelf", "blob")).alias(name))


def find(docs: DataFrame, scratch: Scratch, length: int, *, parcel: int | None = None, bucket: int | None = None,
         heavy: int | None = None, shelves: int | None = None) -> tuple[DataFrame, Deal]:
    """Parcels with the shelves' answers (``states``: shared anchors, ``found``: repeats by context), and the deal."""
    parcel, bucket = PARCEL if parcel is None else parcel, BUCKET if bucket is None else bucket
    heavy, shelves = HEAVY if heavy is None else heavy, SHELVES if shelves is None else shelves
    if length < 8:
        raise ValueError("repeats shorter than 8 bytes are not looked for")
    small_batches(docs.sparkSession)
    packed = scratch.save(parcels(docs, parcel), "parcels")
    total = packed.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    deal = dealt(total, length, bucket, shelves)

    def send(parcel: Parcel, row: dict) -> pa.RecordBatch:
        sent = list(parcel.anchors())
        return pa.record_batch([pa.array([b for b, _ in sent], pa.int32()), pa.array([parcel.number] * len(sent), pa.int64()),
                                pa.array([x for _, x in sent], pa.binary())], names=["shelf", "parcel", "blob"])

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in groups(frames, "shelf"):
            blobs = pdf["blob"].tolist()
            sizes = np.array([len(b) // 9 for b in blobs])
            keys = np.zeros((sizes.sum(), 8), np.uint8)
            keys[:, :6] = np.frombuffer(b"".join(b[:6 * n] for b, n in zip(blobs, sizes.tolist())), np.uint8).reshape(-1, 6)
            n = np.frombuffer(b"".join(b[6 * k:8 * k] for b, k in zip(blobs, sizes.tolist())), "<u2")
            many = np.frombuffer(b"".join(b[8 * k:] for b, k in zip(blobs, sizes.tolist())), np.uint8)
            key, at = np.unique(keys.view(np.uint64).ravel(), return_inverse=True)
            shared = (np.bincount(at) > 1) | (np.bincount(at, many) > 0)
            state = np.where(shared, np.where(np.bincount(at, n) > heavy, 2, 1), 0).astype(np.uint8)[at]
            ends = np.cumsum(sizes).tolist()
            parts = [state[e - s:e] for s, e in zip(sizes.tolist(), ends)]
            hit = [k for k, p in enumerate(parts) if p.any()]
            yield pd.DataFrame({"parcel": pdf["parcel"].to_numpy()[hit], "shelf": pdf["shelf"].to_numpy()[hit],
                                "blob": [pack(parts[k]) for k in hit]})
    sent = _in_parcels(packed, deal, "shelf int, parcel long, blob binary", send)
    states = scratch.save(sent.repartition("shelf").sortWithinPartitions("shelf").mapInPandas(
        match, "parcel long, shelf int, blob binary"), "states")
    rows = packed.join(_answered(states, "states"), "parcel")

    def tell(parcel: Parcel, row: dict) -> pa.RecordBatch:
        own, body = parcel.shared([(s["shelf"], s["blob"]) for s in row["states"]]), parcel.body
        n = len(own.bucket)
        lo, hi = (f.reduceat(own.doc, own.head[:-1]) if n else own.doc for f in (np.minimum, np.maximum))
        start, end, shelf = own.start.tolist(), own.end.tolist(), own.bucket // deal.each
        first, stop = _parts(shelf)
        cuts = list(zip(first.tolist(), stop.tolist()))
        blobs = [pack((own.end[a:b] - own.start[a:b]).astype("<u2"), (own.bucket[a:b] % deal.each).astype("<u4"),
                      lo[a:b].astype("<i8"), hi[a:b].astype("<i8")) for a, b in cuts]
        bodies = [zstandard.ZstdCompressor(level=1).compress(b"".join([body[s:e] for s, e in zip(start[a:b], end[a:b])])) for a, b in cuts]
        return pa.record_batch([pa.array(shelf[first], pa.int32()), pa.array([parcel.number] * len(cuts), pa.int64()),
                                pa.array(blobs, pa.binary()), pa.array(bodies, pa.binary())], names=["shelf", "parcel", "blob", "body"])

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in groups(frames, "shelf"):
            told = [unpack(b, "<u2", "<u4", "<i8", "<i8") for b in pdf["blob"]]
            counts = np.array([len(t[0]) for t in told])
            size, part, lo, hi = (np.concatenate(c) for c in zip(*told))
            raw, ends = b"".join([zstandard.ZstdDecompressor().decompress(b) for b in pdf["body"]]), np.cumsum(size, dtype=np.int64)
            begin, order = ends - size, np.argsort(part, kind="stable")
            found = []
            for a, b in zip(*(e.tolist() for e in _parts(part[order]))):
                own = order[a:b]
                seen: dict[bytes, int] = {}
                member = np.array([seen.setdefault(raw[s:e], len(seen)) for s, e in zip(begin[own].tolist(), ends[own].tolist())])
                least, most = np.full(len(seen), LAST), np.full(len(seen), -LAST - 1)
                np.minimum.at(least, member, lo[own])
                np.maximum.at(most, member, hi[own])
                string, start, end, first = repeats(list(seen), least, most, length)
                by = np.argsort(string, kind="stable")
                a, b = np.searchsorted(string, member, sorter=by), np.searchsorted(string, member, "right", sorter=by)
                at = by[_runs(b - a, a)]
                found.append((np.repeat(own, b - a), start[at].astype("<u2"), end[at].astype("<u2"), first[at].astype("<i8")))
            own, start, end, first = (np.concatenate(c) for c in zip(*found))
            by = np.argsort(own, kind="stable")
            own, start, end, first = own[by], start[by], end[by], first[by]
            head = np.cumsum(counts) - counts
            cuts = np.searchsorted(own, np.r_[head, counts.sum()]).tolist()
            out = [(parcel, shelf, pack((own[a:b] - h).astype("<i4"), start[a:b], end[a:b], first[a:b]))
                   for parcel, shelf, h, a, b in zip(pdf["parcel"].tolist(), pdf["shelf"].tolist(), head.tolist(), cuts, cuts[1:]) if a < b]
            yield pd.DataFrame(out, columns=["parcel", "shelf", "blob"])
    told = _in_parcels(rows, deal, "shelf int, parcel long, blob binary, body binary", tell)
    found = scratch.save(told.repartition("shelf").sortWithinPartitions("shelf").mapInPandas(
        scan, "parcel long, shelf int, blob binary"), "found")
    return packed.join(_answered(states, "states").join(_answered(found, "found"), "parcel"), "parcel", "left"), deal


def _places(parcel: Parcel, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest document, own document) of every occurrence of every repeat in a parcel."""
    none = np.empty(0, np.int64)
    if not row["found"]:
        return none, none, none, none
    own = parcel.shared([(s["shelf"], s["blob"]) for s in row["states"]])
    shelf = own.bucket // parcel.deal.each
    answers = [unpack(a["blob"], "<i4", "<u2", "<u2", "<i8") for a in row["found"]]
    head = np.searchsorted(shelf, [a["shelf"] for a in row["found"]])
    which = np.repeat(head, [len(a[0]) for a in answers]) + np.concatenate([a[0] for a in answers])
    start, end, first = (np.concatenate([a[c] for a in answers]).astype(np.int64) for c in (1, 2, 3))
    times = own.head[which + 1] - own.head[which]
    at = _runs(times, own.head[which])
    place = own.place[at]
    return place + np.repeat(start, times), place + np.repeat(end, times), np.repeat(first, times), own.doc[at]


def _covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Whether each of ``n`` bytes lies in a span."""
    steps = np.zeros(n + 1, np.int8)
    if len(start):
        order = np.argsort(start, kind="stable")
        start, reach = start[order], np.maximum.accumulate(end[order])
        edge = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
        steps[start[edge]] = 1
        steps[reach[np.r_[edge[1:], len(start)] - 1]] = -1
    return np.cumsum(steps[:n], dtype=np.int8).view(bool)


def repeat_groups(docs: DataFrame, scratch: Scratch, *, length: int = 50, **limits: int) -> DataFrame:
    """(doc_id, text) -> repeat_id, doc_id, start, n_bytes, first_id: all occurrences of all repeats.

    ``repeat_id`` is the SHA-1 of the repeated bytes, ``start`` a byte offset, ``first_id`` the smallest document that holds it.
    """
    rows, deal = find(docs, scratch, length, **limits)

    def work(parcel: Parcel, row: dict) -> pa.RecordBatch:
        start, end, first, _ = _places(parcel, row)
        begin = np.cumsum(parcel.sizes) - parcel.sizes
        doc = np.searchsorted(begin, start, "right") - 1
        digests = [hashlib.sha1(parcel.body[a:b]).hexdigest() for a, b in zip(start.tolist(), end.tolist())]
        return pa.record_batch([pa.array(digests, pa.string()), pa.array([int(parcel.ids[d]) if parcel.known[d] else None for d in doc.tolist()], pa.int64()),
                                pa.array(start - begin[doc]), pa.array(end - start), pa.array(first)], names=["repeat_id", "doc_id", "start", "n_bytes", "first_id"])
    return _in_parcels(rows, deal, "repeat_id string, doc_id long, start long, n_bytes long, first_id long", work)


def without_repeats(docs: DataFrame, scratch: Scratch, *, length: int = 50, **limits: int) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept: the text's bytes without those of a repeat
    that a document of smaller id holds too. All repeats are judged on the input."""
    rows, deal = find(docs, scratch, length, **limits)

    def work(parcel: Parcel, row: dict) -> pa.RecordBatch:
        start, end, first, own = _places(parcel, row)
        again = first < own
        n = len(parcel.body)
        gone = _covered(start[again], end[again], n)
        buf = np.frombuffer(parcel.body, np.uint8)
        removed, spans, kept = [], [], []
        at = 0
        for size in parcel.sizes.tolist():
            mask = gone[at:at + size]
            removed.append(int(mask.sum()))
            spans.append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
            kept.append(buf[at:at + size][~mask].tobytes() if removed[-1] else parcel.body[at:at + size])
            at += size
        return pa.record_batch([pa.array([i if k else None for i, k in zip(parcel.ids.tolist(), parcel.known)], pa.int64()),
                                pa.array(parcel.sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                                pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    return _in_parcels(rows, deal, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", work)
