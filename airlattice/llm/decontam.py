"""Benchmark decontamination: a BM25 index of test items searched with block-max WAND.

Test items are cut into parts of at most ``PART`` words and indexed; weights are BM25 contributions
as shares of the part's own best score, so a score lies between 0 and 1. Every
document is cut into passages that overlap so that each stretch of ``PART`` words lies whole in one,
and every passage queries the index for all parts above the threshold. A hit is then verified: the
document must hold enough of the item's question and of its answer as word shingles.

Search: parts lie in the index by length, in blocks of a few. For all passages of a batch at once, the largest
contributions of their terms per block are summed; a passage in which no block can reach the
threshold has no pivot and is skipped. The others run block-max WAND: a pivot by term maxima, a second
bound by the maxima of the posting blocks there, skips past blocks that cannot reach the
threshold, and full scores only where both bounds hold.

The index is made in slices of at most ``SLICE`` item words, each sent to all tasks; more test items make more
slices and one scan of the corpus each, so what is broadcast is bounded.

Words are runs of letters, marks and digits of any script, so numbers count: items that differ in them are
different items, and a number can be an answer.

Defined cases: null and empty documents have no passage; null, empty and wordless items are
not indexed; an item without a second sentence has no answer and only its question
counts; repeated items are each reported; repeated documents each count; rows without doc_id carry null; empty tables give
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlattice.llm.common import kept, small_batches
from airlattice.llm.lexical import Lookup, blocks, hashed_words

PART = 40              # words of an indexed part at most
STRIDE = 24
WINDOW = PART + STRIDE  # words of a passage: any PART words are whole in one
THRESHOLD = 0.7        # BM25 score as a share of the part's own
OVERLAP = 0.8          # share of question and answer shingles that confirms a hit
SHINGLE = 5
K1, B = 1.2, 0.75
POSTINGS = 16          # postings of a block
PARTS = 2              # parts of a block in the bound over all passages
EVERYWHERE = 0.1       # share of blocks from which on a term is bounded by a constant there
SLICE = 100_000        # item words of one index
END = 1 << 60


@lru_cache(maxsize=1)
def _gaps() -> re.Pattern:
    """Characters beyond ASCII that separate words: punctuation, symbols and spaces."""
    other = [c for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in "PSZ"]
    cut = np.flatnonzero(np.diff(other) > 1) + 1
    return re.compile("[" + "".join(f"{chr(x[0])}-{chr(x[-1])}" for x in np.split(np.array(other), cut)) + "]")


def plain(text: str | None) -> str | None:
    """The text with spaces for separators beyond ASCII, whose bytes would count as letters."""
    return text if text is None or text.isascii() else _gaps().sub(" ", text)


def hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the runs of letters and digits of a whole text, in order."""
    out = []
    for block in blocks([plain(text)]):
        _, runs, found = hashed_words(block, (), 1, digits=True)
        out.append(found[0])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingled(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the k-word shingles; fewer words are one shingle."""
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    a = np.full(n, k, np.uint64)
    for i in range(k):
        a = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n]
    return np.unique(a)


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence or line is the answer, what stands before it the question; a point inside a number ends nothing."""
    parts = [m.end() for m in re.finditer(r"(?:[?!\n]|\.(?!(?<=\d\.)\d))+\s*(?=\S)", text.rstrip())]
    cut = parts[-1] if parts else len(text)
    return text[:cut], text[cut:]


class Postings:
    """Inverted index of the parts: postings in blocks with their maxima."""

    def __init__(self, parts: list[tuple[int, np.ndarray, np.ndarray]]):
        """``parts``: (part number, term numbers, weights), by rising number."""
        lists: dict[int, list[tuple[int, float]]] = {}
        for number, terms, weights in parts:
            for t, w in zip(terms.tolist(), weights.tolist()):
                lists.setdefault(t, []).append((number, w))
        self.docs = {t: [n for n, _ in x] for t, x in lists.items()}
        self.weights = {t: [w for _, w in x] for t, x in lists.items()}
        self.most = {t: max(w) for t, w in self.weights.items()}
        self.block_most = {t: [max(w[i:i + POSTINGS]) for i in range(0, len(w), POSTINGS)] for t, w in self.weights.items()}
        self.block_last = {t: [d[min(i + POSTINGS, len(d)) - 1] for i in range(0, len(d), POSTINGS)]
                           for t, d in self.docs.items()}

    def search(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All parts whose summed weights over ``terms`` reach ``least``."""
        cursors = [[self.docs[t][0], t, 0] for t in terms if t in self.docs]
        found = []

        def move(c: list[int], to: int) -> None:
            docs = self.docs[c[1]]
            c[2] = bisect_left(docs, to, c[2])
            c[0] = docs[c[2]] if c[2] < len(docs) else END

        while True:
            cursors = sorted(c for c in cursors if c[0] < END)
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += self.most[c[1]]
                if bound >= least:
                    pivot = i
                    break
            if pivot < 0:
                return found
            at = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
                pivot += 1
            # The blocks that hold the pivot part, and where the first of them ends.
            tight, ends = 0.0, END
            for c in cursors[:pivot + 1]:
                k = bisect_left(self.block_last[c[1]], at)
                if k < len(self.block_last[c[1]]):
                    tight += self.block_most[c[1]][k]
                    ends = min(ends, self.block_last[c[1]][k])
            if tight < least:
                beyond = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else END
                to = max(at + 1, min(ends + 1, beyond))
                for c in cursors[:pivot + 1]:
                    if c[0] < to:
                        move(c, to)
                continue
            for c in cursors[:pivot + 1]:
                if c[0] < at:
                    move(c, at)
            score = sum(self.weights[c[1]][c[2]] for c in cursors if c[0] == at)
            if score >= least:
                found.append((at, score))
            for c in cursors:
                if c[0] == at:
                    move(c, at + 1)


class Index:
    """BM25 index of a bounded slice of test items."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.items, self.owner, parts = [], [], []
        for item_id, text in items:
            h = hashes(text)
            if not len(h):
                continue
            question, answer = map(hashes, question_and_answer(text))
            self.items.append((item_id, question, answer))
            for part in np.array_split(h, -(-len(h) // PART)):
                self.owner.append(len(self.items) - 1)
                parts.append(part)
        keys = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
        self.lookup = Lookup(keys)
        n, average = len(parts), np.mean([len(p) for p in parts]) if parts else 1.0
        counted = [np.unique(np.searchsorted(keys, p), return_counts=True) for p in parts]
        df = np.bincount(np.concatenate([t for t, _ in counted]), minlength=len(keys)) if parts else np.zeros(0)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        weighted = []
        for number, (terms, tf) in enumerate(counted):
            w = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(parts[number]) / average))
            weighted.append((number, terms, w / w.sum()))
        # By length: normalised weights of alike parts are alike, which keeps block maxima tight.
        order = sorted(range(n), key=lambda i: (len(parts[i]), i))
        self.owner = [self.owner[i] for i in order]
        self.postings = Postings([(k, weighted[i][1], weighted[i][2]) for k, i in enumerate(order)])
        self.n_blocks = max(1, -(-n // PARTS))
        most: list[dict[int, float]] = [{} for _ in range(len(keys))]
        for k, i in enumerate(order):
            for t, w in zip(weighted[i][1].tolist(), weighted[i][2].tolist()):
                most[t][k // PARTS] = max(w, most[t].get(k // PARTS, 0.0))
        self.constant = np.zeros(self.n_blocks)
        spread, where, bound = [], [], []
        for each in most:
            if len(each) > max(1, EVERYWHERE * self.n_blocks):
                for k, w in each.items():
                    self.constant[k] += w
                each = {}
            spread.append(len(each))
            where += each.keys()
            bound += each.values()
        self.at = np.concatenate([[0], np.cumsum(spread)]).astype(np.int64)
        self.where, self.bound = np.array(where, np.int64), np.array(bound, np.float64)

    def hits(self, texts: list[str | None]) -> Iterator[tuple[int, int, float]]:
        """(text number, part number, best score) over all passages of all texts."""
        best: dict[tuple[int, int], float] = {}
        for block in blocks(map(plain, texts), overlap=WINDOW):
            doc, _, found = hashed_words(block, (), 1, digits=True)
            pos, term = self.lookup.find(found[0])
            if not len(pos):
                continue
            # Each piece of a text has a stretch of STRIDE words per passage, and two empty ones after it.
            begin = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]])
            n_pass = 1 + (np.diff(begin) - 1) // STRIDE
            start = np.concatenate([[0], np.cumsum(n_pass + 2)])
            piece = np.searchsorted(begin, pos, "right") - 1
            stretch = start[piece] + (pos - begin[piece]) // STRIDE
            times = self.at[term + 1] - self.at[term]
            use = np.repeat(self.at[term] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            sums = np.bincount(np.repeat(stretch, times) * self.n_blocks + self.where[use], self.bound[use],
                               (int(start[-1]) + 2) * self.n_blocks).reshape(-1, self.n_blocks)
            reach = np.flatnonzero((sums[:-2] + sums[1:-1] + sums[2:] + self.constant >= self.threshold - 1e-9).any(1))
            for passage in reach.tolist():
                p = int(np.searchsorted(start, passage, "right")) - 1
                first = begin[p] + (passage - start[p]) * STRIDE
                lo, hi = np.searchsorted(pos, [first, min(first + WINDOW, begin[p + 1])])
                d = int(doc[begin[p]])
                for part, s in self.postings.search(np.unique(term[lo:hi]).tolist(), self.threshold - 1e-9):
                    best[d, part] = max(s, best.get((d, part), 0.0))
        for (d, part), s in best.items():
            yield d, part, s

    def verify(self, words: np.ndarray, item: int) -> tuple[float, float]:
        """Shares of the item's question and answer shingles that a text of these word hashes holds."""
        def share(own: np.ndarray) -> float:
            k = min(SHINGLE, len(own))
            return float(np.isin(shingled(own, k), shingled(words, k)).mean()) if k and len(words) >= k else float(not k)
        _, question, answer = self.items[item]
        return share(question), share(answer)


def find_leaks(docs: DataFrame, items: DataFrame, *, overlap: float = OVERLAP, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text) x (item_id, text) -> doc_id, item_id, bm25, question_overlap, answer_overlap of every leak."""
    small_batches(docs.sparkSession)
    out = None
    for part in slices(items):
        found = _scan(docs, Index(part, threshold), overlap)
        out = found if out is None else out.unionByName(found)
    return out


def slices(items: DataFrame) -> list[list[tuple[int, str]]]:
    """Test items in bounded slices, at least one (maybe empty). Test sets are small next to a corpus;
    a slice is what a task holds at a time."""
    parts, size = [[]], 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL") \
            .orderBy("item_id", "text").toLocalIterator():
        n = len(row["text"].split())
        if size and size + n > SLICE:
            parts.append([])
            size = 0
        parts[-1].append((row["item_id"], row["text"]))
        size += n
    return parts


def leaks_in(index: Index, texts: list[str | None], overlap: float) -> list[tuple[int, int, float, float, float]]:
    """(text number, item number, score, question and answer share) of every confirmed leak."""
    best: dict[tuple[int, int], float] = {}
    for d, part, s in index.hits(texts):
        key = d, index.owner[part]
        best[key] = max(best.get(key, 0.0), s)
    held = {d: hashes(texts[d]) for d in {d for d, _ in best}}
    found = ((d, item, s, *index.verify(held[d], item)) for (d, item), s in sorted(best.items()))
    return [row for row in found if row[3] >= overlap and row[4] >= overlap]


def _scan(docs: DataFrame, index: Index, overlap: float) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[d], index.items[item][0], s, question, answer)
                    for d, item, s, question, answer in leaks_in(index, batch.column("text").to_pylist(), overlap)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.float64()) for k, c in enumerate(zip(*rows))],
                                                 names=["doc_id", "item_id", "bm25", "question_overlap", "answer_overlap"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        search, "doc_id long, item_id long, bm25 double, question_overlap double, answer_overlap double")


def without_leaks(docs: DataFrame, items: DataFrame, *, overlap: float = OVERLAP, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that leak no test item, with all their columns."""
    small_batches(docs.sparkSession)

    def clean(index: Index):
        def choose(texts: list[str | None]) -> np.ndarray:
            out = np.ones(len(texts), bool)
            out[[row[0] for row in leaks_in(index, texts, overlap)]] = False
            return out
        return choose
    for part in slices(items):
        docs = kept(docs, clean(Index(part, threshold)))
    return docs
