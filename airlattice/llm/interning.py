"""Interned n-grams of a batch of texts: an open-addressed table in numpy arrays.

Every occurrence of a run of one to ``n`` words has the xxhash64 of its bytes as key. The key's low bits name a slot; whoever
comes first owns it. An occurrence whose key, length and bytes are the owner's belongs to the slot; the others try
the next slot, until all have one. Slots hold the n-gram's crc32 bucket and its count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

BLOCK = 1 << 21          # bytes of text that are interned together
# xxhash64's multipliers (fixed values).
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


@lru_cache(maxsize=1)
def word_bytes() -> np.ndarray:
    """Which bytes are of a word: digits, lower-case letters and all beyond ASCII."""
    table = np.zeros(256, bool)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[low:high + 1] = True
    return table


def pieces(text: bytes, size: int) -> Iterator[tuple[bytes, bool]]:
    """Parts of a long text that are cut between words; a later one begins with the last word before it (flagged)."""
    table, carry, at = word_bytes(), b"", 0
    while at < len(text):
        end = min(at + size, len(text))
        while end < len(text):
            ahead = np.flatnonzero(~table[np.frombuffer(text[end:end + 4096], np.uint8)])
            end += int(ahead[0]) if len(ahead) else len(text[end:end + 4096])
            if len(ahead):
                break
        chunk, at = text[at:end], end
        yield (carry + b" " + chunk, True) if carry else (chunk, False)
        if at < len(text):
            stop = len(chunk)
            inside = table[np.frombuffer(chunk, np.uint8)]
            if inside.any():
                stop = len(chunk) - int(inside[::-1].argmax())
                gap = np.flatnonzero(~inside[:stop])
                carry = chunk[int(gap[-1]) + 1 if len(gap) else 0:stop]


def blocks(texts: Iterable[bytes | None], size: int = BLOCK) -> Iterator[list[tuple[int, bytes, bool]]]:
    """(row, lower-cased bytes, whether it begins with a word counted before), about ``size`` bytes at a time."""
    held: list[tuple[int, bytes, bool]] = []
    n = 0
    for row, text in enumerate(texts):
        for part, again in pieces((text or b"").lower(), size):
            if held and n + len(part) > size:
                yield held
                held, n = [], 0
            held.append((row, part, again))
            n += len(part)
    if held:
        yield held


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mixed(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * P2, 31) * P1


def xxhash64(lanes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of byte spans; ``lanes`` holds the 8 bytes from every place as a number."""
    h = np.full(len(start), P5)
    at = start.copy()
    long = np.flatnonzero(size >= 32)
    if len(long):
        n = len(long)
        zero = np.zeros(n, np.uint64)
        acc = [zero + P1 + P2, zero + P2, zero, zero - P1]
        left, place, open_ = size[long].copy(), at[long].copy(), np.arange(n)
        while len(open_):
            for k in range(4):
                acc[k][open_] = _mixed(acc[k][open_], lanes[place[open_] + 8 * k])
            place[open_] += 32
            left[open_] -= 32
            open_ = open_[left[open_] >= 32]
        total = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
        for a in acc:
            total = (total ^ _mixed(np.zeros(n, np.uint64), a)) * P1 + P4
        h[long], at[long] = total, place
    h += size.astype(np.uint64)
    left = start + size - at
    open_ = np.flatnonzero(left >= 8)
    while len(open_):
        h[open_] = _turn(h[open_] ^ _mixed(np.zeros(len(open_), np.uint64), lanes[at[open_]]), 27) * P1 + P4
        at[open_] += 8
        left[open_] -= 8
        open_ = open_[left[open_] >= 8]
    open_ = np.flatnonzero(left >= 4)
    if len(open_):
        h[open_] = _turn(h[open_] ^ ((lanes[at[open_]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
        at[open_] += 4
        left[open_] -= 4
    open_ = np.flatnonzero(left > 0)
    while len(open_):
        h[open_] = _turn(h[open_] ^ ((lanes[at[open_]] & np.uint64(0xFF)) * P5), 11) * P1
        at[open_] += 1
        left[open_] -= 1
        open_ = open_[left[open_] > 0]
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


class Interned:
    """The n-grams of one block: per occurrence its row and slot, per slot its bucket and count."""

    def __init__(self, block: list[tuple[int, bytes, bool]], n: int, buckets: int):
        buf = np.frombuffer(b"\n".join(p for _, p, _ in block) + b"\n", np.uint8)
        inside = word_bytes()[buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edge = np.concatenate([[0], edge]) if inside[0] else edge
        start, size = edge[0::2], edge[1::2] - edge[0::2]
        part = np.searchsorted(np.cumsum([len(p) + 1 for _, p, _ in block]), start, "right")
        row = np.array([r for r, _, _ in block])[part]
        # The words again with one space after each, so that every n-gram is one span.
        place = np.cumsum(size + 1) - size - 1
        text = np.full(int((size + 1).sum()) + 40, 32, np.uint8)
        text[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = buf[inside]
        head = np.r_[True, part[1:] != part[:-1]] if len(part) else np.empty(0, bool)
        counted = ~(head & np.array([a for _, _, a in block])[part]) if len(part) else head
        self.words = row[counted]
        starts, sizes, rows = [place[counted]], [size[counted]], [self.words]
        last = np.arange(len(place))
        for k in range(1, n):
            first = np.flatnonzero(part[k:] == part[:-k]) if len(part) > k else last[:0]
            starts.append(place[first])
            sizes.append(place[first + k] + size[first + k] - place[first])
            rows.append(row[first])
        self.start, self.size, self.row = (np.concatenate(c) for c in (starts, sizes, rows))
        self.text = text.tobytes()
        self.lanes = np.ndarray(len(text) - 7, "<u8", self.text, 0, (1,)).copy()
        self.key = xxhash64(self.lanes, self.start, self.size)
        self.slot, owner = self._slots()
        taken = np.flatnonzero(owner >= 0)
        at, end = self.start[owner[taken]], (self.start + self.size)[owner[taken]]
        self.bucket = np.zeros(len(owner), np.int64)
        self.bucket[taken] = [zlib.crc32(self.text[a:b]) % buckets for a, b in zip(at.tolist(), end.tolist())]
        self.count = np.bincount(self.slot, minlength=len(owner))

    def _slots(self) -> tuple[np.ndarray, np.ndarray]:
        """Slot of every occurrence, and the occurrence that owns each slot (-1: free)."""
        n = len(self.key)
        capacity = 1 << max(4, (2 * n - 1).bit_length())
        owner = np.full(capacity, -1, np.int64)
        at = (self.key & np.uint64(capacity - 1)).astype(np.int64)
        slot = np.empty(n, np.int64)
        open_ = np.arange(n)
        while len(open_):
            here = at[open_]
            free = owner[here] < 0
            owner[here[free]] = open_[free]
            held = owner[here]
            mine = self._same(open_, held)
            slot[open_[mine]] = here[mine]
            open_ = open_[~mine]
            at[open_] = (at[open_] + 1) & (capacity - 1)
        return slot, owner

    def _same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether occurrences have equal keys, lengths and bytes."""
        same = (self.key[a] == self.key[b]) & (self.size[a] == self.size[b])
        open_ = np.flatnonzero(same & (a != b))
        step = 0
        while len(open_):
            x = self.lanes[self.start[a[open_]] + step] ^ self.lanes[self.start[b[open_]] + step]
            left = self.size[a[open_]] - step
            short = left < 8
            x[short] <<= (np.uint64(8) * (8 - left[short]).astype(np.uint64))
            same[open_[x != 0]] = False
            open_ = open_[(x == 0) & (left > 8)]
            step += 8
        return same
