"""Enhanced suffix array of short byte strings and the scan of its common-prefix intervals.

``Contexts`` come from texts: every window of ``length`` bytes has an anchor, the smallest
hash among its grams (runs of half that length), the leftmost of equals. Neighbouring windows with one anchor form
a context. Equal windows have equal anchors at equal places, so whatever repeats at this
length repeats inside contexts of equal anchor grams.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

PIECE = 1 << 18               # bytes hashed at once
ROOT = 0x9E3779B97F4A7C15     # odd, so it has an inverse modulo 2^64


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = np.full(n, ROOT, np.uint64), np.full(n, pow(ROOT, -1, 1 << 64), np.uint64)
    power[0] = inverse[0] = 1
    return np.cumprod(power), np.cumprod(inverse)


def _grams(buf: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of every run of ``gram`` bytes."""
    power, inverse = _powers(PIECE + 4096)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:len(buf)], out=total[1:])
    h = (total[gram:] - total[:-gram]) * inverse[:len(buf) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def contexts(buf: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash of the anchor's gram) of every context; no window spans two documents.

    ``doc`` numbers the document of each byte. Long texts are hashed in pieces; a context
    cut by a piece's end is two, whose windows are the same.
    """
    gram = length // 2
    width = length - gram + 1
    found = []
    for at in range(0, len(buf), PIECE):
        part = buf[at:at + PIECE + length - 1]
        if len(part) < length:
            break
        h = _grams(part, gram)
        # The place in the low bits makes the smallest the leftmost one of equal hashes.
        low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while span < width:
            step = min(span, width - span)
            low = np.minimum(low[:-step], low[step:])
            span += step
        anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        own = doc[at:at + len(part)]
        inside = own[:len(anchor)] == own[length - 1:]
        edge = np.empty(len(anchor) + 1, bool)
        edge[0] = edge[-1] = True
        edge[1:-1] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
        at_edge = np.flatnonzero(edge)
        first, stop = at_edge[:-1], at_edge[1:]
        keep = inside[first]
        first, stop = first[keep], stop[keep]
        found.append((at + first, at + stop - 1 + length, h[anchor[first]]))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found))


def _words(strings: list[bytes], width: int) -> np.ndarray:
    """The 8 bytes from every place of every string, as one number, zeros behind the end."""
    flat = np.frombuffer(b"".join(s.ljust(width + 8, b"\0") for s in strings), np.uint8).reshape(len(strings), width + 8)
    out = np.zeros((len(strings), width), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | flat[:, i:i + width]
    return out


def suffix_array(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(string, place, common prefix with the one before, byte on the left or -1) of the sorted suffixes
    that share their first ``length`` bytes with another one."""
    size = np.array([len(s) for s in strings])
    n = np.maximum(size - length + 1, 0)
    string = np.repeat(np.arange(len(strings)), n)
    place = np.arange(len(string)) - np.repeat(np.cumsum(n) - n, n)
    widest = int(size.max(initial=0))
    words = _words(strings, max(widest - length, 0) + widest + 8)
    # Suffixes whose first bytes hash alike with no other are in no interval.
    key = np.zeros(len(string), np.uint64)
    for j in range(0, length, 8):
        w = words[string, place + j]
        if j + 8 > length:
            w = w >> np.uint64(8 * (j + 8 - length))
        key = (key ^ w) * np.uint64(ROOT)
        key ^= key >> np.uint64(31)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    held = np.zeros(len(string), bool)
    held[order[1:][same]] = True
    held[order[:-1][same]] = True
    string, place = string[held], place[held]
    depth = range(0, widest, 8)
    rest = size[string] - place
    # Zeros stand behind a string's end, so of equals the shorter comes first.
    order = np.lexsort([rest] + [words[string, place + j] for j in reversed(depth)])
    string, place, rest = string[order], place[order], rest[order]
    common = np.zeros(len(string), np.int64)
    open_ = np.arange(1, len(string))
    for j in depth:
        if not len(open_):
            break
        x = words[string[open_], place[open_] + j] ^ words[string[open_ - 1], place[open_ - 1] + j]
        whole = x == 0
        common[open_[whole]] += 8
        x, part = x[~whole], open_[~whole]
        lead = np.zeros(len(x), np.int64)
        for k in range(1, 8):
            lead += x < np.uint64(1 << (64 - 8 * k))
        common[part] += lead
        open_ = open_[whole]
    if len(string):
        common[1:] = np.minimum(common[1:], np.minimum(rest[1:], rest[:-1]))
    left = np.where(place > 0, words[string, np.maximum(place - 1, 0)] >> np.uint64(56), 0).astype(np.int64)
    return string, place, common, np.where(place > 0, left, -1)


def intervals(common: list[int], lo: list[int], hi: list[int], left: list[int], length: int) -> list[tuple[int, int, int, int]]:
    """(first, last, depth, smallest lo) of the common-prefix intervals of at least ``length`` that occur
    in several documents and not all after one byte; those of one byte lie within a longer repeat.

    One pass with a stack. A suffix stands for occurrences in documents from ``lo`` to ``hi``; ``left`` is -1 where the byte before it is
    not known or not one.
    """
    found = []
    stack: list[list[int]] = []            # depth, first, lo, hi, left
    for i in range(1, len(common) + 1):
        h = common[i] if i < len(common) else 0
        first, a, b, c = i - 1, lo[i - 1], hi[i - 1], left[i - 1]
        while stack and stack[-1][0] > h:
            depth, first, a2, b2, c2 = stack.pop()
            a, b, c = min(a, a2), max(b, b2), c if c == c2 else -1
            if a < b and c == -1:
                found.append((first, i - 1, depth, a))
        if stack and stack[-1][0] == h:
            top = stack[-1]
            top[2], top[3] = min(top[2], a), max(top[3], b)
            if top[4] != c:
                top[4] = -1
        elif h >= length:
            stack.append([h, first, a, b, c])
    return found


def repeats(strings: list[bytes], lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, end, smallest document) of every member of every repeat within distinct strings.

    A string that occurs in several documents is a repeat as a whole; the others are left-diverse
    common-prefix intervals, listed with all their members.
    """
    whole = np.flatnonzero(lo < hi)
    size = np.array([len(s) for s in strings])
    out = [(whole, np.zeros(len(whole), np.int64), size[whole], lo[whole])]
    string, place, common, left = suffix_array(strings, length)
    if len(string):
        found = intervals(common.tolist(), lo[string].tolist(), hi[string].tolist(), left.tolist(), length)
        if found:
            first, last, depth, least = (np.array(c, np.int64) for c in zip(*found))
            n = last - first + 1
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            out.append((string[at], place[at], place[at] + np.repeat(depth, n), np.repeat(least, n)))
    return tuple(np.concatenate(c) for c in zip(*out))
