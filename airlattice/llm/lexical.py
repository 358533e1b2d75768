"""Word features of texts as numpy arrays: word spans and polynomial hashes of words and prefixes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

BLOCK = 1 << 19               # bytes worked on at once; a longer text comes in several blocks
ROOT = 0x9E3779B97F4A7C15     # odd, so it has an inverse modulo 2^64
PREFIXES = (3, 4, 5, 6)       # bytes


def blocks(texts: Iterable[str | None], size: int = BLOCK, overlap: int = 0) -> Iterator[list[tuple[int, bytes]]]:
    """(text number, lower-cased UTF-8 bytes) pieces, at most about ``size`` bytes at a time.

    Long texts are cut where a run of letters and digits ends (a longer run stays whole), never shortened; a piece
    repeats the last ``overlap`` runs before it, whatever stands between them.
    """
    held: list[tuple[int, bytes]] = []
    n = 0
    for i, text in enumerate(texts):
        data = text.lower().encode("utf-8", "surrogatepass") if text else b""
        at = 0
        while at < len(data):
            end, back = min(at + size, len(data)), len(data)
            while end < len(data):
                end = _run_end(data, end)
                first = np.flatnonzero(np.diff(_in_run(data[at:end]), prepend=False) & _in_run(data[at:end]))
                if end == len(data) or len(first) > overlap:
                    back = end if end == len(data) or not overlap else at + int(first[-overlap])
                    break
                end = min(end + size, len(data))
            part, at = data[at:end], back
            if held and n + len(part) > size:
                yield held
                held, n = [], 0
            held.append((i, part))
            n += len(part) + 1
    if held:
        yield held


def _in_run(data: bytes) -> np.ndarray:
    """Which bytes belong to runs of letters (beyond ASCII: all) and digits."""
    buf = np.frombuffer(data, np.uint8)
    return (buf >= 128) | ((buf >= ord("a")) & (buf <= ord("z"))) | ((buf >= ord("0")) & (buf <= ord("9")))


def _run_end(data: bytes, at: int) -> int:
    """The first place from ``at`` on that is in no run."""
    while at < len(data):
        out = np.flatnonzero(~_in_run(data[at:at + 4096]))
        if len(out):
            return at + int(out[0])
        at = min(at + 4096, len(data))
    return at


@lru_cache(maxsize=1)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letter = np.zeros(256, bool)
    letter[128:] = True
    letter[ord("a"):ord("z") + 1] = True
    power = np.full(n, ROOT, np.uint64)
    power[0] = 1
    inverse = np.full(n, pow(ROOT, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    return letter, np.cumprod(power), np.cumprod(inverse)


def hashed_words(block: list[tuple[int, bytes]], prefixes: tuple[int, ...] = PREFIXES,
                 shortest: int = 2, digits: bool = False) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of every letter run (with ``digits``, run of letters and digits) in a block: its text number, and per feature kind (whole word,
    then each prefix length) the run numbers that have one and their 64-bit hashes."""
    buf = np.frombuffer(b" ".join(p for _, p in block) + b" ", np.uint8)
    letter, power, inverse = _tables(max(2 * BLOCK + 64, 1 << len(buf).bit_length()))
    at = letter[buf]
    if digits:
        at |= (buf >= ord("0")) & (buf <= ord("9"))
    edge = np.flatnonzero(at[1:] != at[:-1]) + 1
    if at[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    lengths = np.array([len(p) + 1 for _, p in block])
    number = np.array([i for i, _ in block])
    doc = number[np.searchsorted(np.cumsum(lengths), starts, "right")]
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:len(buf)], out=sums[1:])
    runs, hashes = [], []
    for kind, k in enumerate((0, *prefixes)):
        own = np.flatnonzero(ends - starts >= max(k, shortest))
        stop = ends[own] if not k else starts[own] + k
        h = (sums[stop] - sums[starts[own]]) * inverse[starts[own]]
        h ^= np.uint64((kind + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        runs.append(own)
        hashes.append(h ^ (h >> np.uint64(31)))
    return doc, runs, hashes


class Lookup:
    """Exact lookup of 64-bit hashes: a bit table lets the few possible ones through."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.keys = np.sort(keys.astype(np.uint64))
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.keys >> self.shift).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, key numbers) of those that are keys."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pos = np.flatnonzero(self.seen[(hashes >> self.shift).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, hashes[pos]), len(self.keys) - 1)
        ok = self.keys[k] == hashes[pos]
        return pos[ok], k[ok]


def newton_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0,
                    intercept: bool = True, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; y may be probabilities. The intercept comes last."""
    if intercept:
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1])
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.full(x.shape[1], ridge)
    if intercept:
        penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - penalty * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        size = np.abs(step).max()
        w += step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-6:
            break
    return w
