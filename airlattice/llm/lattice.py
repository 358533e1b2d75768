"""Subword lattice: all segmentations of a word into vocabulary pieces, summed in log space."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

SPACE = "▁"       # stands for the gap before a word
MATRIX = 40            # words up to so many characters are worked on together, by length


class Vocabulary:
    """Pieces with log-probabilities; a character without a piece is spelled by its byte pieces."""

    def __init__(self, pieces: list[str], byte_ids: list[int], logp: np.ndarray):
        self.pieces, self.byte_ids = pieces, byte_ids
        spelled = set(byte_ids)
        self.ids = {p: i for i, p in enumerate(pieces) if p and i not in spelled}
        self.longest = max(map(len, self.ids), default=1)
        self.set_logp(logp)

    def set_logp(self, logp: np.ndarray) -> None:
        self.logp = np.append(logp, -np.inf)        # index -1: no such piece
        self.spelling: dict[str, float] = {}

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    def spelled(self, char: str) -> float:
        if char not in self.spelling:
            self.spelling[char] = float(sum(self.logp[i] for i in self.bytes_of(char)))
        return self.spelling[char]


def prior(path: str) -> Vocabulary:
    """The vocabulary file's pieces, weighted by its own scores.

    Scores that are log-probabilities are taken as they are. A vocabulary that scores its pieces by
    rank (0, -1, -2, ...) gets Zipf's law over the ranks, 1 / (10 + rank); pieces marked
    unusable count as the last rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    score = np.array([model.get_score(i) for i in range(n)])
    plain = np.array([not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)])
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if -5 < np.logaddexp.reduce(score[plain & (score > -1e6)]) < 1 and score[plain].max() < 0:
        logp = np.where(plain, np.maximum(score, -30.0), -np.inf)
    else:
        rank = np.minimum(-score, n)
        rank[byte_ids] = n
        logp = np.where(plain, -np.log(10 + rank), -np.inf)
    logp -= np.logaddexp.reduce(logp[plain])
    pieces = [model.id_to_piece(i) if plain[i] else "" for i in range(n)]
    return Vocabulary(pieces, byte_ids, logp)


def _total(stack: list[np.ndarray]) -> np.ndarray:
    x = np.stack(stack)
    top = x.max(0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.where(np.isfinite(top), safe + np.log(np.exp(x - safe).sum(0)), -np.inf)


def _matrix(ws: list[str], v: Vocabulary, weight: np.ndarray | None, expected: np.ndarray | None) -> np.ndarray:
    """Forward recursion of words of one length; with ``expected`` also the backward one."""
    n, get = len(ws[0]), v.ids.get
    edges: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for i in range(n):
        for j in range(i + 1, min(n, i + v.longest) + 1):
            ids = np.fromiter((get(w[i:j], -1) for w in ws), np.int64, len(ws))
            lp = v.logp[ids]
            if j == i + 1:
                for r in np.flatnonzero(ids < 0).tolist():
                    lp[r] = v.spelled(ws[r][i])
            elif (ids < 0).all():
                continue
            edges[i, j] = ids, lp
    forward = [np.zeros(len(ws))]
    for j in range(1, n + 1):
        forward.append(_total([forward[i] + edges[i, j][1] for i in range(max(0, j - v.longest), j) if (i, j) in edges]))
    if expected is not None:
        backward = {n: np.zeros(len(ws))}
        for i in range(n - 1, -1, -1):
            backward[i] = _total([backward[j] + edges[i, j][1] for j in range(i + 1, min(n, i + v.longest) + 1) if (i, j) in edges])
        for (i, j), (ids, lp) in edges.items():
            share = weight * np.exp(forward[i] + lp + backward[j] - forward[n])
            has = ids >= 0
            expected += np.bincount(ids[has], share[has], len(expected))
            for r in np.flatnonzero(~has & (share > 0)).tolist():
                for b in v.bytes_of(ws[r][i]):
                    expected[b] += share[r]
    return forward[n]


def _single(w: str, v: Vocabulary, weight: float, expected: np.ndarray | None) -> float:
    """The same for one long word; only the pieces that match are followed."""
    n, get = len(w), v.ids.get
    forward = np.full(n + 1, -np.inf)
    forward[0] = 0.0
    for j in range(1, n + 1):
        terms = []
        for i in range(max(0, j - v.longest), j):
            k = get(w[i:j])
            if k is not None:
                terms.append(forward[i] + v.logp[k])
            elif j == i + 1:
                terms.append(forward[i] + v.spelled(w[i]))
        top = max(terms)
        forward[j] = top + np.log(sum(np.exp(t - top) for t in terms)) if np.isfinite(top) else -np.inf
    if expected is not None:
        backward = np.full(n + 1, -np.inf)
        backward[n] = 0.0
        for i in range(n - 1, -1, -1):
            terms = []
            for j in range(i + 1, min(n, i + v.longest) + 1):
                k = get(w[i:j])
                if k is None and j > i + 1:
                    continue
                lp = v.logp[k] if k is not None else v.spelled(w[i])
                terms.append(lp + backward[j])
                share = weight * np.exp(forward[i] + lp + backward[j] - forward[n])
                for piece in [k] if k is not None else v.bytes_of(w[i]):
                    expected[piece] += share
            top = max(terms)
            backward[i] = top + np.log(sum(np.exp(t - top) for t in terms))
    return float(forward[n])


def marginals(words: Iterable[str], v: Vocabulary, weight: np.ndarray | None = None,
              expected: np.ndarray | None = None) -> np.ndarray:
    """Natural-log marginal probability of every word over all its segmentations.

    With ``expected``, the expected uses of every piece (times ``weight``) are added to it.
    """
    texts = [SPACE + w for w in words]
    out = np.empty(len(texts))
    weight = np.ones(len(texts)) if weight is None else weight
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for at in np.split(order, cuts) if len(texts) else []:
        if size[at[0]] <= MATRIX:
            for part in np.array_split(at, max(1, len(at) // 4096)):
                out[part] = _matrix([texts[i] for i in part.tolist()], v, weight[part], expected)
        else:
            for i in at.tolist():
                out[i] = _single(texts[i], v, float(weight[i]), expected)
    return out
