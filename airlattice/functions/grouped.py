"""Frames of one partition, sorted by a key, split into one frame per key value."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd


def groups(frames: Iterable[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Only the rows of the group that is still open are held from batch to batch."""
    held: list[pd.DataFrame] = []
    for pdf in frames:
        if not len(pdf):
            continue
        k = pdf[key].to_numpy()
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(pdf)]
        if held and held[0][key].iloc[0] != k[0]:
            yield pd.concat(held, ignore_index=True)
            held = []
        for start, end in zip(bounds[:-2], bounds[1:-1]):
            part = pdf.iloc[start:end]
            if held:
                part = pd.concat([*held, part], ignore_index=True)
                held = []
            yield part
        held.append(pdf.iloc[bounds[-2]:])
    if held:
        yield pd.concat(held, ignore_index=True)
