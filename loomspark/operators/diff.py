"""Word differences of two texts by their longest common subsequence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..session import spread

MOST_WORDS = 2000


def word_diff(old: str, new: str) -> list[str]:
    """Lines '- words' and '+ words'; ValueError if what differs is longer than MOST_WORDS words on a side.

    Shared words at both ends are left out first. Of equal choices deletions come first.
    """
    a, b = old.split(), new.split()
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if max(len(a), len(b)) > MOST_WORDS:
        raise ValueError("too large")
    if not a and not b:
        return []
    words = {w: i for i, w in enumerate({*a, *b})}
    x, y = np.array([words[w] for w in a], np.int32), np.array([words[w] for w in b], np.int32)
    # lengths[i, j]: of the common subsequence of a[i:] and b[j:]; a row from the one below by a running maximum.
    lengths = np.zeros((len(a) + 1, len(b) + 1), np.int16)
    for i in range(len(a) - 1, -1, -1):
        candidate = np.maximum(lengths[i + 1, :-1], np.where(y == x[i], lengths[i + 1, 1:] + 1, 0))
        lengths[i, :-1] = np.maximum.accumulate(candidate[::-1])[::-1]
    out: list[tuple[str, list[str]]] = []

    def put(sign: str, word: str) -> None:
        if out and out[-1][0] == sign:
            out[-1][1].append(word)
        else:
            out.append((sign, [word]))

    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            i, j = i + 1, j + 1
            out.append(("=", []))
        elif i < len(a) and (j == len(b) or lengths[i + 1, j] >= lengths[i, j + 1]):
            put("-", a[i])
            i += 1
        else:
            put("+", b[j])
            j += 1
    return [f"{sign} {' '.join(ws)}" for sign, ws in out if sign != "="]


def word_diffs(pairs: DataFrame, key: str) -> DataFrame:
    """key, diff (lines) and error of rows (key, old, new), in Arrow batches."""
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, old, new in zip(pdf[key], pdf["old"], pdf["new"], strict=True):
                try:
                    out.append((k, "\n".join(word_diff(old or "", new or "")), None))
                except ValueError as e:
                    out.append((k, None, str(e)))
            yield pd.DataFrame(out, columns=[key, "diff", "error"])

    return spread(pairs.select(key, "old", "new")).mapInPandas(run, f"{key} {kind}, diff string, error string")
