"""Document fingerprints by winnowing.

A text is folded (lower case, separators dropped), every k bytes of it are hashed, and of every `window` successive
hashes the least is kept, the rightmost of equal ones, with its place in the original text. Any passage of at least
window + k - 1 folded bytes that two texts share gives them a common fingerprint, and none below k bytes does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.llm.common import fold, pick, span_hashes, text_bytes, text_slices

K = 30
WINDOW = 30


def rightmost_minima(h: np.ndarray, window: int) -> np.ndarray:
    """Place of the least of h[i : i + window], the rightmost of equal ones, for each i; by doubling."""
    at, low, width = np.arange(len(h)), h, 1
    while width < window:
        step = min(width, window - width)
        right = low[step:] <= low[: len(low) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        low = np.where(right, low[step:], low[: len(low) - step])
        width += step
    return at


def winnow(raw: np.ndarray, offsets: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, byte places in their row, number of each row's fingerprints)."""
    n = len(offsets) - 1
    f = fold(raw) if len(raw) else raw
    kept = np.flatnonzero(f > 32)
    off = np.searchsorted(kept, offsets)
    size, folded = np.diff(off), f[kept]
    grams = np.where(size >= k, size - k + 1, (size > 0).astype(np.int64))  # a shorter row is one gram, whole
    start = np.repeat(off[:-1] - np.r_[0, np.cumsum(grams)[:-1]], grams) + np.arange(grams.sum())
    row = np.repeat(np.arange(n), grams)
    h = span_hashes(folded, start, np.minimum(start + k, off[row + 1]))
    first = np.r_[0, np.cumsum(grams)]
    wide = grams >= window
    picked = []
    if wide.any():
        best = rightmost_minima(h, window)
        windows = np.where(wide, grams - window + 1, 0)
        i = np.repeat(first[:-1] - np.r_[0, np.cumsum(windows)[:-1]], windows) + np.arange(windows.sum())
        picked.append(best[i])
    few = np.flatnonzero(~wide & (grams > 0))
    if len(few):  # one window of all the row's grams
        inside = np.repeat(first[few] - np.r_[0, np.cumsum(grams[few])[:-1]], grams[few]) + np.arange(grams[few].sum())
        least = np.minimum.reduceat(h[inside], np.r_[0, np.cumsum(grams[few])[:-1]])
        ties = inside[h[inside] == np.repeat(least, grams[few])]
        last = np.r_[row[ties][1:] != row[ties][:-1], True]
        picked.append(ties[last])
    at = np.unique(np.concatenate(picked)) if picked else np.zeros(0, np.int64)
    return h[at], kept[start[at]] - offsets[row[at]], np.bincount(row[at], minlength=n)


_OUT = pa.schema([("id", pa.int64()), ("hashes", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("n", pa.int32())])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """(id, hashes, places, n) of every row of docs: places are UTF-8 byte offsets of the k-grams in the original text,
    ascending. A text of fewer than k folded bytes has one fingerprint, of all of it; one without letters or digits,
    an empty and a null text have none (empty arrays). Repeated rows repeat their result, a null id stays null, an
    empty table gives an empty result. Texts count whole, whatever their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in text_slices(b, "x"):
                h, at, n = winnow(*text_bytes(s.column("x")), k, window)
                cuts = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([s.column("id"), pa.ListArray.from_arrays(cuts, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(at.astype(np.int32))), pa.array(n.astype(np.int32))], schema=_OUT)

    d = pick(docs, id=id_col, x=text_col).select(F.col("id").cast("bigint"), "x")
    return d.mapInArrow(run, "id bigint, hashes array<bigint>, places array<int>, n int").withColumnRenamed("id", id_col)
