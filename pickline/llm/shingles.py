"""Word-shingle sets of whole texts as 64-bit hashes, many texts at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 2 << 20

_PAD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= _STEP
    x ^= x >> np.uint64(32)
    x *= _STEP
    x ^= x >> np.uint64(32)
    return x


def slices(texts, limit: int = SLICE_BYTES):
    """Runs of rows of an Arrow string array with at most ``limit`` bytes, or one row."""
    import pyarrow.compute as pc

    stops = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(stops, (stops[i - 1] if i else 0) + limit, "right")))
        yield i, j
        i = j


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between ASCII white space, A-Z lower-cased, and where each text ends."""
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    names = np.array(coded.dictionary.to_pylist() + [None], dtype=object)[:-1]
    own = pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, np.uint64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    real = (names != "")[codes] if len(names) else np.zeros(0, bool)
    kept = np.concatenate([[0], np.cumsum(real)])
    return own[codes][real], kept[edges[1:]]


def shingle_sets(texts, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts one after the other, and where each ends.

    A text of fewer than ``n`` words, but not none, has its whole sequence as the only shingle.
    Hashes of 64 bits stand for shingles; equal ones are taken as the same shingle.
    """
    words, ends = word_hashes(texts)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    lengths = ends - starts
    windows = np.where(lengths > 0, np.maximum(lengths - n + 1, 1), 0)
    total = int(windows.sum())
    if not total:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    doc = np.repeat(np.arange(len(ends)), windows)
    first = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(total)
    stop = ends[doc]
    hashes = np.full(total, _PAD)
    for k in range(n):
        at = first + k
        word = np.where(at < stop, words[np.minimum(at, len(words) - 1)], _PAD)
        hashes = mix(hashes * _STEP + word)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(total, bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.cumsum(np.bincount(doc[new], minlength=len(ends)))


def set_ids(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit number per set, the same for equal sets; 0 for empty sets."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes), dtype=np.uint64)])
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    sizes = (ends - starts).astype(np.uint64)
    own = mix((sums[ends] - sums[starts]) ^ mix(sizes + _PAD)).view(np.int64)
    return np.where(sizes > 0, own, 0)
