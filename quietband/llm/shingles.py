"""Word shingles of whole texts as 64-bit hashes, computed over Arrow buffers with NumPy.

Words are runs of bytes other than blank, tab and the line breaks up to carriage
return; A-Z is lower-cased. A text's set holds its distinct five-word shingles, or
its whole word sequence where it has fewer words; no words, no set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

WORDS = 5
_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_BLANK = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _multipliers(count: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        steps = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mixed(steps + np.uint64(seed)) | np.uint64(1)


_PLACES = _multipliers(64, 1)
_GRAM = _multipliers(WORDS + 1, 2)


def _places(longest: int) -> np.ndarray:
    global _PLACES
    if longest > len(_PLACES):
        _PLACES = _multipliers(2 * longest, 1)
    return _PLACES


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and where each text's words start (one entry more than texts)."""
    texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    size = int(edges[-1] - edges[0])
    if data is None or size == 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    blank = _BLANK[raw]
    before = np.empty(size + 1, bool)
    before[0], before[1:] = True, blank
    before[edges] = True
    visible = ~blank
    starts = np.flatnonzero(visible & before[:-1])
    after = np.empty(size + 1, bool)
    after[-1], after[:-1] = True, blank
    after[edges] = True
    lengths = np.flatnonzero(visible & after[1:]) + 1 - starts
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    first = np.cumsum(lengths) - lengths
    letters = _LOWER[raw[visible]].astype(np.uint64)
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    table = _places(int(lengths.max()))
    letters += np.uint64(1)
    letters *= table[place]
    return mixed(np.add.reduceat(letters, first)), np.searchsorted(starts, edges)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, starts = word_hashes(texts)
    grams = np.zeros(max(len(hashes) - WORDS + 1, 0), np.uint64)
    for i in range(WORDS if len(grams) else 0):
        grams += hashes[i : i + len(grams)] * _GRAM[i]
    grams = mixed(grams)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= WORDS:
            yield np.unique(grams[a : b - WORDS + 1])
        elif b > a:
            whole = (hashes[a:b] * _GRAM[: b - a]).sum(dtype=np.uint64, keepdims=True)
            yield mixed(whole + _GRAM[WORDS : WORDS + 1] * np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def set_key(shingles: np.ndarray) -> int:
    """64-bit name of a set, as a signed integer: equal for equal sets."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))
