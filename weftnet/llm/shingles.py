"""Five-word shingles and MinHash coordinates of Arrow text columns, in whole-array steps.

A word is a run of characters other than space, tab, line feed, vertical tab,
form feed and carriage return; A-Z count as a-z. A text of one to four words
has one shingle, its whole sequence; a text without words has none. Null is ''.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SHINGLE_WORDS = 5
_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)
_S29, _S31, _S32 = np.uint64(29), np.uint64(31), np.uint64(32)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each; a longer text is a part alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for k, n in enumerate(sizes):
        if total + n > most and k > start:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in order, and where each text's words start (one more at the end)."""
    # no cast to large_string here: on a sliced column, its offsets would be wrong
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, starts = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        flat, starts = flat.filter(pa.array(full)), before[starts]
    return flat, starts


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat, starts = words(texts)
    coded = flat.dictionary_encode()
    if len(coded.dictionary) == 0:
        return np.zeros(0, np.uint64), starts
    known = np.fromiter(
        map(xxhash.xxh3_64_intdigest, coded.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(coded.dictionary)
    )
    return known[coded.indices.to_numpy()], starts


def _join(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of n neighbouring words."""
    s = h[: len(h) - n + 1] + np.uint64(n)
    for k in range(1, n):
        s = (s ^ (s >> _S29)) * _M1 + h[k : len(h) - n + 1 + k]
    s = (s ^ (s >> _S31)) * _M2
    return s ^ (s >> _S32)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes."""
    h, starts = word_hashes(texts)
    runs = _join(h, SHINGLE_WORDS) if len(h) >= SHINGLE_WORDS else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= SHINGLE_WORDS:
            out.append(np.unique(runs[a : b - SHINGLE_WORDS + 1]))
        else:
            out.append(_join(h[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def coordinates(count: int, seed: int = 20011) -> np.ndarray:
    """The fixed odd multipliers of ``count`` MinHash coordinates."""
    return np.random.default_rng(seed).integers(1, 2**63, count, dtype=np.uint64) | np.uint64(1)


def minhash(sets: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Signatures, one row of 32-bit coordinate values for each non-empty set."""
    out = np.empty((len(sets), len(keys)), np.uint32)
    if not sets:
        return out
    values = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    for k, key in enumerate(keys):
        x = (values ^ key) * _M3
        x ^= x >> _S32
        x *= key
        out[:, k] = np.minimum.reduceat(x, starts) >> _S32
    return out
