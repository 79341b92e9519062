"""Word hashes and shingle sets of whole texts, computed on the bytes of many texts at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at a time; a single longer text is a chunk of its own.
CHUNK = 2_000_000
#: For work that keeps many numbers a byte: two tasks of it beside an executor's heap stay small.
SMALL_CHUNK = 400_000
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.Generator(np.random.PCG64(20240131))
BYTE_HASH = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BYTE_HASH[SPACE] = 0  # white space adds nothing to a word
PLACE_HASH = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(1 << (n - 1).bit_length(), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to ``most`` bytes each, or one longer text."""
    return _ranges(map(len, texts), most)


def _ranges(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    start = size = end = 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
        end = i + 1
    if start < end:
        yield start, end


def text_chunks(batch: pa.RecordBatch, *columns: int, most: int = SMALL_CHUNK) -> Iterator[tuple]:
    """Ranges of rows of up to ``most`` bytes of text each, or one longer row, with the texts of the columns as bytes (null: empty).
    Only one range's texts are Python objects at a time."""
    own = [batch.column(i).cast(pa.binary()) for i in columns]
    sizes = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in own)
    for s, e in _ranges(sizes.tolist(), most):
        yield s, e, *([t or b"" for t in c.slice(s, e - s).to_pylist()] for c in own)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z in lower case, and where each text's words begin (one more at the end)."""
    buf = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    blank = SPACE[buf]
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    sums = np.add.reduceat(BYTE_HASH[buf] * powers(BASE, len(buf)), starts)
    words = mix(sums * powers(BASE_INVERSE, len(buf))[starts])
    return words, np.concatenate(([0], np.searchsorted(starts, ends)))


def shingle_sets(texts: list[bytes], k: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; all words as one where there are fewer; empty without words."""
    words, first = word_hashes(texts)
    n = max(0, len(words) - k + 1)
    all_k = np.zeros(n, np.uint64)
    for j in range(k):
        all_k += words[j : j + n] * PLACE_HASH[j]
    all_k = mix(all_k)
    for s, e in zip(first[:-1], first[1:], strict=True):
        if e - s >= k:
            yield np.unique(all_k[s : e - k + 1])
        else:
            yield mix(np.array([(words[s:e] * PLACE_HASH[: e - s]).sum() + np.uint64(e - s)], np.uint64)) if e > s else np.zeros(0, np.uint64)
