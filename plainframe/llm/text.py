"""Vectorised word handling shared by the operators that run on Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes handled at a time in a worker; bounds its memory. One longer text is a slice of its own.
SLICE_BYTES = 8_000_000
#: Odd multipliers of the hashes.
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def release() -> None:
    """Give memory that this process has freed back to the system, so that idle workers hold little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each holds about `most` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    release()


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words [^\\x20\\x09-\\x0D]+ of each text (null: none): words per text, codes of all words in order, and the distinct words."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = parts.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    ends = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False), dtype=np.int64)))
    coded = flat.filter(real).dictionary_encode()
    return np.diff(ends[offsets]), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def hashes(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each distinct word's bytes."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w, seed) for w in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))


def expand(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each run, many of them."""
    ends = np.cumsum(many)
    return np.repeat(first - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose top bits depend on all bits."""
    x = (x ^ (x >> np.uint64(31))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def windows(word_hash: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each k consecutive words of one text: hashes, the text's place, the start word's place in the text."""
    total = len(word_hash)
    starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
    if total < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = word_hash[: total - k + 1].copy()
    for j in range(1, k):
        h *= M2
        h += word_hash[j : total - k + 1 + j]
    owner = np.repeat(np.arange(len(counts)), counts)[: total - k + 1]
    place = np.arange(total - k + 1) - starts[owner]
    inside = place + k <= counts[owner]
    return mix(h[inside]), owner[inside], place[inside]
