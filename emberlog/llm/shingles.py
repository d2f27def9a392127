"""Hashed words and word shingles of Arrow batches of texts, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 2 << 20
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about so many bytes, each a copy (string kernels misread slices), with the first one's place."""
    at, sizes = 0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most)))
        yield at, pc.fill_null(texts.slice(at, end - at).cast(pa.large_string()), "").take(pa.array(np.arange(end - at)))
        at = end


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of anything but the six ASCII spaces, A-Z in lower case) of all texts, and each
    text's first place among them (one more at the end)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    offsets = lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    if not len(words):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    coded = words.dictionary_encode()
    kinds = coded.dictionary.to_pylist()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in kinds), np.uint64, len(kinds))
    filled = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(filled)])
    return known[coded.indices.to_numpy()][filled], ends[offsets]


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k-word shingles of each text in ascending order, all texts one after the other, and the bounds.

    A text of fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    words, bounds = hashed_words(texts)
    n = len(words)
    grams = np.zeros(n, np.uint64)
    for j in range(k):
        grams[: n - j] += words[j:] * _K[j % len(_K)] if j else words * _K[0]
        if j:
            grams[: n - j] = mixed(grams[: n - j])
    sizes = np.diff(bounds)
    sets = []
    for i in range(len(texts)):
        b, size = int(bounds[i]), int(sizes[i])
        if size >= k:
            sets.append(np.unique(grams[b : b + size - k + 1]))
        elif size:
            x = np.uint64(size)
            for w in words[b : b + size]:
                x = mixed(np.array([x], np.uint64) + w, 0x5BD1E995)[0]
            sets.append(np.array([x], np.uint64))
        else:
            sets.append(np.empty(0, np.uint64))
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
