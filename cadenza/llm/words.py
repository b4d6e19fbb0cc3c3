"""Words of Arrow text columns, as flat numpy arrays (used inside tasks only)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Texts are handled in pieces of about this many bytes, which bounds a task's memory
#: whatever the size of the batches that Spark sends (a longer text is one piece).
PIECE_BYTES = 1 << 20


def pieces(batch: pa.RecordBatch, text: str = "text", size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``size`` bytes of text."""
    n = batch.num_rows
    if n == 0:
        return
    own = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64) + 64
    part = (np.cumsum(own) - own) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()   # idle workers keep little


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Lower-case runs of letters and digits of each text: ``(index, vocabulary,
    offsets)``; text ``i`` has the words ``vocabulary[index[offsets[i]:offsets[i+1]]]``.
    Null counts as empty."""
    t = pc.utf8_lower(pc.fill_null(texts, ""))
    t = pc.ascii_trim(pc.replace_substring_regex(t, r"[^\p{L}\p{N}]+", " "), " ")
    lists = pc.split_pattern(t, " ")
    n = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    flat = lists.flatten()
    empty = np.asarray(pc.equal(pc.binary_length(t), 0))
    if empty.any():  # an empty text splits into one empty word
        flat = flat.filter(pc.not_equal(pc.binary_length(flat), 0))
        n = np.where(empty, 0, n)
    offsets = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(n, out=offsets[1:])
    enc = flat.dictionary_encode()
    if isinstance(enc, pa.ChunkedArray):
        enc = enc.combine_chunks()
    return np.asarray(enc.indices, dtype=np.int64), enc.dictionary, offsets


def hashes(vocabulary: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in vocabulary.to_pylist()),
                       dtype=np.uint64, count=len(vocabulary))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix); works on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words: ``(hash, text, position)``.  A text with
    fewer words (but at least one) has one window of all its words."""
    n = np.diff(offsets)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), count)
    first = np.cumsum(count) - count
    pos = np.arange(len(text)) - first[text]
    start = offsets[text] + pos
    length = np.minimum(n, width)[text]
    out = length.astype(np.uint64)
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    for j in range(width):
        step = mix(out * np.uint64(0x9E3779B97F4A7C15) + padded[start + j])
        out = np.where(j < length, step, out)
    return out, text, pos
