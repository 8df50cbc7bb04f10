"""Words and word shingles of Arrow batches as flat numpy arrays.

Words are runs of ``[^\\x20\\x09-\\x0D]``. Each distinct word of a batch is hashed once (64 bits, the same on every
machine); shingles are mixed from word hashes without touching strings again.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Rows and bytes of text that are taken apart at once, so that memory doesn't follow the batch size.
SLICE_ROWS, SLICE_BYTES = 500, 2 << 20

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold SLICE_ROWS rows and about SLICE_BYTES of text at most; a row is never split."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(text))), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes.astype(np.int64)), 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, base + SLICE_BYTES, side="right"))
        stop = min(max(stop, start + 1), start + SLICE_ROWS, n)
        yield batch.slice(start, stop - start)
        start = stop


def free_memory() -> None:
    """Give memory back that a worker, which lives on for other stages, holds but doesn't use."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mixed(a: np.ndarray) -> np.ndarray:
    a = a ^ (a >> np.uint64(32))
    a = a * _ODD[0]
    a = a ^ (a >> np.uint64(29))
    a = a * _ODD[1]
    return a ^ (a >> np.uint64(32))


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(hash of each word, offsets of each text's words, the words). Nulls have no words."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    texts = pc.ascii_trim_whitespace(texts)
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    blank = pc.equal(words, "").to_numpy(zero_copy_only=False)
    if blank.any():  # an empty text splits into one empty word
        before = np.concatenate([[0], np.cumsum(~blank)])
        words, offsets = words.filter(pa.array(~blank)), before[offsets]
    coded = words.dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64), offsets, words


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words, whatever text they belong to."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if width > 8:
        return _power_rolling(hashes, width)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mixed(out + hashes[k : k + n] * _ODD[k % 4] + np.uint64(k))
    return out


def _power_rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Doubling: the hash of 2k words is mixed from the hashes of two runs of k words."""
    runs, have = {1: mixed(hashes)}, 1
    while have * 2 <= width:
        runs[2 * have] = pair(runs[have][:-have], runs[have][have:])
        have *= 2
    out, done = runs[have], have
    n = len(hashes) - width + 1
    out = out[:n]
    for k in sorted((k for k in runs if k < have), reverse=True):
        if done + k <= width:
            out = pair(out, runs[k][done : done + n])
            done += k
    return out


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * _ODD[2] + mixed(b + _ODD[3]))


def shingle_sets(texts: pa.Array, width: int, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one."""
    hashes, offsets, _ = word_hashes(texts, lower)
    whole = rolling(hashes, width)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            out.append(rolling(hashes[a:b], b - a) ^ _ODD[b - a & 3])
        else:
            out.append(np.zeros(0, np.uint64))
    return out
