"""Arrow and numpy helpers on whole texts: words, their hashes, and word shingles."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are worked on together in a Python worker; bounds its memory.
BLOCK_BYTES = 8 << 20

_MASK = (1 << 64) - 1
#: Odd multipliers of the words of a shingle, by a splitmix64 sequence.
_ODD = np.array([((i + 1) * 0x9E3779B97F4A7C15 & _MASK) * 0xBF58476D1CE4E5B9 & _MASK | 1 for i in range(64)], dtype=np.uint64)


def blocks(batches: Iterator[pa.RecordBatch], text_col: str, most: int = BLOCK_BYTES, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of up to ``most`` bytes (or one row): small batches are
    joined so that words are looked up once for many rows, large ones are cut. What the worker still
    holds of earlier tasks goes, but for the tokenizer's pieces if ``keep``."""
    if not keep:
        sys.modules.pop("_stitchlake_worker", None)
    for b in _blocks(batches, text_col, most):
        yield b
        del b
        give_back()
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _blocks(batches: Iterator[pa.RecordBatch], text_col: str, most: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text_col))
        need = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, total = 0, np.cumsum(need)
        while at < batch.num_rows:
            room = most - size + (total[at - 1] if at else 0)
            to = int(np.searchsorted(total, room, side="right"))
            if to <= at and not held:
                to = at + 1
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(total[to - 1] - (total[at - 1] if at else 0))
                at = to
            if at < batch.num_rows:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.concat_batches(held)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def split_words(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, code of each word, offsets by row) of the words ``[^ \\t-\\r]+``.

    ``lower`` lower-cases A-Z alone. Null texts have no words.
    """
    texts = texts.fill_null("")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    off = lists.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    real = np.asarray(pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False), dtype=bool)
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    before = np.zeros(len(real) + 1, dtype=np.int64)
    np.cumsum(real, out=before[1:])
    return coded.dictionary, codes[real], before[off]


def word_hashes(words: pa.Array) -> np.ndarray:
    # Arrow makes an array of bytes some ten times faster than a list of strings
    raw = words.cast(pa.binary()).to_numpy(zero_copy_only=False)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, raw), dtype=np.uint64, count=len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, off: np.ndarray, k: int = 5, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the k-word shingles of each row, repeats included, and their offsets.

    A row with 1 to k-1 words has its whole sequence as one shingle if ``short``, else none.
    """
    n, words = np.diff(off), len(hashes)
    with np.errstate(over="ignore"):
        roll = np.zeros(max(words - k + 1, 0), dtype=np.uint64)
        for j in range(k):
            roll += hashes[j : j + len(roll)] * _ODD[j]
        roll = _mixed(roll)
        have = np.maximum(n - k + 1, 0)
        out_n = np.where((n > 0) & (n < k), 1, have) if short else have
        out = np.zeros(int(out_n.sum()), dtype=np.uint64)
        start = np.zeros(len(n) + 1, dtype=np.int64)
        np.cumsum(out_n, out=start[1:])
        full = have > 0
        if full.any():
            lens = have[full]
            shift = np.repeat(off[:-1][full] - start[:-1][full], lens)
            at = _ranges(start[:-1][full], lens)
            out[at] = roll[at + shift]
        if short:
            for m in range(1, k):
                rows = np.flatnonzero(n == m)
                if len(rows):
                    acc = np.full(len(rows), m, dtype=np.uint64) * _ODD[40]
                    for j in range(m):
                        acc += hashes[off[rows] + j] * _ODD[j]
                    out[start[rows]] = _mixed(acc)
    return out, start


def _ranges(start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+lens[0]-1, start[1] .. and so on; lens > 0."""
    total = np.cumsum(lens)
    step = np.ones(int(total[-1]), dtype=np.int64)
    step[0] = start[0]
    step[total[:-1]] = start[1:] - (start[:-1] + lens[:-1] - 1)
    return np.cumsum(step)


def crc32_ids(ids: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
