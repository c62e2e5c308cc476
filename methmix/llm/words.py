"""Word hashes of texts, used inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

# A task works on this many bytes of text at once, whatever the size of its batches.
SLICE_BYTES = 1_000_000
PIECE_BYTES = 2_000_000
# Words kept with their hashes by one worker.
CACHED_WORDS = 150_000


class WordHashes(dict):
    """64-bit hash of a word; the store is emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = WordHashes()


def split_words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text (runs without ASCII white space), in lists of bounded size."""
    if len(data) <= PIECE_BYTES:
        yield data.split()
        return
    rest = b""
    for at in range(0, len(data), PIECE_BYTES):
        words = (rest + data[at:at + PIECE_BYTES]).split()
        rest = b""
        end = at + PIECE_BYTES
        if end < len(data) and words and not data[end - 1:end].isspace() and not data[end:end + 1].isspace():
            rest = words.pop()
        yield words
    if rest:
        yield [rest]


def word_hashes(data: bytes) -> np.ndarray:
    """uint64 hashes of the words of a text, in order."""
    parts = [np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)) for words in split_words(data)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def mixed(x: np.ndarray) -> np.ndarray:
    """One-to-one scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes modulo 2^64 of every `width` consecutive words."""
    count = len(words) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    total = words[:count].copy()
    for step in range(1, width):
        total *= base
        total += words[step:step + count]
    return mixed(total)


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about SLICE_BYTES of `column`, one row at least."""
    import pyarrow.compute as pc
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            limit = (ends[start - 1] if start else 0) + SLICE_BYTES
            stop = max(start + 1, int(np.searchsorted(ends, limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release_memory()


def release_memory() -> None:
    """Workers are used again: what a task no longer needs goes back to the system, freed blocks of the C heap (glibc) with it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives b''."""
    return [value or b"" for value in batch.column(column).cast(pa.binary()).to_pylist()]
