"""Word and shingle hashes of many UTF-8 texts at once.

The distinct words of a block are found by their bytes, and each is hashed once by XXH3 (64 bits). A run of
words is hashed by mixing in one word after another. Two different runs share a hash with a chance of about
2 ** -64, whatever pattern they follow; grams of up to eight bytes are their own number.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

#: Bytes that are worked on together; some 30 bytes of memory each. A longer text is taken whole.
BLOCK_BYTES = 1_000_000


def lower_words() -> np.ndarray:
    """Byte table: white space (blank, tab to carriage return) separates; A-Z lower-cased; the rest as it is."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[0] = 255  # never in UTF-8, so byte 0 keeps an identity of its own
    table[[32, 9, 10, 11, 12, 13]] = 0
    return table


def lower_letters() -> np.ndarray:
    """Byte table: all ASCII but letters separates; A-Z lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    keep = np.zeros(256, dtype=bool)
    keep[97:123] = keep[65:91] = keep[128:] = True
    table[~keep] = 0
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """The finalising steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of a string column, about ``size`` bytes each; nulls are empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, int(offsets[at]) + size, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], (offsets[at : to + 1] - offsets[at]).astype(np.int64)
        at = to


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own house
        pass


def tidy(run):
    """``run`` over Arrow batches, giving freed memory back to the system when a task ends: workers stay alive between tasks, beside the next ones."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()

    return wrapped


class Words:
    """The words of a block: ``doc`` (row in the block), ``start``, ``end`` (bytes) of each, in order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        norm = table[data]
        inside = np.zeros(len(norm) + 2, dtype=bool)
        inside[1:-1] = norm != 0
        cut = np.zeros(len(norm) + 1, dtype=bool)
        cut[offsets] = True
        self.start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
        self.end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self._norm = norm
        self._distinct: tuple[np.ndarray, list[bytes]] | None = None

    def distinct(self) -> tuple[np.ndarray, list[bytes]]:
        """The number of each word, and the words by number."""
        if self._distinct is None:
            letters = self._norm[self._norm != 0]  # the words, one after another
            bounds = np.concatenate([[0], np.cumsum(self.end - self.start)])
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
            coded = words.dictionary_encode()
            self._distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        return self._distinct

    def hashes(self, first: int | None = None) -> np.ndarray:
        """Hashes of the words, or of their ``first`` bytes at most."""
        number, words = self.distinct()
        own = np.fromiter((xxh3_64_intdigest(w[:first]) for w in words), dtype=np.uint64, count=len(words))
        return own[number]

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc, number) of every run of ``size`` bytes, eight at most, inside a word; the numbers still want mixing."""
        count = np.maximum(0, self.end - self.start - size + 1)
        upto = np.cumsum(count)
        at = np.repeat(self.start - (upto - count), count) + np.arange(upto[-1] if len(upto) else 0)
        number = np.zeros(len(at), dtype=np.uint64)
        for j in range(size):
            number = number << np.uint64(8) | self._norm[at + j]
        return np.repeat(self.doc, count), number


def shingles(words: Words, size: int, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of every run of ``size`` words, with repeats; a text of fewer words is one shingle."""
    h = words.hashes()
    n = max(0, len(h) - size + 1)
    whole = words.doc[:n] == words.doc[size - 1 :] if n else np.zeros(0, dtype=bool)
    run = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        run = mix(run + h[j : j + n])
    run, doc = run[whole], words.doc[:n][whole]
    counts = np.bincount(words.doc, minlength=docs)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.searchsorted(words.doc, short)
        sums = np.zeros(len(short), dtype=np.uint64)
        for j in range(size - 1):
            has = counts[short] > j
            sums[has] = mix(sums[has] + h[first[has] + j])
        run = np.concatenate([run, mix(sums + counts[short].astype(np.uint64))])
        doc = np.concatenate([doc, short])
    return doc, run
