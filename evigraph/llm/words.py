"""Words and shingles of whole Arrow batches as 64-bit hashes, by NumPy over the bytes of the batch.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the same as of code points. A word's hash is a
polynomial of its bytes modulo 2**64, taken from prefix sums over the batch and then mixed. Two different words or shingles of a
corpus share a hash with probability near n**2 / 2**65; where that matters, operators compare the words themselves afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
STEP = U(0xD6E8FEB86659FD93)
#: Bytes of text that are worked on together; a longer text is worked on alone.
CHUNK_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ASCII letters and digits (A-Z as a-z) and all bytes above stay, everything else separates.
PLAIN = np.full(256, 32, np.uint8)
PLAIN[48:58], PLAIN[97:123], PLAIN[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
PLAIN[65:91] = PLAIN[97:123]

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, 2 * len(_powers[0]), CHUNK_BYTES + 1)
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(m, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers[0], _powers[1]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values (splitmix64's finalizer after adding a seed)."""
    x = x + U((int(seed) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def string_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins, the end last; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word in ``data``, and the number of words before each text (and in all, last)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    begins = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return begins, ends, np.searchsorted(begins, offsets)


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A hash for each word; ``fold`` takes A-Z as a-z."""
    if not len(begins):
        return np.zeros(0, U)
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((LOWER[data] if fold else data).astype(U) * up[: len(data)] + up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[begins]) * down[begins])


def hashed(texts: pa.Array, fold: bool = False, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words before each text (and in all, last).

    ``plain`` takes only letters and digits (and all that is not ASCII) as parts of words.
    """
    data, offsets = string_bytes(texts)
    data = PLAIN[data] if plain else data
    begins, ends, starts = word_spans(data, offsets)
    return word_hashes(data, begins, ends, fold), starts


def windows(words: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within a text, and the number of runs before each text (and in all, last)."""
    counts = np.maximum(np.diff(starts) - width + 1, 0)
    before = np.zeros(len(starts), np.int64)
    np.cumsum(counts, out=before[1:])
    if not before[-1]:
        return np.zeros(0, U), before
    at = np.arange(before[-1]) + np.repeat(starts[:-1] - before[:-1], counts)
    h = words[at]
    for k in range(1, width):
        h *= STEP
        h += words[at + k]
    return mix(h, width), before


def chunks(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of text each, or with one row."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pa.compute.binary_length(column).fill_null(0)).astype(np.int64)
    at = 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 65536]), most, side="right")))
        yield batch.slice(at, n)
        at += n


def returning(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with Arrow's free memory given back at the end of a task: the worker lives on and would keep it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return whole
