"""Hashed words of whole texts, and tables by hash block.

A chunk is some thousand documents that one task has read. It sends the hashes it holds to the block that owns each hash
(a range of hash values); the block joins what all chunks sent and answers each chunk. Hashes travel packed, 7 bytes each:
with the block's number that is at least 56 bits, more than 60 on inputs of any size.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE = 2 << 20  # bytes of text hashed at a time
_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


# a random odd number for each byte; A-Z as a-z, white space as nothing
_BYTE = mix(np.arange(1, 257, dtype=_U)) | _U(1)
_BYTE[65:91] = _BYTE[97:123]
_BYTE[_SPACE] = 0
_STEP = _U(0x9E3779B97F4A7C15 | 1)
_powers = np.multiply.accumulate(np.full(64, _STEP))


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow that gives its memory back when it is through: workers live on between stages."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except OSError:  # another C library
                pass

    return wrapped


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, rows) of parts of at most SLICE bytes, or of one row."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
        yield at, upto - at
        at = upto


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words `[^\\x20\\x09-\\x0D]+` in row order, A-Z lower-cased, and the number of words of each row. Null is empty."""
    global _powers
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or off[-1] == off[0]:
        return np.empty(0, dtype=_U), np.zeros(len(texts), dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = off[:-1][off[:-1] < off[1:]]
    first[begins] = word[begins]  # a row's first byte goes on with no other row's word
    starts = np.nonzero(first)[0]
    if not len(starts):
        return np.empty(0, dtype=_U), np.zeros(len(texts), dtype=np.int64)
    data, starts_in = data[starts[0] :], starts - starts[0]
    span = np.diff(starts_in, append=len(data))
    while span.max() > len(_powers):
        _powers = np.multiply.accumulate(np.full(2 * len(_powers), _STEP))
    at = np.arange(len(data)) - np.repeat(starts_in, span)
    length = np.add.reduceat(word[starts[0] :].astype(np.int64), starts_in)
    # what follows a word up to the next is white space, and that counts nothing
    h = np.add.reduceat(_BYTE[data] * _powers[at], starts_in)
    return mix(h + length.astype(_U) * _U(0xD6E8FEB86659FD93)), np.diff(np.searchsorted(starts, off))


def chain(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k successive hashes."""
    n = len(h) - k + 1
    out = mix(h[:n] + _U(k))
    for i in range(1, k):
        out = mix(out * _U(0x9FB21C651E98DF25) + h[i : i + n])
    return out


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    """Blocks are ranges of hash values, all of the same width."""
    b = ((h >> _U(32)) * _U(blocks)) >> _U(32)
    return b.astype(np.uint16 if blocks <= 1 << 16 else np.uint32)


def _pack(h: np.ndarray, wide: int) -> bytes:
    return np.ascontiguousarray(h, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def _unpack(b: bytes, wide: int) -> np.ndarray:
    out = np.zeros((len(b) // wide, 8), dtype=np.uint8)
    out[:, :wide] = np.frombuffer(b, dtype=np.uint8).reshape(-1, wide)
    return out.view("<u8").ravel()


def pack7(h: np.ndarray) -> bytes:
    """The lower 7 bytes of each."""
    return _pack(h, 7)


def unpack7(b: bytes) -> np.ndarray:
    return _unpack(b, 7)


def pack6(h: np.ndarray) -> bytes:
    """The lower 6 bytes of each, for counts that need not tell every pair of hashes apart."""
    return _pack(h, 6)


def unpack6(b: bytes) -> np.ndarray:
    return _unpack(b, 6)


def block_count(docs: DataFrame, mb: int = 8) -> int:
    """One for each `mb` MB of what the plan reads, as Spark estimates it; no fewer than there are shuffle partitions."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(size // (mb << 20), 1 << 20) if size < 1 << 60 else least)
