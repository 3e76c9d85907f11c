"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A word's hash is a function of its bytes alone, so tables hashed by different tasks agree. Texts
are handled as UTF-8: every byte of a non-ASCII character counts as a word byte or not by the
same rule, which is exact for classes that treat all of them alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text hashed together; bounds a task's memory, not what is read.
BLOCK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD1342543DE82EF95)


def word_table(separators: str) -> np.ndarray:
    """256 flags: whether a byte belongs to a word. ``separators`` are the ASCII ones that do not."""
    flags = np.ones(256, dtype=bool)
    flags[[ord(c) for c in separators]] = False
    return flags


# `[^\x20\x09-\x0D]+` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing A-Z.
SPACED = word_table(" \t\n\v\f\r")
ALPHANUMERIC = word_table("".join(
    chr(c) for c in range(128) if not (0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A)
))


def _lowered() -> np.ndarray:
    values = _BYTE_VALUES.copy()
    values[ord("A"):ord("Z") + 1] = values[ord("a"):ord("z") + 1]
    return values


_LOWERED = _lowered()


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> np.ndarray:
    steps = np.full(max(n, 1), _ODD, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Words(NamedTuple):
    """Words of consecutive texts. Text ``i`` has words ``bounds[i]:bounds[i + 1]``."""

    first: int  # index of the first text in the batch
    data: np.ndarray  # bytes of the texts
    offsets: np.ndarray  # where each text starts in ``data``, and the end
    hashes: np.ndarray
    starts: np.ndarray  # byte range of every word in ``data``
    ends: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def _hash_block(first: int, data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    inside = table[data]
    before = np.empty_like(inside)
    before[1:], before[:1] = inside[:-1], False
    after = np.empty_like(inside)
    after[:-1], after[-1:] = inside[1:], False
    full = np.flatnonzero(np.diff(offsets))
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    lengths = ends - starts
    if len(starts):
        heads = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
        values = _LOWERED[data[inside]] * _powers(int(lengths.max()))[place]
        hashes = mix(np.add.reduceat(values, heads) + lengths.astype(np.uint64) * _STEP)
    else:
        hashes = np.empty(0, dtype=np.uint64)
    return Words(first, data, offsets, hashes, starts, ends, np.searchsorted(starts, offsets))


def hashed_words(texts: pa.Array, table: np.ndarray, block: int = BLOCK_BYTES) -> Iterator[Words]:
    """The words of a column of texts, in blocks of whole texts. A NULL text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer else np.empty(0, dtype=np.uint8)
    low = 0
    while low < len(texts):
        high = int(np.searchsorted(offsets, offsets[low] + block, side="right")) - 1
        high = min(max(high, low + 1), len(texts))
        yield _hash_block(
            low, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], table
        )
        low = high


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive words, by where they start."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    powers = _powers(k + 1)
    total = np.full(n, np.uint64(k)) * _STEP
    for j in range(k):
        total += hashes[j:j + n] * powers[j + 1]
    return mix(total)
