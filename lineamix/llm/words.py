"""Words of a batch of texts as NumPy arrays: where they stand and a 64-bit hash of each.

Words are runs of bytes other than space and 0x09-0x0D, as in ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_MIX = np.random.Generator(np.random.PCG64(20_240_601)).integers(0, 1 << 64, 258, np.uint64)
_BYTE, _BASE = _MIX[:256], _MIX[256] | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers: a bijection whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """``text_at[i]:text_at[i + 1]`` are the words of text i; starts and ends are byte positions."""

    data: np.ndarray
    bytes_at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text_at: np.ndarray
    hashes: np.ndarray


def words_of(texts: pa.Array, lower: bool = True) -> Words:
    """Words of each text, A-Z lower-cased before hashing if asked for; NULL counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[at[0]:at[-1]] if whole is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True  # words do not reach over texts
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    hashes = hash_spans(data, starts, ends, lower)
    return Words(data, at, starts, ends, np.searchsorted(starts, at), hashes)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of ``data[starts[i]:ends[i]]``; no span is empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    origin = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int32) - np.repeat(origin.astype(np.int32), lengths)
    letters = data[np.repeat(starts.astype(np.int32), lengths) + place]
    if lower:
        letters = _LOWER[letters]
    power = np.multiply.accumulate(np.full(int(lengths.max()), _BASE, np.uint64))
    return mix(np.add.reduceat(_BYTE[letters] * power[place], origin) + lengths.astype(np.uint64))


def by_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values[at[i]:at[i + 1]]``, empty ranges included."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


#: Bytes of text at once where nothing but arrays is made: those take over twenty times as much.
SMALL_PART = 1 << 18


def parts(texts: pa.Array, most_bytes: int = 2 << 20):
    """Cut an array so that the arrays above stay small; one longer text stands alone."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total, begin = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and total + n > most_bytes:
            yield texts.slice(begin, i - begin)
            total, begin = 0, i
        total += int(n)
    if begin < len(texts):
        yield texts.slice(begin)
