"""Sets of word shingles as sorted 64-bit hashes, and HyperMinHash registers of such sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lineamix.llm.words import SMALL_PART, mix, parts, words_of

#: Bits of a bucket's hash, and mantissa bits that a register keeps beside 4 bits of leading zeros.
HASH_BITS, MANTISSA_BITS = 40, 4
_EMPTY = np.uint64(1 << HASH_BITS)
_ODD = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """The distinct ``width``-word shingles of each whole text, as sorted hashes.

    A-Z is lower-cased. A text with fewer words has one shingle, the sequence of all of them; a
    text without words, or NULL, has none.
    """
    return [s for part in parts(texts, SMALL_PART) for s in _sets(part, width)]


def _sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    w = words_of(texts)
    h, at = w.hashes, w.text_at
    n = len(h) - width + 1
    windows = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        windows += h[k:k + n] * _ODD[k]
    windows = mix(windows)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(windows[a:b - width + 1]))
        elif b > a:
            out.append(mix((h[a:b] * _ODD[:b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share, as two signed numbers."""
    with np.errstate(over="ignore"):
        a = mix(shingles).sum(dtype=np.uint64)
        b = mix(shingles ^ _ODD[63]).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def registers(sets: list[np.ndarray], count: int) -> np.ndarray:
    """HyperMinHash registers, one byte each: ``count`` per set; sets without shingles have zeros.

    A shingle falls into one bucket and the smallest hash of a bucket counts: its leading zeros
    (15 at most) and the mantissa bits after its first one. An empty bucket takes the hash of
    another, tried in an order that all sets share, so that registers agree with probability near
    the Jaccard similarity also for sets with fewer shingles than buckets.
    """
    if not sets:
        return np.zeros((0, count), np.uint8)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    bucket = ((flat >> np.uint64(40)) * np.uint64(count)) >> np.uint64(24)
    row = np.repeat(np.arange(len(sets)), sizes)
    least = np.full(len(sets) * count, _EMPTY)
    np.minimum.at(least, row * count + bucket.astype(np.int64), flat & (_EMPTY - np.uint64(1)))
    least = least.reshape(len(sets), count)
    full = least < _EMPTY
    r, c = np.nonzero(~full & (sizes > 0)[:, None])
    attempt = 0
    while len(r):
        if attempt < 4 * count:
            donor = (mix(c.astype(np.uint64) * _ODD[10] + np.full(1, attempt, np.uint64) * _ODD[11]) % np.uint64(count)).astype(np.int64)
        else:  # few sets get here: then the next bucket that has a hash
            donor = (c + attempt) % count
        found = full[r, donor]
        least[r[found], c[found]] = least[r[found], donor[found]]
        r, c = r[~found], c[~found]
        attempt += 1
    value = least.astype(np.float64)
    length = np.frexp(value)[1]  # bits of the hash; 0 for hash 0
    zeros = np.clip(HASH_BITS - length, 0, 15)
    shift = length - 1 - MANTISSA_BITS
    whole = least.astype(np.int64)
    mantissa = np.where(shift >= 0, whole >> np.maximum(shift, 0), whole << np.maximum(-shift, 0)) & ((1 << MANTISSA_BITS) - 1)
    out = (zeros << MANTISSA_BITS | mantissa).astype(np.uint8)
    out[sizes == 0] = 0
    return out


def chance_collision(size_a: np.ndarray, size_b: np.ndarray, count: int) -> np.ndarray:
    """Probability that registers of different minima agree, for sets of these sizes.

    The minimum of a bucket with m hashes is about exponential with mean 1/m, so its number of
    leading zeros is spread over few values; given equal zeros, mantissas agree once in 16.
    """
    load_a, load_b = np.maximum(size_a / count, 1.0), np.maximum(size_b / count, 1.0)
    zeros = np.arange(16)[:, None]
    low, high = 2.0 ** -(zeros + 1.0), 2.0 ** -zeros.astype(float)
    low = np.where(zeros == 15, 0.0, low)

    def share(load):
        return np.exp(-low * load) - np.where(zeros == 0, 0.0, np.exp(-high * load))

    return (share(load_a) * share(load_b)).sum(0) / (1 << MANTISSA_BITS)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers (rows of ``a`` and ``b``), corrected for chance agreement."""
    agree = (a == b).mean(1)
    chance = chance_collision(size_a, size_b, a.shape[1])
    return np.clip((agree - chance) / (1 - chance), 0.0, 1.0)


def lower_bound(similarity: float, size_a: np.ndarray, size_b: np.ndarray, count: int, deviations: float = 5.0) -> np.ndarray:
    """What an estimate for sets of this similarity exceeds but for once in millions of times."""
    effective = np.minimum(np.minimum(size_a, size_b), count)
    return similarity - deviations * np.sqrt(similarity * (1 - similarity) / np.maximum(effective, 1)) - 0.02


def band_plan(count: int, similarity: float, miss: float = 1e-6) -> tuple[int, int]:
    """(bands, registers per band): the longest bands that miss a pair at most ``miss`` of times."""
    for width in range(16, 0, -1):
        bands = count // width
        if (1 - similarity**width) ** bands <= miss:
            return bands, width
    raise ValueError("too few registers for this similarity")


def band_keys(reg: np.ndarray, bands: int, width: int) -> np.ndarray:
    """One 64-bit key per band, equal for equal registers of the same band."""
    out = np.zeros((len(reg), bands), np.uint64)
    for k in range(width):
        out = out + (reg[:, k:k + bands * width:width].astype(np.uint64) + np.uint64(1)) * _ODD[20 + k]
    return mix(out + np.arange(bands, dtype=np.uint64)[None, :] * _ODD[50]).view(np.int64)
