"""Quality strings (one character per base, offset 33)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

OFFSET = 33


def low_bases(qual: Column, minimum: int) -> Column:
    """Number of bases under ``minimum``, counted without building an array."""
    if minimum <= 0:
        return F.lit(0)
    top = OFFSET + minimum - 1
    kept = F.regexp_replace(qual, rf"[\x{OFFSET:02x}-\x{top:02x}]+", "")
    return F.length(qual) - F.length(kept)


def flatten(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, and the length of each text."""
    encoded = [t.encode("latin-1", "replace") for t in texts]
    lengths = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
    return np.frombuffer(b"".join(encoded), dtype=np.uint8), lengths


#: Bases that are worked on at once; a longer read is cut and its parts follow each other.
MOST_BASES = 1 << 21


def parts(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of reads with at most so many bases; a longer read stands alone."""
    total, begin = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > begin and total + n > most:
            yield begin, i
            total, begin = 0, i
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)


def _passing(codes: np.ndarray, lengths: np.ndarray, window: int, min_mean: float) -> tuple[np.ndarray, np.ndarray]:
    """Where the first and the last passing window of each read begin, -1 without one."""
    first, last = np.full(len(lengths), -1, np.int64), np.full(len(lengths), -1, np.int64)
    if not len(codes):
        return first, last
    sums = np.concatenate([[0], np.cumsum(codes.astype(np.int64) - OFFSET)])
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(codes))
    width = np.minimum(lengths, window)[owner]
    stop = np.minimum(at + width, ends[owner])
    passed = (at + width <= ends[owner]) & (sums[stop] - sums[at] >= width * min_mean)
    hits, reads = at[passed], owner[passed]
    if len(hits):
        # Hits are in order, so the first and last of each read are at its borders.
        edge = np.flatnonzero(np.diff(reads)) + 1
        begin, end = np.concatenate([[0], edge]), np.concatenate([edge - 1, [len(hits) - 1]])
        who = reads[begin]
        start = ends[who] - lengths[who]
        first[who], last[who] = hits[begin] - start, hits[end] - start
    return first, last


def _passing_long(qual: str, window: int, min_mean: float, most: int) -> tuple[int, int]:
    """``_passing`` of one read by parts, each with the beginning of the next."""
    first = last = -1
    for begin in range(0, len(qual) - window + 1, most):
        codes, length = flatten([qual[begin:begin + most + window - 1]])
        a, b = (int(x[0]) for x in _passing(codes, length, window, min_mean))
        if a >= 0:
            first, last = begin + a if first < 0 else first, begin + b
    return first, last


def window_bounds(window: int, min_mean: float, most: int = MOST_BASES):
    """Pandas UDF: 1-based start and length of the part between the first and the last
    window whose mean quality reaches ``min_mean``; NULL without one.

    Reads with ``most`` bases together are one flat array, whatever a batch holds: built-in array
    lambdas cost a call per base.
    """

    @F.pandas_udf("struct<at: int, kept: int>")
    def bounds(quals: pd.Series) -> pd.DataFrame:
        quals = quals.fillna("")
        lengths = quals.str.len().to_numpy(np.int64)
        first, last = np.full(len(lengths), -1, np.int64), np.full(len(lengths), -1, np.int64)
        for begin, end in parts(lengths, most):
            if end - begin == 1 and lengths[begin] > most + window:
                first[begin], last[begin] = _passing_long(quals.iloc[begin], window, min_mean, most)
            else:
                codes, sizes = flatten(quals.iloc[begin:end])
                first[begin:end], last[begin:end] = _passing(codes, sizes, window, min_mean)
        empty = first < 0
        kept = last - first + np.minimum(lengths, window)
        return pd.DataFrame({
            "at": pd.arrays.IntegerArray((first + 1).astype(np.int32), empty.copy()),
            "kept": pd.arrays.IntegerArray(np.where(empty, 0, kept).astype(np.int32), empty.copy()),
        })

    # Otherwise a filter on the result is pushed below and the work is done twice.
    return bounds.asNondeterministic()


def _pieces(batch: pd.DataFrame, most: int) -> Iterator[tuple[pd.DataFrame, int]]:
    """Parts of a batch with at most so many bases, and the position before their first one."""
    seq, qual = batch["seq"].fillna(""), batch["qual"].fillna("")
    lengths = np.maximum(seq.str.len(), qual.str.len()).to_numpy(np.int64)
    for begin, end in parts(lengths, most):
        part = batch.iloc[begin:end]
        if lengths[begin] <= most:
            yield part, 0
            continue
        for at in range(0, int(lengths[begin]), most):
            yield part.assign(seq=seq.iloc[begin][at:at + most], qual=qual.iloc[begin][at:at + most]), at


#: The same for sums per position, which hold some arrays of numbers per base.
SUMMED_BASES = 1 << 19
#: Positions whose sums are held before they leave, and rows that leave at once.
HELD, LEAVING = 1 << 20, 1 << 16


def position_sums(keys: list[str], bases: tuple[str, ...], most: int = SUMMED_BASES):
    """Function of frames: per position, reads, score sums and base counts of some reads.

    Sums are held over frames, at most ``HELD`` positions and those of ``most`` bases, and leave in
    frames of about ``LEAVING`` rows: what is held depends neither on the rows nor on their lengths.
    """
    codes_of = [(b, {ord(b.lower()), ord(b.upper())}) for b in bases]
    measures = ["reads", "scored", "score_sum", *(f"n_{b}" for b in bases)]

    def counted(batch: pd.DataFrame) -> Iterator[tuple[tuple, np.ndarray]]:
        """Each key of a piece and its sums, a row per measure and a column per position."""
        groups = batch.groupby(keys, sort=False, dropna=False)
        owner_key = groups.ngroup().to_numpy()
        names = batch[keys].iloc[np.unique(owner_key, return_index=True)[1]]
        flat = [flatten(batch[c].fillna("")) for c in ("seq", "qual")]
        longest = np.maximum(flat[0][1], flat[1][1])
        spans = np.zeros(len(names), dtype=np.int64)
        np.maximum.at(spans, owner_key, longest)
        base = np.concatenate([[0], np.cumsum(spans)])
        size = int(base[-1])

        def slots(lengths: np.ndarray) -> np.ndarray:
            starts = np.cumsum(lengths) - lengths
            inside = np.arange(lengths.sum()) - np.repeat(starts, lengths)
            return np.repeat(base[owner_key], lengths) + inside

        (seq, seq_len), (qual, qual_len) = flat
        seq_slots, qual_slots = slots(seq_len), slots(qual_len)
        table = np.empty((len(measures), size), np.int64)
        table[0] = np.bincount(slots(longest), minlength=size)
        table[1] = np.bincount(qual_slots, minlength=size)
        table[2] = np.bincount(qual_slots, weights=qual.astype(np.float64) - OFFSET, minlength=size)
        for i, (_, codes) in enumerate(codes_of, 3):
            table[i] = np.bincount(seq_slots[np.isin(seq, list(codes))], minlength=size)
        for k, name in enumerate(names.itertuples(index=False, name=None)):
            yield tuple(None if pd.isna(v) else v for v in name), table[:, base[k]:base[k + 1]]

    def leaving(held: dict[tuple, np.ndarray]) -> Iterator[pd.DataFrame]:
        def frame(some: list[tuple]) -> pd.DataFrame:
            sizes = [held[s].shape[1] for s in some]
            table = np.concatenate([held.pop(s) for s in some], axis=1)
            out = pd.DataFrame({
                name: pd.Series([key[i] for key, _ in some], dtype=object).repeat(sizes).to_numpy() for i, name in enumerate(keys)
            })
            out["pos"] = np.concatenate([np.arange(before + 1, before + n + 1) for (_, before), n in zip(some, sizes)]).astype(np.int32)
            for name, values in zip(measures, table):
                out[name] = values
            return out[out["reads"] > 0]

        some, rows = [], 0
        for slot in list(held):
            some.append(slot)
            rows += held[slot].shape[1]
            if rows >= LEAVING:
                yield frame(some)
                some, rows = [], 0
        if some:
            yield frame(some)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        size = 0
        for batch, before in (piece for whole in batches if len(whole) for piece in _pieces(whole, most)):
            for key, found in counted(batch):
                known = held.get((key, before))
                if known is None or known.shape[1] < found.shape[1]:
                    size += found.shape[1] - (0 if known is None else known.shape[1])
                    grown = found.copy()
                    if known is not None:
                        grown[:, :known.shape[1]] += known
                    held[key, before] = grown
                else:
                    known[:, :found.shape[1]] += found
            if size > HELD:
                yield from leaving(held)
                size = 0
        yield from leaving(held)

    return sums


def by_slices(sums, schema: pa.Schema, most: int = SUMMED_BASES):
    """Function for mapInArrow: ``sums`` of frames with about ``most`` bytes of seq and qual.

    A batch has as many bytes as Spark gives it; only a slice of it becomes Python texts at once.
    """
    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False) for c in ("seq", "qual")]
            for begin, end in parts(np.maximum(*sizes), most):
                yield batch.slice(begin, end - begin).to_pandas()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in sums(frames(batches)):
            yield pa.RecordBatch.from_pandas(out, schema=schema, preserve_index=False)

    return run
