"""Running sums and maxima along a sorted order, over ranges cut anywhere, even inside a group.

Rows are range-partitioned by group, order and a hash of the whole row, so that a group with a third
of all rows, a shared prefix or equal values spread over many ranges. Each range adds up its groups by
itself. Only the first and last group of a range can go on in another one: a table with at most two
rows per range carries their sums over, and meets the rows as a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

_RANGE, _HEAD = "_range", "_head"
#: Stands for NULL in running maxima.
NONE = -(1 << 62)


def _changes(batch: pa.RecordBatch, last: pa.RecordBatch | None, keys: Sequence[int]) -> np.ndarray:
    """True where a row's keys differ from those of the row before it; NULL equals NULL."""
    out = np.zeros(batch.num_rows, bool)
    out[0] = last is None
    for k in keys:
        column = batch.column(k)
        if last is not None:
            column = pa.concat_arrays([last.column(k), column])
        if len(column) > 1:
            a, b = column.slice(0, len(column) - 1), column.slice(1)
            differ = pc.fill_null(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b)))
            out[batch.num_rows - len(differ):] |= differ.to_numpy(zero_copy_only=False)
    return out


class _Scan:
    """Walks the sorted rows of a range: group borders and the running value inside each group."""

    def __init__(self, keys: Sequence[int], value: int, largest: bool):
        self.keys, self.value, self.largest = keys, value, largest
        self.last: pa.RecordBatch | None = None
        self.sum, self.groups = NONE if largest else 0, 0

    def step(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(running value, number of the group in the range) of each row."""
        begins = _changes(batch, self.last, self.keys)
        values = batch.column(self.value).to_numpy(zero_copy_only=False)
        inside = np.cumsum(begins)
        running = self._maxima(values, inside) if self.largest else self._sums(values, begins)
        group = self.groups - 1 + inside
        self.groups, self.sum = int(group[-1]) + 1, running[-1]
        self.last = batch.slice(batch.num_rows - 1)
        return running, group

    def _sums(self, values: np.ndarray, begins: np.ndarray) -> np.ndarray:
        starts = np.maximum.accumulate(np.where(begins, np.arange(len(begins)), -1))
        upto = np.cumsum(values)
        before = np.where(starts > 0, upto[np.maximum(starts, 1) - 1], 0)
        return upto - before + np.where(starts < 0, self.sum, 0)

    def _maxima(self, values: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Each group is lifted above the one before it, so one running maximum serves them all."""
        there = np.append(values, self.sum)
        there = there[there != NONE]
        if not len(there):
            return values
        low, step = int(there.min()) - 1, int(there.max()) - int(there.min()) + 2
        lifted = np.where(values == NONE, low, values) - low + inside * step
        if inside[0] == 0 and self.sum != NONE:
            lifted[0] = max(lifted[0], self.sum - low)
        out = np.maximum.accumulate(lifted) - inside * step + low
        return np.where(out == low, NONE, out)


def _summaries(keys: Sequence[int], value: int, head: int, schema: pa.Schema, largest: bool):
    """Per range: its first and last group with their sums, one row each, and the first row's hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, first, first_sum, mark = _Scan(keys, value, largest), None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if first is None:
                first, mark = batch.slice(0, 1), batch.column(head)[0]
            running, group = scan.step(batch)
            inside = np.flatnonzero(group == 0)
            if len(inside):
                first_sum = running[inside[-1]]
        if first is None:
            return
        number = TaskContext.get().partitionId()
        ends = [(first, first_sum, True)] + ([(scan.last, scan.sum, False)] if scan.groups > 1 else [])
        for row, total, is_first in ends:
            yield pa.RecordBatch.from_arrays([
                pa.array([number], pa.int32()), pa.array([mark.as_py()], pa.int64()),
                pa.array([is_first]), pa.array([total], schema.field(3).type), *(row.column(k) for k in keys),
            ], schema=schema)
    return run


def _rows(keys: Sequence[int], value: int, head: int, schema: pa.Schema, largest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, mark = _Scan(keys, value, largest), None
        number = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            mark = batch.column(head)[0].as_py() if mark is None else mark
            running, group = scan.step(batch)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:value], pa.array(running.astype(schema.field(value).type.to_pandas_dtype())),
                pa.array(np.full(n, number, np.int32)), pa.array(np.full(n, mark, np.int64)), pa.array(group == 0),
            ], schema=schema)
    return run


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, out: str,
    ranges: int | None = None,
) -> DataFrame:
    """Add the inclusive running sum of ``value`` by ``keys`` in ``order``.

    Rows that ``order`` leaves tied follow each other by a hash of the row; rows that are equal in
    every column stay in one range. NULL keys are a group, NULL values count 0, empty tables stay
    empty. Whole numbers are summed as bigint, others as double. ``order`` should name columns, or
    their ``F.desc``: a sort works out an expression again in each of its comparisons.
    """
    whole = df.select(value.alias("v")).schema["v"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    kind = T.LongType() if whole else T.DoubleType()
    return _running(df, keys, order, F.coalesce(value.cast(kind), F.lit(0).cast(kind)), kind, out, ranges, False)


def running_max(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, out: str,
    ranges: int | None = None,
) -> DataFrame:
    """Add the largest whole ``value`` so far by ``keys`` in ``order``; NULL before the first one.

    Ties, NULL keys and empty tables as in ``running_sum``. Values lie between -2^61 and 2^61.
    """
    kind = T.LongType()
    made = _running(df, keys, order, F.coalesce(value.cast(kind), F.lit(NONE)), kind, out, ranges, True)
    return made.withColumn(out, F.nullif(F.col(out), F.lit(NONE)))


def _running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, kind: T.DataType, out: str,
    ranges: int | None, largest: bool,
) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    if ranges is None:
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, at = df.columns, len(df.columns)
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in names])
    rows = df.withColumns({out: value, _HEAD: tie})
    by = [*keys, *order, _HEAD]
    ranged = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    key_at = [names.index(k) for k in keys]
    border = T.StructType([
        T.StructField(_RANGE, T.IntegerType()), T.StructField(_HEAD, T.LongType()), T.StructField("_is_first", T.BooleanType()),
        T.StructField("_sum", kind), *(df.schema[k] for k in keys),
    ])
    # Both walks read the same shuffle: each uses all of its columns.
    borders = ranged.mapInArrow(_summaries(key_at, at, at + 1, to_arrow_schema(border), largest), border)
    earlier = W.partitionBy(*keys).orderBy(_RANGE, F.desc("_is_first")).rowsBetween(W.unboundedPreceding, -1)
    merge, nothing = (F.max, F.lit(NONE)) if largest else (F.sum, F.lit(0).cast(kind))
    carried = borders.withColumn("_before", F.coalesce(merge("_sum").over(earlier), nothing))
    carried = carried.where("_is_first").select(_RANGE, _HEAD, "_before")
    walked = T.StructType([
        *df.schema.fields, T.StructField(out, kind), T.StructField(_RANGE, T.IntegerType()),
        T.StructField(_HEAD, T.LongType()), T.StructField("_is_first", T.BooleanType()),
    ])
    made = ranged.mapInArrow(_rows(key_at, at, at + 1, to_arrow_schema(walked), largest), walked)
    # One row per range. A range that is not the one whose values were carried is an error.
    torn = F.raise_error("ranges changed between two walks").cast(kind)
    both = F.greatest(out, "_before") if largest else F.col(out) + F.col("_before")
    total = F.when(F.col("_before").isNull(), torn).when(F.col("_is_first"), both).otherwise(F.col(out))
    return made.join(F.broadcast(carried), [_RANGE, _HEAD], "left").select(*[F.col(f"`{c}`") for c in names], total.alias(out))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = "position", ranges: int | None = None) -> DataFrame:
    """Row number from 1 by ``keys`` in ``order``."""
    return running_sum(df, keys, order, F.lit(1).cast("bigint"), out, ranges)
