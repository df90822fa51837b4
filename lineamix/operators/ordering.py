"""Running totals, ranks and top-k that hold when one group has a third of all rows.

A plain window sorts a whole group in one task. Here a group is first cut into
buckets along its own order; totals per bucket are aggregated on the map side, the
offsets come from a window over the buckets, and rows are only ordered inside theirs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lineamix.functions.hashing import HASH_SPACE, hash52
from lineamix.operators.prefix import running_sum

# Slots per power of two in value_bucket: under 0.1 % of the value range each.
MANTISSA_SLOTS = 1024
EXPONENT_SHIFT = 1100
OUTERMOST = 1 << 40


def value_bucket(value: Column) -> Column:
    """Bucket number that never decreases as the double grows.

    It is made of the binary exponent and the leading part of the mantissa, so it
    follows any spread of values and needs no sampled bounds. Infinity has the outermost
    buckets, and NaN, which sorts last, the one after them.
    """
    infinite = F.abs(value) == float("inf")
    size = F.when(infinite | F.isnan(value), F.lit(1.0)).otherwise(F.abs(value))
    exponent = F.floor(F.log2(size))
    slot = F.floor((size / F.pow(F.lit(2.0), exponent) - 1.0) * MANTISSA_SLOTS)
    slot = F.least(F.greatest(slot, F.lit(-1)), F.lit(MANTISSA_SLOTS))
    code = (exponent + EXPONENT_SHIFT) * (MANTISSA_SLOTS + 2) + slot + 1
    code = F.when(infinite, F.lit(OUTERMOST)).otherwise(code)
    signed = (
        F.when(F.isnan(value), F.lit(OUTERMOST + 1)).when(value == 0, F.lit(0)).when(value > 0, code).otherwise(-code)
    ).cast("bigint")
    return F.coalesce(signed, F.lit(0).cast("bigint"))


def hash_bucket(hash_col: Column, buckets: int) -> Column:
    """Equal slices of the hash range; grows with the hash."""
    slice_no = F.floor(hash_col / F.lit(float(HASH_SPACE // buckets))).cast("int")
    return F.coalesce(slice_no, F.lit(0))


def known(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not NULL.

    Joins add this filter to one of their sides, and it sinks to the scan. Where a plan
    uses ``df`` twice, saying it first keeps both uses equal and they share one shuffle.
    Buckets and values are made non-NULL for the same reason.
    """
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def attach(df: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a table aggregated by ``keys`` to rows of which one key may hold a third.

    Such a table is already partitioned by its keys, and adaptive execution only splits a
    hot partition when both sides come fresh from a shuffle. The extra join column makes
    the small side shuffle once more; that is its whole cost.
    """
    tag = F.hash(*keys)
    return (
        df.withColumn("_tag", tag)
        .join(per_key.withColumn("_tag", tag), [*keys, "_tag"], how)
        .drop("_tag")
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    value: Column,
    out: str,
    total: str | None = None,
) -> DataFrame:
    """Add the inclusive running total of ``value`` by ``keys`` in ``order``.

    ``bucket`` must not decrease along ``order``. ``total`` names an optional column
    for the total of the whole group.
    """
    keys = list(keys)
    rows = known(df, keys).withColumn("_bucket", bucket).withColumn("_value", value)
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_sum"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    if total is not None:
        offsets = offsets.withColumn(total, F.sum("_sum").over(W.partitionBy(*keys)))
    inside = (
        W.partitionBy(*keys, "_bucket")
        .orderBy(*order)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        rows.join(offsets.drop("_sum"), [*keys, "_bucket"])
        .withColumn(out, F.col("_before") + F.sum("_value").over(inside))
        .drop("_bucket", "_value", "_before")
    )


def average_ranks(cells: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Centred average rank of each distinct value, by group.

    ``cells`` may hold a value many times; ``weight`` counts its rows. The result has
    one row per (keys, value) with the rank minus the mean rank, which keeps later
    sums of squares free of cancellation.
    """
    histogram = cells.groupBy(*keys, value).agg(F.sum(weight).alias("_peers"))
    ranked = running_total(
        histogram, keys, [value], value_bucket(F.col(value)), F.col("_peers"), "_upto", "_size"
    )
    rank = F.col("_upto") - F.col("_peers") + (F.col("_peers") + 1) / 2.0
    return ranked.select(*keys, value, (rank - (F.col("_size") + 1) / 2.0).alias(f"{value}_rank"))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows by group. The planner limits groups on the map side before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= k).drop("_rn")


def hash_cutoffs(
    units: DataFrame, keys: Sequence[str], unit: str, quota: str, seed: int, buckets: int = 1 << 16
) -> DataFrame:
    """Hash and name of the last unit inside each stratum's quota.

    ``units`` holds one row per (keys, unit). Whole buckets under the quota are only
    counted; just the bucket in which the quota falls is ordered.
    """
    keys = list(keys)
    hashed = known(units, keys).select(*keys, unit, quota, hash52(seed, *keys, unit).alias("_hash"))
    hashed = hashed.withColumn("_bucket", hash_bucket(F.col("_hash"), buckets))
    counts = hashed.groupBy(*keys, "_bucket").agg(
        F.count(F.lit(1)).alias("_n"), F.max(quota).alias("_quota")
    )
    upto = F.sum("_n").over(
        W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    group_size = F.sum("_n").over(W.partitionBy(*keys))
    crossing = (
        counts.withColumn("_upto", upto)
        .withColumn("_need", F.least(F.col("_quota"), group_size))
        .where((F.col("_need") > F.col("_upto") - F.col("_n")) & (F.col("_need") <= F.col("_upto")))
        .select(*keys, "_bucket", (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_rest"))
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy("_hash", unit)
    return (
        hashed
        .join(crossing, [*keys, "_bucket"])
        .withColumn("_rn", F.row_number().over(inside))
        .where(F.col("_rn") == F.col("_rest"))
        .select(*keys, F.col("_hash").alias("cut_hash"), F.col(unit).alias("cut_unit"))
    )


def coordinate_sort(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Range-partitioned, sorted within partitions: part files in order form one sorted file."""
    ranged = (
        df.repartitionByRange(*order) if partitions is None
        else df.repartitionByRange(partitions, *order)
    )
    return ranged.sortWithinPartitions(*order)


def sort_positions(
    df: DataFrame, order: Sequence[str], partitions: int | None = None
) -> DataFrame:
    """Global sort position over any order, without one task seeing all rows.

    Equal rows become one row with ``copies``; ``first_position`` counts from 1. Nothing runs before
    the result is asked for, and nothing but the sorted rows is written.
    """
    keys = [*order, *(c for c in df.columns if c not in order)]
    runs = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    placed = running_sum(runs, [], keys, F.col("copies"), "_upto", partitions)
    return placed.withColumn("first_position", F.col("_upto") - F.col("copies") + 1).drop("_upto")
