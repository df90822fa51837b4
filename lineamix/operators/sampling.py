"""Seeded draws that give the same rows under any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lineamix.functions.hashing import hash52, hash_unit, sampling_key
from lineamix.operators.ordering import hash_cutoffs, top_k


def sample_dates(dates: DataFrame, n: int, seed: int) -> DataFrame:
    """n dates without replacement."""
    return (
        dates.select("date").distinct()
        .withColumn("_hash", hash52(seed, "date"))
        .orderBy("_hash", "date")
        .limit(n)
        .drop("_hash")
    )


def weighted_sample(
    frequencies: DataFrame, keys: Sequence[str], k: int, seed: int,
    name: str = "clade", weight: str = "fraction",
) -> DataFrame:
    """k rows per group without replacement, probability by weight.

    Groups with fewer rows return what they have; ``complete`` tells them apart.
    """
    keys = list(keys)
    keyed = frequencies.where(F.col(weight) > 0).withColumn(
        "_key", sampling_key(seed, F.col(weight), *keys, name)
    )
    drawn = top_k(keyed, keys, [F.asc("_key"), F.asc(name)], k).drop("_key")
    # At most k rows per group are left.
    return drawn.withColumn("complete", F.count(F.lit(1)).over(W.partitionBy(*keys)) == k)


def compose_samples(drawn: DataFrame, prefix: str = "SimulatedSample") -> DataFrame:
    """Renormalised compositions with numbered samples; lineage = first word of the clade.

    ``drawn`` holds the few rows of the sampled dates.
    """
    dates = drawn.select("date").distinct()
    numbered = dates.withColumn("_n", F.row_number().over(W.orderBy("date")))
    composed = drawn.groupBy("date").agg(F.sum("fraction").alias("_total"))
    return (
        drawn.join(composed, "date").join(numbered, "date")
        .select(
            F.concat(F.lit(prefix), F.col("_n")).alias("sample"),
            "date",
            F.split("clade", " ")[0].alias("lineage"),
            F.try_divide("fraction", "_total").alias("fraction"),
        )
    )


def read_quota(fraction: Column, n_reads: Column | int) -> Column:
    """Reads of a lineage, truncated. The quotas may sum to less than the total."""
    total = F.lit(n_reads) if isinstance(n_reads, int) else n_reads
    return (fraction * total).cast("int")


def sample_n_reads(
    reads: DataFrame, quotas: DataFrame, keys: Sequence[str], unit: str = "read_id",
    quota: str = "num_reads", seed: int = 100, buckets: int = 1 << 16,
) -> DataFrame:
    """Exactly ``quota`` read ids per stratum (all, if there are fewer), in every mate.

    The draw is made over ids, so both mates of a read come or stay together.
    """
    keys = list(keys)
    wanted = quotas.where(F.col(quota) > 0).select(*keys, F.col(quota).cast("bigint").alias(quota))
    units = reads.select(*keys, unit).distinct().join(wanted, keys)
    cutoffs = hash_cutoffs(units, keys, unit, quota, seed, buckets)
    return (
        reads.withColumn("_hash", hash52(seed, *keys, unit))
        .join(cutoffs, keys)
        .where(F.struct("_hash", unit) <= F.struct("cut_hash", "cut_unit"))
        .select(*reads.columns)
    )


def bernoulli_subset(df: DataFrame, cols: Sequence[str], p: float, seed: int = 42) -> DataFrame:
    """Each key is kept with probability p; equal keys share their fate."""
    return df.where(hash_unit(seed, *cols) <= p)
