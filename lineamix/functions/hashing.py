"""Seeded hashing that does not depend on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_SPACE = 1 << 52


def hash52(seed: int, *cols: str | Column) -> Column:
    """52-bit integer from the md5 of ``seed|col|col…``: the same on every run and layout."""
    parts = [F.lit(str(seed))] + [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    number = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("bigint")
    return F.coalesce(number, F.lit(0).cast("bigint"))


def hash_unit(seed: int, *cols: str | Column) -> Column:
    """Uniform number in (0, 1]."""
    return (hash52(seed, *cols) + F.lit(1)) / F.lit(float(HASH_SPACE))


def sampling_key(seed: int, weight: Column, *cols: str | Column) -> Column:
    """Exponential race key: the k smallest are a weighted draw without replacement."""
    return -F.log(hash_unit(seed, *cols)) / weight
