"""Candidate solutions of the posterior caller (long form: one row per lineage)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lineamix.operators.fractions import dominant, grid

KEYS = ("sample", "coverage")


def best_solutions(posterior: DataFrame) -> DataFrame:
    """Tied best candidates: odds of exactly 1. A sample without one disappears."""
    return posterior.where(F.col("odds") == 1.0)


def first_solution(best: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Policy ``first``: the best candidate that comes first in the file."""
    keys = list(keys)
    first = best.groupBy(*keys).agg(F.min("solution").alias("solution"))
    return best.join(first, [*keys, "solution"], "left_semi")


def dominant_per_solution(best: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Policy ``all``: the dominant lineage of every tied solution."""
    return dominant(best, [*keys, "solution"])


def tie_counts(dominants: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The list of dominant lineages as a multiset: one row per lineage with its count."""
    return dominants.groupBy(*keys, "lineage").agg(F.count(F.lit(1)).alias("n_solutions"))


def max_abundance(
    posterior: DataFrame, lineages: Sequence[str], keys: Sequence[str] = ("sample",)
) -> DataFrame:
    """Largest fraction, in percent, of each lineage over the tied best solutions.

    Samples without a best solution, and lineages a file does not name, get 0.
    """
    keys = list(keys)
    found = (
        best_solutions(posterior)
        .where(F.col("lineage").isin(*lineages) & (F.col("fraction") > 0))
        .groupBy(*keys, "lineage")
        .agg(F.max("fraction").alias("_top"))
    )
    return (
        grid(posterior.select(*keys).distinct(), "lineage", lineages)
        .join(found, [*keys, "lineage"], "left")
        .select(*keys, "lineage", (F.coalesce("_top", F.lit(0.0)) * 100).alias("abundance"))
    )
