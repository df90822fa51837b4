"""Weights to fractions, dominant and top-k lineages, clade frequencies, grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lineamix.operators.ordering import attach, known, top_k


def totals(df: DataFrame, keys: Sequence[str], value: str, out: str = "total") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias(out))


def shares(df: DataFrame, keys: Sequence[str], value: str, out: str = "fraction") -> DataFrame:
    """Share of ``value`` in its group's total; NULL where the total is 0.

    Totals are aggregated on the map side and joined back, so that a hot group is
    never gathered the way a window over it would. Keys are not NULL: saying so lets
    both branches share one shuffle of ``df``.
    """
    keys = list(keys)
    rows = known(df, keys)
    return (
        attach(rows, totals(rows, keys, value, "_total"), keys)
        .withColumn(out, F.try_divide(value, "_total"))
        .drop("_total")
    )


def clade_counts(counts: DataFrame) -> DataFrame:
    """Sequences by (date, clade), summed over states."""
    return counts.groupBy("date", "clade").agg(F.sum("sequences").alias("sequences"))


def clade_frequencies(
    counts: DataFrame, min_fraction: float = 0.01, min_total: int = 50
) -> DataFrame:
    """Frequencies by date: rare clades dropped, the rest renormalised, thin dates dropped.

    The ``min_total`` rule looks at the total before rare clades are dropped.
    """
    per_clade = clade_counts(counts)
    per_date = totals(per_clade, ["date"], "sequences", "total_sequences").where(
        (F.col("total_sequences") != 0) & (F.col("total_sequences") >= min_total)
    )
    kept = attach(per_clade, per_date, ["date"]).where(
        F.col("sequences") / F.col("total_sequences") >= min_fraction
    )
    return shares(kept, ["date"], "sequences").select(
        "date", "total_sequences", "clade", "sequences", "fraction"
    )


def to_map(df: DataFrame, keys: Sequence[str], key: str, value: str, out: str) -> DataFrame:
    """One map per group. A map is one cell: its size is the number of distinct keys."""
    return df.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(out)
    )


def from_map(df: DataFrame, map_col: str, key: str, value: str) -> DataFrame:
    rest = [c for c in df.columns if c != map_col]
    return df.select(*rest, F.explode(map_col).alias(key, value))


def first_largest(name: str, value: str, order: str) -> Column:
    """Aggregate: name of the largest positive value, first in ``order`` on ties, else ''."""
    positive = F.col(value) > 0
    return F.coalesce(
        F.max_by(
            F.when(positive, F.col(name)), F.when(positive, F.struct(F.col(value), -F.col(order)))
        ),
        F.lit(""),
    )


def dominant(df: DataFrame, keys: Sequence[str], order: str = "ord") -> DataFrame:
    """Dominant lineage by group; a group without a positive fraction gets ''."""
    return df.groupBy(*keys).agg(first_largest("lineage", "fraction", order).alias("lineage"))


def top_target(abundance: DataFrame, keys: Sequence[str] = ("sample", "coverage")) -> DataFrame:
    """Most abundant target; ties go to the greatest name."""
    return abundance.groupBy(*keys).agg(
        F.max_by("target_id", F.struct("tpm", "target_id")).alias("lineage")
    )


def top_with_other(
    abundance: DataFrame, keys: Sequence[str] = ("sample", "coverage"), k: int = 5
) -> DataFrame:
    """The k most abundant targets and one ``other`` row, as fractions of the full total.

    The ``other`` row is there even when nothing remains.
    """
    keys = list(keys)
    abundance = known(abundance, keys)
    top = top_k(
        abundance.select(*keys, "target_id", "tpm"), keys, [F.desc("tpm"), F.asc("target_id")], k
    )
    # The last kept row is the boundary; every row can tell its side from it alone.
    bounds = top.groupBy(*keys).agg(
        F.max(F.struct((-F.col("tpm")).alias("rank_tpm"), F.col("target_id"))).alias("_last")
    )
    groups = totals(abundance, keys, "tpm", "_total").join(bounds, keys, "left")
    marker = F.struct((-F.col("tpm")).alias("rank_tpm"), F.col("target_id"))
    labelled = (
        attach(abundance, groups, keys)
        .withColumn("_other", marker > F.col("_last"))
        .select(
            *keys,
            F.when(~F.col("_other"), F.col("target_id")).otherwise("other").alias("prediction"),
            "_other",
            F.try_divide("tpm", "_total").alias("fraction"),
        )
    )
    empty = groups.select(
        *keys,
        F.lit("other").alias("prediction"),
        F.lit(True).alias("_other"),
        F.when(F.col("_total") != 0, 0.0).alias("fraction"),
    )
    return (
        labelled.unionByName(empty)
        .groupBy(*keys, "prediction", "_other")
        .agg(F.sum("fraction").alias("fraction"))
        .drop("_other")
    )


def grid(keys: DataFrame, name: str, values: Sequence[str]) -> DataFrame:
    """Every row of ``keys`` with every value of a fixed list."""
    return keys.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def abundance_grid(
    df: DataFrame, lineages: Sequence[str], keys: Sequence[str] = ("sample",)
) -> DataFrame:
    """Fraction of each requested lineage in every sample; 0 where the lineage is absent."""
    keys = list(keys)
    wanted = grid(df.select(*keys).distinct(), "lineage", lineages)
    found = df.where(F.col("lineage").isin(*lineages)).groupBy(*keys, "lineage").agg(
        F.sum("fraction").alias("fraction")
    )
    return wanted.join(found, [*keys, "lineage"], "left").na.fill({"fraction": 0.0})


def missing_outputs(expected: DataFrame, delivered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the expected grid for which nothing was delivered."""
    return expected.join(delivered.select(*keys).distinct(), list(keys), "left_anti")
