"""Whole studies: each is one lazy plan over the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from lineamix.functions.names import LAB_STRAINS, LAB_TRUTH, VARIANT_CLASSES, ClassRule, classify, list_order, recode
from lineamix.operators import (
    fractions, intervals, prefix, reads, sampling, scoring, solutions, variants,
)
from lineamix.schemas import PREDICTION_COLUMNS

TOOL_ORDER = ("truth", "posterior", "abundance", "consensus", "clade")
BY_COVERAGE = ("sample", "coverage")


# --- predictions in one table -------------------------------------------------

def posterior_predictions(
    posterior: DataFrame, rules: Sequence[ClassRule] = VARIANT_CLASSES
) -> DataFrame:
    """First best solution of each sample, non-zero lineages, with their class."""
    first = solutions.first_solution(solutions.best_solutions(posterior), ["sample"])
    return first.where(F.col("fraction") != 0.0).select(
        "sample", F.col("lineage").alias("prediction"),
        classify(F.col("lineage"), rules).alias("who_name"), "fraction",
        F.lit("posterior").alias("tool"),
    )


def abundance_predictions(
    abundance: DataFrame, rules: Sequence[ClassRule] = VARIANT_CLASSES, k: int = 5
) -> DataFrame:
    """Top targets and the remainder, with their class."""
    top = fractions.top_with_other(abundance, ["sample"], k)
    return top.select(
        "sample", "prediction", classify(F.col("prediction"), rules).alias("who_name"), "fraction",
        F.lit("abundance").alias("tool"),
    )


def consensus_predictions(calls: DataFrame) -> DataFrame:
    return calls.select(
        "sample", F.col("lineage").alias("prediction"),
        recode(F.col("scorpio_call")).alias("who_name"), F.lit(1.0).alias("fraction"),
        F.lit("consensus").alias("tool"),
    )


def clade_predictions(calls: DataFrame, lineage: str = "Nextclade_pango") -> DataFrame:
    return calls.select(
        "sample", F.col(lineage).alias("prediction"), F.lower("clade_who").alias("who_name"),
        F.lit(1.0).alias("fraction"), F.lit("clade").alias("tool"),
    )


def truth_predictions(truth: DataFrame, rules: Sequence[ClassRule] = VARIANT_CLASSES) -> DataFrame:
    return truth.select(
        "sample", F.col("lineage").alias("prediction"),
        classify(F.col("lineage"), rules).alias("who_name"), "fraction", F.lit("truth").alias("tool"),
    )


def stack(*tables: DataFrame) -> DataFrame:
    """All predictions, columns matched by name, duplicates kept."""
    return reduce(DataFrame.unionByName, [t.select(*PREDICTION_COLUMNS) for t in tables])


def stacked_fractions(predictions: DataFrame, order: Sequence[str] = TOOL_ORDER) -> DataFrame:
    """Bar chart rows: summed fractions and the bar's ends, clamped to [0, 1]."""
    bars = predictions.groupBy("sample", "tool", "prediction").agg(F.sum("fraction").alias("fraction"))
    total = prefix.running_sum(bars, ["sample", "tool"], ["prediction"], F.col("fraction"), "_end")

    def clamp(value):
        return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))

    return total.select(
        "sample", "tool", list_order(F.col("tool"), order).alias("tool_order"), "prediction",
        "fraction",
        clamp(F.col("_end") - F.coalesce("fraction", F.lit(0.0))).alias("bar_start"),
        clamp(F.col("_end")).alias("bar_end"),
    )


def coinfection_table(
    predictions: DataFrame, tools: Sequence[str], order: Sequence[str] = TOOL_ORDER, excluded: Sequence[str] = (),
) -> DataFrame:
    """Per tool with bars: samples, bars, and the error of its class fractions; NULL for other tools.

    Bars and errors come from the same predictions; ``excluded`` samples have bars and no error.
    """
    bars = predictions.groupBy("sample", "tool", "prediction").agg(F.count(F.lit(1)).alias("_n"))
    per_sample = bars.groupBy("tool", "sample").agg(F.count(F.lit(1)).alias("_bars"))
    shown = per_sample.groupBy("tool").agg(F.count(F.lit(1)).alias("n_samples"), F.sum("_bars").alias("n_bars"))
    errors = scoring.mse_by_tool(predictions, tools, excluded=excluded)
    return shown.join(errors, "tool", "left").select(
        "tool", list_order(F.col("tool"), order).alias("tool_order"), "n_samples", "n_bars", "n_cells", "mse",
        scoring.mse_label("mse").alias("label"),
    )


def class_lineages(predictions: DataFrame) -> DataFrame:
    """Distinct predictions of each class."""
    return predictions.select("who_name", "prediction").distinct()


def page(table: DataFrame, order: Sequence[str], number: int, size: int = 25) -> DataFrame:
    """One page of a report table, counted from 0."""
    return table.orderBy(*order).offset(number * size).limit(size)


# --- studies ------------------------------------------------------------------

def simulation_input(
    counts: DataFrame, n_dates: int, n_reads: dict[str, int], dates_seed: int = 1313,
    lineages_seed: int = 42,
) -> DataFrame:
    """Counts to frequencies, sampled dates, three lineages each, and their read quotas."""
    frequencies = fractions.clade_frequencies(counts)
    dates = sampling.sample_dates(frequencies, n_dates, dates_seed)
    drawn = sampling.weighted_sample(
        frequencies.join(dates, "date", "left_semi"), ["date"], 3, lineages_seed
    )
    composed = sampling.compose_samples(drawn)
    depth = F.explode(F.create_map(*[F.lit(v) for pair in n_reads.items() for v in pair]))
    return composed.select("*", depth.alias("coverage", "_n")).select(
        "sample", "date", "lineage", "fraction", "coverage",
        sampling.read_quota(F.col("fraction"), F.col("_n")).alias("num_reads"),
    )


def tool_hits(
    truth: DataFrame, posterior: DataFrame, consensus: DataFrame, abundance: DataFrame
) -> DataFrame:
    """Hits of the three tools that name lineages, by coverage and sample."""
    best = solutions.best_solutions(posterior)
    named = {
        "posterior": solutions.dominant_per_solution(best),
        "consensus": consensus,
        "abundance": fractions.top_target(abundance),
    }
    calls = [
        rows.select(
            F.lit(tool).alias("tool"), *BY_COVERAGE, "lineage",
            F.lit(tool == "posterior").alias("listed"),
        )
        for tool, rows in named.items()
    ]
    dominant = fractions.dominant(truth, ["sample"])
    return scoring.call_hits(
        reduce(DataFrame.unionByName, calls), dominant, ["tool", *BY_COVERAGE]
    )


def clade_tool_hits(truth: DataFrame, clade_calls: DataFrame, clade_map: DataFrame) -> DataFrame:
    dominant = fractions.dominant(truth, ["sample"])
    hits = scoring.clade_hits(clade_calls, clade_map, dominant, BY_COVERAGE)
    return hits.withColumn("tool", F.lit("clade"))


def n_expected(truth: DataFrame) -> DataFrame:
    return truth.agg(F.countDistinct("sample").alias("n_expected"))


def abundant_validation(
    truth: DataFrame, posterior: DataFrame, consensus: DataFrame, abundance: DataFrame,
    clade_calls: DataFrame, clade_map: DataFrame,
    tools: Sequence[str] = ("posterior", "consensus", "abundance", "clade"), strict: bool = False,
) -> DataFrame:
    """One row per coverage with scored samples, call rate and accuracy of every tool.

    A sample without a best solution counts as not called, which shows in the call rate.
    ``strict`` raises instead when a tool and the truth do not cover the same samples.
    """
    if strict:
        for predicted in (posterior, consensus, abundance, clade_calls):
            scoring.require_parity(predicted, truth)
    hits = tool_hits(truth, posterior, consensus, abundance).drop("hit_exact").unionByName(
        clade_tool_hits(truth, clade_calls, clade_map)
    )
    scores = scoring.accuracy(hits, ["tool", "coverage"], n_expected(truth))
    return scoring.merge_tools(scores, tools)


def posterior_pairs(posterior: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs of the best solution by error, unmatched lineages folded."""
    keys = [*BY_COVERAGE, "solution"]
    pairs = scoring.truth_pairs(solutions.best_solutions(posterior), truth, keys)
    return scoring.best_rmse(scoring.fold_unmatched(pairs, keys), BY_COVERAGE)


def abundance_pairs(abundance: DataFrame, truth: DataFrame) -> DataFrame:
    predicted = fractions.shares(abundance, BY_COVERAGE, "tpm").withColumnRenamed(
        "target_id", "lineage"
    )
    pairs = scoring.truth_pairs(predicted, truth, BY_COVERAGE)
    return scoring.fold_unmatched(pairs, BY_COVERAGE, only_positive=True)


def scatter(pairs: DataFrame) -> DataFrame:
    """Error and rank correlation of all pairs, by coverage."""
    return scoring.mse(pairs, ["coverage"]).join(
        scoring.spearman(pairs, ["coverage"]).drop("n_points"), "coverage"
    )


def lab_mix(
    abundance: DataFrame, truth: DataFrame, names: DataFrame, keys: Sequence[str] = ("coverage",)
) -> DataFrame:
    """Rank correlation with renamed targets; unmatched ones stay single, with actual 0.

    ``names`` holds ``target_id`` and ``short``; targets without an entry keep their name.
    """
    shares = fractions.shares(abundance, BY_COVERAGE, "tpm")
    predicted = rename_targets(shares, names).withColumnRenamed("target_id", "lineage")
    pairs = scoring.truth_pairs(predicted, truth, BY_COVERAGE)
    return scoring.spearman(pairs, keys)


def lab_mix_posterior(
    posterior: DataFrame, truth: DataFrame, names: DataFrame, keys: Sequence[str] = ("coverage",)
) -> DataFrame:
    """Rank correlation of the first best solution, over the strains of the truth.

    ``names`` holds ``target_id`` and ``short``: other targets are left out, and a strain
    that the solution does not have counts as 0.
    """
    chosen = solutions.first_solution(solutions.best_solutions(posterior))
    renamed = chosen.join(names.select(F.col("target_id").alias("lineage"), "short"), "lineage")
    predicted = renamed.groupBy(*BY_COVERAGE, F.col("short").alias("lineage")).agg(
        F.sum("fraction").alias("predicted")
    )
    asked = chosen.select(*BY_COVERAGE).distinct().join(
        truth.select("sample", "lineage", F.col("fraction").alias("actual")), "sample"
    )
    pairs = asked.join(predicted, [*BY_COVERAGE, "lineage"], "left").na.fill(0.0, ["predicted"])
    return scoring.spearman(pairs, keys)


def lab_tables(spark: SparkSession, sample: str) -> tuple[DataFrame, DataFrame]:
    """Names and truth of the published five-strain mix, for ``lab_mix`` and ``lab_mix_posterior``."""
    names_of = spark.createDataFrame(list(LAB_STRAINS.items()), "target_id string, short string")
    truth = [(sample, short, share) for short, share in LAB_TRUTH.items()]
    return names_of, spark.createDataFrame(truth, "sample string, lineage string, fraction double")


def rename_targets(df: DataFrame, names: DataFrame) -> DataFrame:
    return df.join(names.select("target_id", "short"), "target_id", "left").withColumn(
        "target_id", F.coalesce("short", "target_id")
    ).drop("short")


def similarity(genotypes: DataFrame, compositions: DataFrame, columns: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Wide table of all pairs; ``columns`` must list every pair number that occurs."""
    pairs = variants.lineage_pairs(compositions)
    sets = variants.variant_sets(genotypes, compositions)
    return variants.similarity_wide(variants.lineage_similarity(pairs, sets), columns)


def genotype_filter(genotypes: DataFrame, min_share: float = 0.3) -> DataFrame:
    """Genotypes of the lineages with enough homozygous alternative calls."""
    return variants.keep_lineages(genotypes, variants.hom_alt_share(genotypes, min_share))


def monitoring(posterior: DataFrame, metadata: DataFrame, lineages: Sequence[str]) -> DataFrame:
    """Abundance of each lineage by collection date; NULL where a sample has no result."""
    top = solutions.max_abundance(posterior, lineages)
    wanted = fractions.grid(metadata, "lineage", lineages)
    return wanted.join(top, ["sample", "lineage"], "left").select(
        "sample", F.date_format("collection_date", "yyyy-MM-dd").alias("collection_date"),
        "lineage", "abundance",
    )


def haplotype_pairs(
    haplotypes: DataFrame, alignments: DataFrame, truth: DataFrame, lineages: Sequence[str],
    keys: Sequence[str] = ("sample",),
) -> DataFrame:
    """Summed haplotype frequencies beside the truth; absent lineages count 0."""
    found = reads.haplotype_abundance(haplotypes, alignments, keys=keys)
    filled = fractions.abundance_grid(found, lineages, keys)
    return scoring.truth_pairs(filled, truth, keys).drop("matched")


def read_mix(
    read_rows: DataFrame, compositions: DataFrame, n_reads: int, seed: int = 100
) -> DataFrame:
    """Reads of every lineage up to its quota, mixed into one set per sample."""
    quotas = compositions.select(
        "sample", "lineage", sampling.read_quota(F.col("fraction"), n_reads).alias("num_reads")
    )
    return sampling.sample_n_reads(read_rows, quotas, ["sample", "lineage"], seed=seed)


def clipped_reads(alignments: DataFrame, primers: DataFrame) -> DataFrame:
    """Alignments with the primer part of their 5' end cut off."""
    clipped = intervals.clip_lengths(alignments, primers)
    reverse = F.col("flag").bitwiseAND(intervals.REVERSE) != 0
    return clipped.withColumn(
        "start", F.when(reverse, F.col("start")).otherwise(F.col("start") + F.col("clip"))
    ).withColumn("end", F.when(reverse, F.col("end") - F.col("clip")).otherwise(F.col("end")))
