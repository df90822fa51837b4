"""The registered queries: every operator on views of the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lineamix.functions import names
from lineamix.operators import (
    fractions, intervals, ordering, prefix, reads, sampling, scoring, solutions, variants,
)
from lineamix.plans import studies
from lineamix.session import tune
from lineamix.sources import genomics, lines, posterior, sinks, tables, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

WATCHED = ("LARGE", "PROMO")
# Pair numbers of a sample of four lineages.
PAIRS = tuple(range(1, 7))
STRAINS = ("strain0", "strain1", "strain2", "strain3", "strain4", "strain9")
DEPTHS = {"100x": 20_000, "1000x": 200_000}
MIX_READS = 20


def query(func: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views.forget_tables()
        return func(tune(spark), sf_dir)

    QUERIES[func.__name__] = run
    return func


def r9(name: str | Column, alias: str | None = None) -> Column:
    """Rounded for comparison; adding 0 turns -0.0 into 0.0."""
    column = F.col(name) if isinstance(name, str) else name
    return (F.round(column, 9) + F.lit(0.0)).alias(alias or name)


def all_tables(s: SparkSession, d: str) -> DataFrame:
    calls = views.calls(s, d, by_coverage=False)
    return studies.stack(
        studies.truth_predictions(views.truth(s, d), views.TYPE_RULES),
        studies.posterior_predictions(views.posterior(s, d, by_coverage=False), views.TYPE_RULES),
        studies.abundance_predictions(views.mix_abundance(s, d, by_coverage=False), views.TYPE_RULES),
        studies.consensus_predictions(calls),
        studies.clade_predictions(calls, "lineage"),
    )


def renamed_types(s: SparkSession, d: str) -> DataFrame:
    """Short names for the types with long names."""
    types = views.table(s, d, "part").select(F.col("p_type").alias("target_id")).distinct()
    return types.where(F.length("target_id") > 5).withColumn("short", F.substring("target_id", 1, 2))


def renamed_truth(s: SparkSession, d: str) -> DataFrame:
    name = F.col("lineage")
    return views.truth(s, d).withColumn(
        "lineage", F.when(F.length(name) > 5, F.substring(name, 1, 2)).otherwise(name)
    )


# --- counts and frequencies -----------------------------------------------------

@query
def clade_counts(s, d):
    return fractions.clade_counts(views.counts(s, d))


@query
def clade_map(s, d):
    maps = fractions.to_map(fractions.clade_counts(views.counts(s, d)), ["date"], "clade", "sequences", "m")
    return fractions.from_map(maps.withColumn("n_clades", F.size("m")), "m", "clade", "sequences")


@query
def clade_freq(s, d):
    return fractions.clade_frequencies(views.counts(s, d)).withColumn("fraction", r9("fraction"))


@query
def freq_map(s, d):
    maps = fractions.to_map(
        fractions.clade_frequencies(views.counts(s, d)), ["date", "total_sequences"], "clade", "fraction", "m"
    )
    back = sinks.maps_from_json(sinks.maps_to_json(maps, "m"), "m")
    return fractions.from_map(back, "m", "clade", "fraction").withColumn("fraction", r9("fraction"))


# --- abundance ------------------------------------------------------------------

@query
def fractions_by_sample(s, d):
    return fractions.shares(views.abundance(s, d), ["sample", "coverage"], "tpm").withColumn(
        "fraction", r9("fraction")
    )


QUERIES["fractions"] = QUERIES.pop("fractions_by_sample")


@query
def top1_target(s, d):
    return fractions.top_target(views.abundance(s, d))


@query
def top5_other(s, d):
    return fractions.top_with_other(views.abundance(s, d)).withColumn("fraction", r9("fraction"))


@query
def abundance_order(s, d):
    """Targets of each sample by falling abundance, with their position."""
    ranked = prefix.positions(views.abundance(s, d), ["sample", "coverage"], [F.desc("tpm"), "target_id"])
    return ranked.select("sample", "coverage", "target_id", "tpm", "position")


# --- posterior ------------------------------------------------------------------

@query
def best_solutions(s, d):
    return solutions.best_solutions(views.posterior(s, d)).select(
        "sample", "coverage", "solution", "odds", "lineage", r9("fraction")
    )


@query
def first_solution(s, d):
    return solutions.first_solution(solutions.best_solutions(views.posterior(s, d))).select(
        "sample", "coverage", "solution", "lineage", r9("fraction")
    )


@query
def dominant_per_solution(s, d):
    return solutions.tie_counts(
        solutions.dominant_per_solution(solutions.best_solutions(views.posterior(s, d)))
    )


@query
def max_abundance(s, d):
    return solutions.max_abundance(views.posterior(s, d), WATCHED).withColumn("abundance", r9("abundance"))


@query
def abundance_grid(s, d):
    best = solutions.first_solution(solutions.best_solutions(views.posterior(s, d)))
    grid = fractions.abundance_grid(best, WATCHED, ["sample", "coverage"])
    return grid.withColumn("fraction", r9("fraction"))


# --- truth and scores -------------------------------------------------------------

@query
def dominant_truth(s, d):
    return fractions.dominant(views.truth(s, d), ["sample"])


def _pairs(s, d):
    keys = ["sample", "coverage", "solution"]
    return scoring.truth_pairs(
        solutions.best_solutions(views.posterior(s, d)), views.truth(s, d), keys
    )


@query
def truth_pairs(s, d):
    return _pairs(s, d).select(
        "sample", "coverage", "solution", "lineage", r9("actual"), r9("predicted"), "matched"
    )


@query
def fold_unmatched(s, d):
    folded = scoring.fold_unmatched(_pairs(s, d), ["sample", "coverage", "solution"])
    return folded.select("sample", "coverage", "solution", "lineage", r9("actual"), r9("predicted"))


@query
def best_rmse(s, d):
    return studies.posterior_pairs(views.posterior(s, d), views.truth(s, d)).select(
        "sample", "coverage", "solution", "lineage", r9("rmse"), r9("actual"), r9("predicted")
    )


@query
def mse_points(s, d):
    pairs = studies.posterior_pairs(views.posterior(s, d), views.truth(s, d))
    return scoring.mse(pairs, ["coverage"]).select("coverage", r9("mse"), "n_points")


@query
def spearman(s, d):
    """Rank correlation of quantity and price over all line items, by return flag."""
    pairs = views.table(s, d, "lineitem").select(
        "l_returnflag", F.col("l_quantity").alias("actual"), F.col("l_extendedprice").alias("predicted")
    )
    return scoring.spearman(pairs, ["l_returnflag"]).select(
        "l_returnflag", r9("spearman"), "n_points"
    )


@query
def key_parity(s, d):
    coverages = F.explode(F.array(F.lit(views.LOW), F.lit(views.HIGH))).alias("coverage")
    truth = views.truth(s, d).select("sample", coverages)
    return scoring.one_sided_samples(views.posterior(s, d), truth, ["sample", "coverage"])


@query
def call_match(s, d):
    hits = studies.tool_hits(
        views.truth(s, d), views.posterior(s, d), views.calls(s, d), views.mix_abundance(s, d)
    )
    return hits.withColumnRenamed("hit", "hit_substring")


@query
def clade_match(s, d):
    hits = studies.clade_tool_hits(views.truth(s, d), views.calls(s, d), views.clade_map(s, d))
    return hits.select("sample", "coverage", "truth", "hit")


@query
def tool_accuracy(s, d):
    hits = studies.tool_hits(
        views.truth(s, d), views.posterior(s, d), views.calls(s, d), views.mix_abundance(s, d)
    )
    scores = scoring.accuracy(hits, ["tool", "coverage"], studies.n_expected(views.truth(s, d)))
    return scores.select("tool", "coverage", "n_samples", r9("call_rate"), r9("accuracy"))


@query
def clade_accuracy(s, d):
    hits = studies.clade_tool_hits(views.truth(s, d), views.calls(s, d), views.clade_map(s, d))
    scores = scoring.accuracy(hits, ["tool", "coverage"], studies.n_expected(views.truth(s, d)))
    return scores.select("tool", "coverage", "n_samples", r9("call_rate"), r9("accuracy"))


@query
def merge_tools(s, d):
    hits = studies.tool_hits(
        views.truth(s, d), views.posterior(s, d), views.calls(s, d), views.mix_abundance(s, d)
    )
    scores = scoring.accuracy(hits, ["tool", "coverage"], studies.n_expected(views.truth(s, d)))
    merged = scoring.merge_tools(scores, ["posterior", "consensus", "abundance"])
    return _rounded_scores(merged)


def _rounded_scores(merged):
    return merged.select(*[r9(c) if c.endswith(("_call_rate", "_accuracy")) else c for c in merged.columns])


# --- classes and stacking ---------------------------------------------------------

@query
def classify_lineage(s, d):
    types = views.table(s, d, "part").groupBy(F.col("p_type").alias("lineage")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return types.select(
        "lineage", names.classify(F.col("lineage"), views.TYPE_RULES).alias("who_name"), "n"
    )


@query
def recode_calls(s, d):
    return views.calls(s, d).select(
        "sample", "coverage", "scorpio_call", names.recode(F.col("scorpio_call")).alias("who_name")
    )


@query
def rename_keys(s, d):
    renamed = studies.rename_targets(views.mix_abundance(s, d), renamed_types(s, d))
    return renamed.select("sample", "coverage", "target_id", "tpm")


@query
def canonical_predictions(s, d):
    return studies.abundance_predictions(
        views.mix_abundance(s, d, by_coverage=False), views.TYPE_RULES
    ).withColumn("fraction", r9("fraction"))


@query
def all_predictions(s, d):
    return all_tables(s, d).withColumn("fraction", r9("fraction"))


@query
def distinct_values(s, d):
    return studies.class_lineages(all_tables(s, d))


@query
def page(s, d):
    shown = studies.page(all_tables(s, d), ["sample", "tool", "prediction", "who_name"], number=1)
    return shown.withColumn("fraction", r9("fraction"))


@query
def stacked_fractions(s, d):
    bars = studies.stacked_fractions(all_tables(s, d))
    return bars.select(
        "sample", "tool", "tool_order", "prediction", r9("fraction"), r9("bar_start"), r9("bar_end")
    )


@query
def mse_by_tool(s, d):
    errors = scoring.mse_by_tool(all_tables(s, d), ["posterior", "abundance"], excluded=["0", "1"])
    return errors.select("tool", r9("mse"), "n_cells")


# --- variants ---------------------------------------------------------------------

@query
def hom_alt_share(s, d):
    return variants.hom_alt_share(views.genotypes(s, d)).withColumn("share", r9("share"))


@query
def variant_sets(s, d):
    return variants.variant_sets(views.genotypes(s, d), views.supplier_lineages(s, d))


@query
def lineage_pairs(s, d):
    return variants.lineage_pairs(views.supplier_lineages(s, d))


def _similarity(s, d):
    compositions = views.supplier_lineages(s, d)
    sets = variants.variant_sets(views.genotypes(s, d), compositions)
    return variants.lineage_similarity(variants.lineage_pairs(compositions), sets)


@query
def lineage_similarity(s, d):
    return _similarity(s, d)


@query
def similarity_wide(s, d):
    return variants.similarity_wide(_similarity(s, d), PAIRS)


# --- sampling ---------------------------------------------------------------------

@query
def sample_dates(s, d):
    return sampling.sample_dates(fractions.clade_frequencies(views.counts(s, d)), 10, seed=1313)


@query
def weighted_sample3(s, d):
    drawn = sampling.weighted_sample(fractions.clade_frequencies(views.counts(s, d)), ["date"], 3, seed=42)
    return drawn.select("date", "clade", r9("fraction"), "complete")


@query
def compose_samples(s, d):
    frequencies = fractions.clade_frequencies(views.counts(s, d))
    dates = sampling.sample_dates(frequencies, 10, seed=1313)
    drawn = sampling.weighted_sample(
        frequencies.join(dates, "date", "left_semi"), ["date"], 3, seed=42
    )
    return sampling.compose_samples(drawn).withColumn("fraction", r9("fraction"))


@query
def read_quota(s, d):
    rows = fractions.grid(views.truth(s, d), "coverage", list(DEPTHS))
    total = F.when(F.col("coverage") == "100x", DEPTHS["100x"]).otherwise(DEPTHS["1000x"])
    return rows.select(
        "sample", "lineage", "coverage", sampling.read_quota(F.col("fraction"), total).alias("num_reads")
    )


@query
def sample_n_reads(s, d):
    quotas = views.truth(s, d).select(
        "sample", "lineage", sampling.read_quota(F.col("fraction"), MIX_READS).alias("num_reads")
    )
    return sampling.sample_n_reads(views.mix_reads(s, d), quotas, ["sample", "lineage"])


@query
def bernoulli_subset(s, d):
    orders = views.table(s, d, "orders").select("o_orderkey")
    return sampling.bernoulli_subset(orders, ["o_orderkey"], 0.1)


# --- reads and intervals ------------------------------------------------------------

def _counted(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query
def interval_anti(s, d):
    kept = intervals.outside_regions(views.reads(s, d), views.regions(s, d))
    return _counted(kept, "sample", "flag", "start", "end")


@query
def primer_clip(s, d):
    clipped = intervals.clip_lengths(views.reads(s, d), views.regions(s, d))
    return _counted(clipped, "flag", "start", "end", "clip")


@query
def mate_pairs(s, d):
    return _counted(reads.mate_pairs(views.reads(s, d)), "sample", "qname", "mate", "singleton")


@query
def coordinate_sort(s, d):
    alignments = views.reads(s, d).withColumn("unplaced", F.col("chrom").isNull())
    placed = ordering.sort_positions(
        alignments, ["unplaced", "chrom", "start", "end", "sample", "qname", "flag"]
    )
    return placed.select("chrom", "start", "end", "sample", "qname", "flag", "copies", "first_position")


@query
def primary_alignments(s, d):
    return reads.primary_alignments(views.alignments(s, d)).select("hap_id", "lineage", "line_no")


@query
def hap_abundance(s, d):
    found = reads.haplotype_abundance(views.haplotypes(s, d), views.alignments(s, d), keys=["sample"])
    return found.withColumn("fraction", r9("fraction"))


@query
def read_qc(s, d):
    return reads.read_qc(views.fastq(s, d)).withColumn("mean_quality", r9("mean_quality"))


@query
def read_summary(s, d):
    return reads.read_summary(views.fastq(s, d))


@query
def quality_filter(s, d):
    kept = reads.quality_filter(views.fastq(s, d), min_quality=20)
    return kept.select("sample", "read_id", F.length("seq").alias("length"))


@query
def quality_trim(s, d):
    return reads.quality_trim(views.fastq(s, d), min_mean=28).select(
        "sample", "read_id", F.length("seq").alias("length"),
        F.md5("seq").alias("seq_md5"), F.md5("qual").alias("qual_md5"),
    )


@query
def contig_lengths(s, d):
    documents = views.table(s, d, "documents").select("doc_id", F.col("text").alias("sequence"))
    return reads.contig_lengths(documents, ["doc_id"])


# --- sheets, grids, order -------------------------------------------------------------

@query
def metadata_lookup(s, d):
    best = solutions.first_solution(solutions.best_solutions(views.posterior(s, d, False)), ["sample"])
    measure = best.groupBy("sample").agg(F.max("fraction").alias("measure"))
    return views.metadata(s, d).join(measure, "sample", "left").select(
        "sample", reads.with_default(F.col("collection_date")).alias("collection_date"), r9("measure")
    )


@query
def route_reads(s, d):
    samples = views.truth(s, d).select("sample").distinct()
    return reads.route_reads(samples, views.sheet(s, d))


@query
def sample_grid(s, d):
    samples = views.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("sample"))
    expected = fractions.grid(samples, "coverage", views.COVERAGES)
    return fractions.missing_outputs(expected, views.posterior(s, d), ["sample", "coverage"])


@query
def natural_order(s, d):
    brands = views.table(s, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    keyed = brands.withColumn("_key", names.natural_key(F.col("p_brand")))
    return keyed.orderBy("_key").select(
        "p_brand", F.array_join("_key", "|").alias("natural_key"),
        names.numeric_suffix(F.col("p_brand")).alias("suffix"), "n",
    )


@query
def name_order(s, d):
    """Alignments in the order of their names, over all samples, with their place."""
    name = F.concat(F.lit("r"), F.col("qname"), F.when(F.col("flag") % 128 < 64, ".02").otherwise(".1"), F.lit("/"), F.length("qname"))
    named = views.reads(s, d).select("sample", name.alias("name"), "flag", "start", "end")
    # As a column: a sort works an expression out again in each of its comparisons.
    keyed = named.withColumn("_natural", names.natural_text(F.col("name")))
    ordered = prefix.positions(keyed, [], ["_natural", "name", "flag", "sample", "start", "end"])
    return ordered.groupBy("name").agg(F.min("position").alias("first"), F.max("position").alias("last"))


@query
def positional_zip(s, d):
    def listed(df, name):
        return prefix.positions(df, ["sample"], [name])

    true = listed(views.truth(s, d).select("sample", "lineage", "fraction"), "lineage")
    found = listed(views.mix_abundance(s, d, False), "target_id")
    return true.join(found, ["sample", "position"]).select(
        "sample", "position", "lineage", "target_id", r9("fraction"), "tpm"
    )


# --- parsers and path parts, on lines made from the tables ------------------------------

@query
def vcf_records(s, d):
    found = genomics.parse_vcf(views.vcf_lines(s, d), few_files=True, head=views.vcf_head(s, d))
    return genomics.cell_digests(found).select(
        "line_no", "chrom", "pos", "id", "ref", F.array_join("alts", ",").alias("alt"), "qual", "filter", "info", "format",
        "n_cells", "cells",
    )


@query
def vcf_genotypes(s, d):
    head = views.vcf_head(s, d)
    records = genomics.parse_vcf(views.vcf_lines(s, d), few_files=True, head=head)
    long = genomics.genotypes_of(records, genomics.vcf_lineages(head), few_files=True)
    return long.groupBy("lineage", "ord", "gt").agg(F.sum("n").alias("n"), F.sum("places").alias("places"))


@query
def sam_alignments(s, d):
    spans = genomics.alignment_spans(genomics.parse_sam(views.sam_lines(s, d)))
    return spans.select(
        "file", "line_no", "qname", "flag", "chrom", "start", "end", "rnext", "pnext", "tlen",
        F.array_join("tags", ";").alias("tags"),
    )


@query
def sam_round_trip(s, d):
    """Alignment lines that come out as they went in, with their number."""
    back = genomics.sam_lines(genomics.parse_sam(views.sam_lines(s, d)))
    return back.select("file", "line_no", F.md5("value").alias("line"))


@query
def fastq_reads(s, d):
    return genomics.parse_fastq(views.fastq_lines(s, d)).select(
        "sample", "read_id", "mate", F.length("seq").alias("bases"), F.md5("seq").alias("seq"), F.md5("qual").alias("qual")
    )


@query
def posterior_long(s, d):
    return posterior.parse_posterior(views.posterior_lines(s, d)).select(
        "sample", "coverage", "solution", "ord", "density", "odds", "lineage", "fraction"
    )


@query
def whitespace_table(s, d):
    return tables.parse_whitespace(views.metadata_lines(s, d), "CollectionDate date, SRA_ID string, Other int")


@query
def bed_intervals(s, d):
    return genomics.parse_bed(views.bed_lines(s, d))


@query
def fasta_sequences(s, d):
    found = genomics.parse_fasta(views.fasta_records(s, d))
    return found.select("contig", "description", "frequency", F.md5("sequence").alias("sequence"))


@query
def accession_list(s, d):
    padded = F.when(F.col("s_suppkey") % 5 == 0, " \t").otherwise(F.concat(F.lit("  "), "s_name", F.lit(" ")))
    return lines.parse_accessions(views.table(s, d, "supplier").select(padded.alias("value")))


@query
def path_dims(s, d):
    """The three layouts of paths, each of some of the orders' paths."""
    orders = views.table(s, d, "orders")
    sample = F.concat_ws("-", F.concat(F.lit("S"), F.col("o_custkey")), F.when(F.col("o_orderkey") % 3 != 0, "100x"))
    layouts = {
        "file": F.concat(F.lit("/x.y/"), sample, F.lit(".tar.csv")),
        "folder": F.concat(F.lit("/x/"), sample, F.lit("/out.tsv")),
        "quant_folder": F.concat(F.lit("/x/quant_results_"), sample, F.lit("/abundance.tsv")),
    }
    found = None
    for i, (layout, path) in enumerate(layouts.items()):
        mine = orders.where(F.col("o_custkey") % 3 == i).select("o_orderkey", path.alias("file"))
        mine = lines.path_dims(mine, layout).withColumn("layout", F.lit(layout))
        found = mine if found is None else found.unionByName(mine)
    return found


@query
def mate_dims(s, d):
    path = F.concat(F.lit("/r/S"), F.col("o_custkey"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("_"), F.col("o_orderkey") % 3)).otherwise(""), F.lit(".fastq.gz"))
    return lines.mate_dims(views.table(s, d, "orders").select("o_orderkey", path.alias("file"))).drop("file")


@query
def first_rows(s, d):
    """First line item of each order, as first rows of files."""
    row_id = ((F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")) * 100
    listed = views.table(s, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("file"), F.lit(0).cast("bigint").alias("split_start"),
        (row_id + F.col("l_quantity").cast("bigint")).alias("row_id"), "l_partkey", "l_quantity",
    )
    return tables.first_rows(listed)


@query
def column_pair(s, d):
    return tables.column_pair(views.table(s, d, "part"), 3, 4, ("brand", "type"))


@query
def report_names(s, d):
    return views.table(s, d, "supplier").select(
        "s_suppkey", names.text_from(F.col("s_name"), "#00000000").alias("part"),
        names.archive_link(F.col("s_name"), "https://example.org/").alias("link"),
    )


@query
def similarity_cells(s, d):
    cells = variants.similarity_cells(variants.similarity_wide(_similarity(s, d), PAIRS), PAIRS)
    return cells.select("sample", *[
        F.concat_ws("=", f"{m}_{i}.pair", f"{m}_{i}.value").alias(f"{m}_{i}") for m in ("Diff", "Shared") for i in PAIRS
    ])


@query
def study_vcf_filter(s, d):
    """Whole lines of the filtered variant file: every field, order and repeats are kept."""
    head = views.vcf_head(s, d)
    records = genomics.parse_vcf(views.vcf_lines(s, d), few_files=True, head=head)
    calls = genomics.genotypes_of(records, genomics.vcf_lineages(head), few_files=True)
    kept = variants.hom_alt_share(calls, n="n")
    return sinks.filtered_vcf_lines(records, head, kept, few_files=True).select("line_no", "value")


# --- whole studies ----------------------------------------------------------------------

@query
def study_simulation_input(s, d):
    made = studies.simulation_input(views.counts(s, d), 10, DEPTHS)
    return made.withColumn("fraction", r9("fraction"))


@query
def study_abundant_validation(s, d):
    calls = views.calls(s, d)
    merged = studies.abundant_validation(
        views.truth(s, d), views.posterior(s, d), calls, views.mix_abundance(s, d), calls, views.clade_map(s, d)
    )
    return _rounded_scores(merged)


@query
def study_scatter_posterior(s, d):
    scored = studies.scatter(studies.posterior_pairs(views.posterior(s, d), views.truth(s, d)))
    return scored.select("coverage", r9("mse"), "n_points", r9("spearman"))


@query
def study_scatter_abundance(s, d):
    scored = studies.scatter(studies.abundance_pairs(views.mix_abundance(s, d), views.truth(s, d)))
    return scored.select("coverage", r9("mse"), "n_points", r9("spearman"))


@query
def study_labmix(s, d):
    scored = studies.lab_mix(views.mix_abundance(s, d), renamed_truth(s, d), renamed_types(s, d))
    return scored.select("coverage", r9("spearman"), "n_points")


@query
def study_labmix_posterior(s, d):
    scored = studies.lab_mix_posterior(views.posterior(s, d), renamed_truth(s, d), renamed_types(s, d))
    return scored.select("coverage", r9("spearman"), "n_points")


@query
def study_coinfection(s, d):
    """Class fractions of every tool beside the truth, per sample."""
    bars = studies.stacked_fractions(all_tables(s, d))
    return bars.groupBy("tool", "tool_order", "prediction").agg(
        F.count(F.lit(1)).alias("n_samples"), r9(F.avg("fraction"), "mean_fraction"),
        r9(F.max("bar_end"), "highest"),
    )


@query
def study_coinfection_errors(s, d):
    """The table beside the bars: per tool its bars, samples, and mean squared error against the truth."""
    return studies.coinfection_table(all_tables(s, d), ("posterior", "abundance", "consensus")).withColumn("mse", r9("mse"))


@query
def study_similarity(s, d):
    return studies.similarity(views.genotypes(s, d), views.supplier_lineages(s, d), PAIRS)


@query
def study_genotype_filter(s, d):
    """Body lines of the filtered variant file."""
    kept = studies.genotype_filter(views.genotypes(s, d))
    meta = s.createDataFrame([], "line_no bigint, value string")
    return sinks.vcf_lines(kept, meta).select("kind", "pos", "value")


@query
def study_monitoring(s, d):
    watched = studies.monitoring(views.posterior(s, d, False), views.metadata(s, d), WATCHED)
    return watched.withColumn("abundance", r9("abundance"))


@query
def study_hap_abundance(s, d):
    truth = views.haplotypes(s, d).groupBy(
        "sample", F.concat(F.lit("strain"), F.col("hap_id") % 5).alias("lineage")
    ).agg(F.sum("frequency").alias("fraction"))
    pairs = studies.haplotype_pairs(views.haplotypes(s, d), views.alignments(s, d), truth, STRAINS)
    return pairs.select("sample", "lineage", r9("actual"), r9("predicted"))


@query
def study_read_mix(s, d):
    mixed = studies.read_mix(views.mix_reads(s, d), views.truth(s, d), MIX_READS)
    return _counted(mixed, "sample", "mate")


@query
def study_clipped_reads(s, d):
    clipped = studies.clipped_reads(views.reads(s, d), views.regions(s, d))
    return _counted(clipped, "sample", "flag", "start", "end")
