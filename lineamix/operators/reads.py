"""Alignments and reads: flags, mates, routing, quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lineamix.functions import phred
from lineamix.operators.ordering import attach

UNMAPPED, SECONDARY, SUPPLEMENTARY = 0x4, 0x100, 0x800
FIRST_MATE, SECOND_MATE = 0x40, 0x80


def primary_alignments(alignments: DataFrame) -> DataFrame:
    skip = UNMAPPED | SECONDARY | SUPPLEMENTARY
    return alignments.where(F.col("flag").bitwiseAND(skip) == 0)


def haplotype_lineages(
    alignments: DataFrame, hap: str = "hap_id", lineage: str = "lineage", keys: Sequence[str] = ()
) -> DataFrame:
    """Lineage of each haplotype: its last primary alignment in file order."""
    return primary_alignments(alignments).groupBy(*keys, hap).agg(
        F.max_by(lineage, "line_no").alias("lineage")
    )


def haplotype_abundance(
    haplotypes: DataFrame, alignments: DataFrame, hap: str = "hap_id", keys: Sequence[str] = ()
) -> DataFrame:
    """Frequencies summed by lineage; haplotypes without frequency or alignment are skipped."""
    named = haplotype_lineages(alignments, hap, keys=keys)
    return (
        named.join(haplotypes.where("frequency is not null"), [*keys, hap])
        .groupBy(*keys, "lineage")
        .agg(F.sum("frequency").alias("fraction"))
    )


def mate_number(flag: Column) -> Column:
    return (
        F.when(flag.bitwiseAND(FIRST_MATE) != 0, 1)
        .when(flag.bitwiseAND(SECOND_MATE) != 0, 2)
        .otherwise(0)
    )


def mate_pairs(alignments: DataFrame, keys: Sequence[str] = ("sample", "qname")) -> DataFrame:
    """Add ``mate`` (1, 2 or 0) and ``singleton``: the read name has only one mate.

    Secondary and supplementary alignments are dropped first.
    """
    skip = SECONDARY | SUPPLEMENTARY
    kept = alignments.where(F.col("flag").bitwiseAND(skip) == 0).withColumn(
        "mate", mate_number(F.col("flag"))
    )
    names = kept.groupBy(*keys).agg((F.min("mate") == F.max("mate")).alias("singleton"))
    return attach(kept, names, keys)


CLIPPED, TRIMMED, RAW_MIX = "clipped", "trimmed", "raw_mix"


def route_reads(samples: DataFrame, sheet: DataFrame, simulated: bool = False) -> DataFrame:
    """Which read set each sample uses: clipped with a primer, trimmed without one."""
    if simulated:
        return samples.withColumn("primer", F.lit(None).cast("string")).withColumn(
            "route", F.lit(RAW_MIX)
        )
    if "primer" not in sheet.columns:
        sheet = sheet.withColumn("primer", F.lit(None).cast("string"))
    known = sheet.select("sample", F.nullif("primer", F.lit("")).alias("primer"))
    return samples.join(known, "sample", "left").withColumn(
        "route", F.when(F.col("primer").isNotNull(), CLIPPED).otherwise(TRIMMED)
    )


def with_default(value: Column, default: str = "NA") -> Column:
    return F.coalesce(value.cast("string"), F.lit(default))


def contig_lengths(sequences: DataFrame, keys: Sequence[str] = ("contig",)) -> DataFrame:
    return sequences.select(
        *keys, F.length(F.regexp_replace("sequence", r"\s", "")).cast("bigint").alias("length")
    )


def quality_filter(
    reads: DataFrame, min_quality: int = 30, max_low_share: float = 0.4
) -> DataFrame:
    """Drop reads in which more than ``max_low_share`` of the bases are under ``min_quality``."""
    low = phred.low_bases(F.col("qual"), min_quality)
    return reads.where(low <= F.length("qual") * F.lit(max_low_share))


def quality_trim(reads: DataFrame, window: int = 4, min_mean: int = 20) -> DataFrame:
    """Cut both ends back to the first and last window whose mean quality reaches the minimum.

    Reads without such a window, empty ones included, are dropped. Shorter reads count
    as one window.
    """
    bounds = phred.window_bounds(window, min_mean)
    marked = reads.withColumn("_part", bounds("qual")).where("_part.at is not null")
    cut = {c: F.substr(c, F.col("_part.at"), F.col("_part.kept")) for c in ("seq", "qual")}
    return marked.select(*[cut[c].alias(c) if c in cut else c for c in reads.columns])


BASES = ("a", "c", "g", "t")


def read_qc(reads: DataFrame, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """Mean quality, reads and base counts by position.

    Reads are reduced to sums per position before the shuffle, some of them at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = list(keys)
    counts = [T.StructField(c, T.LongType()) for c in ("reads", "scored", "score_sum", *(f"n_{b}" for b in BASES))]
    schema = T.StructType([*reads.select(*names).schema.fields, T.StructField("pos", T.IntegerType()), *counts])
    partial = reads.select(*names, "seq", "qual").mapInArrow(
        phred.by_slices(phred.position_sums(names, BASES), to_arrow_schema(schema)), schema
    )
    return partial.groupBy(*names, "pos").agg(
        F.try_divide(F.sum("score_sum"), F.sum("scored")).alias("mean_quality"),
        F.sum("reads").alias("n_reads"),
        *[F.sum(f"n_{b}").alias(f"n_{b}") for b in BASES],
    )


def read_summary(reads: DataFrame, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """Number of reads, bases and length range."""
    length = F.length("seq").cast("bigint")
    return reads.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_reads"), F.sum(length).alias("n_bases"),
        F.min(length).alias("min_length"), F.max(length).alias("max_length"),
    )
