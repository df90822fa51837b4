"""Half-open intervals: overlap tests and clipping by one walk along the genome.

Reads and regions are sorted together by position, over ranges that are cut anywhere, and the
furthest reach so far decides about a read. A region is one row whatever its length, a read is moved
once and never copied, and no place, bin or region gathers the reads that it meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lineamix.operators.prefix import running_max

REVERSE = 0x10
_PLACE, _KIND, _REACH, _SIDE, _FAR = "_place", "_kind", "_reach", "_side", "_far"


def _walk(reads: DataFrame, marks: DataFrame, keys: list[str], reads_first: bool) -> DataFrame:
    """Reads with the furthest ``_reach`` of the marks at or before their place in ``_far``.

    With ``reads_first`` a mark at the place of a read comes after it.
    """
    mine = reads.withColumns({_KIND: F.lit(0 if reads_first else 1), _REACH: F.lit(None).cast("bigint")})
    other = marks.withColumn(_KIND, F.lit(1 if reads_first else 0))
    both = mine.unionByName(other, allowMissingColumns=True)
    far = running_max(both, keys, [_PLACE, _KIND], F.col(_REACH), _FAR)
    return far.where(F.col(_KIND) == (0 if reads_first else 1))


def _overlapping(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Reads with ``_meets``: of the regions that begin before a read ends, one ends after it begins."""
    marks = regions.select(
        "chrom", F.col("start").cast("bigint").alias(_PLACE), F.col("end").cast("bigint").alias(_REACH)
    ).where(F.col("chrom").isNotNull() & F.col(_PLACE).isNotNull()).distinct()
    placed = reads.withColumn(_PLACE, F.col("end").cast("bigint"))
    meets = F.coalesce(F.col("chrom").isNotNull() & (F.col(_FAR) > F.col("start")) & F.col("end").isNotNull(), F.lit(False))
    return _walk(placed, marks, ["chrom"], True).select(*reads.columns, meets.alias("_meets"))


def outside_regions(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Reads that overlap no region; reads without coordinates are kept."""
    return _overlapping(reads, regions).where(~F.col("_meets")).drop("_meets")


def inside_regions(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Reads that overlap at least one region."""
    return _overlapping(reads, regions).where("_meets").drop("_meets")


def clip_lengths(reads: DataFrame, primers: DataFrame) -> DataFrame:
    """Bases to clip from the 5' end of each read: column ``clip``.

    For a forward read that is the furthest end of the primers that begin at or before it; a reverse
    read is the same in mirror image. So each primer is a mark on both sides, and rows grow with
    primers, not with the bases they cover.
    """
    p = primers.select("chrom", F.col("start").cast("bigint"), F.col("end").cast("bigint"))
    p = p.where((F.col("end") > F.col("start")) & F.col("chrom").isNotNull()).distinct()

    def mark(side: int, place: Column, reach: Column) -> Column:
        return F.struct(F.lit(side).alias(_SIDE), place.alias(_PLACE), reach.alias(_REACH))

    marks = p.select("chrom", F.inline(F.array(
        mark(0, F.col("start"), F.col("end")), mark(1, -F.col("end"), -F.col("start"))
    )))
    reverse = F.col("flag").bitwiseAND(REVERSE) != 0
    placed = reads.withColumns({
        _SIDE: F.when(reverse, 1).otherwise(0),
        _PLACE: F.when(reverse, -F.col("end")).otherwise(F.col("start")).cast("bigint"),
        "_stop": F.when(reverse, -F.col("start")).otherwise(F.col("end")).cast("bigint"),
    })
    clip = F.when(F.col(_FAR) > F.col(_PLACE), F.least(_FAR, "_stop") - F.col(_PLACE)).otherwise(0)
    return _walk(placed, marks, ["chrom", _SIDE], False).select(*reads.columns, clip.cast("bigint").alias("clip"))
