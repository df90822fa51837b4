"""Posterior tables: every file has its own lineage columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lineamix.sources.lines import Paths, few, numbered_lines, path_dims

_MEASURES = ("density", "odds")


def read_posterior(spark: SparkSession, paths: Paths, layout: str = "file") -> DataFrame:
    """One row per (sample, coverage, solution, lineage).

    ``solution`` is the line of the candidate in its file, ``ord`` the column of the
    lineage: both keep the order that decides ties. Files are read line by line and
    meet their own header by a join on the file.
    """
    lines = numbered_lines(spark, paths)
    return parse_posterior(lines, layout, few(lines))


def parse_posterior(lines: DataFrame, layout: str = "file", few_files: bool = False) -> DataFrame:
    """``read_posterior`` of lines (file, line_no, value); headers of few files are broadcast."""
    cells = F.split(F.regexp_replace("value", r"\s+$", ""), ",")
    lines = lines.where(F.col("value").rlike(r"\S")).select("file", "line_no", cells.alias("_cells"))
    header = lines.where("line_no = 0").select("file", F.col("_cells").alias("_names"))
    rows = lines.where("line_no > 0").join(F.broadcast(header) if few_files else header, "file")

    def measure(name: str):
        at = F.array_position("_names", F.lit(name)).cast("int") - 1
        return F.get("_cells", at).try_cast("double").alias(name)

    pairs = F.posexplode(F.arrays_zip(F.col("_names").alias("name"), F.col("_cells").alias("cell")))
    long = rows.select(
        "file", F.col("line_no").cast("int").alias("solution"),
        *[measure(m) for m in _MEASURES], pairs.alias("ord", "_pair"),
    ).where(~F.col("_pair")["name"].isin(*_MEASURES))
    return path_dims(long, layout).select(
        "sample", "coverage", "solution", "ord", *_MEASURES,
        F.col("_pair")["name"].alias("lineage"),
        F.col("_pair")["cell"].try_cast("double").alias("fraction"),
    )
