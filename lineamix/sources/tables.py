"""Delimited tables. The separator is always given: endings do not tell it."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lineamix import schemas
from lineamix.sources.lines import Paths, as_list, few, numbered_lines, path_dims

_ORIGIN = {
    "file": "_metadata.file_path",
    "split_start": "_metadata.file_block_start",
}


def read_table(
    spark: SparkSession, paths: Paths, schema: str, sep: str = ",", header: bool = True
) -> DataFrame:
    """Typed columns plus the origin of each row (``file``, ``split_start``, ``row_id``).

    With a header, each file's columns are found by the names in its own first line, in any
    order, and others are ignored; a file that lacks a column has NULL there. Values that
    do not parse become NULL. Files with one header are read together.
    """
    fields = T._parse_datatype_string(schema).fields
    if not header:
        return _typed(spark, as_list(paths), [f.name for f in fields], fields, sep, False)
    groups = _by_header(spark, as_list(paths))
    if not groups:
        return _typed(spark, as_list(paths), [f.name for f in fields], fields, sep, True)
    parts = [
        _typed(spark, files, _names(line, sep), fields, sep, True) for line, files in groups
    ]
    # Rows keep the order inside their file; ids of different headers are not comparable.
    return reduce(DataFrame.unionByName, parts)


def _by_header(spark: SparkSession, paths: list[str]) -> list[tuple[str, list[str]]]:
    """First lines with the files that begin with them: file names come to the driver, not rows."""
    lines = spark.read.text(paths).select(
        "value", *[F.col(source).alias(name) for name, source in _ORIGIN.items()],
        F.monotonically_increasing_id().alias("row_id"),
    )
    first = lines.where("split_start = 0").groupBy("file").agg(
        F.min_by("value", "row_id").alias("header")
    )
    found = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))
    return [(r.header, list(r.files)) for r in found.orderBy("header").collect()]


def _names(line: str, sep: str) -> list[str]:
    """Column names of a header line, split as the reader would; later repeats are renamed."""
    names = next(csv.reader([line], delimiter=sep), [])
    return [n if names.index(n) == i else f"{n}#{i}" for i, n in enumerate(names)]


def _typed(
    spark: SparkSession, files: list[str], names: list[str], fields: list[T.StructField], sep: str, header: bool
) -> DataFrame:
    layout = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.option("sep", sep).option("header", header).schema(layout).csv(files)
    columns = [
        (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in fields
    ]
    origin = [F.col(source).alias(name) for name, source in _ORIGIN.items()]
    return raw.select(*columns, *origin, F.monotonically_increasing_id().alias("row_id"))


def first_rows(table: DataFrame) -> DataFrame:
    """First data row of every file."""
    origin = ("file", "split_start", "row_id")
    columns = [c for c in table.columns if c not in origin]
    first = F.min_by(F.struct(*columns), F.struct("split_start", "row_id"))
    return table.groupBy("file").agg(first.alias("_row")).select("_row.*", "file")


def read_whitespace_table(spark: SparkSession, paths: Paths, schema: str) -> DataFrame:
    """Table separated by runs of white space, header in the first line of each file."""
    lines = numbered_lines(spark, paths)
    return parse_whitespace(lines, schema, few(lines))


def parse_whitespace(lines: DataFrame, schema: str, few_files: bool = False) -> DataFrame:
    """``read_whitespace_table`` of lines (file, line_no, value); headers of few files are broadcast."""
    fields = T._parse_datatype_string(schema).fields
    tokens = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")
    lines = lines.select("file", "line_no", tokens.alias("_v")).where(F.array_join("_v", "") != "")
    header = lines.where("line_no = 0").select("file", F.col("_v").alias("_h"))
    rows = lines.where("line_no > 0").join(F.broadcast(header) if few_files else header, "file")
    columns = [
        F.get("_v", F.array_position("_h", F.lit(f.name)).cast("int") - 1)
        .try_cast(f.dataType).alias(f.name)
        for f in fields
    ]
    return rows.select(*columns)


def read_abundance(spark: SparkSession, paths: Paths, layout: str = "quant_folder") -> DataFrame:
    return path_dims(read_table(spark, paths, schemas.ABUNDANCE_FILE, "\t"), layout).select(
        "sample", "coverage", "target_id", "tpm"
    )


def read_consensus_calls(spark: SparkSession, paths: Paths) -> DataFrame:
    return path_dims(read_table(spark, paths, schemas.CONSENSUS_FILE), "file")


def read_clade_calls(spark: SparkSession, paths: Paths, sep: str = "\t") -> DataFrame:
    return path_dims(read_table(spark, paths, schemas.CLADE_FILE, sep), "folder")


def read_compositions(spark: SparkSession, paths: Paths, sep: str = ",") -> DataFrame:
    """Truth by sample; ``ord`` keeps the order of rows within a file."""
    table = read_table(spark, paths, schemas.COMPOSITION_FILE, sep)
    return table.select(
        "sample", "lineage", "fraction", (F.col("split_start") + F.col("row_id")).alias("ord")
    )


def read_clade_map(spark: SparkSession, paths: Paths) -> DataFrame:
    return read_table(spark, paths, schemas.CLADE_MAP_FILE, "\t", header=False).select("clade", "pango")


def read_sequence_counts(spark: SparkSession, paths: Paths) -> DataFrame:
    return read_table(spark, paths, schemas.COUNTS_FILE, "\t").select(
        "date", "state", "clade", "sequences"
    )


def read_predictions(spark: SparkSession, paths: Paths) -> DataFrame:
    table = read_table(spark, paths, schemas.PREDICTIONS_FILE, "\t")
    return table.withColumnRenamed("WHO_name", "who_name").select(*schemas.PREDICTION_COLUMNS)


def read_sheet(spark: SparkSession, paths: Paths) -> DataFrame:
    """Sample sheet; the primer column may be absent."""
    names = spark.read.option("sep", "\t").option("header", True).csv(as_list(paths)).columns
    schema = schemas.SHEET_FILE if "primer" in names else "sra string"
    table = read_table(spark, paths, schema, "\t").withColumnRenamed("sra", "sample")
    if "primer" not in table.columns:
        table = table.withColumn("primer", F.lit(None).cast("string"))
    return table.select("sample", "primer")


def column_pair(table: DataFrame, first: int, second: int, names: Sequence[str]) -> DataFrame:
    """Distinct sorted pairs of two columns given by number, from 1."""
    a, b = table.columns[first - 1], table.columns[second - 1]
    pair = table.select(F.col(a).alias(names[0]), F.col(b).alias(names[1]))
    return pair.distinct().orderBy(*names)
