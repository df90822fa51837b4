"""Text lines with their file and line number, and dimensions kept in paths."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

Paths = str | Sequence[str]


def as_list(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


#: Tables with a row per split or file are broadcast up to so many rows.
MOST_SPLITS = 100_000


def few(raw: DataFrame) -> bool:
    """True if the files have so few splits that a table of them may be broadcast; runs no job."""
    return raw.rdd.getNumPartitions() + len(raw.inputFiles()) <= MOST_SPLITS


def raw_lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """Lines with ``file``, ``_split`` (its first byte) and ``_id``, which counts up inside a split.

    Two scans of one query cut the files alike: the least number of partitions, which otherwise
    follows the executors of the moment, is fixed for the session where it is not set.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(max(spark.sparkContext.defaultParallelism, 1)))
    return spark.read.text(as_list(paths)).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )


def numbered_lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """Columns ``file``, ``line_no`` (from 0) and ``value``, for files of any size.

    Rows of one split have consecutive ids, so only the number of lines per split has to be known:
    a first scan counts them, their prefix sum meets the second scan, and lines are neither sorted,
    moved nor copied. Should the second scan find other splits than the first, it is an error.
    """
    raw = raw_lines(spark, paths)
    splits = raw.groupBy("file", "_split").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_lines")
    )
    before = W.partitionBy("file").orderBy("_split").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select(
        "file", "_split", "_first", "_lines", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before")
    )
    if few(raw):
        offsets = F.broadcast(offsets)
    at = F.col("_id") - F.col("_first")
    torn = F.raise_error("files were cut into other splits while their lines were counted").cast("bigint")
    line_no = F.when((at >= 0) & (at < F.col("_lines")), F.col("_before") + at).otherwise(torn)
    return raw.join(offsets, ["file", "_split"], "left").select("file", line_no.alias("line_no"), "value")


def text_of(column: pa.Array) -> tuple[memoryview, list[int]]:
    """Bytes of a text column without NULLs, and where each text begins and the last one ends."""
    _, offsets, text = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1]
    return memoryview(text if text is not None else b""), ends.tolist()


def text_array(pieces: Iterable[bytes], sizes: Sequence[int]) -> pa.Array:
    """Text column of UTF-8 pieces one after another; ``sizes`` are the bytes of each text."""
    ends = np.cumsum([0, *sizes])
    if ends[-1] >= 1 << 31:
        raise ValueError("a batch of lines is longer than 2 GB")
    return pa.Array.from_buffers(
        pa.string(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(b"".join(pieces))]
    )


def first_lines(lines: DataFrame) -> DataFrame:
    """The line with number 0 of each file, as (file, first)."""
    return lines.where("line_no = 0").select("file", F.col("value").alias("first"))


def accession_list(spark: SparkSession, paths: Paths) -> DataFrame:
    """Stripped, non-blank lines."""
    return parse_accessions(spark.read.text(as_list(paths)))


def parse_accessions(lines: DataFrame) -> DataFrame:
    """``accession_list`` of lines (value)."""
    text = F.regexp_replace("value", r"^\s+|\s+$", "")
    return lines.select(text.alias("accession")).where(F.length("accession") > 0)


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/.]*)[^/]*$", 1)


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def path_dims(df: DataFrame, layout: str, path: str = "file") -> DataFrame:
    """Lift ``sample`` and ``coverage`` out of the path.

    Layouts: ``file`` for ``<sample>[-<coverage>].ext``, ``folder`` for
    ``<sample>[-<coverage>]/…`` and ``quant_folder`` for
    ``quant_results_<sample>[-<coverage>]/…``. Coverage is NULL where there is none.
    """
    where = F.col(path)
    name = {
        "file": lambda: _stem(where),
        "folder": lambda: _folder(where),
        "quant_folder": lambda: F.regexp_replace(_folder(where), "^quant_results_", ""),
    }[layout]()
    parts = F.split(name, "-")
    return df.withColumn("sample", F.get(parts, F.lit(0))).withColumn(
        "coverage", F.get(parts, F.lit(1))
    )


def mate_dims(df: DataFrame, path: str = "file") -> DataFrame:
    """Lift ``sample`` and ``mate`` out of ``<sample>_<1|2>.ext``."""
    stem = _stem(F.col(path))
    return df.withColumn("sample", F.regexp_replace(stem, r"_[12]$", "")).withColumn(
        "mate", F.nullif(F.regexp_extract(stem, r"_([12])$", 1), F.lit("")).try_cast("int")
    )
