"""Token-id files: Parquet list columns in document order, for selective reads of ids and metadata.

Ids are dictionary-encoded lists; document ids, positions and lengths are delta-encoded. Row
groups and pages are small enough that column and page indexes let a reader skip what it does not
ask for. Each file is one range of documents, so positions inside a file are known while it is
written, and a file's place among all ids follows from the lengths alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lineamix.llm.common import broadcast_bounded, new_folder, table, written
from lineamix.llm.tokens import definition_of, encoder, slices

DOCUMENTS_END = 0
FILE_SCHEMA = "file_no int, doc_id bigint, first bigint, n_tokens bigint, ids array<int>"
_FILE_TYPE = pa.schema([
    ("file_no", pa.int32()), ("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()),
    ("ids", pa.list_(pa.int32())),
])
#: Delta encoding belongs to version 2 pages and is what integers get there without a dictionary.
LAYOUT = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "512",
    "parquet.enable.dictionary": "true",
    **{f"parquet.enable.dictionary#{c}": "false" for c in ("file_no", "doc_id", "first", "n_tokens")},
}


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) cut into ranges of ascending id (NULL first), sorted inside each range.

    Rows of one id follow each other by text hash, and by the order of reading where they reach over
    ranges; a repeated row is a row of its own. Ranges are chosen without reading texts.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    ranged = keyed.repartitionByRange(ranges, "doc_id", "row").withColumn("h", F.xxhash64("text"))
    return ranged.sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")


def encode_in_order(docs: DataFrame, definition: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``FILE_SCHEMA``: all documents, each with its ids and ``end_id`` after them.

    NULL and empty texts have the end id only. ``first`` counts the ids before the document in its
    range ``file_no``. Texts of any length are encoded whole, some megabytes at a time.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, first, words = TaskContext.get().partitionId(), 0, encoder(definition)
        for batch in batches:
            for part in slices(batch, 1):
                ids, at, _ = words.encode(part.column(1))
                rows = np.arange(len(at) - 1)
                ends = at[1:] + rows
                full = np.full(len(ids) + len(rows), end_id, np.int32)
                keep = np.ones(len(full), bool)
                keep[ends] = False
                full[keep] = ids
                offsets = np.concatenate([[0], ends + 1])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(rows), number, np.int32)),
                    part.column(0),
                    pa.array(first + offsets[:-1]),
                    pa.array(np.diff(offsets)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(full)),
                ], schema=_FILE_TYPE)
                first += len(full)

    return in_order(docs, id_col, text_col).mapInArrow(encode, FILE_SCHEMA)


def write_token_files(docs: DataFrame, path: str, definition: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode and write all documents; files in order of name hold documents in order of id."""
    encode_in_order(docs, definition, end_id, id_col, text_col).write.options(**LAYOUT).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(file_no, doc_id, start, n_tokens) without reading ids; ``start`` counts all ids before."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path).select("file_no", "doc_id", "first", "n_tokens")
    return _with_start(rows, path).select("file_no", "doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents; filters on doc_id skip pages."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    return _with_start(rows, path).select("doc_id", "start", "n_tokens", "ids")


def _with_start(rows: DataFrame, path: str) -> DataFrame:
    """Add the ids of earlier files; one row per file passes through one task.

    That table is counted and broadcast up to 100,000 files, so ids are not shuffled to be read.
    """
    files = rows.sparkSession.read.schema(FILE_SCHEMA).parquet(path).groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    starts = broadcast_bounded(written(starts, "file-starts"))
    return rows.join(starts, "file_no").withColumn("start", F.col("before") + F.col("first"))


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows with ids."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            at = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            sums = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    wanted = tokens.select("doc_id", "start", "n_tokens", "ids")
    return wanted.mapInArrow(check, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written and read back from their files, as checksums."""
    import public_tokenizers

    path = new_folder(spark, "tokens")
    definition = definition_of(public_tokenizers.path("byte_bpe_50k.json"))
    write_token_files(table(spark, sf_dir, "documents"), path, definition, DOCUMENTS_END)
    return checksums(read_tokens(spark, path))
