"""Exact dedup against a persistent digest index, bucketed and sorted by digest.

The index is an external table (digest, keep_id, group_size) in ``n`` buckets. A batch of
documents is reduced to one row per digest, which a sort-merge anti-join holds against the index
without moving the index; what is new is appended to the same buckets. DataFrame functions only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lineamix.llm.common import ascii_lower, new_folder, table, written

LEAST_ID = -(1 << 63)


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text after lower-casing A-Z only; NULL counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, digest), one per document. Other columns, whatever their names, play no part."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), digest(F.col(text_col)).alias("digest"))


class DigestIndex:
    """Digests of all documents seen so far, kept at ``path``.

    A digest has one row from the batch that brought it. With ``counted`` batches, those that meet it
    later add a row each to a second table of the same buckets, so that sizes and largest ids of
    groups over all batches are an aggregate that moves nothing.

    ``buckets`` is fixed when the index is made: choose it so that one bucket of the final index
    fits a task. Opening an existing path again registers the files that are there.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{hashlib.md5(path.encode()).hexdigest()[:16]}"
        self._create(self.name, path)

    def _create(self, name: str, path: str) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest STRING, keep_id BIGINT, group_size BIGINT)"
            f" USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
            f" LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        """The index as a bucketed table: joins on digest do not shuffle it."""
        return self.spark.table(self.name)

    def append(self, seen: DataFrame, counted: bool = False) -> None:
        """Add the digests of ``seen`` (rows of ``digests``) that the index does not have.

        A new digest keeps its largest doc_id (NULL only if all its ids are) and its number of
        rows. A digest that is there already stays as it is. Appending the same batch again adds
        nothing, so a job that was cut off can be repeated. With ``counted``, what the batch has of
        known digests is noted beside them; such a batch is to be given once.

        The groups are written before they meet the index: otherwise Spark would move the anti-join
        below the aggregate and send every row of a text that a third of all documents share to one
        task.
        """
        groups = written(seen.groupBy("digest").agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        ), "groups")
        if counted:
            self._insert(self._met(groups, "left_semi"), self._more())
        self._insert(self._met(groups, "left_anti"), self.name)

    def _met(self, groups: DataFrame, how: str) -> DataFrame:
        return groups.hint("merge").join(self.rows().select("digest"), "digest", how)

    def _insert(self, rows: DataFrame, name: str) -> None:
        rows.repartition(self.buckets, "digest").select("digest", "keep_id", "group_size").write.insertInto(name)
        self.spark.catalog.refreshTable(name)

    def _more(self) -> str:
        """The table of what later batches had of known digests."""
        self._create(f"{self.name}_more", f"{self.path}-more")
        return f"{self.name}_more"

    def totals(self) -> DataFrame:
        """(digest, keep_id, group_size) over all counted batches."""
        both = self._read(self.path).unionAll(self._read(f"{self.path}-more"))
        return both.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(self.rows().schema).parquet(path)

    def decisions(self, seen: DataFrame, groups: DataFrame | None = None) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of ``seen``.

        ``kept`` marks the rows whose doc_id is the group's keep_id; rows that repeat both id and
        text are one document and share the mark. ``groups`` are ``totals``, or the index itself. It
        is read by path here: both sides are then shuffled and Spark can split the digest of a text
        that a third of all rows share.
        """
        return seen.join(self._read(self.path) if groups is None else groups, "digest").select(
            "doc_id", "keep_id", "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )


def build_index(seen: DataFrame) -> DigestIndex:
    """A new index in the shared folder with the digests of ``seen``."""
    spark = seen.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = DigestIndex(spark, new_folder(spark, "digests"), buckets)
    index.append(seen)
    return index


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: one of each group of equal texts.

    The row with the largest id stays; of rows that repeat it, one. With an ``index`` of earlier
    batches, documents whose text it has already are dropped. Texts move once, dealt by digest and
    id together, so the rows of a group that a third of all documents belong to are spread.
    """
    spark, fresh = docs.sparkSession, digests(docs, id_col, text_col)
    if index is not None:
        fresh = fresh.join(index.rows().select("digest"), "digest", "left_anti")
    fresh = written(fresh, "digests")  # before the index grows
    if index is None:
        index = build_index(fresh)
        keepers = spark.read.schema(index.rows().schema).parquet(index.path)
    else:
        index.append(fresh)
        keepers = fresh.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
    keepers = keepers.select(
        F.col("digest").alias("__digest"), F.coalesce("keep_id", F.lit(LEAST_ID)).alias("__key")
    )
    names = docs.columns
    marked = docs.withColumns({
        "__digest": digest(F.col(text_col)),
        "__key": F.coalesce(F.col(id_col).cast("bigint"), F.lit(LEAST_ID)),
    })
    return marked.join(keepers, ["__digest", "__key"]).dropDuplicates(["__digest", "__key"]).select(*names)


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, given to one index in two batches: the second meets what the first left there.

    The batches are the halves of a hash of the id; every document is in one of them. Groups that
    reach over both are put together from both tables of the index.
    """
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    seen = written(digests(table(spark, sf_dir, "documents")).withColumn("half", half), "digests")
    index = DigestIndex(spark, new_folder(spark, "digests"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    for batch in (0, 1):
        index.append(seen.where(F.col("half") == batch).drop("half"), counted=True)
    return index.decisions(seen.drop("half"), written(index.totals(), "totals"))


EXACT_DEDUP_SQL = """
WITH hashed AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, text_sha256
FROM hashed WINDOW same AS (PARTITION BY text_sha256)
"""
