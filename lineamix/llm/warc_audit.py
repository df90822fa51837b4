"""WARC archives and a Merkle audit of their replicas.

Records are hashed, and ranges of keys (length and hash of each record) are hashed into a tree per
segment. Two replicas agree on a segment if its roots do; where they differ, only the children of
differing nodes are compared, down to the records that are damaged. The second replica is cut at
the keys where the first one is, so that a lost or repeated record changes its own range only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lineamix.llm.common import table, written

RECORD_VERSION = "WARC/1.1\r\n"
RECORD_END = "\r\n\r\n"
#: Records of a segment, and children of a tree node.
SEGMENT, FANOUT = 1024, 16
#: Levels above the records: ranges of 16 and of 256 records, and the root.
LEVELS = 3
ROW_BITS = 33


def warc_record(url: Column, payload: Column) -> Column:
    """A WARC resource record without the line ends after it; NULL url or payload are empty."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit(f"{RECORD_VERSION}WARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(RECORD_END), body,
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Write the column ``record`` as archive files, one record after the other."""
    records.select("record").write.option("lineSep", RECORD_END).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(url, payload, whole) of archive files, split at records so that large files are read in parts.

    ``whole`` is false where the payload has another length than the record says, which is also the
    case if a payload contains what separates records.
    """
    pieces = spark.read.option("lineSep", RECORD_END + RECORD_VERSION).text(path)
    at = F.instr("value", RECORD_END)
    head, body = F.substring("value", F.lit(1), at - F.lit(1)), F.col("value").substr(at + F.lit(4), F.length("value"))
    said = F.regexp_extract(head, r"(?i)content-length: *(\d+)", 1).cast("bigint")
    # The last record of a file still has the line ends after it.
    last = body.endswith(RECORD_END) & (F.octet_length(body) == said + 4)
    body = F.when(last, F.substring(body, F.lit(1), F.length(body) - F.lit(4))).otherwise(body)
    return pieces.where("value <> ''").select(
        F.regexp_extract(head, r"(?i)warc-target-uri: *([^\r\n]*)", 1).alias("url"), body.alias("payload"),
        (F.octet_length(body) == said).alias("whole"),
    )


def manifest(records: DataFrame, segment: int = SEGMENT, fanout: int = FANOUT, cuts: DataFrame | None = None) -> DataFrame:
    """(segment, ordinal, leaf, offset, length, digest, key, copy) of rows (key, record) in order of key.

    Records are dealt into segments of equal number in ascending key order (NULL first; rows of one
    key by digest, ``copy`` numbers equal ones), and ``fanout`` of them each into leaves. With
    ``cuts`` (segment, leaf, key, digest, copy), the first records of another manifest's leaves,
    they go to its segments and leaves by key range instead, however many there are. ``offset``
    counts the bytes before a record in its segment, with the line ends after each. Payloads are
    hashed where they are read and never shuffled. A key that very many rows share is spread over
    ranges by its digests and copies.
    """
    spark = records.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = records.select(
        "key", F.sha2("record", 256).alias("digest"), (F.octet_length("record") + len(RECORD_END)).cast("bigint").alias("length")
    ).groupBy("key", "digest", "length").count()
    hashed = counted.select("key", "digest", "length", F.explode(F.sequence(F.lit(1).cast("bigint"), "count")).alias("copy"))
    leaves = -(-segment // fanout)
    hashed = hashed.withColumn("cut", F.lit(None).cast("bigint"))
    if cuts is not None:
        cut = (F.col("segment") * leaves + F.col("leaf")).alias("cut")
        hashed = hashed.unionByName(cuts.select("key", "digest", F.lit(None).cast("bigint").alias("length"), "copy", cut))
    order = ["key", "digest", "copy", F.col("length").asc_nulls_first()]  # a cut stands before its record
    placed = hashed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = written(placed, "manifest").withColumns({
        "range": F.shiftright("place", ROW_BITS), "at": F.col("place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    })
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = placed.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), F.max("cut").alias("last")).select(
        "range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.coalesce(F.max("last").over(before), F.lit(0)).alias("last")
    )
    rank = F.col("before") + F.col("at")
    if cuts is None:
        ranked = placed.join(starts, "range").select(
            F.floor(rank / segment).alias("segment"), F.floor(F.pmod(rank, F.lit(segment)) / fanout).alias("leaf"), rank.alias("rank"),
            "length", "digest", "key", "copy"
        )
    else:
        so_far = Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        inside = placed.withColumn("cut", F.max("cut").over(so_far)).where("length IS NOT NULL")
        leaf = F.coalesce("cut", "last")
        ranked = inside.join(starts, "range").select(
            F.floor(leaf / leaves).alias("segment"), F.pmod(leaf, F.lit(leaves)).alias("leaf"), rank.alias("rank"),
            "length", "digest", "key", "copy"
        )
    ordered = Window.partitionBy("segment").orderBy("rank")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    return ranked.select(
        "segment", (F.row_number().over(ordered) - 1).cast("bigint").alias("ordinal"), "leaf",
        F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"), "length", "digest", "key", "copy"
    )


def leaf_nodes(records: DataFrame) -> DataFrame:
    """(segment, node, length, digest) of the leaves of a manifest: what records they hold.

    A leaf's digest adds up hashes of its records, in four parts, so that it takes no memory
    however many records a damaged replica has in the leaf.
    """
    text = F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("")), F.col("key").isNull().cast("string"), "copy", "length", "digest")
    hashed = records.withColumn("hash", F.sha2(text, 256))
    lanes = [F.sum(F.conv(F.substring("hash", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    return hashed.groupBy("segment", F.col("leaf").alias("node")).agg(F.sum("length").alias("length"), F.sha2(F.concat_ws(":", *lanes), 256).alias("digest"))


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(segment, node, length, digest) of the nodes above ``nodes``.

    A node covers up to ``fanout`` nodes: their bytes, and a hash over their places, lengths and
    digests in order.
    """
    below = F.sort_array(F.collect_list(F.struct("node", "length", "digest")))  # at most fanout of them
    lines = F.transform(below, lambda p: F.concat_ws(":", p["node"].cast("string"), p["length"].cast("string"), p["digest"]))
    return nodes.groupBy("segment", F.floor(F.col("node") / fanout).alias("node")).agg(
        F.sum("length").alias("length"), F.sha2(F.array_join(lines, "\n"), 256).alias("digest")
    )


def tree(
    records: DataFrame, segment: int = SEGMENT, fanout: int = FANOUT, levels: int = LEVELS, like: list[DataFrame] | None = None
) -> list[DataFrame]:
    """Levels of the trees over all segments of rows (key, record), the records first.

    Each level is written to the shared folder: it is the replica's index. The last level has one
    node per segment, so ``fanout ** levels`` must be ``segment`` or more. A replica that is held
    against the tree ``like`` takes that tree's key ranges, so that records it has lost or has
    more of leave all other nodes as they are.
    """
    if fanout**levels < segment:
        raise ValueError("too few levels for a root over each segment")
    cuts = None if like is None else like[0].where(F.col("node") % fanout == 0)
    out = [written(manifest(records, segment, fanout, cuts).withColumnRenamed("ordinal", "node"), "records")]
    out.append(written(leaf_nodes(out[0]), "nodes"))
    for _ in range(levels - 1):
        out.append(written(parents(out[-1], fanout), "nodes"))
    return out


def _differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(segment, node) of nodes that one side lacks or that differ."""
    theirs = theirs.select(F.col("segment").alias("s"), F.col("node").alias("n"), F.col("length").alias("l"), F.col("digest").alias("d"))
    both = ours.join(theirs, (F.col("segment") == F.col("s")) & (F.col("node") == F.col("n")), "full")
    same = F.col("digest").eqNullSafe(F.col("d")) & F.col("length").eqNullSafe(F.col("l"))
    return both.where(~same).select(F.coalesce("segment", "s").alias("segment"), F.coalesce("node", "n").alias("node"))


def audit(ours: list[DataFrame], theirs: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(segment, ordinal, offset, length, key, status): the records in which two replicas differ.

    ``ours`` and ``theirs`` are the levels of two trees. Status is ``changed``, ``missing`` in
    theirs, or ``extra`` in theirs; extra records stand where they are in theirs. From the roots
    on, a level is read only below nodes that differ. Records of differing leaves meet by key, not
    by place: equal ones cancel, then those left of one key are pairs, and what has no partner is
    missing or extra. So results are right for any two trees; a tree made ``like`` ours keeps what
    is read small. Empty replicas have no segments; equal ones give no rows.
    """
    found = _differing(ours[-1], theirs[-1])

    def below(level: DataFrame, of: Column) -> DataFrame:
        suspects = found.select(F.col("segment").alias("ps"), F.col("node").alias("pn"))
        return level.join(suspects, (F.col("segment") == F.col("ps")) & (of == F.col("pn")), "left_semi")

    for a, b in zip(ours[-2:0:-1], theirs[-2:0:-1]):
        up = F.floor(F.col("node") / fanout)
        found = _differing(below(a, up), below(b, up))
    place = F.struct("segment", F.col("node").alias("ordinal"), "offset", "length")
    sides = [below(level[0], F.col("leaf")).select("key", "digest", "copy", F.lit(k).alias("side"), place.alias("place")) for k, level in enumerate((ours, theirs))]
    one = sides[0].unionByName(sides[1]).groupBy("key", "digest", "copy").agg(
        F.count(F.lit(1)).alias("sides"), F.first("side").alias("side"), F.first("place").alias("place")
    ).where("sides = 1")
    nth = F.row_number().over(Window.partitionBy("side", "key").orderBy("digest", "copy"))
    left = one.withColumn("nth", nth).groupBy("key", "nth").agg(
        F.max(F.when(F.col("side") == 0, F.col("place"))).alias("mine"), F.max(F.when(F.col("side") == 1, F.col("place"))).alias("other")
    )
    status = F.when(F.col("other").isNull(), "missing").when(F.col("mine").isNull(), "extra").otherwise("changed")
    return left.select(F.coalesce("mine", "other").alias("at"), "key", status.alias("status")).select("at.*", "key", "status")


def replica(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").alias("key"), warc_record(F.col("url"), F.col("html")).alias("record"))


def damaged(records: DataFrame) -> DataFrame:
    """The same replica after bit rot: of some keys one byte is another, of others all are zero."""
    text = F.col("record")
    flipped = F.concat(F.expr("left(record, length(record) - 1)"), F.when(text.endswith("!"), "?").otherwise("!"))
    cases = [(F.col("key") % 97 == 13, flipped), (F.col("key") % 389 == 7, F.repeat(F.lit("\0"), F.octet_length("record")))]
    return records.withColumn("record", reduce(lambda rest, c: F.when(c[0], c[1]).otherwise(rest), cases, text))


def warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit a damaged replica of the archive of all pages against the sound one."""
    records = replica(table(spark, sf_dir, "pages"))
    sound = tree(records)
    return audit(sound, tree(damaged(records), like=sound)).withColumnRenamed("key", "page_id")


WARC_AUDIT_SQL = f"""
WITH records AS (
  SELECT page_id, html, row_number() OVER (ORDER BY page_id) - 1 AS rank,
    strlen('WARC/1.1' || 'WARC-Type: resource' || 'WARC-Target-URI: ' || coalesce(url, '') || 'Content-Type: text/html' || 'Content-Length: '
      || CAST(strlen(coalesce(html, '')) AS VARCHAR) || coalesce(html, '')) + 16 AS length
  FROM pages
), placed AS (
  SELECT page_id, html, rank // {SEGMENT} AS segment, rank % {SEGMENT} AS ordinal, length,
    CAST(coalesce(sum(length) OVER (PARTITION BY rank // {SEGMENT} ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM records
)
SELECT segment, ordinal, "offset", length, page_id, 'changed' AS status FROM placed
WHERE page_id % 97 = 13 OR page_id % 389 = 7
"""
