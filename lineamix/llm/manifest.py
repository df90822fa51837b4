"""Merkle manifest of a dataset: trees whose nodes carry the interval of leaf ranks they cover.

Leaves are ranked inside their tree. Levels come in bands: a band's bucket is the interval of up to
``RUN_LEVELS`` levels above consecutive nodes, so a tree of any height is a few joins. A bucket
finds its ancestors by a containment join with the band above it (equal bucket number, interval
inside interval); inside a bucket, what a parent's interval covers and a node's own does not are
the node's siblings. The roots of all trees are the leaves of one more tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lineamix.llm.common import broadcast_bounded, table, written

#: Children of a node, and levels of a bucket: at most 2 ** 10 nodes enter one bucket.
WIDTH, RUN_LEVELS = 2, 10
TAMPER_EVERY = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_RANKED = pa.schema([
    ("tree", pa.string()), ("doc_id", pa.int64()), ("digest", pa.string()), ("altered", pa.string()),
    ("part", pa.int32()), ("ordinal", pa.int64()),
])
_BUCKET = pa.schema([
    ("tree", pa.string()), ("bucket", pa.int64()), ("leaves", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()),
    ("ids", pa.list_(pa.int64())), ("digests", pa.list_(pa.string())), ("altered", pa.list_(pa.string())),
    ("root", pa.string()),
])
_BUCKET_DDL = (
    "tree string, bucket bigint, leaves bigint, lo bigint, hi bigint, ids array<bigint>,"
    " digests array<string>, altered array<string>, root string"
)
_WAYS_DDL = "tree string, bucket bigint, up_lo bigint, up_hi bigint, before array<string>, after array<string>"
_PROOF_DDL = "tree string, doc_id bigint, leaf string, altered string, before array<string>, after array<string>"
_CHECK_DDL = "tree string, doc_id bigint, leaf string, proof_sha256 string, folded string"


def node_digest(*parts: str) -> str:
    """Lowercase hex SHA-256 of the parts, digests among them as hex text."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(**fields: Column) -> Column:
    """SHA-256 over the fields in order: ``-`` for NULL, else UTF-8 byte count, ``:`` and value."""
    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*(framed(v) for v in fields.values())), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Rows (tree, doc_id, digest, altered), one per document; the tree is its language.

    ``altered`` is the digest with 1 added to n_chars where ``tampered`` holds, NULL elsewhere.
    ``tree`` is ``0`` for NULL and ``1`` before any other language, so it sorts as languages do.
    Columns of ``docs`` other than the five fields play no part, whatever their names.
    """
    fields = {name: F.col(name) for name in FIELDS}
    altered = leaf_digest(**(fields | {"n_chars": F.col("n_chars") + 1}))
    return docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0")).alias("tree"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        leaf_digest(**fields).alias("digest"),
        (F.lit(None).cast("string") if tampered is None else F.when(tampered, altered)).alias("altered"),
    )


def ranked(nodes: DataFrame) -> DataFrame:
    """Add ``rank`` (0, 1, …) and the number of ``leaves`` inside each tree, ordered by doc_id, then by digest.

    Ranges of (tree, doc_id, digest, row number) may cut a tree, an id and even a repeated row
    anywhere, so a tree with all documents is spread like many small ones. Rows count themselves in
    their range while it is written; only the counts of (tree, range) meet.
    """
    spark = nodes.sparkSession
    keys = ["tree", "doc_id", "digest", "__row"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = (
        nodes.withColumn("__row", F.monotonically_increasing_id())
        .repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        .select("tree", "doc_id", "digest", "altered")
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            ordinal = np.empty(len(names), np.int64)
            begin = 0
            while begin < len(names):
                name = names[begin]
                end = begin
                while end < len(names) and names[end] == name:
                    end += 1
                seen = seen if name == tree else 0
                ordinal[begin:end] = np.arange(seen, seen + end - begin)
                tree, seen, begin = name, seen + end - begin, end
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(names), part, np.int32)), pa.array(ordinal)], schema=_RANKED
            )

    numbered = written(sorted_rows.mapInArrow(
        number, "tree string, doc_id bigint, digest string, altered string, part int, ordinal bigint"
    ), "ranked")
    counts = numbered.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(counts.select(
        "tree", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
        F.sum("n").over(Window.partitionBy("tree")).alias("leaves"),
    ), "bases")
    return numbered.join(broadcast_bounded(bases), ["tree", "part"]).select(
        "tree", "doc_id", "digest", "altered", (F.col("base") + F.col("ordinal")).alias("rank"), "leaves"
    )


class Levels:
    """The nodes above consecutive nodes of one tree: per level the leaf intervals and digests.

    The lowest nodes cover ``unit`` leaves each, from leaf rank ``lo`` on; the tree has ``leaves``.
    """

    def __init__(self, digests: list[str], lo: int, leaves: int, unit: int = 1, levels: int = RUN_LEVELS, width: int = WIDTH):
        los = lo + unit * np.arange(len(digests))
        self.los, self.his, self.digests = [los], [np.minimum(los + unit, leaves)], [digests]
        self.unit, nodes = unit, -(-leaves // unit)
        while len(self.los) <= levels and nodes > 1:
            below, nodes = self.digests[-1], -(-nodes // width)
            first = np.arange(0, len(below), width)
            self.los.append(self.los[-1][first])
            self.his.append(self.his[-1][np.minimum(first + width, len(below)) - 1])
            self.digests.append([node_digest(*below[i:i + width]) for i in first])

    @property
    def root(self) -> str:
        return self.digests[-1][0]

    def steps(self) -> list[tuple[np.ndarray, list[str], list[str]]]:
        """Per level: the parent of each node, and the siblings before and after it.

        The parent is the node above whose interval contains the node's; its siblings are the nodes
        inside the two differences of both intervals.
        """
        out = []
        for k in range(len(self.los) - 1):
            los, his, digests = self.los[k], self.his[k], self.digests[k]
            parent = np.searchsorted(self.los[k + 1], los, "right") - 1
            left = np.searchsorted(los, self.los[k + 1][parent])
            right, own_end = np.searchsorted(los, self.his[k + 1][parent]), np.searchsorted(los, his)
            before = ["".join(digests[a:i]) for i, a in enumerate(left)]
            after = ["".join(digests[e:b]) for e, b in zip(own_end, right)]
            out.append((parent, before, after))
        return out

    def ways(self, before: list[str], after: list[str]) -> Iterator[tuple[list[str], list[str]]]:
        """Per lowest node its siblings from there to the top, and on along the way given."""
        steps = self.steps()
        for at in range(len(self.los[0])):
            left, right = [], []
            for parent, b, a in steps:
                left.append(b[at])
                right.append(a[at])
                at = parent[at]
            yield left + before, right + after


class Forest:
    """Trees over ranked leaves, each as buckets of one or more bands, written to the shared folder.

    ``bands[0]`` holds the leaves; a bucket's root is a node of the next band. ``roots`` has
    (tree, digest), a row per tree. No rows make no trees.
    """

    def __init__(self, nodes: DataFrame, width: int = WIDTH, levels: int = RUN_LEVELS):
        if width < 2 or levels < 1:
            raise ValueError("a node has two children or more, a bucket one level or more")
        self.width, self.levels, self.size = width, levels, width ** levels
        self.bands, unit, ends = [], 1, []
        while True:
            band = written(self._climb(nodes, unit), "band")
            self.bands.append(band)
            unit *= self.size
            ends.append(band.where(F.col("leaves") <= unit).select("tree", F.col("root").alias("digest")))
            nodes = band.where(F.col("leaves") > unit).select(
                "tree", F.col("lo").alias("rank"), "leaves", F.lit(None).cast("bigint").alias("doc_id"),
                F.col("root").alias("digest"), F.lit(None).cast("string").alias("altered"),
            )
            if nodes.isEmpty():
                break
        self.roots = reduce(DataFrame.unionAll, ends)

    def _climb(self, nodes: DataFrame, unit: int) -> DataFrame:
        """Buckets of nodes (tree, rank of the first leaf, leaves of the tree, doc_id, digest, altered)."""
        width, levels = self.width, self.levels

        def climb(key: tuple, group: pa.Table) -> pa.Table:
            group = group.sort_by("rank")
            lo, leaves = group.column("rank")[0].as_py(), group.column("leaves")[0].as_py()
            digests = group.column("digest").to_pylist()
            found = Levels(digests, lo, leaves, unit, levels, width)
            return pa.Table.from_pydict({
                "tree": [key[0].as_py()], "bucket": [key[1].as_py()], "leaves": [leaves], "lo": [lo],
                "hi": [int(found.his[-1][0])], "ids": [group.column("doc_id").to_pylist()], "digests": [digests],
                "altered": [group.column("altered").to_pylist()], "root": [found.root],
            }, schema=_BUCKET)

        keyed = nodes.withColumn("bucket", F.expr(f"rank div {unit * self.size}"))
        return keyed.groupBy("tree", "bucket").applyInArrow(climb, _BUCKET_DDL)

    def proofs(self, above: DataFrame | None = None) -> DataFrame:
        """(tree, doc_id, leaf, altered, before, after), a row per leaf.

        ``before[i]`` and ``after[i]`` are the siblings on either side at level i, from the leaf up.
        ``above`` (tree, before, after) continues the way of each tree's root, as in a tree of trees.
        """
        return self._down(above, _PROOF_DDL, _open)

    def check(self, above: DataFrame | None = None) -> DataFrame:
        """(tree, doc_id, leaf, proof_sha256, folded): digests of the proofs instead of the proofs.

        ``folded`` is the root recomputed from the altered leaf, or the leaf where it is NULL.
        """
        return self._down(above, _CHECK_DDL, _fold)

    def _down(self, above: DataFrame | None, ddl: str, finish: Callable) -> DataFrame:
        nothing = F.array().cast("array<string>")
        ways = None
        for number in reversed(range(len(self.bands))):
            unit, reach = self.size ** number, self.size ** (number + 1)
            band = self.bands[number].drop("root")
            mine = band.where(F.col("leaves") <= reach)
            if above is None:
                mine = mine.withColumns({"before": nothing, "after": nothing})
            else:
                mine = mine.join(above.select("tree", "before", "after"), "tree")
            if ways is not None:
                # Ancestors: the node of the band above in the same bucket whose interval contains this one's.
                below = band.where(F.col("leaves") > reach).join(ways, ["tree", "bucket"])
                mine = mine.unionByName(below.where("up_lo <= lo AND hi <= up_hi").drop("up_lo", "up_hi"))
            run = _rowwise(finish if number == 0 else _way, unit, self.levels, self.width)
            mine = mine.groupBy("tree", "bucket").applyInArrow(run, ddl if number == 0 else _WAYS_DDL)
            if number == 0:
                return mine
            ways = written(mine, "ways")


def _rowwise(finish: Callable, unit: int, levels: int, width: int) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        row = group.slice(0, 1).to_pylist()[0]
        found = Levels(row["digests"], row["lo"], row["leaves"], unit, levels, width)
        return finish(row, found, list(found.ways(row["before"], row["after"])))
    return run


def _texts(values: list[str | None]) -> pa.Array:
    return pa.array(values, pa.string())


def _lists(ways: list[tuple[list[str], list[str]]], side: int) -> pa.Array:
    return pa.array([w[side] for w in ways], pa.list_(pa.string()))


def _way(row: dict, found: Levels, ways: list) -> pa.Table:
    return pa.Table.from_pydict({
        "tree": _texts([row["tree"]] * len(ways)), "bucket": pa.array(found.los[0] // found.unit, pa.int64()),
        "up_lo": pa.array(found.los[0], pa.int64()), "up_hi": pa.array(found.his[0], pa.int64()),
        "before": _lists(ways, 0), "after": _lists(ways, 1),
    })


def _open(row: dict, found: Levels, ways: list) -> pa.Table:
    return pa.Table.from_pydict({
        "tree": _texts([row["tree"]] * len(ways)), "doc_id": pa.array(row["ids"], pa.int64()),
        "leaf": _texts(row["digests"]), "altered": _texts(row["altered"]),
        "before": _lists(ways, 0), "after": _lists(ways, 1),
    })


def _fold(row: dict, found: Levels, ways: list) -> pa.Table:
    proofs, roots = [], []
    for leaf, altered, (before, after) in zip(row["digests"], row["altered"], ways):
        node = altered or leaf
        for left, right in zip(before, after):
            node = node_digest(left, node, right)
        roots.append(node)
        proofs.append(node_digest(*chain.from_iterable(zip(before, after))))
    return pa.Table.from_pydict({
        "tree": _texts([row["tree"]] * len(ways)), "doc_id": pa.array(row["ids"], pa.int64()),
        "leaf": _texts(row["digests"]), "proof_sha256": _texts(proofs), "folded": _texts(roots),
    })


class Manifest:
    """A forest with one tree per language and the tree over the forest's roots.

    Documents without a language make a tree of their own, which comes first. Rows that repeat
    everything are leaves of their own; rows of one doc_id follow each other by digest, NULL ids
    come first. An empty table has no root, and no rows in any result.
    """

    def __init__(self, docs: DataFrame, tampered: Column | None = None, width: int = WIDTH, levels: int = RUN_LEVELS):
        self.forest = Forest(ranked(leaves(docs, tampered)), width, levels)
        # Trees are ranked by name; afterwards the name rides along in place of an altered digest.
        named = self.forest.roots.select(
            F.lit("").alias("tree"), F.lit(None).cast("bigint").alias("doc_id"),
            F.col("tree").alias("digest"), F.col("digest").alias("altered"),
        )
        self.top = Forest(ranked(named).select(
            "tree", "rank", "leaves", "doc_id", F.col("altered").alias("digest"), F.col("digest").alias("altered")
        ), width, levels)
        self.root = self.top.roots.select(F.col("digest").alias("root"))
        #: (tree, subroot, root, before, after): from the root of each language to the root.
        ways = self.top.proofs().join(self.top.roots.withColumnRenamed("digest", "root"), "tree")
        self.ways = written(ways.select(
            F.col("altered").alias("tree"), F.col("leaf").alias("subroot"), "root", "before", "after"
        ), "subroots")

    def proofs(self) -> DataFrame:
        """(tree, doc_id, leaf, altered, before, after): whole proofs, from each leaf to the root."""
        return self.forest.proofs(self.ways)

    def check(self) -> DataFrame:
        """(tree, doc_id, leaf, proof_sha256, folded, subroot, root), a row per document."""
        return self.forest.check(self.ways).join(broadcast_bounded(self.ways.drop("before", "after")), "tree")


def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its proof in the manifest, checked after tampering with some of them."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPER_EVERY == 0
    return Manifest(table(spark, sf_dir, "documents"), tampered).check().select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


DATASET_MANIFEST_SQL = """
WITH RECURSIVE framed AS (
  SELECT doc_id, lang, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') AS n,
         coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') AS n_tampered,
         coalesce(strlen(text) || ':' || text, '-') AS tail, coalesce(xor(4294967295, list_reduce(
           list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
           lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)),
             lambda s, k: xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 7 = 0, false) AS tampered
  FROM documents
), leaves AS (
  SELECT doc_id, lang, sha256(head || n || tail) AS leaf,
         CASE WHEN tampered THEN sha256(head || n_tampered || tail) END AS altered
  FROM framed
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM leaves
), levels AS (
  SELECT coalesce('1' || lang, '0') AS tree, 0 AS level, rank AS pos, leaf AS digest FROM ranked
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(digest || coalesce(other, ''))
  FROM (SELECT *, lead(digest) OVER (PARTITION BY tree ORDER BY pos) AS other,
               count(*) OVER (PARTITION BY tree) AS nodes FROM levels)
  WHERE pos % 2 = 0 AND nodes > 1
), heights AS (
  SELECT tree, max(level) AS height FROM levels GROUP BY tree
), subroots AS (
  SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS rank
  FROM levels JOIN heights USING (tree) WHERE level = height
), tops AS (
  SELECT 0 AS level, rank AS pos, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(digest || coalesce(other, ''))
  FROM (SELECT *, lead(digest) OVER (ORDER BY pos) AS other, count(*) OVER () AS nodes FROM tops)
  WHERE pos % 2 = 0 AND nodes > 1
), every AS (
  SELECT tree, level, pos, digest FROM levels
  UNION ALL
  SELECT '', level, pos, digest FROM tops
), folding AS (
  SELECT r.doc_id, r.rank AS row_rank, coalesce('1' || r.lang, '0') AS home, r.leaf, 0 AS step, '' AS proof,
         coalesce(r.altered, r.leaf) AS node
  FROM ranked r
  UNION ALL
  SELECT f.doc_id, f.row_rank, f.home, f.leaf, f.step + 1, f.proof || coalesce(e.digest, ''),
         CASE WHEN e.digest IS NULL THEN sha256(f.node)
              WHEN e.pos < f.at THEN sha256(e.digest || f.node) ELSE sha256(f.node || e.digest) END
  FROM (
    SELECT g.*, h.height, CASE WHEN g.step < h.height THEN g.home ELSE '' END AS tree,
           CASE WHEN g.step < h.height THEN g.step ELSE g.step - h.height END AS level,
           CASE WHEN g.step < h.height THEN g.row_rank >> g.step ELSE s.rank >> (g.step - h.height) END AS at
    FROM folding g JOIN heights h ON h.tree = g.home JOIN subroots s ON s.tree = g.home
    WHERE g.step < h.height + (SELECT max(level) FROM tops)
  ) f LEFT JOIN every e ON e.tree = f.tree AND e.level = f.level AND e.pos = xor(f.at, 1)
)
SELECT f.doc_id, f.leaf, s.subroot, t.digest AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root,
       f.node = t.digest AS verified
FROM folding f JOIN heights h ON h.tree = f.home JOIN subroots s ON s.tree = f.home
JOIN tops t ON t.level = (SELECT max(level) FROM tops)
WHERE f.step = h.height + (SELECT max(level) FROM tops)
"""
