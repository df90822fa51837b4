"""MinHash near-dedup with HyperMinHash registers.

Equal shingle sets are one class, and classes are compared. Bands of compressed registers put
classes into buckets. Each bucket first compares its members with its smallest and its largest
one, a number of pairs that grows with the bucket; the links found join classes to components.
Buckets that still hold several components are compared in blocks of bounded size, which give out
only pairs that join different components. Pairs are tried only if the similarity estimated from
their registers, corrected for chance collisions, may be high enough, and every pair is confirmed
on the full sets of both texts before it counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lineamix.llm import shingles as sh
from lineamix.llm.common import table, written
from lineamix.llm.components import components

WIDTH = 5
REGISTERS = 192
#: Members of a bucket on one side of a block.
BLOCK = 1024
#: Shingles that a set brings to a block: sets up to this size are compared whole there.
SMALLEST = 1024
SET_KEYS = ["f1", "f2", "n"]

#: ``h`` is a hash of the text: it tells apart texts that share a doc_id.
SIGNATURES = "doc_id bigint, n bigint, f1 bigint, f2 bigint, registers binary, h bigint"
_SIGNATURE_TYPE = pa.schema([
    ("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("registers", pa.binary()), ("h", pa.int64()),
])
_PAIR_TYPE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def signatures(docs: DataFrame, width: int = WIDTH, count: int = REGISTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``SIGNATURES`` of every document: set size, fingerprint of the set, registers."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                sets = sh.shingle_sets(part.column(1), width)
                marks = np.array([sh.fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
                reg = sh.registers(sets, count)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]),
                    pa.array([r.tobytes() for r in reg], pa.binary()), part.column(2),
                ], schema=_SIGNATURE_TYPE)

    return _identified(docs, id_col, text_col).mapInArrow(sign, SIGNATURES)


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h")
    )


def _bands(classes: DataFrame, bands: int, width: int) -> DataFrame:
    """(key, rep): a row for each class and band. The key also tells the band."""
    @F.arrow_udf("array<bigint>")
    def keys(registers: pa.Array) -> pa.Array:
        reg = _matrix(registers)
        at = np.arange(len(reg) + 1, dtype=np.int32) * bands
        return pa.ListArray.from_arrays(pa.array(at), pa.array(sh.band_keys(reg, bands, width).ravel()))

    return classes.select("rep", F.explode(keys("registers")).alias("key"))


def _matrix(registers: pa.Array) -> np.ndarray:
    if not len(registers):
        return np.zeros((0, 1), np.uint8)
    return np.stack([np.frombuffer(r, np.uint8) for r in registers.to_pylist()])


def _likely(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose registers do not rule out the similarity."""
    @F.arrow_udf("boolean")
    def likely(ra: pa.Array, rb: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        a, b, m, n = _matrix(ra), _matrix(rb), na.to_numpy(), nb.to_numpy()
        return pa.array(sh.estimate(a, b, m, n) >= sh.lower_bound(similarity, m, n, a.shape[1]))

    def side(name: str) -> DataFrame:
        return classes.select(F.col("rep").alias(name), F.col("registers").alias(f"r{name}"), F.col("n").alias(f"n{name}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    # Sizes alone bound the similarity by the smaller over the larger.
    both = both.where(F.least("na", "nb") >= F.floor(F.lit(similarity) * F.greatest("na", "nb")))
    return both.where(likely("ra", "rb", "na", "nb")).select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that are links: ``bound * intersection >= least * union`` of the full sets."""
    least, bound = similarity

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sets: dict[int, np.ndarray] = {}
            for ids, column in ((a, 2), (b, 3)):
                new, first = np.unique(ids, return_index=True)
                keep = np.array([i for k, i in zip(new.tolist(), first.tolist()) if k not in sets], np.int64)
                if len(keep):
                    found = sh.shingle_sets(batch.column(column).take(pa.array(keep)), width)
                    sets |= dict(zip(ids[keep].tolist(), found))
            linked = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                linked[i] = bound * common >= least * (len(sets[x]) + len(sets[y]) - common)
            yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(b[linked])], schema=_PAIR_TYPE)

    def side(name: str) -> DataFrame:
        return texts.select(F.col("doc_id").alias(name), F.col("text").alias(f"t{name}"))

    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(confirm, "a bigint, b bigint")


def _whole_sets(texts: DataFrame, width: int) -> DataFrame:
    """(rep, members): the set of each text as sorted 64-bit numbers, or its ``SMALLEST`` smallest ones."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = sh.shingle_sets(batch.column(1), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s[:SMALLEST].astype("<u8").tobytes() for s in sets], pa.binary())], names=["rep", "members"]
            )

    return texts.select("doc_id", "text").mapInArrow(build, "rep bigint, members binary")


def _blocks(members: DataFrame, similarity: tuple[int, int], bands: int, width: int) -> DataFrame:
    """Pairs of members of one bucket that join different components, at most one fewer than members
    in a block where sets are whole.

    ``members`` has (key, hub, last, size, rep, component, n, registers, members). A bucket is cut
    into slices by hash of the member; a block is two slices or one, so a task holds two slices at
    a time. In a block, registers rule out most pairs; then sets of up to ``SMALLEST`` shingles are
    compared whole, and a link inside what the block has joined already adds nothing and is left
    out. Of larger sets the smallest shingles are compared, and all pairs they leave come out.
    A pair that several bands hold is looked at in the first of them only.
    """
    least, bound = similarity
    slices = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), slices).cast("int")
    placed = members.withColumn("slice", own).withColumn("other", F.explode(F.sequence(F.lit(0), slices - 1)))
    placed = placed.select(
        "key", F.least("slice", "other").alias("low"), F.greatest("slice", "other").alias("high"), "slice",
        "hub", "last", "rep", "component", "n", "registers", "members",
    )
    order = ["key", "low", "high"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            marks = _starts(held)
            if len(marks) > 1:
                yield pairs(held.slice(0, marks[-1]), marks[:-1])
                held = held.slice(marks[-1])
        if held is not None and held.num_rows:
            yield pairs(held, _starts(held))

    def pairs(rows: pa.Table, marks: np.ndarray) -> pa.RecordBatch:
        column = {c: rows[c].to_numpy() for c in ("key", "low", "high", "slice", "hub", "last", "rep", "component", "n")}
        reg = _matrix(rows["registers"])
        sets = [np.frombuffer(m, "<u8") for m in rows["members"].to_pylist()]
        keys = sh.band_keys(reg, bands, width)
        tested = (column["rep"] == column["hub"]) | (column["rep"] == column["last"])
        found: list[tuple[int, int]] = []
        for at, end in zip(marks.tolist(), [*marks[1:].tolist(), rows.num_rows]):
            i, j = np.triu_indices(end - at, 1)
            i, j = i + at, j + at
            keep = (column["component"][i] != column["component"][j]) & ~tested[i] & ~tested[j]
            if column["low"][at] != column["high"][at]:
                keep &= column["slice"][i] != column["slice"][j]
            i, j = i[keep], j[keep]
            joined: dict[int, int] = {}
            for k in range(0, len(i), 1 << 14):
                for x, y in _first_meeting(reg, keys, column, i[k:k + (1 << 14)], j[k:k + (1 << 14)]):
                    p, q = _root(joined, column["component"][x]), _root(joined, column["component"][y])
                    if p == q:
                        continue
                    m, n = column["n"][x], column["n"][y]
                    if max(m, n) <= SMALLEST:
                        common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                        if bound * common < least * (m + n - common):
                            continue
                        joined[max(p, q)] = min(p, q)
                    elif not _may_link(sets[x], sets[y], least / bound):
                        continue
                    found.append((min(column["rep"][x], column["rep"][y]), max(column["rep"][x], column["rep"][y])))
        out = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], schema=_PAIR_TYPE)

    def _first_meeting(reg, keys, column, i, j) -> list[tuple[int, int]]:
        likely = sh.estimate(reg[i], reg[j], column["n"][i], column["n"][j]) >= sh.lower_bound(
            least / bound, column["n"][i], column["n"][j], reg.shape[1])
        i, j = i[likely], j[likely]
        if not len(i):
            return []
        first = keys[i, (keys[i] == keys[j]).argmax(1)] == column["key"][i]
        return list(zip(i[first].tolist(), j[first].tolist()))

    dealt = placed.repartition(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(compare, "a bigint, b bigint")


def _root(joined: dict[int, int], node: int) -> int:
    while (up := joined.get(node)) is not None:
        node = up
    return node


def _may_link(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """False if the smallest shingles of the union rule out the similarity (five deviations)."""
    size = min(len(a), len(b), SMALLEST)
    union = np.union1d(a, b)[:size]
    share = len(np.intersect1d(np.intersect1d(union, a, True), b, True)) / max(size, 1)
    return share >= similarity - 5 * np.sqrt(similarity * (1 - similarity) / max(size, 1))


def _starts(rows: pa.Table) -> np.ndarray:
    """Where a new (key, low, high) begins in sorted rows."""
    if not rows.num_rows:
        return np.zeros(0, np.int64)
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for c in ("key", "low", "high"):
        v = rows[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def near_duplicates(
    docs: DataFrame, percent: int = 80, width: int = WIDTH, count: int = REGISTERS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each document.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets, confirmed
    on the whole sets. The component's id is the smallest doc_id that links reach, and that
    document is kept. A text without words is linked with nothing. Rows that repeat id and text are
    one document, rows of one id with other texts are judged by their texts; a row with a NULL id is
    linked with nothing and kept, its component NULL. A link is missed if no band of registers
    agrees (less than once in a million links), or if the estimate from registers or, between sets
    of more than ``SMALLEST`` shingles, from their smallest ones falls five deviations short of the
    similarity: each less than once in a million links, and only until another pair joins the two.
    """
    return _decisions(docs, percent, width, count, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def _decisions(docs: DataFrame, percent: int, width: int, count: int, id_col: str, text_col: str) -> DataFrame:
    """``near_duplicates`` with the hash of each row's text.

    Classes have numbers of their own, given when they are written: texts of one doc_id may be in
    different classes.
    """
    similarity = percent / 100
    bands, band_width = sh.band_plan(count, similarity)
    signed = written(signatures(docs, width, count, id_col, text_col), "signatures")
    usable = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy(*SET_KEYS).agg(F.min(F.struct("doc_id", "h")).alias("least"), F.first("registers").alias("registers"))
    classes = written(classes.select(
        *SET_KEYS, "least.doc_id", "least.h", "registers", F.monotonically_increasing_id().alias("rep")
    ), "classes")
    keyed = written(_bands(classes, bands, band_width), "bands")
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(keyed.join(buckets, "key"), "members")

    spokes = members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).union(
        members.where("rep <> last AND hub <> rep").select("rep", "last")
    )
    first = written(_likely(spokes.distinct(), classes, similarity), "pairs")
    needed = classes.select("rep", "doc_id", "h").join(members.select("rep").distinct(), "rep", "left_semi")
    texts = _identified(docs, id_col, text_col).join(needed, ["doc_id", "h"])
    texts = written(texts.select(F.col("rep").alias("doc_id"), "text").dropDuplicates(["doc_id"]), "texts")
    links = written(_confirmed(first, texts, width, (percent, 100)), "links")

    joined = written(components(links), "components")
    # Up to three members have no other pairs than those with the smallest and the largest one.
    labelled = members.where("size > 3").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = written(labelled.withColumn("component", F.coalesce("component", "rep")), "labelled")
    split = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    open_members = written(labelled.join(split, "key"), "open")
    sets = _whole_sets(texts.join(open_members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), width)
    details = written(classes.select("rep", "n", "registers").join(sets, "rep"), "sets")
    more = written(_blocks(open_members.join(details, "rep"), (percent, 100), bands, band_width).distinct(), "pairs")
    links = links.union(written(_confirmed(more, texts, width, (percent, 100)), "links"))

    final = written(components(links), "components")
    named = classes.select(*SET_KEYS, "rep", "doc_id").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    named = written(named.select(*SET_KEYS, "doc_id", F.coalesce("component", "rep").alias("component")), "named")
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    decided = signed.select("doc_id", "h", *SET_KEYS).join(
        named.join(smallest, "component").select(*SET_KEYS, "component_id"), SET_KEYS, "left"
    )
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return decided.select(
        "doc_id", "h", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: one of each component, the smallest id."""
    dropped = _decisions(docs, percent, WIDTH, REGISTERS, id_col, text_col).where("NOT kept")
    gone = written(dropped.select(F.col("doc_id").alias("__dropped"), F.col("h").alias("__text")).distinct(), "dropped")
    same = (F.col(id_col).cast("bigint") == F.col("__dropped")) & (F.xxhash64(F.col(text_col)) == F.col("__text"))
    return docs.join(gone, same, "left_anti")


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents at a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


NEAR_DEDUP_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
), classes AS (
  SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY ALL
), grams AS (SELECT rep, n, unnest(s) AS g FROM classes),
pairs AS (
  SELECT x.rep AS a, y.rep AS b FROM grams x JOIN grams y ON x.g = y.g AND x.rep < y.rep
  GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), steps AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(node, other) AS (
  SELECT rep, rep FROM classes UNION SELECT r.node, s.b FROM reach r JOIN steps s ON s.a = r.other
), named AS (SELECT node AS rep, min(other) AS component_id FROM reach GROUP BY node)
SELECT doc_id, len(sets.s) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
       coalesce(component_id, doc_id) = doc_id AS kept
FROM sets LEFT JOIN classes ON list_sort(sets.s) = classes.s LEFT JOIN named USING (rep)
"""
