"""The Merkle manifest against plain recursion over lists."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lineamix.llm.manifest import Levels, Manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    out = []
    for value in (row[0], row[3], row[2], None if row[4] is None else row[4] + more, row[1]):
        out.append("-" if value is None else f"{len(str(value).encode())}:{value}")
    return h(*out)


def climb(digests, width):
    """Root, and per leaf its (before, after) siblings."""
    ways, places = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        runs = [digests[i:i + width] for i in range(0, len(digests), width)]
        for leaf, at in enumerate(places):
            run, k = runs[at // width], at % width
            ways[leaf].append(("".join(run[:k]), "".join(run[k + 1:])))
        places = [at // width for at in places]
        digests = [h(*run) for run in runs]
    return digests[0], ways


def expected(rows, width, tampered):
    trees = {}
    for row in rows:
        trees.setdefault((row[2] is not None, (row[2] or "").encode()), []).append(row)
    tops, mine = [], []
    for key in sorted(trees):
        ordered = sorted(trees[key], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        subroot, ways = climb([leaf_of(r) for r in ordered], width)
        tops.append(subroot)
        mine.append((ordered, ways))
    root, upper = climb(tops, width)
    out = []
    for subroot, up, (ordered, ways) in zip(tops, upper, mine):
        for row, way in zip(ordered, ways):
            node = leaf_of(row, 1 if row[0] in tampered else 0)
            for before, after in way + up:
                node = h(before, node, after)
            out.append((row[0], leaf_of(row), subroot, root, h(*(x for pair in way + up for x in pair)), node))
    return out


def make(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return frame.withColumns({"tree": F.lit("x"), "rank": F.lit(1), "digest": F.lit(2), "bucket": F.lit(3)}).repartition(3)


ROWS = [(i, "word " * (i % 5), ["en", "de", None, "é", "zz"][0 if i < 60 else i % 5], "s", i) for i in range(100)] + [
    (None, None, None, None, None), (None, None, None, None, None), (7, "other", "en", "s", None), (5, "word ", "en", "t", 1),
    (5, "word ", "en", "t", 1), (101, "x" * 50_000, "lone", "", 3), (102, "", "", "", 0),
]


@pytest.mark.parametrize("width, levels", [(2, 10), (2, 3), (3, 2)])
def test_trees(spark, rows, width, levels):
    docs, tampered = make(spark, ROWS), {5, 7, 60, 101}
    manifest = Manifest(docs, F.col("doc_id").isin(*tampered), width, levels)
    got = rows(manifest.check(), "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded")
    assert got == sorted(expected(ROWS, width, tampered), key=lambda r: tuple((v is None, str(v)) for v in r))
    root = manifest.root.collect()[0].root
    for row in manifest.proofs().collect():
        node = row.leaf
        for before, after in zip(row.before, row.after):
            node = h(before, node, after)
        assert node == root
    bad = {r[0] for r in got if r[5] != r[3]}
    assert bad == {5, 7, 60, 101}


def test_no_documents_and_one(spark):
    docs = make(spark, ROWS)
    assert Manifest(docs.limit(0)).check().count() == 0
    only = Manifest(docs.where("doc_id = 102")).check().collect()
    assert [(r.leaf, r.subroot, r.root, r.folded, r.proof_sha256) for r in only] == [(leaf_of(ROWS[-1]),) * 4 + (h(),)]


def test_siblings_are_interval_differences():
    levels = Levels([h(str(i)) for i in range(5)], lo=16, leaves=21, width=2, levels=2)
    assert [list(map(tuple, zip(a.tolist(), b.tolist()))) for a, b in zip(levels.los, levels.his)] == [
        [(16, 17), (17, 18), (18, 19), (19, 20), (20, 21)], [(16, 18), (18, 20), (20, 21)], [(16, 20), (20, 21)],
    ]
    parent, before, after = levels.steps()[0]
    assert parent.tolist() == [0, 0, 1, 1, 2]
    assert before == ["", h("0"), "", h("2"), ""] and after == [h("1"), "", h("3"), "", ""]
