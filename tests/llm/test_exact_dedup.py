import hashlib

from pyspark.sql import functions as F

from lineamix.llm.exact_dedup import DigestIndex, build_index, deduplicate, digests
from lineamix.llm.common import new_folder

ROWS = [(1, "Same Text"), (7, "same text"), (3, "É other"), (4, "é other"), (5, None), (6, ""), (None, "x"), (9, "y"), (9, "y"), (8, "Y")]


def test_decisions(docs, rows):
    seen = digests(docs(ROWS))
    got = rows(build_index(seen).decisions(seen), "doc_id", "keep_id", "group_size", "kept")
    assert got == sorted([
        (1, 7, 2, False), (7, 7, 2, True), (3, 3, 1, True), (4, 4, 1, True), (5, 6, 2, False), (6, 6, 2, True),
        (None, None, 1, True), (9, 9, 3, True), (9, 9, 3, True), (8, 9, 3, False),
    ], key=lambda r: tuple((v is None, str(v)) for v in r))
    sums = {r.doc_id: r.text_sha256 for r in build_index(seen).decisions(seen).collect()}
    assert sums[7] == hashlib.sha256(b"same text").hexdigest()
    assert sums[3] == hashlib.sha256("É other".encode()).hexdigest()


def test_rows_that_stay(docs, rows):
    more = docs(ROWS).withColumn("digest", F.lit(1)).withColumn("keep_id", F.lit(2))
    kept = deduplicate(more)
    assert kept.columns == more.columns
    assert rows(kept, "doc_id") == sorted([(7,), (3,), (4,), (6,), (None,), (9,)], key=lambda r: (r[0] is None, str(r[0])))
    assert deduplicate(docs([])).count() == 0


def test_index_grows_by_what_is_new(spark, docs, rows):
    path = new_folder(spark, "index")
    index = DigestIndex(spark, path, 4)
    assert rows(deduplicate(docs([(1, "a"), (2, "A"), (3, "b")]), index), "doc_id") == [(2,), (3,)]
    again = DigestIndex(spark, path, 4)
    assert rows(deduplicate(docs([(4, "B"), (5, "c")]), again), "doc_id") == [(5,)]
    assert rows(again.rows(), "keep_id", "group_size") == [(2, 2), (3, 1), (5, 1)]
    before = again.rows().count()
    again.append(digests(docs([(4, "B"), (5, "c")])))
    assert again.rows().count() == before
    plan = again.rows().join(digests(docs([(1, "a")])).groupBy("digest").count().hint("merge"), "digest")
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(digest") <= 1


def test_groups_over_batches_and_plan(spark, docs, rows):
    """Counted batches add up; the anti-join meets groups, not rows."""
    index = DigestIndex(spark, new_folder(spark, "index"), 4)
    seen = [digests(docs(x)) for x in ([(1, "a"), (2, "A"), (3, "b")], [(9, "B"), (5, "c"), (0, "a"), (None, "b")], [(7, "c"), (8, None)])]
    for batch in seen:
        index.append(batch, counted=True)
    every = seen[0].unionAll(seen[1]).unionAll(seen[2])
    got = rows(index.decisions(every, index.totals()), "doc_id", "keep_id", "group_size", "kept")
    assert got == rows(build_index(every).decisions(every), "doc_id", "keep_id", "group_size", "kept")
    assert rows(index.totals(), "keep_id", "group_size") == [(2, 3), (7, 2), (8, 1), (9, 3)]
    hot = digests(docs([(i, "same") for i in range(500)]))
    made = []
    original = DigestIndex._met
    DigestIndex._met = lambda self, groups, how: made.append(groups.count()) or original(self, groups, how)
    try:
        index.append(hot)
    finally:
        DigestIndex._met = original
    assert made == [1]
