"""The pipeline's stages against plain computations on the smallest tables."""

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import tracemalloc
from lineamix.llm import quality, shingles
from lineamix.llm.common import written
from pyspark.sql import functions as F
from tests.llm.test_near_dedup import brute_components
from tests.llm.test_tokens import P, _expected, check_pieces

import re


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    names, kept = docs.columns, [[(r.doc_id, r.text) for r in docs.collect()]]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.columns == names
        kept.append([(r.doc_id, r.text) for r in docs.collect()])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    gone = {i for i, _ in kept[0]} - {i for i, _ in kept[1]}
    assert sum(labels.get(i) == 1 for i in gone) <= 0.02 * len(labels)
    lowered = {}
    for i, t in kept[1]:
        key = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        lowered[key] = max(i, lowered.get(key, i))
    assert {i for i, _ in kept[2]} == set(lowered.values())
    assert {i for i, _ in kept[3]} == {c for _, c in brute_components(kept[2], 80).values()}
    leaks = {i for i, t in kept[3] if any(x in t for x in items)}
    assert leaks and leaks <= {i for i, _ in kept[3]} - {i for i, _ in kept[4]}
    assert len(kept[3]) - len(kept[4]) <= 1.2 * len(leaks) + 1
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    check_pieces(pieces, _expected(kept[4], corpus_pipeline.TOKENIZER, corpus_pipeline.DOCUMENT_END), 2048)


def test_run_and_empty_tables(spark, sf_dir, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).where(F.col("length") > 2048).count() == 0
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["quality", "near_dedup", "decontamination", "packing"])
def test_stages_hand_texts_to_python_by_size(spark, docs, tmp_path, name):
    """240 texts of 100,000 bytes are 24 MB, too much for one batch."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    session = spark.newSession()
    assert session.conf.get(setting, None) is None
    columns = ["id AS doc_id", "repeat('a word or two ', 7143) AS text", "'en' AS lang", "'s' AS source", "0L AS n_chars"]
    session.range(240, numPartitions=1).selectExpr(*columns).write.parquet(f"{tmp_path}/documents.parquet")
    session.range(9).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality").write.parquet(f"{tmp_path}/labels.parquet")
    session.range(9).selectExpr("id AS item_id", "'what is this ' || id AS text").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = session.read.parquet(f"{tmp_path}/documents.parquet")
    dict(corpus_pipeline.STAGES)[name](session, rows.limit(3), str(tmp_path))
    found = rows.mapInArrow(sizes, "n bigint, size bigint").collect()
    assert sum(r.n for r in found) == 240
    assert max(r["size"] for r in found) < 5 << 20
    session.conf.set(setting, "1m")
    dict(corpus_pipeline.STAGES)[name](session, rows.limit(3), str(tmp_path))
    assert session.conf.get(setting) in ("1m", "1048576b")


@pytest.mark.parametrize("work", [shingles.shingle_sets, quality.text_features])
def test_arrays_of_a_batch_stay_small(work):
    """4 MB of texts: arrays over 2 MB of text at once took 56 MB and more."""
    rng = np.random.default_rng(5)
    texts = pa.array([" ".join(map(str, rng.integers(0, 99999, 400))) for _ in range(1800)])
    work(texts.slice(0, 10))
    tracemalloc.start()
    whole = work(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20
    assert all(np.array_equal(a, work(texts.slice(i, 1))[0]) for i, a in list(enumerate(whole))[::300])
