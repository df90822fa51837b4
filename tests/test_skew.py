"""One key with a third of all rows: joins must split it, results must not change."""

import contextlib

import pytest

from pyspark.sql import functions as F

from lineamix.operators import fractions, intervals, ordering, sampling, scoring

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40000",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "6",
}


@contextlib.contextmanager
def small_pieces(spark):
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def assert_spread(out):
    """Rows lie in ranges of like size, and each row was moved once."""
    sizes = [r["count"] for r in out.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
    assert len(sizes) > 3 and max(sizes) < 2 * sum(sizes) / len(sizes)
    assert "rangepartitioning" in final_plan(out) and "ReusedExchange" in final_plan(out)


def hot_rows(spark, n=30_000):
    """A third of all rows has the key ``hot``."""
    return spark.range(0, n, 1, 8).selectExpr(
        "if(id % 3 = 0, 'hot', concat('k', id % 500)) as sample", "cast(id as string) as target_id",
        "cast(1 + id % 7 as double) as tpm", "id",
    )


def test_shares_split_the_hot_sample(spark):
    with small_pieces(spark):
        out = fractions.shares(hot_rows(spark), ["sample"], "tpm")
        got = out.collect()
        assert "skew=true" in final_plan(out)
    sums = {}
    for r in got:
        sums[r["sample"]] = sums.get(r["sample"], 0.0) + r.fraction
    assert len(got) == 30_000 and all(v == pytest.approx(1.0) for v in sums.values())


def test_overlap_splits_the_hot_bin(spark):
    with small_pieces(spark):
        reads = hot_rows(spark).selectExpr(
            "target_id as qname", "'c' as chrom", "if(id % 3 = 0, 1000, id * 10) as start",
            "if(id % 3 = 0, 1000, id * 10) + 50 as end",
        )
        regions = spark.createDataFrame([("c", 1020, 1030), ("c", 90_000, 90_500)], "chrom string, start bigint, end bigint")
        out = intervals.outside_regions(reads, regions)
        got = {r.qname for r in out.collect()}
        assert_spread(out)
    expected = set()
    for i in range(30_000):
        start = 1000 if i % 3 == 0 else i * 10
        if not any(start < e and start + 50 > s for s, e in ((1020, 1030), (90_000, 90_500))):
            expected.add(str(i))
    assert got == expected


def test_truth_pairs_split_and_keep_all_rows(spark):
    with small_pieces(spark):
        predicted = hot_rows(spark).selectExpr("sample", "if(id % 3 = 0, 'L', target_id) as lineage", "tpm as fraction")
        truth = spark.createDataFrame([("hot", "L", 0.5)], "sample string, lineage string, fraction double")
        pairs = scoring.truth_pairs(predicted, truth, ["sample"])
        folded = {r["sample"]: r.predicted for r in scoring.fold_unmatched(pairs, ["sample"]).collect()}
    assert folded["hot"] == sum(1 + i % 7 for i in range(0, 30_000, 3))
    assert sum(folded.values()) == sum(1 + i % 7 for i in range(30_000))


def test_clip_splits_the_hot_position(spark):
    with small_pieces(spark):
        reads = hot_rows(spark).selectExpr(
            "target_id as qname", "0 as flag", "'c' as chrom", "if(id % 3 = 0, 1000, id * 10) as start",
            "if(id % 3 = 0, 1000, id * 10) + 50 as end",
        )
        primers = spark.createDataFrame([("c", 990, 1010)], "chrom string, start bigint, end bigint")
        out = intervals.clip_lengths(reads, primers)
        got = out.collect()
        assert_spread(out)
    assert len(got) == 30_000
    assert {r.qname for r in got if r.clip == 10} == {str(i) for i in range(30_000) if i % 3 == 0 or i == 100}


def test_quota_of_the_hot_stratum(spark):
    with small_pieces(spark):
        reads = hot_rows(spark).selectExpr("sample", "target_id as read_id", "1 as mate")
        quotas = spark.createDataFrame([("hot", 4321), ("k1", 5)], "sample string, num_reads int")
        got = sampling.sample_n_reads(reads, quotas, ["sample"]).groupBy("sample").count().collect()
    assert {r["sample"]: r["count"] for r in got} == {"hot": 4321, "k1": 5}


def test_top_with_other_of_the_hot_sample(spark):
    with small_pieces(spark):
        got = fractions.top_with_other(hot_rows(spark), ["sample"]).where("sample = 'hot'").collect()
    total = sum(1 + i % 7 for i in range(0, 30_000, 3))
    assert len(got) == 6
    assert {r.prediction: r.fraction for r in got}["other"] == pytest.approx((total - 35) / total)


def test_buckets_of_infinity_and_nan(spark):
    values = [float("-inf"), -1e300, -1.0, 0.0, 1e-300, 1.0, 1e300, float("inf"), float("nan")]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    found = [r[0] for r in frame.select(ordering.value_bucket(F.col("v"))).collect()]
    assert found == sorted(found) and len(set(found)) == len(found)
