import random

import pytest
from pyspark.sql import functions as F

from lineamix.operators import sampling, variants
from lineamix.plans import studies


def test_dates_and_weighted_draws_do_not_depend_on_layout(spark, rows):
    df = spark.createDataFrame(
        [(f"d{i}", f"c{j} x", float(j + 1)) for i in range(30) for j in range(2 if i == 0 else 6)],
        "date string, clade string, fraction double",
    )
    a = rows(sampling.sample_dates(df, 7, 1))
    assert a == rows(sampling.sample_dates(df.repartition(9), 7, 1)) and len(a) == 7
    assert a != rows(sampling.sample_dates(df, 7, 2))
    drawn = sampling.weighted_sample(df, ["date"], 3, 42)
    assert rows(drawn) == rows(sampling.weighted_sample(df.repartition(5), ["date"], 3, 42))
    sizes = {r.date: (r.n, r.c) for r in drawn.groupBy("date").agg(
        F.count("*").alias("n"), F.min("complete").alias("c")).collect()}
    assert sizes["d0"] == (2, False) and all(v == (3, True) for k, v in sizes.items() if k != "d0")


def test_weighted_draw_prefers_heavy_rows(spark):
    df = spark.range(3000).selectExpr("cast(id as string) as date").crossJoin(
        spark.createDataFrame([("heavy", 0.8), ("light", 0.2)], "clade string, fraction double")
    )
    n = sampling.weighted_sample(df, ["date"], 1, 7).where("clade = 'heavy'").count()
    assert 0.77 < n / 3000 < 0.83


def test_compose_samples(spark):
    df = spark.createDataFrame(
        [("d1", "X Y", 0.2), ("d1", "Z", 0.2), ("d2", "W", 0.5)], "date string, clade string, fraction double"
    )
    got = {(r["sample"], r.lineage): r.fraction for r in sampling.compose_samples(df).collect()}
    assert got == {("SimulatedSample1", "X"): 0.5, ("SimulatedSample1", "Z"): 0.5, ("SimulatedSample2", "W"): 1.0}


def test_quota_truncates(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.7,), (1 / 3,)], "f double")
    assert [r.q for r in df.select(sampling.read_quota(F.col("f"), 20_000).alias("q")).collect()] == [2000, 4000, 14000, 6666]


def test_sample_n_reads_exact_in_both_mates(spark):
    rng = random.Random(2)
    sizes = {"hot": 3000, "small": 4, "mid": 200, "none": 10}
    quota = {"hot": 777, "small": 9, "mid": 200, "none": 0}
    data = [("s", k, f"{k}-{i}", m) for k, n in sizes.items() for i in range(n) for m in (1, 2)]
    rng.shuffle(data)
    reads = spark.createDataFrame(data, "sample string, lineage string, read_id string, mate int")
    quotas = spark.createDataFrame([("s", k, q) for k, q in quota.items()], "sample string, lineage string, num_reads int")
    for buckets in (4, 1024):
        got = sampling.sample_n_reads(reads, quotas, ["sample", "lineage"], buckets=buckets).collect()
        for k in sizes:
            mates = [{r.read_id for r in got if r.lineage == k and r.mate == m} for m in (1, 2)]
            assert mates[0] == mates[1] and len(mates[0]) == min(sizes[k], quota[k])
        assert len(got) == 2 * sum(min(sizes[k], quota[k]) for k in sizes)
    again = sampling.sample_n_reads(reads.repartition(11), quotas, ["sample", "lineage"]).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_bernoulli_subset(spark, rows):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    kept = sampling.bernoulli_subset(df, ["k"], 0.1)
    assert 1800 < kept.count() < 2200
    assert rows(kept) == rows(sampling.bernoulli_subset(df.repartition(3), ["k"], 0.1))


def test_read_mix_uses_truncated_quotas(spark):
    reads = spark.createDataFrame(
        [("s", l, f"{l}{i}", m) for l in "AB" for i in range(50) for m in (1, 2)],
        "sample string, lineage string, read_id string, mate int",
    )
    truth = spark.createDataFrame([("s", "A", 0.33), ("s", "B", 0.67)], "sample string, lineage string, fraction double")
    mixed = studies.read_mix(reads, truth, 20)
    assert mixed.count() == 2 * (6 + 13)


GENOTYPE = "chrom string, pos int, ref string, alts array<string>, lineage string, ord int, gt string"


def genotypes(spark):
    calls = {
        "A": ["1|1", "1|1", ".|.", "0|1", "0|0", "0|0", "1|1", "0|0", "0|0", "0|0"],   # exactly 0.3
        "B": ["1|1", "0|1", "1|1", "0|0", "0|0", "0|0", "0|0", "0|0", "0|0", "0|0"],   # 0.2
        "C": ["1|1"] * 10,
    }
    return spark.createDataFrame(
        [("c", i, "A", ["G", "T"], l, o, g) for o, (l, gs) in enumerate(calls.items()) for i, g in enumerate(gs)],
        GENOTYPE,
    )


def test_hom_alt_share_border(spark, rows):
    assert rows(variants.hom_alt_share(genotypes(spark)), "lineage", "n_hom_alt") == [("A", 3), ("C", 10)]


def test_similarity_wide(spark, rows):
    compositions = spark.createDataFrame(
        [("s1", 0, "C"), ("s1", 1, "A"), ("s1", 2, "B"), ("s2", 0, "A"), ("s2", 1, "unknown")],
        "sample string, ord int, lineage string",
    )
    got = rows(studies.similarity(genotypes(spark), compositions))
    assert got == [
        ("s1", "C vs A", "C vs B", "A vs B", 7, 8, 3, 3, 2, 1),
        ("s2", "A vs unknown", None, None, 3, None, None, 0, None, None),
    ]
    four = spark.createDataFrame([("s", i, n) for i, n in enumerate("ABCD")], "sample string, ord int, lineage string")
    assert len(studies.similarity(genotypes(spark), four, range(1, 7)).first()) == 1 + 3 * 6
    with pytest.raises(Exception, match="no column for pair"):
        studies.similarity(genotypes(spark), four).collect()
    cells = variants.similarity_cells(studies.similarity(genotypes(spark), compositions)).where("sample = 's1'").first()
    assert (cells.Diff_2.value, cells.Shared_2.pair) == (8, "C vs B")
