import math
import random

import pytest
from pyspark.sql import functions as F

from lineamix.operators import fractions, ordering


def test_shares_sum_to_one_and_zero_total_is_null(spark, rows):
    df = spark.createDataFrame(
        [("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 0.0)], "sample string, target_id string, tpm double"
    )
    got = rows(fractions.shares(df, ["sample"], "tpm"), "sample", "target_id", "fraction")
    assert got == [("a", "x", 0.25), ("a", "y", 0.75), ("b", "x", None)]


def test_clade_frequencies_limits(spark, rows):
    data = [
        ("2024-01-01", "s1", "A", 99), ("2024-01-01", "s1", "B", 1),       # exactly 1 %: kept
        ("2024-01-08", "s1", "A", 30), ("2024-01-08", "s2", "A", 20),      # exactly 50: kept
        ("2024-01-15", "s1", "A", 49),                                     # under 50: dropped
        ("2024-01-22", "s1", "A", 0),                                      # zero: dropped
        ("2024-01-29", "s1", "A", 199), ("2024-01-29", "s1", "B", 1),      # 0.5 %: dropped, rest 1.0
    ]
    df = spark.createDataFrame(data, "date string, state string, clade string, sequences bigint")
    got = rows(fractions.clade_frequencies(df), "date", "total_sequences", "clade", "fraction")
    assert got == [
        ("2024-01-01", 100, "A", 0.99), ("2024-01-01", 100, "B", 0.01),
        ("2024-01-08", 50, "A", 1.0), ("2024-01-29", 200, "A", 1.0),
    ]


def test_map_round_trip(spark, rows):
    df = spark.createDataFrame([("d", "A", 0.25), ("d", "B", 0.75)], "date string, clade string, f double")
    maps = fractions.to_map(df, ["date"], "clade", "f", "m")
    assert maps.first()["m"] == {"A": 0.25, "B": 0.75}
    assert rows(fractions.from_map(maps, "m", "clade", "f")) == rows(df)


def test_dominant_ties_and_all_zero(spark, rows):
    df = spark.createDataFrame(
        [("a", 2, "late", 0.5), ("a", 1, "first", 0.5), ("b", 1, "x", 0.0), ("c", 1, "z", 0.2)],
        "sample string, ord int, lineage string, fraction double",
    )
    assert rows(fractions.dominant(df, ["sample"])) == [("a", "first"), ("b", ""), ("c", "z")]


@pytest.mark.parametrize("n", [3, 5, 8])
def test_top_with_other(spark, n):
    data = [("s", "100x", f"t{i}", float(10 - i)) for i in range(n)] + [("z", "100x", "t", 0.0)]
    df = spark.createDataFrame(data, "sample string, coverage string, target_id string, tpm double")
    got = {r.prediction: r.fraction for r in fractions.top_with_other(df).where("sample = 's'").collect()}
    total = sum(10.0 - i for i in range(n))
    assert len(got) == min(n, 5) + 1
    assert got["other"] == pytest.approx(sum(10.0 - i for i in range(5, n)) / total)
    assert got["t0"] == pytest.approx(10 / total)
    empty = fractions.top_with_other(df).where("sample = 'z'").collect()
    assert {(r.prediction, r.fraction) for r in empty} == {("t", None), ("other", None)}


def test_top_with_other_tied_boundary_and_real_other(spark, rows):
    data = [("s", f"t{i}", 1.0) for i in range(7)] + [("s", "other", 5.0)]
    df = spark.createDataFrame(data, "sample string, target_id string, tpm double")
    got = rows(fractions.top_with_other(df, ["sample"]).withColumn("fraction", F.round("fraction", 6)))
    assert got == [
        ("s", "other", round(3 / 12, 6)), ("s", "other", round(5 / 12, 6)),
        *[("s", f"t{i}", round(1 / 12, 6)) for i in range(4)],
    ]


def test_abundance_grid_and_missing(spark, rows):
    df = spark.createDataFrame([("a", "L1", 0.4)], "sample string, lineage string, fraction double")
    assert rows(fractions.abundance_grid(df, ["L1", "L2"])) == [("a", "L1", 0.4), ("a", "L2", 0.0)]
    expected = fractions.grid(spark.createDataFrame([("1",), ("2",)], "sample string"), "coverage", ["x", "y"])
    done = spark.createDataFrame([("1", "x"), ("2", "y")], "sample string, coverage string")
    assert rows(fractions.missing_outputs(expected, done, ["sample", "coverage"])) == [("1", "y"), ("2", "x")]


def test_value_bucket_never_decreases(spark):
    rng = random.Random(3)
    values = [0.0, 1.0, -1.0, 2.0, 0.5, 1e-300, 1e300, math.nextafter(1.0, 0), math.nextafter(2.0, 0)]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 12) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", ordering.value_bucket(F.col("v")).alias("b")).orderBy("v").collect()
    assert all(x.b <= y.b for x, y in zip(got, got[1:]))


def test_running_total_matches_plain_order(spark):
    rng = random.Random(5)
    data = [("hot" if i % 3 else f"k{i % 7}", rng.random() * 10, i, rng.randint(1, 9)) for i in range(2000)]
    df = spark.createDataFrame(data, "k string, v double, i int, w int")
    out = ordering.running_total(
        df, ["k"], ["v", "i"], ordering.value_bucket(F.col("v")), F.col("w"), "upto", "all"
    )
    for key in {d[0] for d in data}:
        total = 0
        expected = {}
        for d in sorted((d for d in data if d[0] == key), key=lambda d: (d[1], d[2])):
            total += d[3]
            expected[d[2]] = total
        got = {r.i: r.upto for r in out.where(F.col("k") == key).collect()}
        assert got == expected
    assert out.where("k = 'hot'").first()["all"] == sum(d[3] for d in data if d[0] == "hot")


def test_sort_positions_with_copies(spark):
    rng = random.Random(11)
    data = [("c", rng.randint(0, 20), f"r{rng.randint(0, 30)}") for _ in range(800)] + [("c", 7, "hot")] * 500
    df = spark.createDataFrame(data, "chrom string, start int, name string")
    placed = ordering.sort_positions(df, ["chrom", "start", "name"], partitions=8).collect()
    ordered = sorted(data)
    assert sum(r.copies for r in placed) == len(data)
    for r in placed:
        at = r.first_position - 1
        assert ordered[at:at + r.copies] == [(r.chrom, r.start, r.name)] * r.copies


def test_coordinate_sort_is_sorted_over_partitions(spark):
    df = spark.range(1000).selectExpr("'c' as chrom", "(id * 37) % 1000 as start")
    out = ordering.coordinate_sort(df, ["chrom", "start"], 5)
    got = [r.start for r in out.collect()]
    assert got == sorted(got) and len(got) == 1000
