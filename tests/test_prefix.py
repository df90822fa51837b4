"""Running sums over ranges that are cut anywhere."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lineamix.functions import names
from lineamix.operators import prefix
from lineamix.plans import studies
from lineamix.plans.catalog import QUERIES
from tests.test_skew import final_plan, small_pieces


def plain(data, key, order, value):
    out, total = {}, {}
    for row in sorted(data, key=lambda r: (key(r) is not None, key(r) or "", *order(r))):
        total[key(row)] = total.get(key(row), 0) + (value(row) or 0)
        out[row[2]] = total[key(row)]
    return out


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_any_cut(spark, ranges):
    pick = random.Random(7)
    data = [(pick.choice(["hot", "hot", None, "a", "b", f"k{i}"]), pick.choice([0.0, 0.0, 1.5, pick.random()]), i, pick.choice([None, 1, 5, -2])) for i in range(1500)]
    df = spark.createDataFrame(data, "k string, v double, i int, w int").repartition(5)
    got = {r.i: r.upto for r in prefix.running_sum(df, ["k"], ["v", "i"], F.col("w"), "upto", ranges).collect()}
    assert got == plain(data, lambda r: r[0], lambda r: (r[1], r[2]), lambda r: r[3])
    down = {r.i: r.position for r in prefix.positions(df.where("k = 'hot'"), ["k"], [F.desc("v"), F.desc("i")], ranges=ranges).collect()}
    ordered = sorted((r for r in data if r[0] == "hot"), key=lambda r: (-r[1], -r[2]))
    assert down == {r[2]: n + 1 for n, r in enumerate(ordered)}
    assert prefix.running_sum(df.limit(0), ["k"], ["v"], F.col("v"), "upto").count() == 0


def test_double_sums_and_clashing_names(spark):
    df = spark.createDataFrame([("a", 1, 0.25), ("a", 2, None), ("b", 1, float("inf")), ("a", 3, 0.5)], "`k.x` string, sum int, value double")
    got = prefix.running_sum(df.withColumnRenamed("k.x", "key"), ["key"], ["sum"], F.col("value"), "total")
    assert sorted(map(tuple, got.select("key", "sum", "total").collect())) == [("a", 1, 0.25), ("a", 2, 0.25), ("a", 3, 0.75), ("b", 1, float("inf"))]


def test_one_prefix_and_tied_zeros_are_spread(spark):
    """All names share their beginning, and two thirds of the values are equal: no range has much more than its share."""
    with small_pieces(spark):
        rows = spark.range(0, 30_000, 1, 8).selectExpr("'s' as sample", "concat('SHARED-PREFIX-', id) as name", "if(id % 3 = 0, 1.0, 0.0) as tpm", "id")
        for order in (["name"], [F.desc("tpm"), "name"]):
            out = prefix.positions(rows, ["sample"], order, ranges=12)
            sizes = [r["count"] for r in out.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
            assert len(sizes) >= 10 and max(sizes) < 30_000 / 12 * 2
            got = out.collect()
            assert sorted(r.position for r in got) == list(range(1, 30_001))
        plan = final_plan(out)
        assert plan.count("ReusedExchange") >= 1 and "rangepartitioning" in plan


def test_stacked_bars_shuffle_little(spark):
    rows = spark.createDataFrame([("s", f"p{i % 7}", "omicron", 0.1, "truth") for i in range(50)], "sample string, prediction string, who_name string, fraction double, tool string")
    out = studies.stacked_fractions(rows)
    bars = {r.prediction: (round(r.bar_start, 9), round(r.bar_end, 9)) for r in out.collect()}
    assert bars["p0"] == (0.0, 0.8) and bars["p1"] == (0.8, 1.0) and bars["p6"] == (1.0, 1.0)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange ") <= 8


@pytest.mark.parametrize("ranges", [1, 4, 30])
def test_running_maxima(spark, ranges):
    pick = random.Random(2)
    data = [(pick.choice(["hot", "hot", None, "a", f"k{i}"]), pick.randint(0, 30), i, pick.choice([None, None, -5, 0, i, 1 << 50])) for i in range(900)]
    df = spark.createDataFrame(data, "k string, v int, i int, w bigint").repartition(3)
    got = {r.i: r.far for r in prefix.running_max(df, ["k"], ["v", "i"], F.col("w"), "far", ranges).collect()}
    far, want = {}, {}
    for k, v, i, w in sorted(data, key=lambda r: (r[1], r[2])):
        far[k] = max((x for x in (far.get(k), w) if x is not None), default=None)
        want[i] = far[k]
    assert got == want


def test_intervals_against_all_pairs(spark):
    """Regions of one base to 10^9 bases are one mark each; every read meets what it overlaps."""
    from lineamix.operators import intervals

    pick = random.Random(9)
    reads = [(f"r{i}", pick.choice([0, 16]), pick.choice(["c", "d", None]), pick.choice([None, pick.randint(0, 2000)]), pick.randint(0, 60)) for i in range(600)]
    reads = [(n, f, c, s, None if s is None else s + w) for n, f, c, s, w in reads] + [("far", 0, "d", 999_999_000, 999_999_010)]
    regions = [(pick.choice("cc d".split()), s, s + pick.choice([0, 1, 5, 40])) for s in (pick.randint(0, 2100) for _ in range(25))] + [("d", 1900, 1_000_000_000)]
    r = spark.createDataFrame(reads, "qname string, flag int, chrom string, start bigint, end bigint").repartition(4)
    g = spark.createDataFrame(regions, "chrom string, start bigint, end bigint")
    hit = {n for n, _, c, s, e in reads if any(c == gc and s is not None and s < ge and e > gs for gc, gs, ge in regions)}
    assert {x.qname for x in intervals.inside_regions(r, g).collect()} == hit
    assert {x.qname for x in intervals.outside_regions(r, g).collect()} == {x[0] for x in reads} - hit
    want = {}
    for n, f, c, s, e in reads:
        best = 0
        for gc, gs, ge in regions:
            if gc == c and s is not None and gs < ge:
                if f & 16 and gs < e <= ge:
                    best = max(best, e - max(gs, s))
                if not f & 16 and gs <= s < ge:
                    best = max(best, min(ge, e) - s)
        want[n] = best
    assert {x.qname: x.clip for x in intervals.clip_lengths(r, g).collect()} == want


def test_name_order_sorts_by_columns(spark, tmp_path):
    """A sort that holds the expression of the natural order works it out again in each comparison."""
    rows = [(o, p, 1, 1 + o % 3, 4.0, 0.0 if o % 5 == 0 else 0.1, "F") for o in (1, 2, 9, 10, 11, 100, 2) for p in (1, 2)]
    columns = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_discount double, l_linestatus string"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    out = QUERIES["name_order"](spark, str(tmp_path))
    got = {r.name: (r.first, r.last) for r in out.collect()}
    assert [n for n, _ in sorted(got.items(), key=lambda x: x[1])] == ["r1.02/1", "r2.1/1", "r9.1/1", "r10.02/2", "r11.1/2", "r100.02/3"]
    assert got["r2.1/1"] == (3, 6)
    sorts = [line for line in final_plan(out).split("\n") if "Sort [" in line or "rangepartitioning(" in line]
    assert sorts and not any("regexp" in line or "transform" in line for line in sorts)


def test_natural_text_of_odd_names(spark):
    odd = ["", "0", "000", "007x", "x0", "x00.10", "é9", "9é", ":1", "/1", "12345678901234567890123", "a:b", "-", "٣4"]

    def plain(text):
        return "".join(f"{len(r.lstrip('0') or '0'):06d}{r.lstrip('0') or '0'}" if r[0] in "0123456789" else r for r in re.findall("[0-9]+|[^0-9]+", text))

    df = spark.createDataFrame([(x,) for x in odd], "name string")
    assert {r.name: r.key for r in df.select("name", names.natural_text(F.col("name")).alias("key")).collect()} == {x: plain(x) for x in odd}
