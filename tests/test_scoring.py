import random

import pytest
from pyspark.sql import functions as F

from lineamix.operators import scoring, solutions
from lineamix.plans import studies

POSTERIOR = "sample string, coverage string, solution int, ord int, odds double, lineage string, fraction double"


def posterior(spark):
    return spark.createDataFrame([
        ("s", "100x", 1, 0, 1.0, "A", 0.5), ("s", "100x", 1, 1, 1.0, "B", 0.5),
        ("s", "100x", 2, 0, 1.0, "A", 0.2), ("s", "100x", 2, 1, 1.0, "B", 0.8),
        ("s", "100x", 3, 0, 0.9, "A", 1.0), ("s", "100x", 3, 1, 0.9, "B", 0.0),
        ("z", "100x", 1, 0, 1.0, "A", 0.0), ("z", "100x", 1, 1, 1.0, "B", 0.0),
        ("n", "100x", 1, 0, 0.7, "A", 1.0),
    ], POSTERIOR)


def test_best_first_dominant_and_multiset(spark, rows):
    best = solutions.best_solutions(posterior(spark))
    assert {r.sample for r in best.collect()} == {"s", "z"}
    assert {r.solution for r in solutions.first_solution(best).where("sample = 's'").collect()} == {1}
    dominant = solutions.dominant_per_solution(best)
    assert rows(dominant, "sample", "solution", "lineage") == [("s", 1, "A"), ("s", 2, "B"), ("z", 1, "")]
    assert rows(solutions.tie_counts(dominant), "sample", "lineage", "n_solutions") == [
        ("s", "A", 1), ("s", "B", 1), ("z", "", 1)
    ]


def test_max_abundance_defaults_to_zero(spark, rows):
    got = rows(solutions.max_abundance(posterior(spark), ["B", "Q"]))
    assert got == [
        ("n", "B", 0.0), ("n", "Q", 0.0), ("s", "B", 80.0), ("s", "Q", 0.0), ("z", "B", 0.0), ("z", "Q", 0.0)
    ]


def test_fold_unmatched_and_best_rmse(spark, rows):
    truth = spark.createDataFrame([("s", "A", 0.25), ("s", "T", 0.75)], "sample string, lineage string, fraction double")
    data = posterior(spark).where("sample = 's'")
    got = rows(studies.posterior_pairs(data, truth), "solution", "lineage", "actual", "predicted")
    # Truth lineage T was not predicted and adds nothing; B is folded.
    assert got == [(1, "A", 0.25, 0.5), (1, "~other", 0.0, 0.5)]


def test_best_rmse_last_wins_on_ties(spark):
    pairs = spark.createDataFrame(
        [("s", "c", 1, 0.5, 0.4), ("s", "c", 2, 0.5, 0.6)],
        "sample string, coverage string, solution int, actual double, predicted double",
    )
    assert {r.solution for r in scoring.best_rmse(pairs, ["sample", "coverage"]).collect()} == {2}


def test_fold_rules_differ_on_zero_sum(spark):
    pairs = spark.createDataFrame(
        [("s", "A", 0.5, 0.5, True), ("s", "Q", 0.0, 0.0, False)],
        "sample string, lineage string, actual double, predicted double, matched boolean",
    )
    assert scoring.fold_unmatched(pairs, ["sample"]).count() == 2
    assert scoring.fold_unmatched(pairs, ["sample"], only_positive=True).count() == 1


def plain_spearman(xs, ys):
    def ranks(v):
        order = sorted(range(len(v)), key=lambda i: v[i])
        out, i = [0.0] * len(v), 0
        while i < len(v):
            j = i
            while j < len(v) and v[order[j]] == v[order[i]]:
                j += 1
            for k in order[i:j]:
                out[k] = (i + j + 1) / 2
            i = j
        return out

    a, b = ranks(xs), ranks(ys)
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    num = sum((x - ma) * (y - mb) for x, y in zip(a, b))
    return num / (sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b)) ** 0.5


def test_spearman_against_plain_ranks_with_hot_value(spark):
    rng = random.Random(1)
    data = [(0.0 if rng.random() < 0.4 else round(rng.random(), 3), rng.random() * rng.choice([1e-6, 1, 1e5]))
            for _ in range(1500)]
    df = spark.createDataFrame([("g", *d) for d in data], "coverage string, actual double, predicted double")
    got = scoring.spearman(df.repartition(7), ["coverage"]).first()
    assert got.n_points == 1500
    assert got.spearman == pytest.approx(plain_spearman([d[0] for d in data], [d[1] for d in data]), abs=1e-10)


def test_spearman_bounds(spark):
    df = spark.createDataFrame(
        [("up", float(i), float(i)) for i in range(9)] + [("down", float(i), float(-i)) for i in range(9)]
        + [("flat", float(i), 1.0) for i in range(9)],
        "g string, actual double, predicted double",
    )
    got = {r.g: r.spearman for r in scoring.spearman(df, ["g"]).collect()}
    assert got["up"] == pytest.approx(1.0) and got["down"] == pytest.approx(-1.0) and got["flat"] is None


def test_parity(spark, rows):
    a = spark.createDataFrame([("1",), ("2",)], "sample string")
    b = spark.createDataFrame([("2",), ("3",)], "sample string")
    assert rows(scoring.one_sided_samples(a, b)) == [("1", True, False), ("3", False, True)]
    scoring.require_parity(a, a)
    with pytest.raises(ValueError):
        scoring.require_parity(a, b)


def test_call_hits_substring_and_list(spark, rows):
    calls = spark.createDataFrame(
        [("1", "BA.1.18", False), ("2", "BA.2", False), ("3", None, False), ("4", "X", True), ("4", "BA.1", True),
         ("5", "BA.1.18", True)],
        "sample string, lineage string, listed boolean",
    )
    truth = spark.createDataFrame([(str(i), "BA.1") for i in range(1, 6)], "sample string, lineage string")
    got = rows(scoring.call_hits(calls, truth, ["sample"]), "sample", "hit", "hit_exact")
    assert got == [("1", True, False), ("2", False, False), ("3", False, False), ("4", True, True), ("5", False, False)]


def test_clade_matching_is_a_case_insensitive_regex(spark, rows):
    clade_map = spark.createDataFrame(
        [("21K (Omicron)", "BA.1"), ("21L omicron", "BA.2"), (None, "Q"), ("21J", "AY.4")],
        "clade string, pango string",
    )
    patterns = spark.createDataFrame(
        [("OMICRON",), ("21[KL]",), ("21K (Omicron)",), ("21",), ("none",), (None,)], "pattern string"
    )
    got = rows(scoring.matched_lineages(patterns, clade_map))
    # Brackets are a group, so that name does not match itself.
    assert got == [
        ("21", "AY.4"), ("21", "BA.1"), ("21", "BA.2"), ("21[KL]", "BA.1"), ("21[KL]", "BA.2"),
        ("OMICRON", "BA.1"), ("OMICRON", "BA.2"),
    ]


def test_accuracy_and_merge(spark, rows):
    hits = spark.createDataFrame(
        [("a", "100x", "1", True), ("a", "100x", "2", False), ("b", "100x", "1", True)],
        "tool string, coverage string, sample string, hit boolean",
    )
    expected = spark.createDataFrame([(2,)], "n_expected bigint")
    scores = scoring.accuracy(hits, ["tool", "coverage"], expected)
    assert rows(scores) == [("a", "100x", 2, 1.0, 50.0), ("b", "100x", 1, 0.5, 100.0)]
    # b scored another number of samples, and says so.
    assert rows(scoring.merge_tools(scores, ["a", "b"])) == [("100x", 2, 1.0, 50.0, 1, 0.5, 100.0)]


def test_spearman_of_tiny_values(spark):
    points = spark.createDataFrame(
        [("k", i * 1e-14, float(i)) for i in range(1, 40)] + [("n", 0.1 + 0.2, 1.0), ("n", 0.3, 1.0), ("n", -0.0, 2.0), ("n", 0.0, 3.0)],
        "key string, actual double, predicted double",
    )
    found = {r.key: r.spearman for r in scoring.spearman(points, ["key"]).collect()}
    assert abs(found["k"] - 1.0) < 1e-12
    # 0.1 + 0.2 ties with 0.3, and the zeros tie: ranks 3.5 3.5 1.5 1.5 against 1.5 1.5 3 4.
    assert abs(found["n"] + 0.9428090415820634) < 1e-9


def test_strict_validation_needs_the_same_samples(spark):
    a = spark.createDataFrame([("1", "100x"), ("2", "100x")], "sample string, coverage string")
    b = spark.createDataFrame([("1", "100x"), ("2", "1000x")], "sample string, coverage string")
    scoring.require_parity(a, b)
    with pytest.raises(ValueError):
        scoring.require_parity(a, b, ["sample", "coverage"])


def test_mse_by_tool(spark, rows):
    df = spark.createDataFrame(
        [("1", "delta", 0.6, "truth"), ("1", "omicron", 0.4, "truth"), ("1", "delta", 0.3, "p"),
         ("1", "delta", 0.2, "p"), ("1", "other", 0.5, "p"), ("2", "delta", 1.0, "truth"), ("2", "delta", 0.0, "p"),
         ("9", "delta", 1.0, "truth")],
        "sample string, who_name string, fraction double, tool string",
    )
    got = scoring.mse_by_tool(df, ["p", "q"], excluded=["9"]).select("tool", F.round("mse", 9), "n_cells")
    assert rows(got) == [("p", round((0.01 + 0.16 + 1.0) / 3, 9), 3)]


def test_lab_mix_keeps_unmatched_targets_single(spark):
    abundance = spark.createDataFrame(
        [("m", "c", "K1", 3.0), ("m", "c", "K2", 1.0), ("m", "c", "other1", 0.5), ("m", "c", "other2", 0.25)],
        "sample string, coverage string, target_id string, tpm double",
    )
    names = spark.createDataFrame([("K1", "one"), ("K2", "two")], "target_id string, short string")
    truth = spark.createDataFrame([("m", "one", 0.7), ("m", "two", 0.3)], "sample string, lineage string, fraction double")
    got = studies.lab_mix(abundance, truth, names).first()
    assert got.n_points == 4
    assert got.spearman == pytest.approx(plain_spearman([0.7, 0.3, 0, 0], [3, 1, 0.5, 0.25]))


def test_stack_and_bars(spark, rows):
    df = spark.createDataFrame(
        [("s", "A", "delta", 0.25, "truth"), ("s", "B", "delta", 0.75, "truth"), ("s", "A", "delta", 0.5, "truth")],
        "sample string, prediction string, who_name string, fraction double, tool string",
    )
    bars = studies.stacked_fractions(studies.stack(df))
    assert rows(bars, "prediction", "fraction", "bar_start", "bar_end") == [("A", 0.75, 0.0, 0.75), ("B", 0.75, 0.75, 1.0)]


def test_lab_mix_posterior(spark):
    names_of, truth = studies.lab_tables(spark, "mix")
    rows = [(1, 1.0, "M38429.1", 0.4), (1, 1.0, "U39362.2", 0.3), (1, 1.0, "AF324493.2", 0.2), (1, 1.0, "other", 0.1),
            (2, 1.0, "K03455.1", 1.0), (0, 0.9, "K03455.1", 1.0)]
    posterior = spark.createDataFrame(
        [("mix", "100x", *r) for r in rows], "sample string, coverage string, solution bigint, odds double, lineage string, fraction double"
    )
    found = studies.lab_mix_posterior(posterior, truth, names_of).first()
    # Truth ranks 896 3, HXB2 1, JRCSF 5, NL43 4, YU2 2 against 4, 1.5, 5, 3, 1.5.
    assert found.n_points == 5 and abs(found.spearman - 0.8720815992723809) < 1e-9


def test_patterns_against_all_names(spark):
    """Every pattern finds the names that Python's expressions find, whatever it requires."""
    import random
    import re

    pick = random.Random(4)
    names = sorted({"".join(pick.choices("abcABC19. -/é", k=pick.randint(1, 9))) for _ in range(150)}) + ["", "Omicron (BA.1-like)", "[x]"]
    fixed = ["", ".*", "a", "^a", "c$", "a|b", "(ab)+c", "a?b", "a*b", "ab{0,2}c", "a+b", r"\.", r"\[x\]", "[ab]c", "[^a]b", "[]a]b", "BA.1", "omicron", "zzz", "a.c", "é", "ba*?c", "9++", r"\d\d"]
    plain = ["".join(pick.choices("abc19 -", k=pick.randint(1, 5))) for _ in range(60)]
    mixed = ["".join(pick.choices(["a", "b", "C", "1", ".", "a?", "b*", "c+", "[ab]", "9"], k=pick.randint(1, 5))) for _ in range(80)]
    patterns = sorted({*fixed, *plain, *mixed})
    got = scoring.matched_lineages(
        spark.createDataFrame([(p,) for p in [*patterns, None]], "pattern string"),
        spark.createDataFrame([(n, n) for n in names] + [(None, "x")], "clade string, pango string"),
    ).collect()

    def matches(p, n):
        return re.search(p, n, re.I | re.A) is not None

    assert {(r.pattern, r.pango) for r in got} == {(p, n) for p in patterns for n in names if matches(p, n)}
    plan = scoring.matched_lineages(spark.createDataFrame([("a",)], "pattern string"), spark.createDataFrame([("a", "b")], "clade string, pango string"))
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()


def test_natural_text_sorts_like_numbers(spark):
    from lineamix.functions import names
    order = ["1", "2a", "10", "ab-", "ab2", "ab10", "abc", "r1.2/9", "r1.10/3", "r2.1", "r99999999999999999999", "r100000000000000000000"]
    df = spark.createDataFrame([(x,) for x in reversed(order)], "n string").repartition(3)
    assert [r.n for r in df.repartitionByRange(4, names.natural_text(F.col("n"))).sortWithinPartitions(names.natural_text(F.col("n"))).collect()] == order
    same = df.limit(1).select(names.natural_text(F.lit("a007b")).alias("x"), names.natural_text(F.lit("a7b")).alias("y")).first()
    assert same.x == same.y
