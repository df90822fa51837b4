"""Predictions against truth: pairs, errors, correlation, accuracy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lineamix.functions.names import fold_ascii
from lineamix.operators.ordering import attach, average_ranks, known

FOLDED = "~other"


def truth_pairs(predicted: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predicted fractions with the true one beside it; ``matched`` tells if there is one.

    Truth lineages that were not predicted add nothing.
    """
    known = truth.select(
        "sample", "lineage", F.col("fraction").alias("actual"), F.lit(True).alias("_known")
    )
    return predicted.join(known, ["sample", "lineage"], "left").select(
        *keys,
        "lineage",
        F.coalesce("actual", F.lit(0.0)).alias("actual"),
        F.col("fraction").alias("predicted"),
        F.col("_known").isNotNull().alias("matched"),
    )


def fold_unmatched(
    pairs: DataFrame, keys: Sequence[str], only_positive: bool = False
) -> DataFrame:
    """Sum the predictions without truth into one pair with actual 0.

    ``only_positive`` drops that pair when its sum is not above 0 (abundance caller);
    otherwise it stays whenever there was such a prediction (posterior caller).
    """
    folded = (
        pairs.groupBy(
            *keys, F.when(F.col("matched"), F.col("lineage")).otherwise(FOLDED).alias("lineage"),
            "matched",
        )
        .agg(F.max("actual").alias("actual"), F.sum("predicted").alias("predicted"))
    )
    if only_positive:
        folded = folded.where(F.col("matched") | (F.col("predicted") > 0))
    return folded.drop("matched")


def solution_errors(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Root mean squared error of each candidate solution.

    Rounded to 12 significant digits: equal errors must tie whatever the order of summation.
    """
    error = F.sqrt(F.avg(F.pow(F.col("actual") - F.col("predicted"), 2)))
    errors = pairs.groupBy(*keys, "solution").agg(error.alias("rmse"))
    return errors.withColumn("rmse", F.when(F.col("rmse").isNotNull(), significant("rmse")))


def best_rmse(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Policy ``min_rmse``: pairs of the solution with the smallest error, the last on ties."""
    keys = list(keys)
    best = solution_errors(pairs, keys).groupBy(*keys).agg(
        F.min(F.struct("rmse", (-F.col("solution")).alias("last"))).alias("_best")
    )
    chosen = best.select(*keys, (-F.col("_best.last")).alias("solution"), "_best.rmse")
    return pairs.join(chosen, [*keys, "solution"])


def mse(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(
        F.avg(F.pow(F.col("actual") - F.col("predicted"), 2)).alias("mse"),
        F.count(F.lit(1)).alias("n_points"),
    )


def mse_label(value: str = "mse") -> F.Column:
    """Text shown with the plot."""
    return F.format_number(value, 4)


def significant(name: str, digits: int = 12) -> F.Column:
    """A double rounded to so many significant digits; 0, NaN and infinity stay, -0.0 becomes 0.0."""
    value = F.col(name).cast("double")
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(value))))
    rounded = F.round(value / scale, digits - 1) * scale
    finite = (value != 0) & ~F.isnan(value) & (F.abs(value) < float("inf")) & (F.abs(value) > 1e-290)
    return F.coalesce(F.when(finite, rounded).otherwise(value + 0.0), F.lit(0.0))


def spearman(
    pairs: DataFrame, keys: Sequence[str], x: str = "actual", y: str = "predicted"
) -> DataFrame:
    """Rank correlation by group, NULL when one side is constant.

    Equal pairs are counted first, ranks come from the histogram of distinct values,
    so neither a hot value nor one huge group is sorted in one task. Values are rounded to
    12 significant digits, however small they are: equal sums must tie whatever the order
    of summation.
    """
    keys = list(keys)
    points = known(pairs, [*keys, x, y])
    cells = points.select(*keys, significant(x).alias("x"), significant(y).alias("y"))
    cells = cells.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("w"))
    ranked = cells.join(average_ranks(cells, keys, "x", "w"), [*keys, "x"]).join(
        average_ranks(cells, keys, "y", "w"), [*keys, "y"]
    )
    w, rx, ry = F.col("w"), F.col("x_rank"), F.col("y_rank")
    sums = ranked.groupBy(*keys).agg(
        F.sum(w * rx * ry).alias("_xy"),
        F.sum(w * rx * rx).alias("_xx"),
        F.sum(w * ry * ry).alias("_yy"),
        F.sum(w).alias("n_points"),
    )
    rho = F.try_divide(F.col("_xy"), F.sqrt("_xx") * F.sqrt("_yy"))
    return sums.select(*keys, rho.alias("spearman"), "n_points")


def one_sided_samples(predicted: DataFrame, truth: DataFrame, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """Samples that only one side knows; ``keys`` may tell samples apart by coverage too."""
    keys = list(keys)
    left = predicted.select(*keys).distinct().withColumn("in_predictions", F.lit(True))
    right = truth.select(*keys).distinct().withColumn("in_truth", F.lit(True))
    return (
        left.join(right, keys, "full")
        .na.fill({"in_predictions": False, "in_truth": False})
        .where(~(F.col("in_predictions") & F.col("in_truth")))
    )


def require_parity(predicted: DataFrame, truth: DataFrame, keys: Sequence[str] = ("sample",)) -> None:
    """Raise unless both sides have the same samples."""
    if not one_sided_samples(predicted, truth, keys).isEmpty():
        raise ValueError("predictions and truth do not cover the same samples")


def call_hits(calls: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether a sample's calls name the true lineage.

    ``calls`` may hold several rows per sample; one hit is enough. ``hit_exact`` compares
    names. ``hit`` does so for a ``listed`` call (a tool that lists its solutions); for a
    single call it is true whenever the call contains the true name.
    """
    wanted = truth.select("sample", F.col("lineage").alias("truth"))
    exact = F.coalesce(F.col("lineage") == F.col("truth"), F.lit(False))
    loose = F.coalesce(F.col("lineage").contains(F.col("truth")), F.lit(False))
    return (
        attach(calls, wanted, ["sample"])
        .groupBy(*keys)
        .agg(
            F.max("truth").alias("truth"),
            F.max(F.when(F.col("listed"), exact).otherwise(loose)).alias("hit"),
            F.max(exact).alias("hit_exact"),
        )
    )


#: Characters of a gram; names are found by those of this length and shorter ones.
GRAM = 3


def required_literal(pattern: Column) -> Column:
    """A text that every match of a regular expression contains, lower-cased; empty if none is known.

    Escapes, classes, anchors, any-character signs and whatever may be left out cut the pattern;
    the longest rest counts. Alternatives and groups are not looked into.
    """
    cut = "\0"
    rest = F.regexp_replace(pattern, r"(?s)\\.", cut)
    rest = F.regexp_replace(rest, r"\[\^?\]?[^\]]*\]", cut)
    rest = F.regexp_replace(rest, r"(?s).(?:[?*][?+]?|\{[^}]*\}[?+]?)", cut)
    rest = F.regexp_replace(rest, r"(?s)(.)\+[?+]?", f"$1{cut}")
    pieces = F.split(F.regexp_replace(rest, r"[.^$]", cut), cut)
    longest = F.reduce(pieces, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    return F.when(pattern.rlike(r"[|()]"), F.lit("")).otherwise(fold_ascii(longest))


def _grams(text: Column, sizes: Sequence[int]) -> Column:
    """Different substrings of these lengths, and the empty one."""
    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substr(text, i, F.lit(n)))).otherwise(
            F.array().cast("array<string>")
        )

    return F.array_distinct(F.concat(F.array(F.lit("")), *map(of, sizes)))


def matched_lineages(patterns: DataFrame, clade_map: DataFrame) -> DataFrame:
    """(pattern, pango) for map rows whose clade contains the pattern, as a
    case-insensitive regular expression. NULL clades never match.

    Only distinct patterns and distinct clade names meet, by an equi-join: names are entered under
    their grams of up to three characters, a pattern is looked up under the rarest gram of the text
    it requires, and the whole expression is tested on those candidates. A pattern that requires
    nothing meets all names, as its result may.
    """
    wanted = patterns.select("pattern").where("pattern is not null").distinct()
    names = clade_map.select("clade").where("clade is not null").distinct()
    postings = names.select("clade", F.explode(_grams(fold_ascii(F.col("clade")), range(1, GRAM + 1))).alias("_gram"))
    literal = required_literal(F.col("pattern"))
    asked = wanted.withColumn("_literal", literal).select(
        "pattern", F.explode(F.when(F.length("_literal") >= GRAM, _grams(F.col("_literal"), [GRAM])).otherwise(F.array("_literal"))).alias("_gram"),
        F.length("_literal").alias("_size"),
    ).where((F.col("_gram") != "") | (F.col("_size") == 0))
    # A gram that no name has makes the pattern match nothing: it is the rarest.
    frequency = postings.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = asked.join(frequency, "_gram", "left").groupBy("pattern").agg(
        F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram")
    )
    hits = rarest.join(postings, "_gram").where(F.expr("clade rlike concat('(?i)', pattern)")).select("pattern", "clade")
    return hits.join(clade_map.select("clade", "pango"), "clade").select("pattern", "pango").distinct()


def clade_hits(
    calls: DataFrame, clade_map: DataFrame, truth: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Whether the true lineage belongs to a clade that the called clade matches."""
    wanted = truth.select("sample", F.col("lineage").alias("truth"))
    asked = attach(calls, wanted, ["sample"]).withColumnRenamed("clade", "pattern")
    matches = matched_lineages(calls.select(F.col("clade").alias("pattern")), clade_map).select(
        "pattern", F.col("pango").alias("truth"), F.lit(True).alias("_hit")
    )
    return (
        attach(asked, matches, ["pattern", "truth"], "left")
        .groupBy(*keys)
        .agg(F.max("truth").alias("truth"), F.coalesce(F.max("_hit"), F.lit(False)).alias("hit"))
    )


def accuracy(hits: DataFrame, keys: Sequence[str], expected: DataFrame) -> DataFrame:
    """Accuracy in percent and call rate (called / expected) by tool and coverage.

    ``expected`` holds the number of true samples in one row, column ``n_expected``.
    It is read as a scalar subquery, not joined.
    """
    scored = hits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg(F.when(F.col("hit"), 100.0).otherwise(0.0)).alias("accuracy"),
    )
    return scored.select(
        *keys, "n_samples", (F.col("n_samples") / expected.scalar()).alias("call_rate"), "accuracy"
    )


def merge_tools(scores: DataFrame, tools: Sequence[str]) -> DataFrame:
    """One row per coverage with every tool's own ``n_samples``, call rate and accuracy.

    Cells are NULL only for a tool without any scored sample at that coverage.
    """
    cell = F.struct("n_samples", "call_rate", "accuracy")
    per_tool = scores.where(F.col("tool").isin(*tools)).groupBy("coverage").agg(
        *[F.max(F.when(F.col("tool") == t, cell)).alias(f"_{t}") for t in tools]
    )
    columns = [
        F.col(f"_{t}.{measure}").alias(f"{t}_{measure}") for t in tools for measure in ("n_samples", "call_rate", "accuracy")
    ]
    return per_tool.select("coverage", *columns)


def mse_by_tool(
    predictions: DataFrame,
    tools: Sequence[str],
    classes: Sequence[str] = ("omicron", "delta"),
    excluded: Sequence[str] = (),
    truth: str = "truth",
) -> DataFrame:
    """Mean squared error of class fractions against the truth, per tool.

    Cells a tool leaves empty count as 0; a tool without any row is left out.
    """
    rows = predictions.where(
        F.col("who_name").isin(*classes) & F.col("tool").isin(*tools, truth)
    )
    if excluded:
        rows = rows.where(~F.col("sample").isin(*excluded))

    def total(tool: str):
        return F.coalesce(F.sum(F.when(F.col("tool") == tool, F.col("fraction"))), F.lit(0.0))

    cells = rows.groupBy("sample", "who_name").agg(
        total(truth).alias("_truth"),
        *[total(t).alias(f"_f_{t}") for t in tools],
        *[F.count(F.when(F.col("tool") == t, 1)).alias(f"_n_{t}") for t in tools],
    )
    per_tool = F.explode(
        F.array(*[
            F.struct(
                F.lit(t).alias("tool"), F.col(f"_f_{t}").alias("f"), F.col(f"_n_{t}").alias("n")
            )
            for t in tools
        ])
    )
    return (
        cells.select("_truth", per_tool.alias("_t"))
        .groupBy(F.col("_t.tool").alias("tool"))
        .agg(
            F.avg(F.pow(F.col("_t.f") - F.col("_truth"), 2)).alias("mse"),
            F.count(F.lit(1)).alias("n_cells"),
            F.sum("_t.n").alias("_rows"),
        )
        .where(F.col("_rows") > 0)
        .drop("_rows")
    )
