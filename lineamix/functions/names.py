"""Lineage names: classes, recodings and sort keys."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, functions as F


class ClassRule(NamedTuple):
    """A class applies when the name has one of the prefixes or equals one of the names."""

    label: str
    prefixes: tuple[str, ...] = ()
    names: tuple[str, ...] = ()


# Variant classes by lineage name, first match wins.
VARIANT_CLASSES = (
    ClassRule("delta", prefixes=("AY",), names=("B.1.617.2",)),
    ClassRule("omicron", prefixes=("BA",)),
    ClassRule("recombinant", prefixes=("X",)),
)
OTHER_CLASS = "other"

# Class calls of the consensus caller and the class each stands for.
CALL_CLASSES = {
    "Probable Omicron (Unassigned)": "omicron",
    "Omicron (Unassigned)": "omicron",
    "Omicron (BA.1-like)": "omicron",
    "Probable Delta (Unassigned)": "delta",
    "Delta (B.1.617.2-like)": "delta",
    "Delta (AY.4-like)": "delta",
}

# Accessions of the five lab-mix strains, their names and true fractions.
LAB_STRAINS = {
    "AF324493.2": "NL43",
    "K03455.1": "HXB2",
    "M38429.1": "JRCSF",
    "M93258.1": "YU2",
    "U39362.2": "896",
}
LAB_TRUTH = {"896": 0.226, "HXB2": 0.10, "JRCSF": 0.296, "NL43": 0.269, "YU2": 0.109}


def classify(name: Column, rules: Sequence[ClassRule] = VARIANT_CLASSES) -> Column:
    """Class label of a lineage name."""
    chain = None
    for rule in rules:
        hit = F.lit(False)
        for prefix in rule.prefixes:
            hit = hit | name.startswith(prefix)
        if rule.names:
            hit = hit | name.isin(*rule.names)
        chain = F.when(hit, rule.label) if chain is None else chain.when(hit, rule.label)
    return F.lit(OTHER_CLASS) if chain is None else chain.otherwise(OTHER_CLASS)


def recode(value: Column, mapping: dict[str, str] | None = None) -> Column:
    """Replace known values and pass every other one through, NULL included."""
    chain = None
    by_label: dict[str, list[str]] = {}
    for old, new in (CALL_CLASSES if mapping is None else mapping).items():
        by_label.setdefault(new, []).append(old)
    for new, olds in by_label.items():
        hit = value.isin(*olds)
        chain = F.when(hit, new) if chain is None else chain.when(hit, new)
    return value if chain is None else chain.otherwise(value)


def _run_key(run: Column) -> Column:
    """A run of digits as the number of its digits and the digits, without leading zeros; others as they are.

    Plain comparisons and trims: this is worked out for each run of each name.
    """
    digits = F.coalesce(F.nullif(F.ltrim(run, F.lit("0")), F.lit("")), F.lit("0"))
    keyed = F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)
    return F.when((run >= "0") & (run < ":"), keyed).otherwise(run)


def natural_key(text: Column) -> Column:
    """Sortable array in which digit runs compare as integers of any length."""
    runs = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), 1)
    lead = F.when(text.rlike(r"^\d"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(lead, F.transform(runs, _run_key))


def natural_text(text: Column) -> Column:
    """One string that sorts by code points as alignment tools sort names: digit runs as integers.

    A run becomes the number of its digits and the digits, without leading zeros; other characters
    stay, so a digit meets another character as itself. Names that differ in leading zeros only are
    equal here. The key of a name is as long as the name and seven characters per run, and range
    partitioning can cut between any two of them.
    """
    runs = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(runs, _run_key), "")


def numeric_suffix(text: Column) -> Column:
    """Trailing number of a name such as ``SimulatedSample12``; NULL without one."""
    return F.nullif(F.regexp_extract(text, r"(\d+)$", 1), F.lit("")).try_cast("bigint")


def list_order(value: Column, order: Sequence[str]) -> Column:
    """Position in a fixed list; values outside it come last."""
    position = F.array_position(F.array(*[F.lit(v) for v in order]), value)
    return F.when(position > 0, position).otherwise(F.lit(len(order) + 1)).cast("int")


def text_from(text: Column, needle: str) -> Column:
    """Substring from the first ``needle`` on, or the fixed message when absent."""
    at = F.instr(text, needle)
    return F.when(at > 0, F.substr(text, at)).otherwise(F.lit("Substring not found"))


def archive_link(sample: Column, base: str) -> Column:
    """Link of a report cell."""
    return F.concat(F.lit(base), sample)


def fold_ascii(text: Column) -> Column:
    """Lower-case A to Z only, as case-insensitive regular expressions do."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
