"""Benchmark decontamination by templates: catches questions whose numbers, units or names changed.

Words become template tokens: a number with its unit, or a run of names, is one typed placeholder,
and other words stand for themselves. Windows of template tokens meet the benchmark's windows in a
hash join. Matches of one document and item along neighbouring diagonals are then one passage, which
counts if it covers enough of the item and the values in its slots replace those of the item one for one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lineamix.llm.common import table, written
from lineamix.llm.words import SMALL_PART, hash_spans, mix, parts, words_of

WINDOW = 5
#: Share of an item's words that a passage must cover, or so many of them in one run.
COVERAGE, LONG_RUN = 0.8, 20
#: Words by which neighbouring windows of a passage may move against each other.
DRIFT = 4
#: A window with fewer literal words than this matches by its values too.
LITERALS = 3
#: Bits of the filter that documents' windows pass before the join: its size whatever the benchmark.
FILTER_BITS = 1 << 24
_BITMAP_BITS = 32768

UNITS = (
    "%", "$", "€", "£", "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "mile", "miles", "mg", "g", "kg", "gram", "grams",
    "ton", "tons", "lb", "pounds", "ml", "l", "liter", "liters", "litre", "litres", "s", "sec", "second", "seconds", "min",
    "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "cent",
    "cents", "dollar", "dollars", "euro", "euros", "percent", "degrees", "mph", "km/h", "watt", "watts", "kw", "kb", "mb", "gb",
)
NUMBER_WORDS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen",
    "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty",
    "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion",
)
LITERAL, NUMBER, NAME = 0, 1, 2
_MARK = mix(np.arange(1, 4, dtype=np.uint64))
_ODD = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)

WINDOWS = "id bigint, text_hash bigint, window bigint, position bigint, after bigint, words bigint, sure boolean, slots array<bigint>"
_WINDOW_TYPE = pa.schema([
    ("id", pa.int64()), ("text_hash", pa.int64()), ("window", pa.int64()), ("position", pa.int64()), ("after", pa.int64()),
    ("words", pa.int64()), ("sure", pa.bool_()), ("slots", pa.list_(pa.int64())),
])


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_TRIM = _flags(".,;:!?\"'()[]{}*_`")
_BEFORE = _flags("\"'([{*_`$+-#")
_DIGIT, _CAPITAL, _STOP = _flags("0123456789"), _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _flags(".!?:\"\n")


def _hashes(words: tuple[str, ...]) -> np.ndarray:
    return np.sort(words_of(pa.array([" ".join(words)])).hashes)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


class Template:
    """Words of some texts and what they may be; ``readings`` have the template tokens."""

    def __init__(self, texts: pa.Array):
        w = words_of(texts)
        self.text_at = w.text_at
        starts, ends = w.starts.copy(), w.ends.copy()
        for _ in range(3):
            starts += (ends - starts > 1) & _BEFORE[w.data[starts]] if len(starts) else 0
            ends -= (ends - starts > 1) & _TRIM[w.data[ends - 1]] if len(ends) else 0
        value = hash_spans(w.data, starts, ends)
        n = len(value)
        first = w.data[starts] if n else np.zeros(0, np.uint8)
        second = w.data[np.minimum(starts + 1, ends - 1)] if n else first
        number = _DIGIT[first] | _among(value, _hashes(NUMBER_WORDS))
        after = np.ones(n, bool)  # begins a sentence: first of its text, or after a stop or a line break
        opening = w.text_at[:-1][np.diff(w.text_at) > 0]
        if n:
            breaks = np.cumsum(w.data == 0x0A)
            after[1:] = _STOP[w.data[w.ends[:-1] - 1]] | (breaks[w.starts[1:]] != breaks[w.ends[:-1] - 1])
            after[opening] = True
        accented = (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)
        capital = (accented | (_CAPITAL[first] & ~_CAPITAL[second] & (ends - starts > 1))) & ~number
        unit = np.zeros(n, bool)
        unit[1:] = number[:-1] & _among(value[1:], _hashes(UNITS)) & ~number[1:]
        unit[opening] = False
        none = np.zeros(n, bool)
        #: Names inside sentences, names anywhere, and no names: what else a capital may mean. Of the
        #: last two only windows with a word that they read otherwise are of use.
        self.readings = [
            Reading(w.text_at, opening, value, number, unit, name, odd)
            for name, odd in ((capital & ~after, None), (capital, capital & after), (none, capital & ~after))
        ]


class Reading:
    """Template tokens: ``kind``, ``token`` (hash that windows use), ``value``, ``at``, and where each begins and ends in words."""

    def __init__(self, text_at, opening, value, number, unit, name, odd):
        n = len(value)
        kind = np.where(number | unit, NUMBER, np.where(name, NAME, LITERAL))
        # A placeholder that goes on is no token of its own: units, further names, "two hundred".
        goes_on = np.zeros(n, bool)
        goes_on[1:] = unit[1:] | ((kind[1:] == kind[:-1]) & (kind[1:] != LITERAL))
        goes_on[opening] = False
        keep = np.flatnonzero(~goes_on)
        position = np.arange(n, dtype=np.uint64) - np.repeat(keep, np.diff(np.append(keep, n))).astype(np.uint64) if n else value
        self.value = np.add.reduceat(value * (position * np.uint64(2) + np.uint64(1)), keep) if n else value
        self.kind = kind[keep]
        self.token = np.where(self.kind == LITERAL, self.value, _MARK[self.kind])
        self.at = np.searchsorted(keep, text_at)
        self.first, self.after = keep, np.append(keep, n)[1:]
        self.odd = None if odd is None else np.concatenate([[0], np.cumsum(odd)])

    def windows(self, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(template hash, hash with values, first token, tokens) of every window.

        A text with fewer tokens is one window. A window with fewer than ``LITERALS`` literal words,
        or with all of a short text, has no template of its own: that alone says little. The two
        hashes are equal where a window has no placeholder, so that words which capitals make a
        name in one text and not in the other still match.
        """
        sizes = np.diff(self.at)
        counts = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
        owner = np.repeat(np.arange(len(sizes)), counts)
        begin = self.at[:-1][owner] + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        length = np.minimum(sizes, width)[owner]
        plain = valued = np.zeros(len(begin), np.uint64)
        literal = np.zeros(len(begin), np.int64)
        for k in range(width):
            inside = k < length
            at = np.where(inside, begin + k, 0)
            plain = plain + np.where(inside, self.token[at] * _ODD[k], np.uint64(0)) if len(self.token) else plain
            valued = valued + np.where(inside, self.value[at] * _ODD[k], np.uint64(0)) if len(self.token) else valued
            literal += inside & (self.kind[at] == LITERAL) if len(self.token) else 0
        weak = (literal < LITERALS) | (length < width)
        size = length.astype(np.uint64)
        return mix(np.where(weak, valued, plain) + size), mix(valued + size), begin, length


def template_windows(rows: DataFrame, passing: bytes | None = None, width: int = WINDOW) -> DataFrame:
    """``WINDOWS`` of rows (id, text_hash, text): hash, first word, word after, and slot values of each window.

    A window with placeholders comes out as template, with its slots, and with its values filled
    in, without. ``words`` is the number of words that the text has; windows that take a capital at
    the beginning of a sentence for a name, or no capital for one, are not ``sure``. With a bitmap
    in ``passing`` only windows whose bit is set come out. NULL and empty texts have none.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if passing is None else np.frombuffer(passing, np.uint8)
        for batch in batches:
            begin = 0
            for part in parts(batch.column(2), SMALL_PART):
                yield from _rows(batch.slice(begin, len(part)), part, bits)
                begin += len(part)

    def _rows(batch: pa.RecordBatch, texts: pa.Array, bits: np.ndarray | None) -> list[pa.RecordBatch]:
        t = Template(texts)
        return pa.Table.from_batches([_windows(batch, t, r, k == 0, bits) for k, r in enumerate(t.readings)]).combine_chunks().to_batches()

    def _windows(batch: pa.RecordBatch, whole: Template, t: Reading, sure: bool, bits: np.ndarray | None) -> pa.RecordBatch:
        window, valued, begin, length = t.windows(width)
        if t.odd is not None:
            use = np.flatnonzero(t.odd[t.after[begin + length - 1]] > t.odd[t.first[begin]]) if len(begin) else begin
            window, valued, begin, length = (x[use] for x in (window, valued, begin, length))
        other = np.flatnonzero(valued != window)
        filled = np.arange(len(window) + len(other)) >= len(window)
        window, (begin, length) = np.concatenate([window, valued[other]]), (np.concatenate([x, x[other]]) for x in (begin, length))
        if bits is not None:
            bit = _bit(window)
            kept = np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
            window, begin, length, filled = (x[kept] for x in (window, begin, length, filled))
        owner = np.searchsorted(t.at, begin, "right") - 1
        slots = [
            [] if f else [int(t.value[i].view(np.int64)) for i in range(b, b + n) if t.kind[i] != LITERAL]
            for b, n, f in zip(begin.tolist(), length.tolist(), filled.tolist())
        ]
        origin = whole.text_at[:-1][owner]
        first = t.first[begin] if len(begin) else begin
        after = t.after[begin + length - 1] if len(begin) else begin
        return pa.RecordBatch.from_arrays([
            batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), pa.array(window.view(np.int64)),
            pa.array(first - origin, pa.int64()), pa.array(after - origin, pa.int64()), pa.array(np.diff(whole.text_at)[owner], pa.int64()),
            pa.array(np.full(len(begin), sure)), pa.array(slots, pa.list_(pa.int64())),
        ], schema=_WINDOW_TYPE)

    return rows.select("id", "text_hash", "text").mapInArrow(scan, WINDOWS)


def _bit(window: np.ndarray) -> np.ndarray:
    return (window & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def window_bitmap(windows: DataFrame) -> bytes:
    """Which of ``FILTER_BITS`` bits the windows' hashes have: some megabytes at most."""
    bit = F.col("window").bitwiseAND(F.lit(FILTER_BITS - 1))
    maps = windows.select((bit / _BITMAP_BITS).cast("int").alias("n"), (bit % _BITMAP_BITS).alias("bit"))
    out = bytearray(FILTER_BITS // 8)
    for row in maps.groupBy("n").agg(F.bitmap_construct_agg("bit").alias("map")).collect():
        out[row.n * _BITMAP_BITS // 8:(row.n + 1) * _BITMAP_BITS // 8] = row.map
    return bytes(out)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, width: int = WINDOW, id_col: str = "doc_id",
    text_col: str = "text", item_col: str = "item_id",
) -> DataFrame:
    """(doc_id, text_hash, item_id, windows, matched, changed_slots): passages of items in documents.

    A passage is a chain of windows that stand in the item's order and move against it by ``DRIFT``
    words at most from one to the next. It counts if it covers ``coverage`` of the item's words or
    ``LONG_RUN`` of them in a row, and if equal slot values of the item stand for equal values in
    the document and different ones for different ones. ``windows`` is the number of the item's
    words and ``matched`` how many of them are covered.
    ``changed_slots`` is the number of item values that were replaced, 0 for a verbatim copy. Of
    several passages of one item in one document the fullest is given. An item with fewer tokens
    than a window only matches a document that is nothing else; items without words match none.
    """
    items = benchmark.select(F.col(item_col).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("text_hash"), F.col(text_col).alias("text"))
    wanted = written(template_windows(items, width=width), "windows")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    found = template_windows(rows, window_bitmap(wanted), width)
    wanted = wanted.select("window", F.col("id").alias("item_id"), F.col("position").alias("q"), F.col("after").alias("q_after"),
                           F.col("words").alias("windows"), F.col("sure").alias("item_sure"), F.col("slots").alias("item_slots"))
    met = found.select("window", F.col("id").alias("doc_id"), "text_hash", F.col("position").alias("p"), "sure", "slots").join(wanted, "window")
    # Short texts are one window of all their tokens; they only match texts as short.
    match = F.struct("p", "q", "q_after", (F.col("sure") & F.col("item_sure")).alias("sure"), "item_slots", "slots")
    grouped = met.groupBy("doc_id", "text_hash", "item_id").agg(
        F.first("windows").alias("windows"), F.collect_set(F.struct("q", "q_after")).alias("spans"), F.collect_list(match).alias("matches")
    )
    most = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["q_after"] - x["q"])
    enough = F.least(F.lit(coverage) * F.col("windows"), F.lit(LONG_RUN))

    @F.udf("matched int, changed_slots int")
    def best(matches, words):
        return best_passage(matches, words, coverage, width)

    return grouped.where(most >= enough).select("doc_id", "text_hash", "item_id", "windows", best("matches", "windows").alias("best")).where(
        "best IS NOT NULL"
    ).select("doc_id", "text_hash", "item_id", "windows", F.col("best.matched").cast("bigint").alias("matched"), "best.changed_slots")


def best_passage(matches: list, words: int, coverage: float = COVERAGE, width: int = WINDOW) -> tuple[int, int] | None:
    """(covered words, changed slots) of the fullest passage that counts, of equals the least changed."""
    reach = 2 * width + DRIFT + int((1 - coverage) * words)
    places: dict[int, list] = {}
    for m in matches:
        places.setdefault(m[0], []).append(m)
    chains: list[list] = []
    ended: list[list] = []
    for p in sorted(places):
        ended += [c for c in chains if p - c[-1][0] > reach]
        chains = [c for c in chains if p - c[-1][0] <= reach]
        # The nearest diagonals first; a chain has one place of the item for each of the document.
        fits = sorted(
            (abs((p - m[1]) - (c[-1][0] - c[-1][1])), k, i) for i, m in enumerate(places[p]) for k, c in enumerate(chains)
            if abs((p - m[1]) - (c[-1][0] - c[-1][1])) <= DRIFT and m[1] >= c[-1][1])
        taken: dict[int, int] = {}
        joined = set()
        for _, k, i in fits:
            m = places[p][i]
            if i not in joined and taken.setdefault(k, m[1]) == m[1]:
                chains[k].append(m)
                joined.add(i)
        opened: dict[int, list] = {}
        for i, m in enumerate(places[p]):
            if i not in joined:
                opened.setdefault(m[1], []).append(m)
        chains += opened.values()
    found = [x for c in ended + chains if (x := _judged(c, words, coverage))]
    return max(found, key=lambda x: (x[0], -x[1]), default=None)


def _judged(chain: list, words: int, coverage: float) -> tuple[int, int] | None:
    longest = reached = 0
    begin = -1
    for q, after in sorted({(m[1], m[2]) for m in chain}):
        begin, reached = (q, max(after, reached)) if begin < 0 or q > reached else (begin, max(after, reached))
        longest = max(longest, reached - begin)
    have = bytearray(words)
    for m in chain:
        have[m[1]:m[2]] = b"\1" * (m[2] - m[1])
    covered = sum(have)
    if covered < coverage * words and longest < LONG_RUN:
        return None
    # Sentence beginnings may be names or not, so that their values decide nothing.
    pairs = {x for m in chain if m[3] for x in zip(m[4], m[5])}
    if not len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs):
        return None
    # Nor do they count as changed where another reading has the same words in the same place.
    same = bytearray(words)
    for m in chain:
        if m[4] == m[5]:
            same[m[1]:m[2]] = b"\1" * (m[2] - m[1])
    told = [m for m in chain if m[3] or not all(same[m[1]:m[2]])]
    return covered, len({a for m in told for a, b in zip(m[4], m[5]) if a != b})


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without passages of the benchmark, with all their columns."""
    found = contaminated(docs, benchmark, coverage, id_col=id_col, text_col=text_col)
    gone = written(found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "contaminated")
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text_col)) == F.col("__hash"))
    return docs.join(gone, same, "left_anti")


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents: a row for each document and item, fullest passage of each."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(
        F.max("windows").alias("windows"), F.max("matched").alias("matched"), F.min("changed_slots").alias("changed_slots")
    )
