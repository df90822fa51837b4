"""Toxicity: misspelled lexicon terms by Levenshtein automata on a trie, weighed by their context.

The lexicon is learned from two halves of a labelled sample: each half proposes words that its toxic
documents have and its other documents do not, and the other half tells what each term is worth at
each edit distance. Of the different words of a batch, those that share a deletion with a term run
as automata over the trie of the lexicon; hits are then weighed by what stands around them, and a
logistic model turns quoted and unquoted evidence into a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lineamix.llm.common import table, written
from lineamix.llm.quality import remainder, sample
from lineamix.llm.words import Words, mix, parts, words_of

#: Labelled rows to learn from at most.
SAMPLE_ROWS = 20_000
#: A term is in so many toxic sample documents at least (and in this share of them), and so large a
#: share of the documents that have it is toxic.
LEAST_DOCS, LEAST_PART, LEAST_SHARE = 5, 0.004, 0.9
#: Beginnings of words are proposed if so many different toxic words have them, and nearly no others.
STEM_LENGTHS, STEM_WORDS, STEM_SHARE = (4, 5, 6, 7, 8), 3, 0.97
#: So large a share of the other half's documents with a term must be toxic, and so many of them.
CONFIRMED_SHARE, CONFIRMED_DOCS = 0.8, 2
#: A misspelling counts as so many documents, toxic as often as the term's, before any is seen.
NEAR_TRUST = 2.0
#: Words on each side of a hit that are its context.
WINDOW = 8
THRESHOLD = 0.7
QUOTES = "\"'`“”„‘’‚«»‹›"
#: What the features are worth before data speak, and how much data it takes to move them.
PRIOR, TRUST = (1.6, 0.8, 0.1, 0.3, 0.0, -3.5), 4.0
_STRIP = QUOTES + ".,;:!?()[]{}<>*_#|%&$@~-…"
_OPENING, _CLOSING = tuple("\"“„‘«‹`'"), tuple("\"”’»›`'")
#: Signs that stand for letters in disguised words.
_DISGUISE = str.maketrans("013457@$", "oieastas")
_SIGNS = frozenset("013457@$")
END = ""
STEM = "*"
#: Odd multiplier of the rolling hash and its inverse: leaving a letter out shifts what follows.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BACK_TWICE = np.uint64(pow(int(_BASE), -2, 1 << 64))
_BITS = 22


def edits(term_length: int) -> int:
    """Misspellings that are looked for: none in short terms, two in long ones."""
    return 0 if term_length < 5 else 1 if term_length < 8 else 2


class LevenshteinAutomaton:
    """Accepts strings within ``most`` edits of ``word``.

    A state holds, for each number of edits up to ``most``, a bit set of how many letters of the
    word may have been matched so far with that many edits.
    """

    def __init__(self, word: str, most: int):
        self.most, self.last, self.bits = most, len(word), (2 << len(word)) - 1
        self.letters: dict[str, int] = {}
        for i, letter in enumerate(word):
            self.letters[letter] = self.letters.get(letter, 0) | 2 << i

    def start(self) -> tuple[int, ...]:
        return tuple(((2 << d) - 1) & self.bits for d in range(self.most + 1))

    def step(self, state: tuple[int, ...], letter: str) -> tuple[int, ...]:
        fits = self.letters.get(letter, 0)
        fewer, after = state[0], (state[0] << 1) & fits
        out = [after]
        for same in state[1:]:
            # Match, or one more edit: letter inserted, replaced, or letter of the word left out.
            after = (((same << 1) & fits) | fewer | (fewer << 1) | (after << 1)) & self.bits
            out.append(after)
            fewer = same
        return tuple(out)

    def distance(self, state: tuple[int, ...]) -> int | None:
        return next((d for d, places in enumerate(state) if places >> self.last & 1), None)


def shortened(words: list[str], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, hash) of each word with up to ``most`` (0, 1, 2) letters left out, every way.

    Two strings within k edits have a string in common among those with up to k letters left out.
    """
    owners, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    lengths = np.array([len(w) for w in words], np.int64)
    for n in np.unique(lengths).tolist():
        chosen = np.flatnonzero(lengths == n)
        letters = np.frombuffer("".join(words[i] for i in chosen).encode("utf-32-le"), np.uint32).reshape(len(chosen), n)
        power = np.multiply.accumulate(np.full(n, _BASE, np.uint64)) if n else np.zeros(0, np.uint64)
        upto = np.zeros((len(chosen), n + 1), np.uint64)
        np.cumsum(mix(letters.astype(np.uint64) + np.uint64(1)) * power, axis=1, out=upto[:, 1:])
        total = upto[:, -1:]
        found = [total]
        if most >= 1:
            found.append(upto[:, :-1] + (total - upto[:, 1:]) * _BACK)
        if most >= 2 and n >= 2:
            i, j = np.triu_indices(n, 1)
            found.append(upto[:, i] + (upto[:, j] - upto[:, i + 1]) * _BACK + (total - upto[:, j + 1]) * _BACK_TWICE)
        found = np.concatenate(found, axis=1)
        owners.append(np.repeat(chosen, found.shape[1]))
        hashes.append(mix(found.ravel()))
    return np.concatenate(owners), np.concatenate(hashes)


class _Neighbourhood:
    """Hashes of terms with letters left out: a bit table before an exact search."""

    def __init__(self, terms: list[str], most: int):
        self.most = most
        self.hashes = np.unique(shortened(terms, most)[1])
        self.table = np.zeros(1 << _BITS, bool)
        self.table[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.lengths = {n for t in terms for n in range(len(t) - most, len(t) + most + 1)}

    def near(self, words: list[str]) -> np.ndarray:
        """Numbers of the words that have such a hash in common with a term."""
        if not len(self.hashes):
            return np.zeros(0, np.int64)
        fit = [i for i, w in enumerate(words) if len(w) in self.lengths]
        out = []
        for begin in range(0, len(fit), 20_000):
            some = fit[begin:begin + 20_000]
            owners, hashes = shortened([words[i] for i in some], self.most)
            maybe = np.flatnonzero(self.table[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            sure = maybe[self.hashes[place] == hashes[maybe]]
            out.append(np.array(some, np.int64)[np.unique(owners[sure])])
        return np.concatenate([np.zeros(0, np.int64), *out])


@dataclass
class Lexicon:
    """Terms with the evidence (log odds) of an exact hit and of hits one and two edits away.

    A term that ends with ``*`` is a beginning of words, found as it is written. ``harmless`` are words near a term that clean documents use: no hits. Terms of any number and
    length take part; they travel with the tasks, some hundred bytes each.
    """

    terms: dict[str, tuple[float, float, float]]
    harmless: frozenset[str] = frozenset()
    trie: dict = field(default_factory=dict)

    def __post_init__(self):
        by_edits: dict[int, list[str]] = {1: [], 2: []}
        self.stem_lengths = sorted({len(t) - 1 for t in self.terms if t[-1] == STEM})
        for term in sorted(self.terms):
            if term[-1] != STEM and (k := edits(len(term))):
                by_edits[k].append(term)
                node = self.trie
                for letter in term:
                    node = node.setdefault(letter, {})
                node[END] = term
        self.around = [_Neighbourhood(terms, k) for k, terms in by_edits.items()]

    def nearest(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its distance by automata on the trie, of equals the first by name."""
        if word in self.terms:
            return word, 0
        automaton = LevenshteinAutomaton(word, edits(len(word) + 2))
        best, stack = None, [(self.trie, automaton.start())]
        while stack:
            node, state = stack.pop()
            for letter, child in node.items():
                if letter == END:
                    d = automaton.distance(state)
                    if d is not None and d <= edits(len(child)) and (best is None or (d, child) < best):
                        best = (d, child)
                elif (after := automaton.step(state, letter))[-1]:
                    stack.append((child, after))
        return best and (best[1], best[0])

    def hits(self, words: list[str]) -> dict[int, tuple[str, int]]:
        """Word number to (term, distance), for different words in lower case without signs around.

        A word is read as it is and with the letters that signs stand for. As written it is a term,
        or begins with one, or is near one: words that share a deletion with a term are looked up by
        automata.
        """
        plain = {i: w.translate(_DISGUISE) for i, w in enumerate(words) if not w.isdigit() and not _SIGNS.isdisjoint(w)}
        readings = (range(len(words)), words), (list(plain), list(plain.values()))
        found: dict[int, tuple[str, int]] = {}
        for numbers, forms in readings:
            for i, form in zip(numbers, forms):
                if form in self.terms:
                    found.setdefault(i, (form, 0))
                else:
                    for n in self.stem_lengths:
                        if len(form) >= n and (stem := form[:n] + STEM) in self.terms:
                            found.setdefault(i, (stem, 0))
                            break
        for numbers, forms in readings:
            for k in np.concatenate([a.near(forms) for a in self.around]).tolist():
                i = numbers[k]
                if i not in found and words[i] not in self.harmless and (hit := self.nearest(forms[k])):
                    found[i] = hit
        return found

    def evidence(self, hit: tuple[str, int]) -> float:
        return self.terms[hit[0]][hit[1]]


FEATURES = 5


def _different(w: Words) -> tuple[list[str], np.ndarray]:
    """The different words of a batch, lower-cased and without signs around them; which each word is."""
    _, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
    size = w.ends[first] - w.starts[first]
    at = np.concatenate([[0], np.cumsum(size)])
    letters = w.data[np.repeat(w.starts[first] - at[:-1], size) + np.arange(at[-1])]
    words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(letters.astype(np.uint8)))
    coded = pc.dictionary_encode(pc.utf8_trim(pc.utf8_lower(words), characters=_STRIP))
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)[inverse]


def word_hits(texts: pa.Array, lexicon: Lexicon) -> Iterator[list[tuple[str, int, str]]]:
    """Per text the different hits (term, distance, word)."""
    for part in parts(texts):
        w = words_of(part)
        words, which = _different(w) if len(w.hashes) else ([], np.zeros(0, np.int64))
        hits = lexicon.hits(words)
        is_hit = np.zeros(len(words), bool)
        is_hit[list(hits)] = True
        for a, b in zip(w.text_at[:-1], w.text_at[1:]):
            yield [(*hits[i], words[i]) for i in np.unique(which[a:b][is_hit[which[a:b]]]).tolist()]


def hit_features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Per text: evidence of unquoted hits and its largest, of quoted and of crowded hits, density."""
    rows = [_features(part, lexicon) for part in parts(texts)]
    return np.concatenate(rows) if rows else np.zeros((0, FEATURES))


def _features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    w = words_of(texts)
    out = np.zeros((len(texts), FEATURES))
    if not len(w.hashes):
        return out
    raw = w.data.tobytes()

    def word(i: int) -> str:
        return raw[w.starts[i]:w.ends[i]].decode("utf-8", "replace")

    words, which = _different(w)
    weight = np.zeros(len(words))
    for i, hit in lexicon.hits(words).items():
        weight[i] = max(lexicon.evidence(hit), 0.0)
    where = np.flatnonzero(weight[which])
    owner = np.searchsorted(w.text_at, where, "right") - 1
    for n, (i, t) in enumerate(zip(where.tolist(), owner.tolist())):
        mine = weight[which[i]]
        if _quoted(word, i, int(w.text_at[t]), int(w.text_at[t + 1])):
            out[t, 2] += mine
            continue
        crowd = (n > 0 and owner[n - 1] == t and i - where[n - 1] <= WINDOW) or (
            n + 1 < len(where) and owner[n + 1] == t and where[n + 1] - i <= WINDOW)
        out[t, 0] += mine
        out[t, 1] = max(out[t, 1], mine)
        out[t, 3] += mine * crowd
    out[:, 4] = out[:, 0] * 100 / np.maximum(np.diff(w.text_at), 20)
    return np.log1p(out)


def _quoted(word, i: int, first: int, after: int) -> bool:
    """True if a quotation opens before the hit and closes after it inside the window."""
    opens = closes = False
    for j in range(i, max(first, i - WINDOW) - 1, -1):
        text = word(j)
        if j < i and text.rstrip(".,;:!?").endswith(_CLOSING):
            break
        if text.startswith(_OPENING):
            opens = True
            break
    for j in range(i, min(after, i + WINDOW + 1)):
        text = word(j)
        if j > i and text.startswith(_OPENING):
            break
        if text.rstrip(".,;:!?").endswith(_CLOSING):
            closes = True
            break
    return opens and closes


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray  # one per feature, then the constant

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(x @ self.weights[:-1] + self.weights[-1])))


def different_words(texts: pa.Array) -> Iterator[list[str]]:
    """The different words of each text with two letters or more, lower-cased and without signs around them."""
    for text in texts.to_pylist():
        words = {w.strip(_STRIP) for w in (text or "").lower().split()}
        yield sorted(w for w in words if len(w) > 1)


def propose(rows: DataFrame) -> list[str]:
    """Words and beginnings of words of sample rows (text, label) that many toxic texts have and hardly any other.

    Equal texts count once, so that what copies share is no evidence. Rows of one label propose none.
    """
    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array(list(different_words(texts)), pa.list_(pa.string()))

    rows = rows.groupBy("text").agg(F.max("label").alias("label"))
    labelled = rows.agg(F.sum("label")).first()
    least = max(LEAST_DOCS, LEAST_PART * (labelled[0] or 0))
    counted = rows.select(F.explode(split("text")).alias("term"), "label").groupBy("term").agg(
        F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("docs")
    )
    counted = written(counted, "toxicity-terms")
    beginnings = F.transform(F.array(*map(F.lit, STEM_LENGTHS)), lambda n: F.when(n <= F.length("term"), F.substring("term", F.lit(1), n)))
    stems = counted.select(F.explode(beginnings).alias("stem"), "toxic", "docs").where("stem IS NOT NULL").groupBy("stem").agg(
        F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"), F.count_if(F.col("toxic") > 0).alias("words")
    ).where(f"words >= {STEM_WORDS}").withColumnRenamed("stem", "term")

    def fit(terms: DataFrame, share: float) -> list[str]:
        good = terms.where((F.col("toxic") >= least) & (F.col("toxic") / (F.col("docs") + 0.2) >= share))
        return [r.term for r in good.select("term").collect()]

    found: set[str] = set()
    for stem in sorted(fit(stems, STEM_SHARE), key=lambda t: (len(t), t)):
        if not any(stem[:n] in found for n in STEM_LENGTHS):
            found.add(stem)
    return fit(counted, LEAST_SHARE) + [stem + STEM for stem in sorted(found)]


def _log_odds(share: float) -> float:
    return float(np.log(share / (1 - share)))


def confirm(terms: list[str], rows: DataFrame) -> Lexicon:
    """Of proposed terms those that hold in other rows (text, label), with what each distance is worth.

    An exact hit is worth the share of toxic documents among those that have it. A misspelling starts
    with that share and follows the documents that have one, so terms that other words resemble by
    chance lose their misspellings. Near words that clean documents have are harmless.
    """
    draft = Lexicon({t: (1.0, 1.0, 1.0) for t in terms})

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([[f"{d} {t} {w}" for t, d, w in hits] for hits in word_hits(texts, draft)], pa.list_(pa.string()))

    rows = rows.groupBy("text").agg(F.max("label").alias("label"))
    counts = rows.select(F.explode(found("text")).alias("hit"), "label").groupBy("hit").agg(
        F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("docs")
    ).collect()
    toxic, docs, harmless = Counter(), Counter(), set()
    for r in counts:
        d, term, word = r.hit.split(" ", 2)
        toxic[term, int(d)] += r.toxic
        docs[term, int(d)] += r.docs
        if int(d) and r.docs > r.toxic and r.toxic <= r.docs - r.toxic:
            harmless.add(word)
    out = {}
    for term in terms:
        share = (toxic[term, 0] + 0.5) / (docs[term, 0] + 1)
        if share < CONFIRMED_SHARE or toxic[term, 0] < CONFIRMED_DOCS:
            continue
        near = [(toxic[term, d] + NEAR_TRUST * share) / (docs[term, d] + NEAR_TRUST) for d in (1, 2)]
        out[term] = (_log_odds(share), *map(_log_odds, near))
    return Lexicon(out, frozenset(harmless))


def merged(one: Lexicon, other: Lexicon) -> Lexicon:
    """Terms of both; where both have a term, the lesser evidence holds."""
    terms = one.terms | other.terms
    for term in one.terms.keys() & other.terms.keys():
        terms[term] = tuple(map(min, one.terms[term], other.terms[term]))
    return Lexicon(terms, (one.harmless | other.harmless) - terms.keys())


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: tuple[float, ...] = PRIOR, trust: float = TRUST, steps: int = 25) -> np.ndarray:
    """Weights and constant by Newton steps, drawn to ``prior``; that itself if only one label occurs.

    What the sample does not show, such as quotations, keeps the worth it has in the prior.
    """
    start = np.array(prior)
    w = start.copy()
    if not len(y) or y.min() == y.max():
        return w
    z, pull = np.column_stack([x, np.ones(len(x))]), np.r_[np.full(x.shape[1], trust), 1e-3]
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (y - p) - pull * (w - start)
        curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(pull)
        w = w + np.linalg.solve(curve, slope)
    return w


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", most: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn from at most ``most`` labelled documents for which ``learn`` holds.

    Each half of the sample, by hash, judges the terms that the other half proposes, so that all
    evidence comes from documents a term was not chosen from. Bounded by the sample: what is
    broadcast, and the counts of terms and near words that the driver sees.
    """
    chosen = F.broadcast(sample(labels, label, learn, most))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)))
    rows = written(rows.select("doc_id", "text", "label", "half"), "toxicity-sample")
    halves = [rows.where(f"half = {k}") for k in (0, 1)]
    lexicon = merged(*(confirm(propose(halves[k]), halves[1 - k]) for k in (0, 1)))
    found = rows.select(features_column(lexicon, F.col("text")).alias("x"), "label").toArrow()
    x = np.array(found["x"].to_pylist(), float).reshape(-1, FEATURES)
    return ToxicityModel(lexicon, fit_logistic(x, found["label"].to_numpy().astype(float)))


def features_column(lexicon: Lexicon, text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = hit_features(texts, lexicon)
            at = np.arange(len(rows) + 1, dtype=np.int32) * FEATURES
            yield pa.ListArray.from_arrays(pa.array(at), pa.array(rows.ravel()))

    return compute(text)


def score_column(model: ToxicityModel, text: Column) -> Column:
    """Score of each text in (0, 1); NULL and empty texts have that of a text without hits."""
    @F.arrow_udf("double")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.scores(hit_features(texts, model.lexicon)))

    return compute(text)


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of the held-out third are never read for learning."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = train(docs, labels, ~held_out)
    return docs.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), score_column(model, F.col("text")).alias("score")
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
