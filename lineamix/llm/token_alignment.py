"""Alignment of two tokenizers: where their tokens end together, and which tokens overlap.

Character offsets of one and byte spans of the other are coarse cuts; tokens inside one character
are told apart by their decoded bytes. Both tokenizers cut before a single space, so words are
aligned once and remembered. Each chunk of documents numbers its words and id pairs; only a chunk's
different pairs meet the corpus-wide counts, and their counts come back to the chunk.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from lineamix.llm.common import table, written
from lineamix.llm.tokens import BYTE_OF, UNSAFE, definition_of

#: Bytes of text whose words and pairs share one numbering.
CHUNK_BYTES = 10 << 20
#: Words that are aligned in one step, words that a tokenizer gets as one text, and digits of an id at most.
_AT_ONCE, _RUN, _DIGITS = 10_000, 64, 6
#: An id pair is one number: the first id in the upper bits, the second in the lower.
_SHIFT = 32
_SPACE_SIGN = "▁"

_CHUNKS = pa.schema([
    ("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("words", pa.list_(pa.int32())),
    ("word_at", pa.list_(pa.int32())), ("links", pa.list_(pa.int32())),
    ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
])
_CHUNKS_DDL = (
    "chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string,"
    " words array<int>, word_at array<int>, links array<int>, pairs array<bigint>, counts array<bigint>"
)
_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string()),
])
_RESULT_DDL = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint,"
    " groups_sha256 string"
)


class Vocabulary:
    """Decoded bytes of all ids of a tokenizer, one after the other, and the ids as decimal text."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of these ids in a row."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.data[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


@dataclass
class Aligned:
    """Alignments of texts: (tokens of A, of B, groups, links) of each, its links, its groups as text.

    ``ok`` is False, and everything else empty, where a tokenizer's bytes are not those of the text.
    """

    ok: np.ndarray
    sizes: np.ndarray
    links: np.ndarray
    texts: list[bytes]


class Aligner:
    """Tokens of both sides for words (with the space before them) or for whole texts."""

    def __init__(self, definition: str, model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(definition)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        entries = {i: entry for entry, i in json.loads(definition)["model"]["vocab"].items()}
        known = [entries.get(i, "") for i in range(max(entries, default=-1) + 1)]
        self.vocabulary_a = Vocabulary([bytes(BYTE_OF.get(c, 0) for c in e) for e in known])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.is_byte = np.array([self.b.is_byte(i) for i in range(len(pieces))], bool)
        self.vocabulary_b = Vocabulary([
            bytes([int(p[3:5], 16)]) if byte else p.replace(_SPACE_SIGN, " ").encode()
            for p, byte in zip(pieces, self.is_byte)
        ])
        #: What B makes of a space alone.
        self.lone_space = self.b.piece_to_id(_SPACE_SIGN)
        #: A word's tokens do not depend on its neighbours unless a piece goes on after a space.
        self.by_words = not any(_SPACE_SIGN in p.lstrip(_SPACE_SIGN) for p in pieces)
        digits = [str(i).encode() for i in range(max(len(known), len(pieces)))]
        self.digits = np.frombuffer(b"".join(d.ljust(_DIGITS) for d in digits), np.uint8).reshape(-1, _DIGITS)
        self.digit_count = np.array([len(d) for d in digits], np.int64)

    def align(self, texts: list[str], run: int = 1) -> Aligned:
        """A encodes each text after a space, which B adds by itself; links are pair numbers.

        So many words make a ``run``, a text with spaces between them. If it is not what its tokens
        decode to, or a token goes on from word to word, none of its words is ok.
        """
        spaced = [" " + t for t in texts]
        raw = np.frombuffer("".join(spaced).encode(), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in spaced])]).astype(np.int64)
        runs = spaced if run == 1 else ["".join(spaced[i:i + run]) for i in range(0, len(spaced), run)]
        run_at = np.append(at[:-1:run], at[-1])
        ids_a, ends_a, at_a = self._a_ends(runs, run_at)
        ids_b, ends_b, at_b = self._b_ends(texts if run == 1 else [r[1:] for r in runs], run_at)
        ok = np.ones(len(runs), bool)
        for vocabulary, ids, begin in ((self.vocabulary_a, ids_a, at_a), (self.vocabulary_b, ids_b, at_b)):
            ok &= _sums(vocabulary.sizes[ids], begin) == np.diff(run_at)
        if ok.all() and len(texts):
            for vocabulary, ids in ((self.vocabulary_a, ids_a), (self.vocabulary_b, ids_b)):
                ok &= _sums(vocabulary.decoded(ids) != raw, run_at) == 0
        if not ok.all():
            return self._without(texts, np.repeat(ok, run)[:len(texts)], run)
        ending = np.zeros(len(raw) + 1, np.uint8)
        ending[ends_a] = 1
        ending[ends_b] += 2
        atoms, cuts = np.flatnonzero(ending), np.flatnonzero(ending == 3)
        if run > 1:
            apart = ending[at[1:]] == 3
            if not apart.all():
                whole = np.logical_and.reduceat(apart, np.arange(0, len(texts), run))
                return self._without(texts, np.repeat(whole, run)[:len(texts)], run)
            at_a, at_b = np.searchsorted(ends_a, at, "right"), np.searchsorted(ends_b, at, "right")
        links = ids_a[np.searchsorted(ends_a, atoms)] << _SHIFT | ids_b[np.searchsorted(ends_b, atoms)]
        sizes = np.stack([
            np.diff(at_a), np.diff(at_b), np.diff(np.searchsorted(cuts, at, "right")), np.diff(np.searchsorted(atoms, at, "right")),
        ], axis=1)
        return Aligned(ok if run == 1 else np.ones(len(texts), bool), sizes, links, self._group_texts(ids_a, ends_a, ids_b, ends_b, cuts, at))

    def _without(self, texts: list[str], ok: np.ndarray, run: int) -> Aligned:
        """Alignments of those that are ok, empty ones for the others."""
        rest = self.align([t for t, good in zip(texts, ok) if good], run)
        good = ok.copy()
        good[ok] = rest.ok
        sizes = np.zeros((len(texts), 4), np.int64)
        sizes[ok] = rest.sizes
        kept = iter(rest.texts)
        return Aligned(good, sizes, rest.links, [next(kept) if x else b"" for x in ok])

    def _a_ends(self, spaced: list[str], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A, where each ends among the bytes of all texts, and where each text's begin.

        Ends are those of the character offsets, but for a token whose last character goes on in the
        next token: there the decoded bytes tell.
        """
        found = self.a.encode_batch(spaced, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), np.int64)
        offsets = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in found)), np.int64).reshape(-1, 2)
        begin = np.concatenate([[0], np.cumsum([len(e) for e in found])]).astype(np.int64)
        text_of = np.repeat(np.arange(len(spaced)), np.diff(begin))
        letters = np.frombuffer("".join(spaced).encode("utf-32-le"), np.uint32)
        byte_at = np.concatenate([[0], np.cumsum(1 + (letters >= 0x80) + (letters >= 0x800) + (letters >= 0x10000).astype(np.int64))])
        letter_at = np.concatenate([[0], np.cumsum([len(t) for t in spaced])]).astype(np.int64)
        ends = byte_at[letter_at[text_of] + offsets[:, 1]]
        shared = np.zeros(len(ids), bool)
        shared[:-1] = (offsets[1:, 0] < offsets[:-1, 1]) & (text_of[1:] == text_of[:-1])
        return ids, np.where(shared, self._decoded_ends(self.vocabulary_a, ids, begin, text_of, at), ends), begin

    def _b_ends(self, texts: list[str], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_a_ends``: byte spans, which leave out the space before a text; byte pieces by decoded bytes."""
        found = self.b.encode(texts, return_type="offset_mapping", return_bytes=True, num_threads=1)
        alone = {"ids": [self.lone_space], "offsets": [(0, 0)]}
        found = [f if t else alone for f, t in zip(found, texts)]
        ids = np.fromiter(chain.from_iterable(f["ids"] for f in found), np.int64)
        offsets = np.fromiter(chain.from_iterable(chain.from_iterable(f["offsets"] for f in found)), np.int64).reshape(-1, 2)
        begin = np.concatenate([[0], np.cumsum([len(f["ids"]) for f in found])]).astype(np.int64)
        text_of = np.repeat(np.arange(len(texts)), np.diff(begin))
        ends = at[text_of] + 1 + offsets[:, 1]
        return ids, np.where(self.is_byte[ids], self._decoded_ends(self.vocabulary_b, ids, begin, text_of, at), ends), begin

    @staticmethod
    def _decoded_ends(vocabulary: Vocabulary, ids: np.ndarray, begin: np.ndarray, text_of: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(vocabulary.sizes[ids])])
        return total[1:] - total[begin[text_of]] + at[text_of]

    def _group_texts(self, ids_a: np.ndarray, ends_a: np.ndarray, ids_b: np.ndarray, ends_b: np.ndarray, cuts: np.ndarray, at: np.ndarray) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text: digits and signs are laid out for all texts at once."""
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        place_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)
        place_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")
        ids, signs = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = ids_a, ids_b
        last_a, last_b = (np.flatnonzero(np.diff(g, append=-1)) for g in (group_a, group_b))
        signs[place_a[last_a]] = ord("|")
        signs[place_b[last_b]] = np.where(np.isin(cuts, at[1:]), ord("\n"), ord(";"))
        width = self.digit_count[ids]
        start = np.cumsum(width + 1) - width - 1
        out = np.empty(int(width.sum()) + len(ids), np.uint8)
        for k in range(_DIGITS):
            has = np.flatnonzero(width > k)
            out[start[has] + k] = self.digits[ids[has], k]
        out[start + width] = signs
        return out.tobytes().split(b"\n")[:-1]


@lru_cache(maxsize=2)
def _aligner(definition: str, model: bytes) -> Aligner:
    return Aligner(definition, model)


class _Chunk:
    """Documents of a task until their texts reach the chunk's size: words by number, links by word."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.word_no: dict = {}
        self.sizes, self.links = np.zeros((0, 4), np.int64), []
        self.texts: list[bytes] = []
        self.times = np.zeros(0, np.int64)

    def add(self, keys: list, words: list[str], aligner: Aligner, run: int = 1) -> np.ndarray:
        """Numbers of these different words or whole texts; -1 for those without tokens.

        Words of a ``run`` that does not come out whole are aligned one by one.
        """
        known = self.word_no
        new = [i for i, key in enumerate(keys) if key not in known]
        sizes = [self.sizes]

        def aligned(some: list[int], run: int) -> list[int]:
            found = aligner.align([words[i] for i in some], run)
            first = len(self.texts)
            numbers = np.where(found.ok, first + np.cumsum(found.ok) - 1, -1).tolist()
            known.update((keys[i], no) for i, no in zip(some, numbers))
            sizes.append(found.sizes[found.ok])
            self.links.append(found.links)
            self.texts += found.texts if found.ok.all() else [t for t, good in zip(found.texts, found.ok) if good]
            return [i for i, no in zip(some, numbers) if no < 0]

        for begin in range(0, len(new), _AT_ONCE):
            left = aligned(new[begin:begin + _AT_ONCE], run)
            if left and run > 1:
                aligned(left, 1)
        self.sizes = np.concatenate(sizes)
        return np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))

    def count(self, numbers: np.ndarray) -> None:
        more = np.bincount(numbers, minlength=len(self.texts))
        more[:len(self.times)] += self.times
        self.times = more

    def summary(self) -> pa.RecordBatch:
        """The row that holds the chunk's pairs, their counts, and the links of each word."""
        sizes = self.sizes[:, 3]
        pairs, places = np.unique(np.concatenate(self.links), return_inverse=True)
        counts = np.bincount(places, np.repeat(self.times, sizes), len(pairs)).astype(np.int64)
        return _batch({
            "chunk": [self.number], "word_at": [np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)],
            "links": [places.astype(np.int32)], "pairs": [pairs], "counts": [counts],
        }, 1)


def _batch(columns: dict, rows: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns.get(f.name, [None] * rows), f.type)
        for f in _CHUNKS
    ], schema=_CHUNKS)


def _aligned(definition: str, model: bytes, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(definition, model)
        base, count = TaskContext.get().partitionId() << 32, 0
        chunk = _Chunk(base)
        for batch in batches:
            for part in _parts(batch, 4 << 20):
                yield _documents(aligner, chunk, part)
                if chunk.bytes >= chunk_bytes:
                    yield chunk.summary()
                    count += 1
                    chunk = _Chunk(base + count)
        if chunk.texts:
            yield chunk.summary()
    return run


def _parts(batch: pa.RecordBatch, most_bytes: int) -> Iterator[pa.RecordBatch]:
    lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    total, begin = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and total + n > most_bytes:
            yield batch.slice(begin, i - begin)
            total, begin = 0, i
        total += int(n)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _documents(aligner: Aligner, chunk: _Chunk, part: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of the documents of one part; their words get numbers in the chunk."""
    texts = pc.fill_null(part.column(1).cast(pa.large_string()), "")
    chunk.bytes += int(pc.sum(pc.binary_length(texts)).as_py() or 0)
    spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
    whole = pc.match_substring_regex(spaced, UNSAFE).to_numpy(zero_copy_only=False) if aligner.by_words else np.ones(len(texts), bool)
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    split = pc.split_pattern(texts.filter(pa.array(~whole & ~empty)), " ")
    coded = pc.dictionary_encode(split.flatten())
    different = coded.dictionary.to_pylist()
    numbers = chunk.add(different, different, aligner, _RUN)
    codes = numbers[coded.indices.to_numpy(zero_copy_only=False)] if different else np.zeros(0, np.int64)
    at = split.offsets.to_numpy() - (split.offsets[0].as_py() if len(split) else 0)
    long = list(dict.fromkeys(texts[int(i)].as_py() for i in np.flatnonzero(whole & ~empty)))
    number_of = dict(zip(long, chunk.add([(t,) for t in long], long, aligner).reshape(-1, 1)))
    rows, next_split = [], 0
    for i in range(len(texts)):
        if empty[i]:
            mine = None
        elif whole[i]:
            mine = number_of[texts[i].as_py()]
        else:
            mine = codes[at[next_split]:at[next_split + 1]]
            next_split += 1
        rows.append(None if mine is None or (mine < 0).any() else mine)
    text_of = chunk.texts.__getitem__
    sums = [hashlib.sha256(b";".join(map(text_of, r.tolist()))).hexdigest() if r is not None else "" for r in rows]
    flat = np.concatenate([np.zeros(0, np.int64), *(r for r in rows if r is not None)]).astype(np.int32)
    chunk.count(flat)
    ends = np.concatenate([[0], np.cumsum([0 if r is None else len(r) for r in rows])]).astype(np.int32)
    totals = np.stack([_sums(chunk.sizes[flat, k], ends) for k in range(4)], axis=1)
    return _batch({
        "chunk": np.full(len(rows), chunk.number), "doc_id": part.column(0), "n_a": totals[:, 0], "n_b": totals[:, 1],
        "n_groups": totals[:, 2], "n_links": totals[:, 3], "groups_sha256": sums,
        "words": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
    }, len(rows))


def align(docs: DataFrame, definition: str, model: bytes, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Documents with words by number and, in a row per chunk, that chunk's words, pairs and counts.

    Written to the shared folder: both uses below read it. Texts that are NULL, empty, or changed by
    a tokenizer have no words. Repeated rows and ids stay rows of their own; other columns play no
    part. A chunk is what one task read until ``chunk_bytes`` of text, never less than one text.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(_aligned(definition, model, chunk_bytes), _CHUNKS_DDL), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best): how often ids are linked, and whether that is the most for the second id."""
    counts = _chunk_pairs(aligned).groupBy("pair").agg(F.sum("count").alias("count"))
    return _with_best(counts).select(
        F.shiftright("pair", _SHIFT).cast("int").alias("a"), _second("pair").cast("int").alias("b"), "count", "best"
    )


def _second(pair: str):
    return F.col(pair).bitwiseAND((1 << _SHIFT) - 1)


def _chunk_pairs(aligned: DataFrame) -> DataFrame:
    return aligned.where("pairs IS NOT NULL").select(
        "chunk", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "found")
    ).select("chunk", "place", F.col("found.pairs").alias("pair"), F.col("found.counts").alias("count"))


def _with_best(counts: DataFrame) -> DataFrame:
    """The highest count of each second id has a row per id of one vocabulary: it may be broadcast."""
    most = counts.groupBy(_second("pair").alias("b")).agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), _second("pair") == F.col("b")).select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best")
    )


def scores(aligned: DataFrame) -> DataFrame:
    """Rows of ``_RESULT_DDL``, one per document.

    A pair that every chunk has is one narrow row per chunk; the join with the counts may split it.
    What meets in one group is bounded by the chunk's texts.
    """
    pairs = _chunk_pairs(aligned)
    counts = written(_with_best(pairs.groupBy("pair").agg(F.sum("count").alias("count"))), "pair-counts")
    known = pairs.select("chunk", "place", "pair").join(counts, "pair").select(
        F.col("chunk").alias("home"), "place", "count", "best"
    )
    return aligned.drop("pairs", "counts").groupBy("chunk").cogroup(known.groupBy("home")).applyInArrow(_score, _RESULT_DDL)


def _score(rows: pa.Table, known: pa.Table) -> pa.Table:
    docs = rows.filter(pc.is_valid(rows.column("words"))).combine_chunks()
    words = rows.filter(pc.is_valid(rows.column("links")))
    if words.num_rows:
        place = known.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place] = known.column("count").to_numpy()
        best[place] = known.column("best").to_numpy()
        links = words.column("links").combine_chunks().flatten().to_numpy()
        at = words.column("word_at").combine_chunks().flatten().to_numpy()
        per_word = [_sums(v[links], at) for v in (best, count)]
    else:
        per_word = [np.zeros(0, np.int64)] * 2
    lists = docs.column("words").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    used = lists.flatten().to_numpy()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    n_best, total = (_sums(w[used], ends) for w in per_word)
    return pa.Table.from_arrays([
        *(docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")),
        pa.array(n_best), pa.array(total), docs.column("groups_sha256"),
    ], schema=_RESULT)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level and piece tokens of all documents, aligned and scored by corpus-wide link counts."""
    import public_tokenizers

    definition = definition_of(public_tokenizers.path("byte_bpe_50k.json"))
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    return scores(align(table(spark, sf_dir, "documents"), definition, model))
