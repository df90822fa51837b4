"""Token counts of greedy word pieces in linear time, without building pieces.

A trie of the vocabulary gets failure links: where no child fits the next letter, the longest
pieces of what was read are popped, and matching goes on at the node of the rest. How many pieces
a link pops is computed once, so counting a word takes a number of steps linear in its letters.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lineamix.llm.common import table
from lineamix.llm.words import by_text, parts, words_of

#: Stands before the first letter of a word, as in the vocabulary.
WORD_START = "▁"
#: Different words that a Python worker remembers.
CACHE_WORDS = 1_000_000
COUNTS = "doc_id bigint, n_words bigint, n_unknown bigint, n_tokens bigint"
_COUNT_TYPE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_unknown", pa.int64()), ("n_tokens", pa.int64())])


class LongestMatch:
    """Automaton over ``pieces``; node 0 is the root and -1 no node."""

    def __init__(self, pieces: tuple[str, ...]):
        self.children: list[dict[str, int]] = [{}]
        ends = [False]
        for piece in pieces:
            node = 0
            for letter in piece:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    ends.append(False)
                node = self.children[node][letter]
            ends[node] = True
        self.link, self.pops = [-1] * len(ends), [0] * len(ends)
        queue = deque((0, letter, child) for letter, child in self.children[0].items())
        while queue:
            parent, letter, node = queue.popleft()
            if ends[node]:
                self.link[node], self.pops[node] = 0, 1
            else:
                at, popped = self.link[parent], self.pops[parent]
                while at >= 0 and letter not in self.children[at]:
                    popped += self.pops[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[node], self.pops[node] = self.children[at][letter], popped
            queue.extend((node, x, child) for x, child in self.children[node].items())

    def count(self, word: str) -> int:
        """Number of pieces of greedy longest match from the left; 0 if they do not cover the word."""
        children, link, pops = self.children, self.link, self.pops
        node = total = 0
        for letter in word:
            while (child := children[node].get(letter)) is None:
                total += pops[node]
                if (node := link[node]) < 0:
                    return 0
            node = child
        while node:
            total += pops[node]
            if (node := link[node]) < 0:
                return 0
        return total


@lru_cache(maxsize=2)
def _counter(pieces: tuple[str, ...]) -> tuple[LongestMatch, dict[int, int]]:
    """Automaton and remembered counts (by word hash) of a Python worker."""
    return LongestMatch(pieces), {}


def text_counts(texts: pa.Array, pieces: tuple[str, ...]) -> np.ndarray:
    """Rows (words, unknown words, tokens) per text; an unknown word is one token. NULL is empty."""
    automaton, seen = _counter(pieces)
    out = [np.zeros((0, 3), np.int64)]
    for part in parts(texts):
        w = words_of(part, lower=False)
        raw = w.data.tobytes()
        different, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
        if len(seen) + len(different) > CACHE_WORDS:
            seen.clear()
        counts = np.zeros(len(different), np.int64)
        begin, end = w.starts[first].tolist(), w.ends[first].tolist()
        for k, h in enumerate(different.tolist()):
            if (n := seen.get(h)) is None:
                n = seen[h] = automaton.count(WORD_START + raw[begin[k]:end[k]].decode("utf-8", "replace"))
            counts[k] = n
        each = counts[inverse] if len(different) else counts
        unknown = each == 0
        out.append(np.column_stack([np.diff(w.text_at), by_text(unknown, w.text_at), by_text(np.where(unknown, 1, each), w.text_at)]))
    return np.concatenate(out)


def count_tokens(docs: DataFrame, pieces: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``COUNTS`` of each document: words, words outside the vocabulary, tokens of the whole text.

    Words are separated by white space and begin with ``WORD_START`` in the vocabulary. A row is
    counted for each input row, repeated or not; no shuffle.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_counts(batch.column(1), pieces)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, k]) for k in range(3))], schema=_COUNT_TYPE)

    return docs.selectExpr(f"CAST(`{id_col}` AS bigint) AS doc_id", f"`{text_col}` AS text").mapInArrow(count, COUNTS)


def vocabulary(path: str) -> tuple[str, ...]:
    """The ordinary pieces of a sentencepiece model file: no control, unknown or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple(
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    )


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
