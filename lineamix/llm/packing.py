"""Order-preserving packing: cut the stream of documents into windows by dynamic programming.

Documents stand in ascending id order. A window is at most ``width`` ids; it ends at a document's
end, at a sentence's end or, inside long sentences, at every ``grid`` ids. The cuts minimise
padding plus a penalty for each cut that splits a document or a sentence. The best earlier cut of
a window is the minimum over a sliding range of positions, kept in a monotone queue, so a block of
n possible cuts takes O(n) steps.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from lineamix.llm.common import table
from lineamix.llm.token_files import in_order
from lineamix.llm.tokens import definition_of, encoder, slices

WIDTH = 2048
#: Ids of padding that a cut at a sentence's end inside a document, or inside a sentence, is worth.
SPLIT_DOCUMENT, SPLIT_SENTENCE = 8, 48
#: Sentences longer than this may be cut inside.
GRID = 64
#: Ids whose cuts are chosen together; a window open at the end of a block goes on in the next.
BLOCK = 1 << 20

PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
_PIECES_TYPE = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])


def best_cuts(places: np.ndarray, penalties: np.ndarray, width: int) -> np.ndarray:
    """Positions at which windows end, the last place included.

    ``places`` ascend from 0 in steps of at most ``width``; a window between two places a < b
    costs ``width - (b - a)`` of padding and the penalty of b. Of equally good earlier places the
    first is taken.
    """
    where, cost_of = places.tolist(), penalties.tolist()
    best, back = [0] * len(where), [0] * len(where)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (best + place, index), ascending
    for j in range(1, len(where)):
        here = where[j]
        while here - where[queue[0][1]] > width:
            queue.popleft()
        value, back[j] = queue[0]
        best[j] = value + width - here + cost_of[j]
        value = best[j] + here
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [], len(where) - 1
    while j > 0:
        cuts.append(where[j])
        j = back[j]
    return np.array(cuts[::-1], np.int64)


def possible_cuts(size: int, document_ends: np.ndarray, sentence_ends: np.ndarray, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """All places where ``size`` ids may be cut, with penalties; 0 and ``size`` are among them."""
    natural = np.unique(np.concatenate([[0, size], document_ends, sentence_ends]))
    steps = -(-np.diff(natural) // grid)
    inner = np.repeat(natural[:-1], steps) + grid * (np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps))
    places = np.unique(np.concatenate([natural, inner]))
    penalties = np.full(len(places), SPLIT_SENTENCE)
    penalties[np.searchsorted(places, natural)] = SPLIT_DOCUMENT
    penalties[np.searchsorted(places, np.concatenate([[0, size], document_ends]))] = 0
    return places, penalties


class _Stream:
    """Ids of one range of documents that are not in a window yet."""

    def __init__(self, base: int, width: int):
        self.width, self.sequence = width, base
        self.ids = np.zeros(0, np.uint32)
        self.sentence_ends = np.zeros(0, np.int64)
        # Of each document in the stream: its id (None if NULL), position of its first id (negative if
        # that is in a window already), and its number of ids.
        self.doc_ids, self.begins, self.sizes = [], np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, doc_ids: list, ids: np.ndarray, sizes: np.ndarray, sentence_ends: np.ndarray) -> None:
        held = len(self.ids)
        self.begins = np.concatenate([self.begins, held + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.doc_ids = self.doc_ids + doc_ids
        self.sentence_ends = np.concatenate([self.sentence_ends, held + sentence_ends])
        self.ids = np.concatenate([self.ids, ids])

    def windows(self, last: bool) -> pa.RecordBatch | None:
        """Close windows over what is held; unless ``last``, the final one stays open."""
        size = len(self.ids)
        if not size:
            return None
        places, penalties = possible_cuts(size, self.begins[self.begins > 0], self.sentence_ends)
        cuts = best_cuts(places, penalties, self.width)
        if not last:
            cuts = cuts[:-1]
        if not len(cuts):
            return None
        end = int(cuts[-1])
        marks = np.unique(np.concatenate([[0], cuts, self.begins[(self.begins > 0) & (self.begins < end)]]))
        begin, length = marks[:-1], np.diff(marks)
        document = np.searchsorted(self.begins, begin, "right") - 1
        window = np.searchsorted(cuts, begin, "right")
        opening = np.concatenate([[0], cuts])[window]
        raw = np.ascontiguousarray(self.ids[:end], "<u4")
        offsets = np.concatenate([begin, [end]]) * 4
        out = pa.RecordBatch.from_arrays([
            pa.array([self.doc_ids[d] for d in document], pa.int64()),
            pa.array(begin - self.begins[document]),
            pa.array(length),
            pa.array(self.sizes[document]),
            pa.array(self.sequence + window),
            pa.array(begin - opening),
            pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)]),
        ], schema=_PIECES_TYPE)
        self.sequence += len(cuts)
        stays = int(document[-1]) + (self.begins[document[-1]] + self.sizes[document[-1]] <= end)
        self.doc_ids, self.begins, self.sizes = self.doc_ids[stays:], self.begins[stays:] - end, self.sizes[stays:]
        self.sentence_ends = self.sentence_ends[self.sentence_ends > end] - end
        self.ids = self.ids[end:]
        return out


def pack(docs: DataFrame, definition: str, end_id: int, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most ``width`` ids (``PIECES``).

    Every document, also a NULL or empty text, is its ids with ``end_id`` after them; each id is in
    exactly one piece. ``start`` counts the ids of the document before the piece, ``offset`` those
    of the sequence; ``ids`` holds the piece as 32-bit little-endian numbers. Sequences never reach
    over two ranges of documents: a range loses one padded sequence at most. A range works in
    blocks, so its memory does not grow with its size, but for the ids of its longest document.
    Repeated rows are packed as often as they occur. The tokenizer must drop white space.
    """
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(definition)
        stream = _Stream(TaskContext.get().partitionId() << 32, width)
        for batch in batches:
            for part in slices(batch, 1):
                ids, at, ends = words.encode(part.column(1))
                rows = np.arange(len(at) - 1)
                closing = at[1:] + rows
                full = np.full(len(ids) + len(rows), end_id, np.uint32)
                keep = np.ones(len(full), bool)
                keep[closing] = False
                full[keep] = ids
                sizes = np.diff(at) + 1
                # The id at position p - 1 of text t stands at p - 1 + t among the ids with end ids.
                ends = ends[ends > 0]
                sentences = ends + np.searchsorted(at[1:], ends - 1, "right")
                stream.add(part.column(0).to_pylist(), full, sizes, sentences)
                while len(stream.ids) > BLOCK and (out := stream.windows(last=False)) is not None:
                    yield out
        if (out := stream.windows(last=True)) is not None:
            yield out

    return in_order(docs, id_col, text_col).mapInArrow(place, PIECES)


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    definition = definition_of(public_tokenizers.path("word_bpe_49k.json"))
    pieces = pack(table(spark, sf_dir, "documents"), definition, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
