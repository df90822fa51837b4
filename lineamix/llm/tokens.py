"""Ids of whole texts from a ``tokenizers`` file, at the cost of the different words of a batch.

A word that a batch repeats is encoded once and remembered for later batches of the same Python
worker. Texts are cut only where the tokenizer itself always cuts, so the ids are those that the
library gives for the whole text.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as the tokenizers' patterns see it, without the space.
_WHITE = r"\t\n\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A space next to other white space: there a cut before the space is not safe.
UNSAFE = f"[{_WHITE} ] | [{_WHITE}]"
#: Words of which the pre-tokens are plain: letters up to U+00FF, runs of signs, single line breaks.
#: No apostrophe is among the signs, as it may begin a pre-token with letters, nor the sign with
#: which added tokens begin.
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:;=-@\[-`{-~"
_PLAIN = re.compile(rf" ?(?:[{_LETTERS}{_SIGNS}]|\n(?=[{_LETTERS}{_SIGNS}]))+\n?").fullmatch
_PIECES = re.compile(rf" ?[{_LETTERS}]+| ?[{_SIGNS}]+|\n").findall
#: The usual word is letters, and signs after them, which are a pre-token of their own.
_WORD = rf"\A[{_LETTERS}]+\z"
_ALL_LETTERS, _ALL_SIGNS = ("".join(filter(re.compile(f"[{some}]").match, map(chr, range(0x100)))) for some in (_LETTERS, _SIGNS))
#: Ends of sentences, perhaps before closing quotes and brackets.
_CLOSES = r"""[.!?…\n]["')\]]*\z"""


def _byte_letters() -> list[str]:
    """Byte-level BPE writes printable bytes as themselves and the others from U+0100 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in kept else next(rest)) for b in range(256)]


_LETTER_OF = _byte_letters()
BYTE_OF = {letter: byte for byte, letter in enumerate(_LETTER_OF)}
#: The same by byte, as 16-bit characters; line breaks, which no word of letters has, stay.
_LETTER_CODES = np.array([ord(letter) for letter in _LETTER_OF], "<u2")
_LETTER_CODES[0x0A] = 0x0A


class Encoder:
    """Encodes Arrow string arrays; remembers up to ``cache_words`` words, the latest half at least."""

    def __init__(self, definition: str, cache_words: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        parts = json.loads(definition)
        before, normal = parts["pre_tokenizer"] or {}, parts["normalizer"]
        steps = before.get("pretokenizers", [])
        #: Words carry the space before them.
        self.leading = before.get("type") == "ByteLevel" and bool(before.get("use_regex")) and not before.get("add_prefix_space") and normal is None
        #: White space belongs to no token.
        self.dropping = [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed"
        self.lower = any(n["type"] == "Lowercase" for n in (normal or {}).get("normalizers", []))
        #: Words seen lately, and those of the time before: what is seen again moves to the first.
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cache_words = cache_words

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offsets, ends): all ids, where each text begins and ends, where sentences end.

        NULL is an empty text. ``ends`` are positions in ids after a word that ends with ``.``,
        ``!``, ``?`` or a line break; only for tokenizers that drop white space.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not (self.leading or self.dropping):
            return (*self._whole(texts), np.zeros(0, np.int64))
        if self.dropping:
            return self._by_words(pc.replace_substring(texts, "\n", "\n "), "")
        unsafe = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False)
        if not unsafe.any():
            return self._by_words(texts, " ")
        easy = self._by_words(texts.filter(pa.array(~unsafe)), " ")
        hard = self._whole(texts.filter(pa.array(unsafe)))
        ids = [None] * len(texts)
        for mask, (flat, at) in ((~unsafe, easy[:2]), (unsafe, hard)):
            for i, row in enumerate(np.flatnonzero(mask)):
                ids[row] = flat[at[i]:at[i + 1]]
        at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        return np.concatenate(ids), at, np.zeros(0, np.int64)

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        return np.concatenate([np.zeros(0, np.uint32), *found]), at

    def _by_words(self, texts: pa.Array, space: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = pc.split_pattern(texts, " ")
        begin = words.offsets.to_numpy()
        begin = begin - begin[0]
        coded = pc.dictionary_encode(words.flatten())
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        packed = self._packed(coded.dictionary, space)
        if space:  # the first word of a text has no space before it
            first = pc.dictionary_encode(words.flatten().take(pa.array(begin[:-1])))
            codes[begin[:-1]] = first.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(packed)
            packed = pa.concat_arrays([packed, self._packed(first.dictionary, "")])
        size = pc.binary_length(packed).to_numpy() >> 2
        ids = np.frombuffer(_content(packed.take(pa.array(codes))), np.uint32)
        after = np.concatenate([[0], np.cumsum(size[codes])])
        ends = np.zeros(0, np.int64)
        if not space:
            closing = pc.match_substring_regex(coded.dictionary, _CLOSES).to_numpy(zero_copy_only=False)
            ends = after[1:][closing[codes]]
        return ids, after[begin], ends

    def _packed(self, different: pa.Array, space: str) -> pa.Array:
        """Ids of different words, as 32-bit numbers in a row.

        Letters and the signs after them are looked up apart: both are fewer than the words they make.
        """
        stems = pc.ascii_rtrim(different, characters=_ALL_SIGNS)
        usual = pc.match_substring_regex(stems, _WORD)
        letters, others = pc.dictionary_encode(stems.filter(usual)), different.filter(pc.invert(usual))
        signs = pc.dictionary_encode(pc.if_else(usual, pc.utf8_ltrim(different, characters=_ALL_LETTERS), ""))
        mask, place = usual.to_numpy(zero_copy_only=False), np.empty(len(different), np.int64)
        place[mask] = letters.indices.to_numpy()
        place[~mask] = len(letters.dictionary) + np.arange(len(others))
        known = self._ids_of(letters.dictionary, space, self._letters) + self._ids_of(others, space, self._mixed)
        ends = pa.array(self._ids_of(signs.dictionary, "", self._mixed), pa.large_binary())
        return pc.binary_join_element_wise(
            pa.array(known, pa.large_binary()).take(pa.array(place)), ends.take(signs.indices), pa.scalar(b"", pa.large_binary())
        )

    def _ids_of(self, different: pa.Array, space: str, encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Ids of each word, after a space or not, as 32-bit numbers; ``encode`` makes those of words not seen lately."""
        if len(self.cache) > self.cache_words // 2:
            self.cache, self.older = {}, self.cache
        words = different.to_numpy(zero_copy_only=False).tolist()

        def seen_before(missing: list[str]) -> list[bytes]:
            more = _filled(missing, self.older, encode)
            self.cache.update(zip(missing, more))
            return more

        # No cycles are made here, and looking for them among so many strings takes a tenth of the time.
        collecting = gc.isenabled()
        gc.disable()
        try:
            words = [space + w for w in words] if space else words
            return _filled(words, self.cache, seen_before)
        finally:
            if collecting:
                gc.enable()

    def _mixed(self, words: list[str]) -> list[bytes]:
        """Ids of any words: plain ones piece by piece, the others by the whole tokenizer."""
        found = [b"".join(map(self._piece, _PIECES(word))) if _PLAIN(word) else None for word in words]
        hard = [word for word, ids in zip(words, found) if ids is None]
        if hard:
            encoded = iter(self.tokenizer.encode_batch_fast(hard, add_special_tokens=False))
            found = [array("I", next(encoded).ids).tobytes() if ids is None else ids for ids in found]
        return found

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token: letters or signs, perhaps after a space, or a line break."""
        if self.dropping and piece == "\n":
            return b""
        ids = self.cache.get(piece)
        if ids is None:
            ids = self.older.get(piece)
            if ids is None:
                ids = array("I", [t.id for t in self.model.tokenize("".join(map(_LETTER_OF.__getitem__, (piece.lower() if self.lower else piece).encode())))]).tobytes()
            self.cache[piece] = ids
        return ids

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, perhaps after a space; their bytes become letters of the model all at once."""
        if not words:
            return []
        text = "\n".join(words)
        raw = np.frombuffer((text.lower() if self.lower else text).encode(), np.uint8)
        tokenize = self.model.tokenize
        found = [[t.id for t in tokenize(word)] for word in _LETTER_CODES[raw].tobytes().decode("utf-16-le").split("\n")]
        flat = np.fromiter(chain.from_iterable(found), np.uint32).tobytes()
        ends = np.cumsum([len(ids) for ids in found]) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _filled(words: list[str], cache: dict[str, bytes], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """What the cache has of these words; what it has not is encoded."""
    found = list(map(cache.get, words))
    missing = [word for word, ids in zip(words, found) if ids is None]
    if not missing:
        return found
    rest = iter(encode(missing))
    return [next(rest) if ids is None else ids for ids in found]


def _content(values: pa.Array) -> memoryview | bytes:
    """The bytes of a large binary array, one value after the other."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]
    return memoryview(values.buffers()[2])[offsets[0]:offsets[-1]] if len(values) and offsets[-1] > offsets[0] else b""


@lru_cache(maxsize=4)
def encoder(definition: str) -> Encoder:
    """One encoder per Python worker and definition."""
    return Encoder(definition)


def slices(batch: pa.RecordBatch, text: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many bytes of text; one longer text stands alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    total, begin = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and total + n > most_bytes:
            yield batch.slice(begin, i - begin)
            total, begin = 0, i
        total += int(n)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def definition_of(path: str) -> str:
    """The tokenizer file's text, a few MB whatever the data: it travels with the tasks."""
    with open(path, encoding="utf-8") as file:
        return file.read()
