"""Token files and packing against the tokenizers library on whole texts."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lineamix.llm import packing, token_files
from lineamix.llm.common import new_folder
from lineamix.llm.tokens import Encoder, definition_of

P = pytest.importorskip("public_tokenizers")

TEXTS = ["", None, " a", "a ", "a  b", "a \nb", "a\n b", "foo.\n\nBar  baz\t qux", "it's don't WE'LL ça va Été 123 4,567.89",
         "日本語 テスト。 ok", "<|endoftext|> x<|endoftext|>y", " x\u2003 y", "İstanbul ΣΑΣ ﬁ é", "a...b !!! ?!", "'s 's", "x'll.", "é ́a",
         "One two, three. Four five! " * 900, "word " * 5000, "x" * 9000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_whole_texts(name):
    words = Encoder(definition_of(P.path(name)), cache_words=50)
    whole = Tokenizer.from_file(P.path(name))
    for texts in (TEXTS, TEXTS[::-1], [t or "" for t in TEXTS]):
        ids, at, _ = words.encode(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[at[i]:at[i + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_random_texts(name):
    import random
    pick = random.Random(1)
    pieces = [" ", " ", " ", "a", "Word", "été", "ß", "'", "'s", ".", ",", "$$$", "%", "\n", "\n", "12", "_", "-", "日", "(x)", "…", "’t", "ÿ", "×", "[", "\\", "^", "`", "~"]
    words, whole = Encoder(definition_of(P.path(name)), cache_words=400), Tokenizer.from_file(P.path(name))
    texts = ["".join(pick.choices(pieces, k=pick.randint(1, 30))) for _ in range(3000)]
    for begin in range(0, len(texts), 300):
        some = texts[begin:begin + 300]
        ids, at, _ = words.encode(pa.array(some, pa.string()))
        for i, t in enumerate(some):
            assert ids[at[i]:at[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_letters_are_remembered_without_signs(name):
    """Words that differ in their signs alone cost one look at the tokenizer's model and one place in the cache."""
    texts = ["stem" + sign + " Stem" + sign + " ÉtéÿÖß" + sign for sign in (".", ",", "!?", ")", "", "\nEnd;")] + ["µ, ª. xº! a×b÷ ...", ", x"]
    words, whole = Encoder(definition_of(P.path(name))), Tokenizer.from_file(P.path(name))
    ids, at, _ = words.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)
    assert not {w.strip() for w in words.cache} & {w + sign for w in ("stem", "Stem", "ÉtéÿÖß") for sign in (".", ",", "!?", ")")}
    assert {w.strip() for w in words.cache} >= {"stem", "Stem", "ÉtéÿÖß", ".", ",", "!?", ")"}


def _expected(rows, name, end):
    whole = Tokenizer.from_file(P.path(name))
    return [(i, np.array(whole.encode(t or "", add_special_tokens=False).ids + [end], "<u4")) for i, t in rows]


def test_token_files(spark, docs):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3])] * 2 + [(None, "no id")]
    path = new_folder(spark, "tokens")
    more = docs(rows).withColumn("ids", F.lit(1)).withColumn("file_no", F.lit(1))
    token_files.write_token_files(more, path, definition_of(P.path("byte_bpe_50k.json")), 0)
    got = [tuple(r) for r in token_files.checksums(token_files.read_tokens(spark, path)).orderBy("start").collect()]
    assert [r[0] for r in got] == [None] + sorted(i for i, _ in rows if i is not None)
    start = 0
    expected = sorted(_expected(rows, "byte_bpe_50k.json", 0), key=lambda r: (r[0] is not None, r[0] or 0))
    for (i, ids), row in zip(expected, got):
        assert row == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.read_metadata(spark, path).count() == len(rows)
    plan = token_files.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan
    empty = new_folder(spark, "tokens")
    token_files.write_token_files(docs([]), empty, definition_of(P.path("byte_bpe_50k.json")), 0)
    assert token_files.checksums(token_files.read_tokens(spark, empty)).count() == 0


def test_file_layout(spark, docs):
    import glob
    import pyarrow.parquet as pq
    path = new_folder(spark, "tokens")
    token_files.write_token_files(docs([(i, f"some words {i} again") for i in range(300)]), path, definition_of(P.path("byte_bpe_50k.json")), 0)
    for file in glob.glob(path.removeprefix("file:") + "/*.parquet"):
        group = pq.ParquetFile(file).metadata.row_group(0)
        found = {group.column(c).path_in_schema.split(".")[0]: group.column(c) for c in range(group.num_columns)}
        assert any("DICTIONARY" in e for e in found["ids"].encodings)
        assert found["doc_id"].encodings == ("DELTA_BINARY_PACKED",) or "DELTA_BINARY_PACKED" in found["doc_id"].encodings
        assert found["ids"].has_offset_index and found["doc_id"].has_column_index


def check_pieces(pieces, expected, width):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert p.length == len(p.ids) // 4 > 0
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == {i for i, _ in expected}
    for i, ids in expected:
        own = sorted(by_doc[i], key=lambda p: p.start)
        assert b"".join(p.ids for p in own) == ids.tobytes() and own[0].start == 0
        assert all(p.doc_tokens == len(ids) for p in own)
        assert all(a.start + a.length == b.start for a, b in zip(own, own[1:]))
    order = []
    for s in sorted(by_sequence):
        at = 0
        for p in sorted(by_sequence[s], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
            order.append((p.doc_id is not None, p.doc_id or 0, p.start))
        assert at <= width
    assert order == sorted(order)
    return len(by_sequence)


def test_packing_is_lossless(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 6000)
    rows = [(i * 10 + k, t) for k in range(4) for i, t in enumerate(TEXTS)] + [(None, "no id here")]
    definition = definition_of(P.path("word_bpe_49k.json"))
    got = packing.pack(docs(rows).withColumn("start", F.lit(0)), definition, 1).collect()
    expected = _expected(rows, "word_bpe_49k.json", 1)
    used = check_pieces(got, expected, 2048)
    assert used <= sum(len(x) for _, x in expected) / 2048 * 1.05 + 5
    assert packing.pack(docs([]), definition, 1).count() == 0
    twice = packing.pack(docs([(1, "a b"), (1, "a b")]), definition, 1).collect()
    assert sum(p.length for p in twice) == 6


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_the_cheapest(seed):
    pick = np.random.default_rng(seed)
    width = int(pick.integers(4, 20))
    places = np.concatenate([[0], np.cumsum(pick.integers(1, width + 1, pick.integers(1, 14)))])
    penalties = pick.integers(0, 9, len(places))
    cheapest = {0: 0}
    for j in range(1, len(places)):
        cheapest[j] = min(cheapest[i] + width - (places[j] - places[i]) for i in range(j) if places[j] - places[i] <= width) + penalties[j]
    cuts = packing.best_cuts(places, penalties, width)
    at, cost = 0, 0
    for c in cuts:
        assert 0 < c - at <= width
        cost += width - (c - at) + penalties[np.searchsorted(places, c)]
        at = c
    assert at == places[-1] and cost == cheapest[len(places) - 1]
