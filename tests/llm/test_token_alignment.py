"""Alignment of tokenizers against a plain computation on whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lineamix.llm import token_alignment as t
from lineamix.llm.tokens import BYTE_OF, definition_of
from tests.llm.test_tokens import P, TEXTS

BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    with open(PIECES, "rb") as file:
        model = file.read()
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    return definition_of(BYTES), model, a, sentencepiece.SentencePieceProcessor(model_proto=model)


def plain(text, a, b):
    """(ids and byte ranges of both) straight from whole texts and decoded bytes, or None."""
    if not text:
        return None
    raw = (" " + text).encode()
    first = [(i, bytes(BYTE_OF[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    second = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    out = []
    for side in (first, second):
        if b"".join(x for _, x in side) != raw:
            return None
        at, ranges = 0, []
        for i, x in side:
            ranges.append((i, at, at + len(x)))
            at += len(x)
        out.append(ranges)
    return out


def expected(texts, a, b):
    found = [plain(x, a, b) for x in texts]
    links = [[] if f is None else [(p[0], q[0]) for p in f[0] for q in f[1] if p[1] < q[2] and q[1] < p[2]] if len(f[0]) < 600 else _fast(f) for f in found]
    counts = Counter(x for some in links for x in some)
    most = {}
    for (_, q), n in counts.items():
        most[q] = max(n, most.get(q, 0))
    out = []
    for f, mine in zip(found, links):
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = sorted({e for _, _, e in f[0]} & {e for _, _, e in f[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, _, e in side if low < e <= cut) for side in f) if len(cuts) < 600 else "")
            low = cut
        text = ";".join(groups) if len(cuts) < 600 else _groups(f, set(cuts))
        out.append((len(f[0]), len(f[1]), len(cuts), len(mine), sum(counts[x] == most[x[1]] for x in mine), sum(counts[x] for x in mine),
                    hashlib.sha256(text.encode()).hexdigest()))
    return out


def _fast(f):
    out, j = [], 0
    for i, low, high in f[0]:
        while f[1][j][2] <= low:
            j += 1
        k = j
        while k < len(f[1]) and f[1][k][1] < high:
            out.append((i, f[1][k][0]))
            k += 1
    return out


def _groups(f, cuts):
    sides = []
    for side in f:
        runs, run = [], []
        for i, _, e in side:
            run.append(str(i))
            if e in cuts:
                runs.append(",".join(run))
                run = []
        sides.append(runs)
    return ";".join(f"{x}|{y}" for x, y in zip(*sides))


EXTRA = [" ", "  ", "\n", "▁ x", "<0x0A> <s> </s>", "😀 ệ𝔘x 日本\U0002070e", "ﬁ ﷺ́", "a b", "tail ", "﻿x", "é" * 30, "𝔘" * 40]


def test_whole_texts(spark, docs, tools):
    definition, model, a, b = tools
    pick = random.Random(5)
    alphabet = [" ", "the", "ing", "é", "日", "😀", "𝔘", "\n", "'s", "123", "Zürich", ".", "ﬀ", "​", "x"]
    texts = [x for x in TEXTS] + EXTRA + ["".join(pick.choices(alphabet, k=pick.randint(1, 40))) for _ in range(300)]
    texts += texts[:40]
    rows = list(enumerate(texts))
    want = expected(texts, a, b)
    for size in (1, 5_000, t.CHUNK_BYTES):
        frame = docs(rows).withColumns({"chunk": F.lit(1), "words": F.lit("w"), "pairs": F.lit(2)})
        got = {r.doc_id: tuple(r)[1:] for r in t.scores(t.align(frame, definition, model, chunk_bytes=size)).collect()}
        for i, x in rows:
            assert got[i] == want[i], (i, x)
    assert sum(w[0] > 0 for w in want) > 300 and want[0][6] == ""


@pytest.mark.parametrize("odd", [[], ["ﬁx", "\u0301a", "<|endoftext|>"], ["ﬁx"] + [f"ﬀ{i}" for i in range(3000)]])
def test_words_go_to_the_tokenizers_in_runs(tools, odd):
    """Not word by word, but for the words of runs that a tokenizer changes; each word comes out as it does alone."""
    definition, model, _, _ = tools
    aligner, chunk, seen = t.Aligner(definition, model), t._Chunk(0), []
    ends = aligner._a_ends
    aligner._a_ends = lambda spaced, at: (seen.append(len(spaced)), ends(spaced, at))[1]
    words = [f"{x}{i}{y}" for i in range(300) for x, y in (("the", "."), ("É", ",\nUnd"), ("日本", "'s"), ("", "…"), ("x" * 9, "ß"))]
    words[700:700] = odd
    texts = [" ".join(words), "", None, words[0], " ".join(words[:99]), "two  spaces"]
    part = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    t._documents(aligner, chunk, part)
    if len(odd) < 5:
        assert sum(seen) < (len(words) / 10 if not odd else len(words) / 4)
    links = np.split(np.concatenate(chunk.links), np.cumsum(chunk.sizes[:, 3])[:-1])
    assert len(chunk.texts) == len(chunk.sizes) == sum(no >= 0 for no in chunk.word_no.values())
    for word in words:
        alone, no = aligner.align([word]), chunk.word_no[word]
        assert bool(alone.ok[0]) == (no >= 0), word
        if no >= 0:
            assert alone.texts == [chunk.texts[no]] and alone.sizes[0].tolist() == chunk.sizes[no].tolist() and alone.links.tolist() == links[no].tolist(), word


def test_edges_and_counts(spark, docs, tools):
    definition, model, a, b = tools
    assert t.scores(t.align(docs([]), definition, model)).count() == 0
    nothing = t.scores(t.align(docs([(1, None), (None, ""), (1, None)]), definition, model)).collect()
    assert [tuple(r)[1:] for r in nothing] == [(0, 0, 0, 0, 0, 0, "")] * 3
    aligned = t.align(docs([(1, "one two"), (1, "one two"), (None, "two")]), definition, model, chunk_bytes=1)
    counts = {(r.a, r.b): r["count"] for r in t.pair_counts(aligned).collect()}
    links = Counter((p, q) for x in ("one two", "one two", "two") for p, q in _fast(plain(x, a, b)))
    assert counts == links and all(r.best for r in t.pair_counts(aligned).collect())


def test_query(spark, sf_dir, tools):
    _, _, a, b = tools
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = dict(zip((i for i, _ in rows), expected([x for _, x in rows], a, b)))
    got = t.token_alignment(spark, sf_dir)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
