import random

import pyarrow as pa

from lineamix.llm.token_counts import WORD_START, LongestMatch, count_tokens, text_counts


def greedy(word, pieces):
    n, at, longest = 0, 0, max(map(len, pieces))
    while at < len(word):
        end = max((e for e in range(at + 1, min(len(word), at + longest) + 1) if word[at:e] in pieces), default=None)
        if end is None:
            return 0
        n, at = n + 1, end
    return n


def test_counts_against_greedy_matching():
    pick = random.Random(1)
    for _ in range(300):
        pieces = {"".join(pick.choice("abc") for _ in range(pick.randint(1, 5))) for _ in range(pick.randint(1, 14))}
        automaton = LongestMatch(tuple(sorted(pieces)))
        for _ in range(20):
            word = "".join(pick.choice("abcd" if pick.random() < 0.1 else "abc") for _ in range(pick.randint(1, 12)))
            assert automaton.count(word) == greedy(word, pieces), (word, pieces)


def test_texts(docs, rows):
    pieces = (WORD_START, WORD_START + "ab", "a", "b", "ba", "é")
    texts = ["ab abba\né", "", None, "xyz ab xyz", "ab" * 30_000, " \t "]
    got = text_counts(pa.array(texts), pieces).tolist()
    for text, (words, unknown, tokens) in zip(texts, got):
        each = [greedy(WORD_START + w, set(pieces)) for w in (text or "").split()]
        assert (words, unknown, tokens) == (len(each), each.count(0), sum(n or 1 for n in each))
    made = docs([*enumerate(texts), (0, "ab"), (None, "ab")])
    assert len(rows(count_tokens(made, pieces))) == len(texts) + 2
    assert count_tokens(docs([]), pieces).count() == 0


def test_public_vocabulary(docs):
    import pytest
    public = pytest.importorskip("public_tokenizers")
    from lineamix.llm.token_counts import vocabulary
    pieces = vocabulary(public.path("piece_bpe_32k.model"))
    known = set(pieces)
    words = "The quick brown fox, jumps über 123 lazy_dogs straße 日本 <0x0A> <s>".split()
    automaton = LongestMatch(pieces)
    assert [automaton.count(WORD_START + w) for w in words] == [greedy(WORD_START + w, known) for w in words]
