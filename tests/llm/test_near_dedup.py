import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lineamix.llm import near_dedup, shingles as sh


def brute_sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute_components(rows, percent):
    sets, ids = brute_sets(rows), sorted(i for i, _ in rows)
    root = {i: i for i in ids}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefg") for _ in range(4))
    rows, n = [], 0
    for size in (3, 5, 6, 8, 12, 30, 60, 150):
        for _ in range(3):
            base = [word() for _ in range(size)]
            for k in range(12):
                copy = list(base)
                for _ in range(pick.randrange(0, max(2, size // 25))):
                    copy[pick.randrange(size)] = word()
                rows.append((n, (" " if k % 2 else "\n\t").join(copy).title() if k % 3 else " ".join(copy)))
                n += 1
    # A base and many copies that are near it, but mostly not near each other.
    base = [word() for _ in range(200)]
    for k in range(60):
        copy = list(base)
        for j in pick.sample(range(200), pick.choice((2, 4, 5, 6))):
            copy[j] = word()
        rows.append((n + 100 - k, " ".join(copy)))
    return rows + [(9001, ""), (9002, None), (9003, " \n"), (9004, "é É")]


@pytest.mark.parametrize("percent", [80, 85])
def test_components_against_all_pairs(spark, docs, percent, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rows = corpus(percent)
    more = docs(rows).withColumns({"rep": F.lit(1), "key": F.lit(2), "n": F.lit(3), "a": F.lit(4)})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(more, percent).collect()}
    assert got == brute_components(rows, percent)


def test_rows_that_stay(spark, docs, rows):
    text = " ".join(f"w{i}" for i in range(60))
    made = docs([(5, text), (3, text + " end"), (3, text + " end"), (None, text), (8, ""), (9, None), (7, "other words")])
    assert near_dedup.deduplicate(made).columns == made.columns
    assert rows(near_dedup.deduplicate(made), "doc_id") == sorted([(3,), (3,), (None,), (8,), (9,), (7,)], key=lambda r: (r[0] is None, str(r[0])))
    found = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_duplicates(made).collect()}
    assert found[None] == (None, True) and found[5] == (3, False) and found[9] == (9, True)
    assert near_dedup.near_duplicates(docs([])).count() == 0


def test_estimates_and_bands():
    pick = np.random.default_rng(5)
    for size, similarity in ((8, 0.86), (40, 0.8), (400, 0.85), (5000, 0.6), (3000, 0.1)):
        errors, missed = [], 0
        bands, width = sh.band_plan(192, 0.8)
        for _ in range(60):
            common = round(2 * size * similarity / (1 + similarity))
            pool = pick.integers(0, 1 << 63, 2 * size - common, np.int64).astype(np.uint64)
            a, b = np.sort(pool[:size]), np.sort(pool[size - common:])
            true = common / len(pool)
            r = sh.registers([a, b], 192)
            m = np.array([size])
            guess = sh.estimate(r[:1], r[1:], m, m)[0]
            errors.append(guess - true)
            if true >= 0.8:
                assert guess >= sh.lower_bound(0.8, m, m, 192)[0]
                keys = sh.band_keys(r, bands, width)
                missed += not (keys[0] == keys[1]).any()
        assert abs(np.mean(errors)) < 0.07 and missed == 0


def test_shingles_of_whole_texts():
    texts = ["A b c d E f", "a b  c\nd e F", "a b c d", "", None, "x " * 3000, "é b c d e f"]
    sets = sh.shingle_sets(pa.array(texts))
    assert [len(s) for s in sets] == [2, 2, 1, 0, 0, 1, 1]
    assert (sets[0] == sets[1]).all()
    assert sh.fingerprint(sets[0]) == sh.fingerprint(sets[1]) != sh.fingerprint(sets[2])


def test_texts_that_share_a_doc_id(spark, docs):
    """A link of the second text of an id counts, whatever text of the id comes first."""
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    for order in ([(1, a), (2, b), (2, a + " more")], [(2, a + " more"), (1, a), (2, b)], [(1, a), (2, a + " more"), (2, b), (3, b + " x"), (2, b)]):
        got = near_dedup.near_duplicates(docs(order), 85).collect()
        of = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in got}
        assert len(got) == len(order) and of[2, 57] == (1, False) and of[1, 56] == (1, True) and of[2, 56] == (2, True)
        kept = {(r.doc_id, r.text) for r in near_dedup.deduplicate(docs(order), 85).collect()}
        assert kept == {(1, a), (2, b)}
