"""Held-out accuracy of the classifiers, and their parts against plain computations."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lineamix.llm import quality, toxicity
from lineamix.llm.toxicity import LevenshteinAutomaton, Lexicon, edits


def test_features_of_odd_texts():
    texts = ["", None, "A", "word word WORD", "ab|cd!! %%% 12\nx.", "é" * 5000, "  \n"]
    x = quality.text_features(pa.array(texts))
    assert np.isfinite(x).all() and x.shape == (7, len(quality.FEATURES))
    assert (x[0] == x[1]).all() and x[3][quality.FEATURES.index("repeated_word")] == 1 / 3
    assert (quality.text_features(pa.array(["q r s", *texts]))[1:] == x).all()
    assert (quality.text_features(pa.array(["q", *texts]).slice(1)) == x).all()


def test_additive_model_learns_an_interaction():
    pick = np.random.default_rng(2)
    x = pick.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert ((model.scores(x[3000:]) > 0.5) == y[3000:]).mean() > 0.93
    for bare in (quality.fit(x[:0], y[:0]), quality.fit(x[:5], np.ones(5))):
        assert len(set(bare.scores(x).tolist())) == 1


def held_out(frame, labels, name):
    rows = frame.join(labels, "doc_id").where("held_out").select("score", "predicted", name).collect()
    good = [r.score for r in rows if r[name] == 1]
    bad = [r.score for r in rows if r[name] == 0]
    right = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / max(len(good) * len(bad), 1)
    return right, sum(r.predicted == 1 for r in rows if r[name] == 1) / max(len(good), 1), sum(r.predicted == 1 for r in rows if r[name] == 0) / max(len(bad), 1)


def test_quality_on_held_out_rows(spark):
    import os
    folder = os.path.join(os.environ.get("LINEAMIX_TESTDATA", "/root/testdata"), "sf0.01")
    auc, kept, wrong = held_out(quality.quality_classifier(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"), "quality")
    assert auc > 0.95 and kept > 0.95 and wrong < 0.2


def test_toxicity_on_held_out_rows(spark):
    import os
    folder = os.path.join(os.environ.get("LINEAMIX_TESTDATA", "/root/testdata"), "sf0.1")
    auc, caught, wrong = held_out(toxicity.toxicity(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"), "toxic")
    assert auc > 0.93 and caught > 0.8 and wrong < 0.02


def test_nothing_to_learn_from(spark, docs):
    made = docs([(1, "a b"), (2, None), (None, "")]).withColumns({"label": F.lit(1), "score": F.lit(2)})
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (7, 0, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(made, labels, F.lit(True))
    assert quality.score_documents(made, model, F.lit(False)).select("score").distinct().count() == 1
    assert quality.keep_good(made, labels).count() in (0, 3)
    other = toxicity.train(made, labels, F.lit(True))
    assert made.select(toxicity.score_column(other, F.col("text")).alias("s")).distinct().count() == 1
    assert quality.score_documents(docs([]), model, F.lit(False)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    pick = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(pick.choice("abc") for _ in range(pick.randint(1, 9))) for _ in range(2))
        automaton = LevenshteinAutomaton(a, 2)
        state = automaton.start()
        for letter in b:
            state = automaton.step(state, letter)
        d = distance(a, b)
        assert automaton.distance(state) == (d if d <= 2 else None)


def same(*terms):
    return Lexicon({t: (2.0, 2.0, 2.0) for t in terms})


def spoil(word, times, pick):
    letters = "abcdefghijklmnopqrstuvwxyz"
    for _ in range(times):
        i = pick.randrange(len(word) + 1)
        word = pick.choice((word[:i] + pick.choice(letters) + word[i:], word[:i] + word[i + 1:], word[:i] + pick.choice(letters) + word[i + 1:]))
    return word


def test_lexicon_finds_every_near_word():
    pick = random.Random(6)
    terms = ["scum", "idiot", "morons", "pathetic", "disgusting", "é" * 9 + "ab"]
    lexicon = same(*terms)
    words = sorted({spoil(pick.choice(terms), pick.randint(0, 3), pick) for _ in range(4000)})
    hits = lexicon.hits(words)
    for i, word in enumerate(words):
        best = min(((distance(word, t), t) for t in terms if distance(word, t) <= edits(len(t))), default=None)
        assert hits.get(i) == (best and (best[1], best[0])), word
    odd = ["idi0t", "m0r0ms", "loweischaft", "l0weix", "1234", "", "lowe", "harm"]
    lexicon = Lexicon({"idiot": (2.0, 1.0, 1.0), "morons": (2.0, 1.0, 1.0), "lowei*": (1.0,) * 3, "harmless": (1.0,) * 3}, frozenset({"harmles"}))
    assert lexicon.hits(odd) == {0: ("idiot", 0), 1: ("morons", 1), 2: ("lowei*", 0), 3: ("lowei*", 0)}
    assert lexicon.hits(["harmles", "harmlss"]) == {1: ("harmless", 1)}
    assert Lexicon({}).hits(odd) == {}


def test_context():
    texts = ['he said "you idiot go" and left', "you idiot and moron", "you idoit idiott", "", None, "idiot " * 9000, "so “idiot” said"]
    x = toxicity.hit_features(pa.array(texts), same("idiot", "moron"))
    assert x[0][2] > 0 == x[0][0] and x[1][3] > 0 and x[2][0] > 0 and not x[3].any() and not x[4].any() and np.isfinite(x).all() and x[6][2] > 0
    hits = list(toxicity.word_hits(pa.array(texts), same("idiot", "moron")))
    assert hits[1] == [("idiot", 0, "idiot"), ("moron", 0, "moron")] and sorted(h[1] for h in hits[2]) == [1] and hits[4] == []
    assert toxicity.hit_features(pa.array([], pa.string()), same("idiot")).shape == (0, toxicity.FEATURES)


def test_misspellings_of_rare_terms_are_found(spark, docs):
    pick = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    plain, terms = (["".join(pick.choice(letters) for _ in range(7)) for _ in range(n)] for n in (300, 40))
    made, marks = [], []
    for i in range(1200):
        toxic = i % 3 == 0
        words = [pick.choice(plain) for _ in range(30)]
        for j in range(3 * toxic):
            term = pick.choice(terms)
            words[7 * j + 3] = term if j else term[:3] + "q" + term[4:]
        made.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    model = toxicity.train(docs(made), labels, F.lit(True))
    assert len(set(terms) & set(model.lexicon.terms)) >= 30
    words = [w[:5] + "q" + w[6:] for w in terms if w in model.lexicon.terms][:4]
    bad, good = toxicity.hit_features(pa.array([" ".join(plain[:20] + words), " ".join(plain[:24])]), model.lexicon)
    assert model.scores(np.array([bad]))[0] > toxicity.THRESHOLD > model.scores(np.array([good]))[0]
    nobody = docs(made).limit(0)
    assert nobody.select(toxicity.score_column(model, F.col("text")).alias("s")).count() == 0


def test_planted_misspellings_and_quotations(spark):
    """Held-out toxic texts whose insults are all misspelled stay toxic; clean ones that quote them stay clean."""
    import os
    folder = os.path.join(os.environ.get("LINEAMIX_TESTDATA", "/root/testdata"), "sf0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    held = quality.remainder(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs, labels, ~held)
    strong = [t for t, v in model.lexicon.terms.items() if v[0] > 3 and v[1] > 3]
    assert len(strong) >= 5
    pick, bent, quoted, rows = random.Random(3), [], [], docs.join(labels, "doc_id").where(held).select("text", "toxic").collect()
    for r in rows:
        words = (r.text or "").split(" ")
        bad = [i for i, w in enumerate(words) if w.strip(".,").lower() in strong]
        if r.toxic and bad:
            for i in bad:
                w = words[i].strip(".,")
                k = pick.randrange(1, len(w))
                words[i] = pick.choice((w[:k] + "q" + w[k:], w[:k] + "q" + w[k + 1:])) if edits(len(w)) else w
            bent.append(" ".join(words))
        elif not r.toxic and len(words) > 30:
            words[len(words) // 2] = f'"{pick.choice(strong)}"'
            quoted.append(" ".join(words))
    scores = [model.scores(toxicity.hit_features(pa.array(some), model.lexicon)) for some in (bent, quoted)]
    assert len(bent) > 50 and (scores[0] >= toxicity.THRESHOLD).mean() >= 0.9
    assert len(quoted) > 500 and (scores[1] < toxicity.THRESHOLD).mean() >= 0.95


def test_quality_tables_against_row_by_row_sums():
    """Vectorised bin additions give what one row after the other gives, edges and pairs included."""
    from bisect import bisect_right

    pick = np.random.default_rng(5)
    x = np.round(pick.random((600, 5)) * 6, 1)  # many values stand on an edge
    y = ((x[:, 0] > 3) ^ (x[:, 1] > 3) ^ (pick.random(600) < 0.1)).astype(float)
    model = quality.fit(x, y, bins=12, pair_bins=5, rounds=30)
    assert model.pairs
    for row, got in zip(x, model.logits(x)):
        want = model.base
        for value, edges, table in zip(row, model.edges, model.tables):
            want += table[bisect_right(edges.tolist(), value)]
        for (a, b), table in zip(model.pairs, model.pair_tables):
            want += table[bisect_right(model.pair_edges[a].tolist(), row[a])][bisect_right(model.pair_edges[b].tolist(), row[b])]
        assert abs(got - want) < 1e-9


def test_quality_query_against_single_texts(spark, sf_dir):
    """The query's scores are those of each text alone, and labels of held-out rows change nothing."""
    import zlib

    got = {r.doc_id: r for r in quality.quality_classifier(spark, sf_dir).collect()}
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    held = quality.remainder(F.col("doc_id"), 4) == 2
    model = quality.train(docs, labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))), ~held)
    rows = docs.collect()
    assert len(rows) == len(got)
    for r in rows:
        one = got[r.doc_id]
        score = float(model.scores(quality.text_features(pa.array([r.text])))[0])
        assert abs(one.score - score) < 1e-9 and one.predicted == int(score >= quality.THRESHOLD)
        assert one.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
