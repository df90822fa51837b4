from pyspark.sql import functions as F

from lineamix.llm.decontamination import contaminated, decontaminate

ITEM = "Today Anna buys 12 apples for 3 dollars and later she sells 5 apples to Bob for 2 dollars so how much is left now"
OTHER = "In the small village near Paris lived 40 people and 7 dogs who never crossed the river before the bridge was built"
FILLER = "some words that come before the text and have nothing to do with it at all."


def found(spark, docs, rows, items):
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumn("slots", F.lit(1))
    made = docs(rows).withColumns({"window": F.lit(1), "id": F.lit(2), "position": F.lit(3)})
    out = {(r.doc_id, r.item_id): r.changed_slots for r in contaminated(made, benchmark).collect()}
    left = sorted(((r.doc_id, r.text) for r in decontaminate(made, benchmark).collect()), key=str)
    gone = {d for d, _ in out}
    assert left == sorted(((i, t) for i, t in rows if i not in gone or i is None), key=str)
    return out


def test_passages(spark, docs):
    changed = ITEM.replace("12", "4,500").replace("Anna", "Mary Jane Smith").replace("Bob", "Tom").replace("3 dollars", "9 euros").replace("5 apples", "8 apples").replace("2 dollars", "17 pounds")
    inconsistent = OTHER + " . " + "Again Anna saw Bob and then Anna met Bob while Anna told Bob that they were late for the party"
    twisted = "Again Carl saw Dan and then Eve met Dan while Carl told Dan that they were late for the party"
    items = [(1, ITEM), (2, OTHER), (3, "Again Anna saw Bob and then Anna met Bob while Anna told Bob that they were late for the party"),
             (4, None), (5, ""), (6, "of the"), (7, "11 22 33 44 55 66 77")]
    rows = [
        (1, f"{FILLER} {ITEM} {FILLER}"), (2, f"{FILLER}\n{changed}. {FILLER}"), (3, FILLER), (4, None), (5, ""),
        (6, f"{ITEM[:60]} {FILLER}"), (7, twisted), (8, twisted.replace("Eve", "Carl")), (9, OTHER.upper()),
        (10, "it is of the kind"), (11, "Of the!"), (12, "1 2 3 4 5 6 7 8 9"), (13, FILLER * 3000 + ITEM), (1, f"{FILLER} {ITEM} {FILLER}"), (14, inconsistent),
    ]
    got = found(spark, docs, rows, items)
    assert got.keys() == {(1, 1), (2, 1), (8, 3), (9, 2), (11, 6), (13, 1), (14, 2), (14, 3)} | {k for k in got if k == (12, 7)}
    assert (12, 7) not in got
    assert got[1, 1] == 0 and got[13, 1] == 0 and got[2, 1] >= 5


def test_empty_tables(spark, docs):
    assert found(spark, docs, [], [(1, ITEM)]) == {}
    assert found(spark, docs, [(1, ITEM)], []) == {}


def test_null_id_is_judged_by_its_own_text(spark, docs):
    benchmark = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    left = decontaminate(docs([(None, ITEM), (None, FILLER), (2, None)]), benchmark)
    assert sorted(r.text or "" for r in left.collect()) == ["", FILLER]


LONG = ("On the first day of spring the old keeper of the harbour opened the wooden gate and counted all boats that had come from New York "
        "and San Jose during the winter while his daughter wrote down their names")


def test_edited_recased_and_partial_passages(spark, docs):
    words = LONG.split()
    short = "Which of the four rivers that cross this country carries the most water every single year"
    edits = {
        1: words[:19] + ["certainly"] + words[19:], 2: [{9: "captain", 30: "hard"}.get(i, w) for i, w in enumerate(words)], 3: LONG.lower().split(),
        4: words[: len(words) * 3 // 4], 5: short.replace("country", "region").split(), 6: words[:12] + FILLER.split() + words[28:],
    }
    got = found(spark, docs, [(k, f"{FILLER} {' '.join(w)} {FILLER}") for k, w in edits.items()], [(1, LONG), (2, short)])
    assert got.keys() == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 2)}


def test_other_names_at_sentence_beginnings_and_many_slots(spark, docs):
    sold = "Natalia sold clips to 48 friends in the spring. Natalia then sold half as many in the summer. Natalia keeps the money in a box under her old bed."
    dense = "Anna has 3 apples, Bob has 5 pears, Carl has 7 plums and Dora has 9 figs."
    other = dense.replace("Anna", "Emil").replace("Bob", "Fritz").replace("Carl", "Gina").replace("Dora", "Hans").translate(str.maketrans("3579", "4682"))
    got = found(spark, docs, [(1, f"{FILLER} {sold.replace('Natalia', 'Mary')}"), (2, f"{FILLER} {other} {FILLER}"), (3, FILLER)], [(1, sold), (2, dense)])
    assert got.keys() == {(1, 1), (2, 2)} and got[1, 1] >= 1 and got[2, 2] >= 6


def test_query_against_containment(spark, sf_dir):
    """Every document that holds a whole item is found; what is found shares most of the item's words in order."""
    import difflib
    import os
    import re

    from lineamix.llm.decontamination import decontamination

    folder = os.path.join(os.path.dirname(sf_dir), "sf0.01") if os.path.isdir(os.path.join(os.path.dirname(sf_dir), "sf0.01")) else sf_dir
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    rows = decontamination(spark, folder).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert len(rows) == len(got) and got >= {(d, i) for d, t in texts.items() for i, x in items.items() if x and x in t} != set()

    def plain(text):
        return [re.sub(r"\d+", "#", w.strip(".,;:!?\"'()").lower()) for w in text.split()]

    for d, i in got:
        doc, item = plain(texts[d]), plain(items[i])
        same = max((sum(b.size for b in difflib.SequenceMatcher(None, doc[k:k + 2 * len(item)], item, False).get_matching_blocks())
                    for k in range(0, max(len(doc) - len(item), 1), max(len(item) // 2, 1))), default=0)
        assert same >= 0.5 * len(item), (d, i)
