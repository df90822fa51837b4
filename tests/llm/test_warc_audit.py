import glob

import pytest
from pyspark.sql import functions as F

from lineamix.llm.common import new_folder
from lineamix.llm.warc_audit import audit, read_warc, tree, warc_record, write_warc

PAGES = "key bigint, url string, html string"


def records(spark, rows):
    return spark.createDataFrame(rows, PAGES).repartition(3).withColumn("record", warc_record(F.col("url"), F.col("html"))).withColumn("digest", F.lit(1))


ROWS = [(i, f"http://h/{i}", f"<p>é page {i}</p>\r\n\r\n" * (i % 7)) for i in range(150)] + [(None, None, None), (7, "http://h/7", ""), (150, "u", "x" * 100_000)]


def test_damage_is_found(spark, rows):
    sound = tree(records(spark, ROWS), segment=64, fanout=4, levels=3)
    assert [r.offset for r in sound[0].where("segment = 0").orderBy("node").collect()][:2] == [0, sound[0].where("segment = 0 AND node = 0").first().length]
    again = tree(records(spark, ROWS[::-1]), segment=64, fanout=4, levels=3)
    assert audit(sound, again, 4).count() == 0
    broken = [(k, u, "?" + (h or "")[1:] if k in (20, 99) else h) for k, u, h in ROWS]
    found = audit(sound, tree(records(spark, broken), segment=64, fanout=4, levels=3), 4)
    changed = {r.key: r.status for r in found.collect()}
    assert changed[20] == "changed" and changed[99] == "changed" and set(changed) <= {20, 99} | set(range(21, 64)) | set(range(99, 151))
    same_length = [(k, u, (h or "")[:-1] + "#" if k == 20 else h) for k, u, h in ROWS]
    only = audit(sound, tree(records(spark, same_length), segment=64, fanout=4, levels=3), 4).collect()
    assert [(r.key, r.status, r.length) for r in only] == [(20, "changed", sound[0].where("key = 20").first().length)]
    cut = audit(sound, tree(records(spark, [r for r in ROWS if r[0] != 150]), segment=64, fanout=4, levels=3), 4).collect()
    assert [(r.key, r.status) for r in cut] == [(150, "missing")]
    none = tree(records(spark, []), segment=64, fanout=4, levels=3)
    assert audit(none, none, 4).count() == 0 and audit(sound, none, 4).count() == len(ROWS)
    with pytest.raises(ValueError):
        tree(records(spark, []), segment=65, fanout=4, levels=3)


def test_archive_round_trip(spark, rows):
    path = new_folder(spark, "warc")
    write_warc(records(spark, ROWS), path)
    got = read_warc(spark, path)
    assert got.where("NOT whole").count() == 0
    assert rows(got, "url", "payload") == sorted((u or "", h or "") for _, u, h in ROWS)
    first = sorted(glob.glob(path + "/*.txt"))[0]
    with open(first, "rb") as file:
        assert file.read().startswith(b"WARC/1.1\r\n")


def test_lost_repeated_and_truncated_records_are_located(spark):
    urls = [f"http://h/{i:04}" for i in range(400)]
    pages = spark.createDataFrame([(u, f"<p>page {u}</p>" * 3) for u in urls], "url string, html string")
    archive = pages.select(warc_record(F.col("url"), F.col("html")).alias("record"), "url")

    def replica_of(kept):
        path = new_folder(spark, "warc")
        write_warc(kept, path)
        back = read_warc(spark, path)
        return back.select(F.col("url").alias("key"), warc_record(F.col("url"), F.col("payload")).alias("record"))

    shape = dict(segment=64, fanout=4, levels=3)
    sound = tree(replica_of(archive), **shape)
    lost, twice, cut, longer = urls[0], urls[101], urls[202], urls[303]
    text = F.when(F.col("url") == cut, F.expr("left(record, length(record) - 9)")).when(F.col("url") == longer, F.concat("record", F.lit("more"))).otherwise(F.col("record"))
    more = spark.createDataFrame([("http://h/0150x", "new")], "url string, html string").select(warc_record(F.col("url"), F.col("html")).alias("record"), "url")
    other = archive.where(F.col("url") != lost).unionByName(archive.where(F.col("url") == twice)).unionByName(more).withColumn("record", text)
    expected = sorted([(lost, "missing"), (twice, "extra"), (cut, "changed"), (longer, "changed"), ("http://h/0150x", "extra")])
    theirs = tree(replica_of(other), **shape, like=sound)
    assert sorted((r.key, r.status) for r in audit(sound, theirs, 4).collect()) == expected
    same_leaves = sound[1].join(theirs[1], ["segment", "node", "length", "digest"]).count()
    assert same_leaves >= sound[1].count() - 5  # all else is not read
    assert sorted((r.key, r.status) for r in audit(sound, tree(replica_of(other), **shape), 4).collect()) == expected
    nothing = tree(replica_of(archive.where("false")), **shape)
    assert audit(nothing, tree(replica_of(archive), **shape, like=nothing), 4).where("status = 'extra'").count() == 400
