import random

import pytest

from lineamix.functions import phred
from lineamix.operators import intervals, reads
from lineamix.plans import studies

READ = "qname string, flag int, chrom string, start bigint, end bigint"
REGION = "chrom string, start bigint, end bigint"


def make_reads(rng, n):
    out = []
    for i in range(n):
        start = rng.choice([rng.randint(0, 400), rng.randint(0, 70_000), 5_000])
        length = rng.choice([0, 1, 30, 150, 3_000, 60_000])
        chrom = rng.choice(["c1", "c2"])
        out.append((f"r{i}", rng.choice([0, 16, 64, 144]), chrom, start, start + length))
    return out + [("u", 4, None, None, None)]


def make_regions(rng, n):
    out = [("c1", 5_010, 5_010), ("c1", 250, 260), ("c2", 0, 1)]
    for _ in range(n):
        start = rng.randint(0, 70_000)
        out.append((rng.choice(["c1", "c2", "c3"]), start, start + rng.choice([0, 1, 25, 700])))
    return out


def overlaps(r, g):
    return r[2] == g[0] and r[3] is not None and r[3] < g[2] and r[4] > g[1]


def test_overlap_equals_naive_join(spark):
    rng = random.Random(8)
    data, regions = make_reads(rng, 900), make_regions(rng, 40)
    r, g = spark.createDataFrame(data, READ), spark.createDataFrame(regions, REGION)
    expected = {d[0] for d in data if not any(overlaps(d, x) for x in regions)}
    kept = [x.qname for x in intervals.outside_regions(r, g).collect()]
    assert set(kept) == expected and len(kept) == len(expected) and "u" in expected
    hit = [x.qname for x in intervals.inside_regions(r, g).collect()]
    assert sorted(hit + kept) == sorted(d[0] for d in data)


def test_half_open_borders(spark, rows):
    r = spark.createDataFrame([("a", 0, "c", 10, 20), ("b", 0, "c", 20, 30), ("c", 0, "c", 19, 21)], READ)
    g = spark.createDataFrame([("c", 20, 25)], REGION)
    assert rows(intervals.outside_regions(r, g), "qname") == [("a",)]


def test_clip_equals_naive_rule(spark):
    rng = random.Random(9)
    data, primers = make_reads(rng, 700), make_regions(rng, 60)
    got = {
        x.qname: x.clip
        for x in intervals.clip_lengths(spark.createDataFrame(data, READ), spark.createDataFrame(primers, REGION)).collect()
    }

    def clip(d):
        best = 0
        for p in primers:
            if overlaps(d, p):
                if not d[1] & 16 and p[1] <= d[3]:
                    best = max(best, min(p[2], d[4]) - d[3])
                if d[1] & 16 and p[2] >= d[4]:
                    best = max(best, d[4] - max(p[1], d[3]))
        return best

    assert got == {d[0]: clip(d) for d in data}
    assert any(got.values())


def test_clipped_reads_move_the_five_prime_end(spark, rows):
    r = spark.createDataFrame([("f", 0, "c", 10, 100), ("r", 16, "c", 10, 100)], READ)
    g = spark.createDataFrame([("c", 5, 30), ("c", 80, 100)], REGION)
    assert rows(studies.clipped_reads(r, g), "qname", "start", "end") == [("f", 30, 100), ("r", 10, 80)]


def test_mates_and_flags(spark, rows):
    df = spark.createDataFrame(
        [("s", "p", 64), ("s", "p", 128), ("s", "q", 64), ("s", "q", 64 | 0x100), ("s", "o", 0)],
        "sample string, qname string, flag int",
    )
    got = rows(reads.mate_pairs(df), "qname", "mate", "singleton")
    assert got == [("o", 0, True), ("p", 1, False), ("p", 2, False), ("q", 1, True)]
    flags = spark.createDataFrame([(f,) for f in (4, 16, 272, 2064, 0)], "flag int")
    assert rows(reads.primary_alignments(flags)) == [(0,), (16,)]


def test_haplotypes_last_alignment_wins(spark, rows):
    aln = spark.createDataFrame(
        [("h1", 0, "A", 1), ("h1", 16, "B", 2), ("h1", 272, "C", 3), ("h2", 0, "B", 4), ("h3", 4, "*", 5), ("h4", 0, "A", 6)],
        "hap_id string, flag int, lineage string, line_no bigint",
    )
    haps = spark.createDataFrame([("h1", 0.25), ("h2", 0.5), ("h3", 0.25)], "hap_id string, frequency double")
    assert rows(reads.haplotype_abundance(haps, aln)) == [("B", 0.75)]


def test_routes(spark, rows):
    samples = spark.createDataFrame([("a",), ("b",), ("c",)], "sample string")
    sheet = spark.createDataFrame([("a", "v3"), ("b", None)], "sample string, primer string")
    assert rows(reads.route_reads(samples, sheet), "sample", "route") == [("a", "clipped"), ("b", "trimmed"), ("c", "trimmed")]
    assert {r.route for r in reads.route_reads(samples, sheet.drop("primer")).collect()} == {"trimmed"}
    assert {r.route for r in reads.route_reads(samples, sheet, simulated=True).collect()} == {"raw_mix"}


def text(scores):
    return "".join(chr(33 + s) for s in scores)


def plain_trim(scores, window=4, mean=20):
    w = min(window, len(scores))
    good = [i for i in range(len(scores) - w + 1) if sum(scores[i:i + w]) >= mean * w] if w else []
    return (good[0], good[-1] + w) if good else None


@pytest.fixture
def quality_reads(spark):
    rng = random.Random(4)
    scores = [[rng.choice([2, 15, 20, 25, 40]) for _ in range(rng.randint(0, 60))] for _ in range(300)]
    scores += [[40], [2], [20, 20], [], [40] * 4, [2] * 9 + [40] * 4]
    data = [(str(i), "s" if i % 3 else "t", "acgtn"[i % 5] * len(s), text(s)) for i, s in enumerate(scores)]
    return scores, data, spark.createDataFrame(data, "read_id string, sample string, seq string, qual string")


def test_quality_trim_equals_plain_windows(quality_reads):
    scores, data, df = quality_reads
    got = {r.read_id: (r.seq, r.qual) for r in reads.quality_trim(df.repartition(5)).collect()}
    expected = {}
    for (read_id, _, seq, qual), s in zip(data, scores):
        part = plain_trim(s)
        if part:
            expected[read_id] = (seq[part[0]:part[1]], qual[part[0]:part[1]])
    assert got == expected


def test_quality_filter_share(spark, rows):
    df = spark.createDataFrame(
        [("keep", text([40] * 6 + [2] * 4)), ("drop", text([40] * 5 + [2] * 5)), ("edge", text([30] * 10))],
        "read_id string, qual string",
    )
    assert rows(reads.quality_filter(df), "read_id") == [("edge",), ("keep",)]
    assert df.select(phred.low_bases(df.qual, 30).alias("n")).agg({"n": "sum"}).first()[0] == 9


def test_read_qc_equals_plain_sums(quality_reads):
    scores, data, df = quality_reads
    got = {(r["sample"], r.pos): (r.n_reads, round(r.mean_quality, 6), r.n_a, r.n_c, r.n_g, r.n_t)
           for r in reads.read_qc(df.repartition(3)).collect()}
    cells = {}
    for (_, sample, seq, _), s in zip(data, scores):
        for i, q in enumerate(s):
            cells.setdefault((sample, i + 1), []).append((q, seq[i]))
    expected = {
        k: (len(v), round(sum(q for q, _ in v) / len(v), 6), *[sum(b == x for _, b in v) for x in "acgt"])
        for k, v in cells.items()
    }
    assert got == expected


def test_contig_lengths_ignore_white_space(spark, rows):
    df = spark.createDataFrame([("c", "ac\ngt \n")], "contig string, sequence string")
    assert rows(reads.contig_lengths(df)) == [("c", 4)]


def test_kernels_do_not_depend_on_where_reads_are_cut():
    """Parts of a few bases give what whole batches give, also for reads longer than a part."""
    import random

    import numpy as np
    import pandas as pd

    from lineamix.functions import phred

    pick = random.Random(3)
    quals = ["".join(chr(33 + pick.choice([5, 15, 20, 35, 40])) for _ in range(pick.choice([0, 1, 3, 4, 9, 50, 700]))) for _ in range(120)]
    quals[7] = None

    def plain(q, window, mean):
        q = [ord(c) - 33 for c in q or ""]
        width = min(window, len(q))
        hits = [i for i in range(len(q) - width + 1) if width and sum(q[i:i + width]) >= width * mean]
        return (hits[0] + 1, hits[-1] - hits[0] + width) if hits else None

    for most in (10, 64, 1 << 21):
        got = phred.window_bounds(4, 20, most).func(pd.Series(quals))
        assert [None if pd.isna(a) else (a, k) for a, k in zip(got["at"], got["kept"])] == [plain(q, 4, 20) for q in quals]
    frame = pd.DataFrame({"sample": [f"s{i % 3}" for i in range(120)], "seq": [None if q is None else "ACgtN"[len(q) % 5] * len(q) for q in quals], "qual": quals})
    sums = []
    for most in (10, 64, 1 << 21):
        out = pd.concat(phred.position_sums(["sample"], ("a", "c", "g", "t"), most)(iter([frame, frame.iloc[:0], frame.iloc[:5]])))
        sums.append(out.groupby(["sample", "pos"], as_index=False).sum().to_numpy().tolist())
    assert sums[0] == sums[1] == sums[2] and len(sums[0]) > 1500


def test_position_sums_hold_little_whatever_comes(monkeypatch):
    """Frames that leave are small, and all of them together add up, however many keys and lengths come."""
    import numpy as np
    import pandas as pd

    from lineamix.functions import phred

    monkeypatch.setattr(phred, "LEAVING", 300, raising=False)
    monkeypatch.setattr(phred, "HELD", 900, raising=False)
    lengths = [(7 * i) % 200 for i in range(400)]
    frame = pd.DataFrame({"sample": [None if i % 9 == 0 else f"s{i % 7}" for i in range(400)], "seq": ["A" * n for n in lengths], "qual": ["5" * n for n in lengths]})
    outs = list(phred.position_sums(["sample"], ("a", "c", "g", "t"), 500)(frame.iloc[i:i + 50] for i in range(0, 400, 50)))
    assert max(map(len, outs)) <= 300 + 200
    got = pd.concat(outs).groupby(["sample", "pos"], dropna=False)["n_a"].sum()
    want = pd.DataFrame({"sample": np.repeat(frame["sample"], lengths), "pos": np.concatenate([np.arange(1, n + 1) for n in lengths])})
    assert got.sum() == sum(lengths) and sorted(got) == sorted(want.groupby(["sample", "pos"], dropna=False).size())


def test_read_qc_of_null_keys_and_other_letters(spark):
    df = spark.createDataFrame(
        [(None, 1, "aCé", "5~5"), (None, 1, "G", "é"), ("s", None, None, None), ("s", None, "t", None), ("s", 2, "", "II")],
        "sample string, mate int, seq string, qual string",
    )
    got = {(r["sample"], r.mate, r.pos): (r.n_reads, r.mean_quality, r.n_a, r.n_c, r.n_g, r.n_t) for r in reads.read_qc(df, ["sample", "mate"]).collect()}
    assert got == {
        (None, 1, 1): (2, (20 + 233 - 33) / 2, 1, 0, 1, 0), (None, 1, 2): (1, 93.0, 0, 1, 0, 0), (None, 1, 3): (1, 20.0, 0, 0, 0, 0),
        ("s", None, 1): (1, None, 0, 0, 0, 1), ("s", 2, 1): (1, 40.0, 0, 0, 0, 0), ("s", 2, 2): (1, 40.0, 0, 0, 0, 0),
    }
