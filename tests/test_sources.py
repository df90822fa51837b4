import gzip
import os
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lineamix.functions import names
from lineamix.operators import reads, solutions, variants
from lineamix.plans import studies
from lineamix.sources import genomics, lines, posterior, sinks, tables


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    if name.endswith(".gz"):
        with gzip.open(path, "wt") as f:
            f.write(text)
    else:
        path.write_text(text)
    return str(path)


def test_numbered_lines_over_many_splits(spark, tmp_path):
    text = "".join(f"line {i}\n" for i in range(5000))
    a, b = put(tmp_path, "a.txt", text), put(tmp_path, "b.txt", "only\n\nlast")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        got = lines.numbered_lines(spark, [a, b]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    first = {r.line_no: r.value for r in got if r.file.endswith("a.txt")}
    assert first == {i: f"line {i}" for i in range(5000)}
    assert {r.line_no: r.value for r in got if r.file.endswith("b.txt")} == {0: "only", 1: "", 2: "last"}


def test_path_dims(spark, rows):
    cases = {
        "file": [("/x/S1.csv", "S1", None), ("/x/S1-100x.tar.csv", "S1", "100x")],
        "folder": [("/x/S2-1000x/out.tsv", "S2", "1000x"), ("/x/S2/out.tsv", "S2", None)],
        "quant_folder": [("/x/quant_results_S3-100x/abundance.tsv", "S3", "100x")],
    }
    for layout, expected in cases.items():
        df = spark.createDataFrame([(e[0],) for e in expected], "file string")
        assert rows(lines.path_dims(df, layout)) == sorted(expected)


def test_posterior_ragged(spark, tmp_path, rows):
    a = put(tmp_path, "S1-100x.csv", "density,odds,A,B\n0.5,1.0,+6.2500e-3,0.99375\n0.5,1.00,1,0.0\n\n")
    b = put(tmp_path, "S2-1000x.csv", "density,odds,Q\n0.1,0.9,1.0\n")
    df = posterior.read_posterior(spark, [a, b])
    assert rows(df, "sample", "coverage", "solution", "ord", "odds", "lineage", "fraction") == [
        ("S1", "100x", 1, 2, 1.0, "A", 0.00625), ("S1", "100x", 1, 3, 1.0, "B", 0.99375),
        ("S1", "100x", 2, 2, 1.0, "A", 1.0), ("S1", "100x", 2, 3, 1.0, "B", 0.0),
        ("S2", "1000x", 1, 2, 0.9, "Q", 1.0),
    ]
    best = solutions.best_solutions(df)
    assert rows(solutions.dominant_per_solution(best), "solution", "lineage") == [(1, "B"), (2, "A")]


def test_call_tables_first_rows_and_predictions(spark, tmp_path, rows):
    put(tmp_path, "calls/S1-100x.csv", "taxon,lineage,x,scorpio_call\nq,BA.1,1,Omicron (BA.1-like)\nq,B.2,1,None\n")
    put(tmp_path, "calls/S2-100x.csv", "taxon,lineage,x,scorpio_call\nq,AY.4,1,\n")
    calls = tables.read_consensus_calls(spark, str(tmp_path / "calls"))
    assert rows(studies.consensus_predictions(calls), "sample", "prediction", "who_name", "fraction") == [
        ("S1", "B.2", "None", 1.0), ("S1", "BA.1", "omicron", 1.0), ("S2", "AY.4", None, 1.0)
    ]
    assert rows(tables.first_rows(calls), "sample", "lineage") == [("S1", "BA.1"), ("S2", "AY.4")]
    put(tmp_path, "clades/S1-100x/n.tsv", "index;clade;Nextclade_pango;clade_who\n0;21K;BA.1;Omicron\n")
    clades = tables.read_clade_calls(spark, str(tmp_path / "clades" / "*"), sep=";")
    assert rows(studies.clade_predictions(clades), "sample", "prediction", "who_name") == [("S1", "BA.1", "omicron")]


def test_other_tables(spark, tmp_path, rows):
    put(tmp_path, "q/quant_results_S1-100x/abundance.tsv", "target_id\tlength\ttpm\nA\t9\t1.5\nB\t9\t0\n")
    assert rows(tables.read_abundance(spark, str(tmp_path / "q" / "*"))) == [("S1", "100x", "A", 1.5), ("S1", "100x", "B", 0.0)]
    clade_map = put(tmp_path, "map.tsv", "21K\tBA.1\n\tBA.2\n")
    assert rows(tables.read_clade_map(spark, clade_map)) == [("21K", "BA.1"), (None, "BA.2")]
    meta = put(tmp_path, "meta.txt", "SRA_ID   CollectionDate\nS1 \t 2021-03-04\nS2  NA\n")
    got = tables.read_whitespace_table(spark, meta, "SRA_ID string, CollectionDate date")
    assert [(a, str(b)) for a, b in rows(got)] == [("S1", "2021-03-04"), ("S2", "None")]
    counts = put(tmp_path, "counts.tsv.gz", "date\tstate\tclade\tsequences\n2024-01-01\tx\tA\t7\n")
    assert rows(tables.read_sequence_counts(spark, counts), "clade", "sequences") == [("A", 7)]
    sheet = put(tmp_path, "sheet.tsv", "sra\nS1\n")
    assert rows(tables.read_sheet(spark, sheet)) == [("S1", None)]
    ids = put(tmp_path, "ids.txt", " K1 \n\nK2\n")
    assert rows(lines.accession_list(spark, ids)) == [("K1",), ("K2",)]
    wide = spark.createDataFrame([("x", "2", "b"), ("x", "1", "a"), ("y", "1", "a")], "a string, b string, c string")
    assert [tuple(r) for r in tables.column_pair(wide, 2, 3, ("clade", "lineage")).collect()] == [("1", "a"), ("2", "b")]


def test_fasta_and_sam(spark, tmp_path, rows):
    fasta = put(tmp_path, "h.fa", ">p1 10x frequency=0.25\nACG\nT\n>p2 none\nGG\n>p3 x frequency=0.75\nA")
    assert rows(genomics.read_fasta(spark, fasta), "contig", "sequence", "frequency") == [
        ("p1", "ACGT", 0.25), ("p2", "GG", None), ("p3", "A", 0.75)
    ]
    haps = genomics.read_haplotypes(spark, fasta)
    rest = "\t60\t{}\t*\t0\t0\tACGT\tIIII\n"
    sam = put(tmp_path, "o.sam", "@SQ\tSN:ref1\n@SQ\tSN:ref2\n"
              + "p1\t16\tref1\t11" + rest.format("2S5M1D3M") + "p1\t272\tref2\t1" + rest.format("4M")
              + "p1\t0\tref2\t21" + rest.format("4M") + "p3\t4\t*\t0" + rest.format("*"))
    aln = genomics.read_sam(spark, sam)
    spans = rows(genomics.alignment_spans(aln), "qname", "chrom", "start", "end")
    assert spans == [("p1", "ref1", 10, 19), ("p1", "ref2", 0, 4), ("p1", "ref2", 20, 24), ("p3", None, None, None)]
    named = aln.select(F.col("qname").alias("hap_id"), "flag", F.col("rname").alias("lineage"), "line_no")
    assert rows(reads.haplotype_abundance(haps, named)) == [("ref2", 0.25)]


def test_fastq_round_trip(spark, tmp_path, rows):
    first = "@r1/1 x\nACGT\n+\n@III\n@r2/1\n\n+\n\n@r3/1\nA\n+r3\nI\n"
    put(tmp_path, "in/S1_1.fastq.gz", first)
    put(tmp_path, "in/S1_2.fastq", "@r1/2\nTT\n+\nII\n")
    got = genomics.read_fastq(spark, str(tmp_path / "in"))
    expected = [("S1", "r1", 1, "ACGT", "@III"), ("S1", "r1", 2, "TT", "II"), ("S1", "r2", 1, "", ""), ("S1", "r3", 1, "A", "I")]
    assert rows(got) == expected
    out = str(tmp_path / "out")
    sinks.write_fastq(got, out)
    texts = []
    for folder, _, files in os.walk(out):
        for f in sorted(files):
            if f.startswith("part-") and "sample=S1" in folder and "mate=1" in folder:
                texts.append(open(os.path.join(folder, f)).read())
    assert sorted("".join(texts).split("@r")[1:]) == ["1/1\nACGT\n+\n@III\n", "2/1\n\n+\n\n", "3/1\nA\n+\nI\n"]


def test_vcf_filter_round_trip(spark, tmp_path, rows):
    head = "##fileformat=VCFv4.2\n##INFO=<ID=X>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tB\tA\n"
    body = ("c\t7\t.\tA\tG,T\t.\t.\t.\tDP:GT\t3:1/1\t4:0|1\n"
            "c\t3\t.\tC\tT\t.\t.\t.\tGT\t./.\t0/0\n" "c\t5\t.\tC\tT\t.\t.\t.\tDP\t1\t2\n")
    path = put(tmp_path, "v.vcf", head + body)
    gt = genomics.read_vcf(spark, path)
    assert rows(gt, "pos", "alts", "lineage", "gt") == [
        (3, ["T"], "A", "0|0"), (3, ["T"], "B", ".|."), (5, ["T"], "A", None), (5, ["T"], "B", None),
        (7, ["G", "T"], "A", "0|1"), (7, ["G", "T"], "B", "1|1"),
    ]
    kept = studies.genotype_filter(gt)
    out = str(tmp_path / "out")
    sinks.write_vcf(kept, genomics.vcf_meta(spark, path), out)
    parts = sorted(f for f in os.listdir(out) if f.startswith("part-"))
    text = "".join(open(os.path.join(out, f)).read() for f in parts).splitlines()
    assert text[:2] == ["##fileformat=VCFv4.2", "##INFO=<ID=X>"] and text[2].endswith("FORMAT\tB")
    assert [line.split("\t")[1] + " " + line.split("\t")[-1] for line in text[3:]] == ["3 .|.", "5 .", "7 1|1"]


def test_bed(spark, tmp_path, rows):
    three = put(tmp_path, "a.bed", "c\t5\t5\nc\t1\t4\n")
    seven = put(tmp_path, "b.bed", "c\t1\t4\tp\t1\t+\tACGT\n")
    assert rows(genomics.read_bed(spark, three), "start", "end", "name") == [(1, 4, None), (5, 5, None)]
    assert rows(genomics.read_bed(spark, seven)) == [("c", 1, 4, "p", "1", "+", "ACGT")]


def test_sinks(spark, tmp_path, rows):
    df = spark.createDataFrame([("S1", "A", 0.5), ("S2", "B", 1.0)], "sample string, lineage string, fraction double")
    sinks.write_by_sample(df, str(tmp_path / "by"))
    assert sorted(f for f in os.listdir(tmp_path / "by") if f.startswith("sample")) == ["sample=S1", "sample=S2"]
    sinks.write_table(df, str(tmp_path / "t"), "\t")
    back = tables.read_table(spark, str(tmp_path / "t"), "fraction double, sample string", "\t")
    assert rows(back, "sample", "fraction") == [("S1", 0.5), ("S2", 1.0)]
    maps = df.groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("lineage", "fraction"))).alias("m"))
    sinks.write_maps(maps, str(tmp_path / "m"))
    assert {r["sample"]: r.m for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {"S1": {"A": 0.5}, "S2": {"B": 1.0}}
    again = sinks.maps_from_json(sinks.maps_to_json(maps, "m"), "m")
    assert {r["sample"]: r.m for r in again.collect()} == {"S1": {"A": 0.5}, "S2": {"B": 1.0}}


def test_names(spark):
    cases = ["AY.4", "B.1.617.2", "BA.5", "XBB", "BE.4", "ay.4"]
    df = spark.createDataFrame([(c,) for c in cases], "n string")
    assert [r[0] for r in df.select(names.classify(F.col("n"))).collect()] == [
        "delta", "delta", "omicron", "recombinant", "other", "other"
    ]
    calls = spark.createDataFrame([("Delta (AY.4-like)",), ("Unknown",), (None,)], "c string")
    assert [r[0] for r in calls.select(names.recode(F.col("c"))).collect()] == ["delta", "Unknown", None]
    order = ["9a", "S2", "S10", "S010b", "S99999999999999999999999", "T"]
    shuffled = spark.createDataFrame([(c,) for c in reversed(order)], "n string")
    assert [r.n for r in shuffled.orderBy(names.natural_key(F.col("n"))).collect()] == order
    one = spark.createDataFrame([("SimulatedSample12", "x")], "a string, b string")
    got = one.select(
        names.numeric_suffix(F.col("a")), names.numeric_suffix(F.col("b")), names.text_from(F.col("a"), "Sample"),
        names.text_from(F.col("b"), "Sample"), names.list_order(F.col("b"), ["w", "x"]),
        names.archive_link(F.col("b"), "https://example.org/"),
    ).first()
    assert tuple(got) == (12, None, "Sample12", "Substring not found", 2, "https://example.org/x")


def test_unknown_layout(spark):
    with pytest.raises(KeyError):
        lines.path_dims(spark.createDataFrame([("x",)], "file string"), "nowhere")


def test_columns_by_the_header_of_each_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("target_id,tpm,length\nx,1.5,700\n")
    (tmp_path / "b.csv").write_text("target_id,length,tpm\ny,900,2.5\n")
    (tmp_path / "c.csv").write_text("length,target_id\n5,z\n")
    (tmp_path / "d.csv").write_text('"target_id","tpm","length"\n')
    got = tables.read_table(spark, str(tmp_path), "target_id string, tpm double")
    assert sorted((r.target_id, r.tpm) for r in got.collect()) == [("x", 1.5), ("y", 2.5), ("z", None)]
    assert sorted(r.target_id for r in tables.first_rows(got).collect()) == ["x", "y", "z"]


def test_cut_off_and_malformed_records_are_errors(spark, tmp_path):
    (tmp_path / "s_1.fastq").write_text("@a\nAC\n+\nII\n\n")
    assert genomics.read_fastq(spark, str(tmp_path / "s_1.fastq")).count() == 1
    (tmp_path / "t_1.fastq").write_text("@a\nAC\n+\nII\n@b\nAC\n")
    with pytest.raises(Exception, match="cut off"):
        genomics.read_fastq(spark, str(tmp_path / "t_1.fastq")).collect()
    (tmp_path / "ok.bed").write_text("#c\ntrack name=x\nchr1\t1\t5\n")
    assert [(r.start, r.end) for r in genomics.read_bed(spark, str(tmp_path / "ok.bed")).collect()] == [(1, 5)]
    (tmp_path / "no.bed").write_text("chr1\t1\t5\nchr1\tx\t9\n")
    with pytest.raises(Exception, match="no bounds"):
        genomics.read_bed(spark, str(tmp_path / "no.bed")).collect()


def test_line_numbers_do_not_depend_on_later_splits(spark, tmp_path):
    (tmp_path / "n.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        numbered = lines.numbered_lines(spark, str(tmp_path / "n.txt"))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
        assert numbered.where("value <> concat('line ', line_no)").count() == 0 and numbered.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _with_splits(spark, size, run):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        return run()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def _vcf(n):
    head = "##fileformat=VCFv4.2\n##INFO=<ID=X>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tB\tA\tC\n"
    body = [f"c{i % 3}\t{n - i if i % 50 else 'x'}\trs{i}\tA\tG,T\t{i}.50\tPASS;q\tX={i};Y\tDP:GT:AD\t3:1/1:4,{i}\t4:0|1\t{i}:1|1:9\n" for i in range(n)]
    return head + "".join(body + body[-1:] * 2)


@pytest.mark.parametrize("size", [10_000_000, 20_000, 700])
def test_variant_lines_come_out_whole(spark, tmp_path, size):
    """Every field, order and repeated records, for two files with different lineages, at several splits."""
    one, two = _vcf(400), _vcf(30).replace("\tB\tA\tC\n", "\tQ\tC\tB\n")
    put(tmp_path, "in/one.vcf", one), put(tmp_path, "in/two.vcf", two)
    out = str(tmp_path / "out")

    def run():
        found = lines.numbered_lines(spark, str(tmp_path / "in"))
        records = genomics.parse_vcf(found)
        kept = spark.createDataFrame([("C",), ("B",), ("nobody",)], "lineage string")
        sinks.write_vcf_files(sinks.filtered_vcf_lines(records, found.where(F.col("value").startswith("#")), kept), out)
        none = sinks.filtered_vcf_lines(records, found.where(F.col("value").startswith("#")), kept.limit(0))
        return none.where("file like '%two.vcf' and line_no = 3").first().value.count("\t"), genomics.genotypes_of(records).where("pos is null").count()

    fields, malformed = _with_splits(spark, size, run)
    assert fields == 8 and malformed == 3 * (8 + 1)
    for name, text, drop in (("one.vcf", one, [10]), ("two.vcf", two, [9])):
        folder = os.path.join(out, f"name={name}")
        got = "".join(open(os.path.join(folder, f)).read() for f in sorted(os.listdir(folder)) if f.startswith("part-")).splitlines()
        want = []
        for line in text.splitlines():
            cells = line.split("\t")
            want.append(line if line.startswith("##") else "\t".join(c for i, c in enumerate(cells) if i not in drop))
        assert got == want


@pytest.mark.parametrize("size", [10_000_000, 5_000, 333, 40])
def test_records_over_splits(spark, tmp_path, size):
    """Reads and alignments do not depend on where a file is cut, even inside every record."""
    made = [(f"r{i}", "ACGT" * (i % 7), "@+II" * (i % 7)) for i in range(301)]
    put(tmp_path, "in/S_1.fastq", "".join(f"@{a}/1 x\n{b}\n+\n{c}\n" for a, b, c in made))
    put(tmp_path, "in/T_2.fastq", "@one/2\nAC\n+one\n@@\n")
    put(tmp_path, "in/U_1.fastq", "")
    got = _with_splits(spark, size, lambda: genomics.read_fastq(spark, str(tmp_path / "in")).collect())
    assert sorted((r.read_id, r.seq, r.qual) for r in got if r.sample == "S") == sorted(made)
    assert [(r.read_id, r.mate, r.seq, r.qual) for r in got if r.sample != "S"] == [("one", 2, "AC", "@@")]
    rows = [f"q{i}\t16\tref\t{i}\t60\t4M\t=\t{i + 9}\t-13\tACGT\tIIII\tNM:i:{i}\tXX:Z:a b" for i in range(200)]
    sam = put(tmp_path, "a.sam", "@HD\tVN:1\n" + "\n".join(rows) + "\n")
    back = _with_splits(spark, size, lambda: genomics.sam_lines(genomics.read_sam(spark, sam)).collect())
    assert [r.value for r in sorted(back, key=lambda r: r.line_no)] == rows and min(r.line_no for r in back) == 1


def test_readers_copy_nothing(spark, tmp_path):
    """No checkpoint and no shuffle of lines: the plans shuffle counts per split only."""
    path = put(tmp_path, "S_1.fastq", "@a\nAC\n+\nII\n" * 50)
    for frame in (genomics.read_fastq(spark, path), lines.numbered_lines(spark, path), genomics.read_sam(spark, path)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "ExistingRDD" not in plan and "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1
    with pytest.raises(Exception, match="cut off"):
        cut = put(tmp_path, "T_1.fastq", "@a\nAC\n+\nII\n@b\nAC\n" * 3 + "@a\n")
        _with_splits(spark, 9, lambda: genomics.read_fastq(spark, cut).collect())


def test_files_follow_the_size_of_a_sample(spark, tmp_path):
    """A large sample has many files, small ones one each; mates with one number hold the same reads in order."""
    keys = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in zip(keys, ("30000", "12", "1")):
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 20_000, 1, 6).selectExpr("if(id % 10 > 0, 'hot', concat('k', id % 30)) as sample", "concat('r', id) as read_id", "'ACGTACGT' as seq", "'IIIIIIII' as qual", "id")
        sinks.write_by_sample(rows, str(tmp_path / "by"))
        mates = rows.drop("id").selectExpr("*", "explode(array(1, 2)) as mate")
        sinks.write_fastq(mates, str(tmp_path / "fq"))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def files(*folder):
        return sorted(f for f in os.listdir(tmp_path.joinpath(*folder)) if f.startswith("part-"))

    assert len(files("by", "sample=hot")) > 4 * len(files("by", "sample=k0")) > 0
    assert spark.read.option("header", True).csv(str(tmp_path / "by")).count() == 20_000
    one, two = files("fq", "sample=hot", "mate=1"), files("fq", "sample=hot", "mate=2")
    assert len(one) > 4 and [f.split("-")[1] for f in one] == [f.split("-")[1] for f in two]
    names = []
    for a, b in zip(one, two):
        x, y = ([line[1:].split("/")[0] for line in open(tmp_path / "fq" / "sample=hot" / m / f) if line[0] == "@"] for m, f in (("mate=1", a), ("mate=2", b)))
        assert x == y
        names += x
    assert names == sorted(names) and len(names) == 18_000


def test_genotypes_of_odd_cells(spark):
    cells = ["5:0/1:x", "5:", "5", "", ".", "a:b/c:d:e", ":", "1/1"]
    rows = [("f", i, "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(f"L{k}" for k in range(len(cells))) if i == 0 else
             "\t".join(["c", "7", ".", "A", "G", ".", ".", ".", form, *cells])) for i, form in enumerate(["", "DP:GT", "GT", "DP", "A:B:GT"])]
    got = genomics.genotypes_of(genomics.parse_vcf(spark.createDataFrame(rows, "file string, line_no bigint, value string"), few_files=True))
    at = {1: 1, 2: 0, 3: None, 4: 2}
    want = {(n, i): None if k is None or len(c.split(":")) <= k else c.split(":")[k].replace("/", "|") for n, k in at.items() for i, c in enumerate(cells)}
    assert {(r.line_no, r.ord): r.gt for r in got.collect()} == want


def test_variant_lines_of_few_files_are_not_moved(spark, tmp_path):
    """Neither a map is searched for each cell, nor are cells shuffled; parts are dealt by number, lines are right."""
    from lineamix.sources import views
    from tests.test_skew import final_plan

    items = [(p, s, "RNA"[(p + s) % 3]) for p in range(1, 40) for s in (3, 5, 99) if (p * s) % 4]
    put_table = lambda name, rows, columns: spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / f"{name}.parquet"))
    put_table("lineitem", items + items[:5], "l_partkey bigint, l_suppkey bigint, l_returnflag string")
    put_table("supplier", [(s,) for s in (5, 3, 12, 5, -4)], "s_suppkey bigint")
    put_table("part", [(p, p % 12, f"T{p}") for p in range(-1, 40)], "p_partkey bigint, p_size int, p_type string")
    views.forget_tables()
    found = views.vcf_lines(spark, str(tmp_path))
    lines = {}
    for r in found.collect():
        lines.setdefault(r.line_no, []).append(r.value)
    names = [-4, 3, 5, 5, 12]
    for p in {p for p, _, _ in items}:
        flags = {s: [f for q, t, f in items + items[:5] if (q, t) == (p, s)] for s in names}
        cells = [f"{len(flags[s])}:{ {'R': '1/1', 'N': '0|1'}.get(max(flags[s]), './.')}" if flags[s] else ".:" + ("1|1" if p + s < 0 or (p + s) % 10 < 3 else "./.") for s in names]
        line = "\t".join(["ref", str(p), f"id{p}", "A", "G,T", str(p % 12), "low" if p % 12 < 10 else "PASS", f"TYPE=T{p}", "DP:GT", *cells])
        for copy in range(2 if p % 12 < 5 else 1):
            assert line in lines[p * 2 + 10 + copy]
    assert lines[2] == ["#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t-4\t3\t5\t5\t12"]
    records = genomics.parse_vcf(found, few_files=True)
    out = sinks.filtered_vcf_lines(records, found.where(F.col("value").startswith("#")), spark.createDataFrame([("3",), ("12",)], "lineage string"), few_files=True)
    assert out.where("line_no = 2").first().value.endswith("FORMAT\t3\t12")
    plan = final_plan(out.drop("value").groupBy().count()) + final_plan(out)
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning(file" in line]
    assert "element_at" not in final_plan(found) and "xxhash64" in final_plan(found) and not any("cells" in line or "_tag" in line for line in exchanges)
    assert final_plan(out).count("SortMergeJoin [file") <= 1


def test_line_items_without_a_supplier_are_an_error(spark, tmp_path):
    from lineamix.sources import views

    for name, rows, columns in (
        ("lineitem", [(1, 3, "R"), (1, None, "R")], "l_partkey bigint, l_suppkey bigint, l_returnflag string"),
        ("supplier", [(3,)], "s_suppkey bigint"), ("part", [(1, 9, "T")], "p_partkey bigint, p_size int, p_type string"),
    ):
        spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / f"{name}.parquet"))
    views.forget_tables()
    with pytest.raises(Exception, match="line items without a supplier"):
        views.vcf_lines(spark, str(tmp_path)).collect()


_ODD_FORMATS = ["GT", "DP:GT", "DP", "A:B:GT", "GT:DP", "GTX:DP"]
_ODD_CELLS = ["0/1", "5:0/1:x", "5:", "5", "", ".", "a:b/c:d:e", ":", "1/1", "::", "10|12", "0/1/2/3", "1:1|1", "é|1:é|1", "0", "x|1:A|1", "3:4:<|1"]


def _odd_lines():
    """Lines of two files: cells alike and not, more and fewer than lineages, and places that are no number."""
    made = []
    for file, names in (("f", ["L1", "L0", "L1", "L3"]), ("g", ["a", "b"])):
        made += [(file, 0, "##x"), (file, 1, "\t".join(["#CHROM", *"23456789", *names]))]
        for i in range(400):
            cells = [_ODD_CELLS[(i * i + k * (i % 5)) % len(_ODD_CELLS)] for k in range((i % 7) or len(names))]
            if i % 3 == 0:
                cells = [("7:0/1", "8:1|1", "9:./.")[(i + k) % 3] for k in range(len(names))]
            pos = str(-3 * i) if i % 4 else "far"
            made.append((file, 2 + i, "\t".join(["c", pos, ".", "A", "G", ".", ".", ".", _ODD_FORMATS[i % 6], *cells])))
        made += [(file, 900, "\t".join("c1.AG...") + "\tGT"), (file, 901, "c\t5\tshort"), (file, 902, "\t".join(["c", "6", ".", "A", "G", ".", ".", ".", "GT", ""]))]
    return made


def test_counted_genotypes_are_those_of_all_cells(spark, rows, monkeypatch):
    found = spark.createDataFrame(_odd_lines(), "file string, line_no bigint, value string").repartition(3)
    records = genomics.parse_vcf(found)
    sums = [F.count(F.lit(1)).alias("n"), F.sum("pos").cast("bigint").alias("places")]
    want = rows(genomics.genotypes_of(records).groupBy("file", "lineage", "ord", "gt").agg(*sums))
    for few_files in (True, False):
        counted = genomics.genotypes_of(records, genomics.vcf_lineages(found), few_files)
        got = counted.groupBy("file", "lineage", "ord", "gt").agg(F.sum("n").alias("n"), F.sum("places").alias("places"))
        assert rows(got) == want and len(want) > 50
    plain = variants.hom_alt_share(genomics.genotypes_of(records), 0.01)
    assert rows(variants.hom_alt_share(counted, 0.01, n="n")) == rows(plain) and plain.count() > 1
    # The same in pieces: one line at a time, few lines before a sum is taken apart, counts that leave early.
    batch = pa.RecordBatch.from_pylist([
        r.asDict() for r in records.where("file = 'f'").selectExpr(
            "file", "head_no", "size(lineages) as _width", "cast(array_position(split(format, ':'), 'GT') as int) as _at", "pos", "octet_length(fixed) as _fixed", "line").collect()
    ])
    whole, pieces = Counter(), Counter()
    for into, limits in ((whole, {}), (pieces, {"CELL_BYTES": 1, "COUNT_BYTES": 1})):
        for name, value in limits.items():
            monkeypatch.setattr(genomics, name, value)
            monkeypatch.setattr(genomics._Counts, "LINES", 2)
        for out in genomics._counted_genotypes(iter([batch, batch.slice(7, 90)])):
            for r in out.to_pylist():
                into[r["ord"], r["gt"], "n"] += r["n"]
                into[r["ord"], r["gt"], "places"] += r["places"] or 0
    assert whole == pieces and len(whole) > 50


def test_cells_counted_digested_and_chosen(spark, rows):
    found = spark.createDataFrame(_odd_lines(), "file string, line_no bigint, value string").repartition(3)
    records = genomics.parse_vcf(found)
    want = records.select("file", "line_no", "format", F.size("cells").alias("n_cells"), F.md5(F.array_join("cells", ",")).alias("cells"))
    assert rows(genomics.cell_digests(records), *want.columns) == rows(want)
    kept = spark.createDataFrame([("L1",), ("b",), ("L3",)], "lineage string")
    places = {"f": [0, 2, 3], "g": [1]}
    expected = {}
    for file, number, line in _odd_lines():
        cells = line.split("\t")
        expected[file, number] = line if line.startswith("##") else "\t".join(cells[:9] + [(cells[9:] + ["."] * 9)[i] for i in places[file]])
    meta = found.where(F.col("value").startswith("#"))
    for few_files in (True, False):
        out = sinks.filtered_vcf_lines(records, meta, kept, few_files).collect()
        assert {(r.file, r.line_no): r.value for r in out} == expected and len(out) == len(expected)


def test_heads_apart_from_their_lines(spark, rows):
    made = _odd_lines()
    frame = lambda some: spark.createDataFrame(some, "file string, line_no bigint, value string")
    head = frame([r for r in made if r[2].startswith("#")])
    found = frame([*made, ("none", 1, "c\t5\tx"), ("f", 1500, "")])
    columns = ("file", "line_no", "line", "lineages", "head_no")
    for few_files in (True, False):
        assert rows(genomics.parse_vcf(found, few_files, head), *columns) == rows(genomics.parse_vcf(found), *columns)
    for late in (("f", 50, "#late"), ("none", 0, "#CHROM")):
        with pytest.raises(Exception, match="line with # below the head of " + late[0]):
            genomics.parse_vcf(frame([*made, late]), True, head).collect()


@pytest.mark.parametrize("query, passes", [("vcf_records", 1), ("vcf_genotypes", 1), ("study_vcf_filter", 3)])
def test_variant_lines_are_made_once_for_each_use(spark, tmp_path, query, passes):
    """Neither for their head, nor cut into arrays of all cells, nor handed to Python by rows whatever their length.

    The filter has two uses, of which Spark meets the counts twice and runs them once.
    """
    from lineamix.plans.catalog import QUERIES

    for name, made, columns in (
        ("lineitem", [(p, 3, "R") for p in range(30)], "l_partkey bigint, l_suppkey bigint, l_returnflag string"),
        ("supplier", [(3,), (4,)], "s_suppkey bigint"), ("part", [(p, 9, "T") for p in range(30)], "p_partkey bigint, p_size int, p_type string"),
    ):
        spark.createDataFrame(made, columns).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = QUERIES[query](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow _vcf_body") == passes and found.collect() and "arrays_zip" not in plan and "posexplode(arrays" not in plan
    assert "split(line" not in plan and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")


def test_genotype_filter_moves_calls_twice(spark, tmp_path):
    """Once to make them and once to their variant; both uses make them alike and so share a shuffle."""
    from lineamix.plans.catalog import QUERIES

    made = [(p, s, "RNA"[(p + s) % 3]) for p in range(30) for s in (3, 5, 99) if (p * s) % 4]
    spark.createDataFrame(made, "l_partkey bigint, l_suppkey bigint, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = QUERIES["study_genotype_filter"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    made_by = [line for line in plan.split("\n") if "Aggregate [l_suppkey" in line]
    assert len(made_by) > 2 and all("max(l_returnflag" in line for line in made_by) and "LeftSemi" not in plan and "_tag" not in plan
    assert "first(gt" not in plan and found.count() > 10


def test_a_line_has_one_call_of_a_lineage(spark):
    """Repeated calls are one, also where they differ; a lineage without a call, or with NULL only, is missing."""
    calls = [("B", 1, 7, "1|1"), ("B", 1, 7, "0|1"), ("B", 1, 7, "0|1"), ("A", 2, 7, "0|1"), ("A", 2, 8, None), ("C", 3, 9, ".|."), ("C", 3, 9, ".|.")]
    made = spark.createDataFrame([("c", p, "G", ["T", "A"], n, o, g) for n, o, p, g in calls],
                                 "chrom string, pos int, ref string, alts array<string>, lineage string, ord int, gt string")
    meta = spark.createDataFrame([], "line_no bigint, value string")
    kept = variants.keep_lineages(made.repartition(5), spark.createDataFrame([("A",), ("B",), ("B",), ("C",), ("D",)], "lineage string"))
    got = {r.pos: r.value.split("\t")[9:] for r in sinks.vcf_lines(kept, meta).where("kind > 0").collect()}
    assert got == {0: ["B", "A", "C"], 7: ["0|1", "0|1", "./."], 8: ["./.", ".", "./."], 9: ["./.", "./.", ".|."]}
