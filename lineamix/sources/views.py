"""Views that give the benchmark tables the shapes of mixture data.

Part types stand for lineages, customers and suppliers for samples, orders for candidate
solutions, line items for reads and sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lineamix.functions.names import ClassRule
from lineamix.operators.fractions import shares
from lineamix.operators.ordering import attach, known, top_k
from lineamix.operators.reads import FIRST_MATE, SECOND_MATE, UNMAPPED
from lineamix.operators.intervals import REVERSE
from lineamix.sources.lines import text_array

TYPE_RULES = (
    ClassRule("delta", prefixes=("ST",), names=("SMALL",)),
    ClassRule("omicron", prefixes=("EC", "PR")),
    ClassRule("recombinant", prefixes=("L",)),
)
TYPE_CALLS = {
    "STANDARD": "Delta (AY.4-like)",
    "SMALL": "Probable Delta (Unassigned)",
    "ECONOMY": "Omicron (BA.1-like)",
    "LARGE": "Omicron (Unassigned)",
    "PROMO": "Unassigned call",
}
TYPE_NAMES = {
    "STANDARD": "Delta",
    "SMALL": "Delta",
    "ECONOMY": "Omicron",
    "PROMO": "Omicron",
    "LARGE": "Recombinant",
}
LOW, HIGH = "100x", "1000x"
COVERAGES = (LOW, HIGH)
# Quality character of each letter: 33 + code point modulo 42.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
LETTER_QUALITY = "".join(chr(33 + ord(c) % 42) for c in LETTERS)
OTHER_LETTER, OTHER_QUALITY = "_", "5"
# Positions between the places of two parts, and suppliers of a sample.
PART_SPACING = 60
LINEAGES_PER_SAMPLE = 4
# Text of lines that leaves a task of Python at once.
LINE_BYTES = 1 << 23


_opened: dict[str, DataFrame] = {}


def forget_tables() -> None:
    """Called before each query, so that files are listed anew."""
    _opened.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Each table's footer is read once per query, not once per use."""
    path = f"{sf_dir}/{name}.parquet"
    opened = _opened.get(path)
    if opened is None or opened.sparkSession is not spark:
        opened = _opened[path] = spark.read.parquet(path)
    return opened


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def _line_coverage() -> Column:
    return F.when(F.col("l_linestatus") == "F", LOW).otherwise(HIGH)


def _order_coverage(key: str) -> Column:
    return F.when(F.col(key) % 2 == 0, LOW).otherwise(HIGH)


def type_code(name: Column) -> Column:
    """Number that sorts part types by name (their first three letters differ)."""
    at = [F.ascii(F.substring(name, i, 1)) for i in (1, 2, 3)]
    return (at[0] * 65536 + at[1] * 256 + at[2]).cast("int")


def _lookup(name: Column, mapping: dict[str, str]) -> Column:
    chain = None
    for key, value in mapping.items():
        hit = name == key
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


def typed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with part type and customer."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return table(spark, sf_dir, "lineitem").join(parts, "l_partkey").join(orders, "l_orderkey")


def _typed_totals(spark: SparkSession, sf_dir: str, by_coverage: bool, total: Column) -> DataFrame:
    """Aggregate by customer(, line status) and part type; names are made afterwards."""
    status = ["l_linestatus"] if by_coverage else []
    coverage = [_line_coverage().alias("coverage")] if by_coverage else []
    named = (
        typed_lines(spark, sf_dir).groupBy("o_custkey", *status, "p_type").agg(total.alias("total"))
        .select(_text("o_custkey").alias("sample"), *coverage, "p_type", "total")
    )
    # Said here, all uses of this table have the same filter and share its shuffle.
    return known(named, ["sample", *(["coverage"] if by_coverage else [])])


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences by (date, state, clade)."""
    stage = F.when(F.col("p_size") <= 10, "early").otherwise("late")
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_brand", stage).alias("clade")
    )
    states = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), _text("s_nationkey").alias("state")
    )
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_partkey", "l_suppkey", F.trunc("l_shipdate", "month").alias("date"))
        .join(parts, "l_partkey").join(states, "l_suppkey")
        .groupBy("date", "state", "clade").agg(F.count(F.lit(1)).alias("sequences"))
    )


def abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier samples with brands as targets."""
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("target_id")
    )
    return (
        table(spark, sf_dir, "lineitem")
        .join(parts, "l_partkey")
        .groupBy("l_suppkey", "l_linestatus", "target_id").agg(F.sum("l_quantity").alias("tpm"))
        .select(_text("l_suppkey").alias("sample"), _line_coverage().alias("coverage"), "target_id", "tpm")
    )


def mix_keys(by_coverage: bool) -> list[str]:
    return ["sample", "coverage"] if by_coverage else ["sample"]


def mix_abundance(spark: SparkSession, sf_dir: str, by_coverage: bool = True) -> DataFrame:
    """Customer samples with part types as targets."""
    return _typed_totals(spark, sf_dir, by_coverage, F.sum("l_quantity")).withColumnsRenamed(
        {"p_type": "target_id", "total": "tpm"}
    )


def posterior(spark: SparkSession, sf_dir: str, by_coverage: bool = True) -> DataFrame:
    """Customer samples with orders as candidate solutions."""
    keys = mix_keys(by_coverage)
    orders = table(spark, sf_dir, "orders").select(
        _text("o_custkey").alias("sample"), _order_coverage("o_orderkey").alias("coverage"),
        F.col("o_orderkey").alias("solution"), "o_totalprice",
    )
    best = orders.groupBy(*keys).agg(F.max("o_totalprice").alias("_top"))
    scored = attach(orders, best, keys).withColumn("odds", F.round(F.col("o_totalprice") / F.col("_top"), 1))
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("lineage")
    )
    lines = (
        table(spark, sf_dir, "lineitem").join(parts, "l_partkey")
        .groupBy(F.col("l_orderkey").alias("solution"), "lineage").agg(F.sum("l_quantity").alias("_q"))
    )
    # One row per part type is left of each order.
    share = F.col("_q") / F.sum("_q").over(W.partitionBy("solution"))
    fractions = lines.withColumn("fraction", share)
    return fractions.join(scored, "solution").select(
        *keys, "solution", "odds", type_code(F.col("lineage")).alias("ord"), "lineage", "fraction"
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three largest part types of each customer, renormalised."""
    weights = mix_abundance(spark, sf_dir, by_coverage=False)
    top = top_k(weights, ["sample"], [F.desc("tpm"), F.asc("target_id")], 3)
    # Three rows per sample at most.
    share = F.col("tpm") / F.sum("tpm").over(W.partitionBy("sample"))
    return top.select(
        "sample", type_code(F.col("target_id")).alias("ord"), F.col("target_id").alias("lineage"),
        share.alias("fraction"),
    )


def calls(spark: SparkSession, sf_dir: str, by_coverage: bool = True) -> DataFrame:
    """Most frequent part type of each customer, as called by consensus tools."""
    keys = mix_keys(by_coverage)
    n = _typed_totals(spark, sf_dir, by_coverage, F.count(F.lit(1))).withColumnRenamed("total", "n")
    top = n.groupBy(*keys).agg(
        F.max_by(F.struct("p_type", "n"), F.struct(F.col("n"), -type_code(F.col("p_type")))).alias("t")
    )
    name = F.col("t.p_type")
    lineage = F.when(F.col("t.n") % 2 == 0, F.concat(name, F.lit(".1"))).otherwise(name)
    literal = F.lower(F.substring(name, 1, 3))
    pattern = F.concat(F.substring(name, 1, 1), F.lit("."), F.substring(name, 3, 1))
    return top.select(
        *keys, lineage.alias("lineage"),
        F.when(F.col("t.n") % 3 == 0, pattern).otherwise(literal).alias("clade"),
        _lookup(name, TYPE_CALLS).alias("scorpio_call"),
        _lookup(name, TYPE_NAMES).alias("clade_who"),
    )


def clade_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.substring("p_type", 1, 3).alias("clade"), F.col("p_type").alias("pango")
    ).distinct()


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as lineages, parts as positions; the strongest return flag is the call."""
    flag = F.max("l_returnflag")
    gt = F.when(flag == "R", "1|1").when(flag == "N", "0|1").otherwise(".|.")
    return (
        table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(gt.alias("gt"))
        .select(
            F.lit("ref").alias("chrom"), F.col("l_partkey").cast("int").alias("pos"),
            F.lit("A").alias("ref"), F.array(F.lit("G")).alias("alts"),
            _text("l_suppkey").alias("lineage"), F.col("l_suppkey").cast("int").alias("ord"), "gt",
        )
    )


def supplier_lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers as lineages; four with consecutive numbers are a sample."""
    return table(spark, sf_dir, "supplier").select(
        F.floor(F.col("s_suppkey") / LINEAGES_PER_SAMPLE).cast("string").alias("sample"), F.col("s_suppkey").alias("ord"),
        _text("s_suppkey").alias("lineage"),
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as alignments; those without discount are unmapped."""
    flag = (
        F.when(F.col("l_linenumber") % 2 == 1, FIRST_MATE).otherwise(SECOND_MATE)
        + F.when(F.col("l_linestatus") == "F", REVERSE).otherwise(0)
        + F.when(F.col("l_discount") == 0, UNMAPPED).otherwise(0)
    )
    mapped = F.col("l_discount") != 0
    start = F.col("l_partkey") * PART_SPACING
    return table(spark, sf_dir, "lineitem").select(
        _text("l_suppkey").alias("sample"), _text("l_orderkey").alias("qname"),
        flag.cast("int").alias("flag"), F.when(mapped, "chr1").alias("chrom"),
        F.when(mapped, start).alias("start"),
        F.when(mapped, start + F.col("l_quantity").cast("bigint")).alias("end"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as intervals, each behind the place where the part's line items begin."""
    start = F.col("p_partkey") * PART_SPACING + F.when(F.col("p_partkey") % 3 == 0, -5).otherwise(25)
    return table(spark, sf_dir, "part").select(
        F.lit("chr1").alias("chrom"), start.alias("start"), (start + F.col("p_size")).alias("end"),
    )


def fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without white space as reads; qualities follow from the letters.

    Characters other than a-z have one quality of their own.
    """
    seq = F.regexp_replace("text", r"[ \t\n\r]+", "")
    plain = F.regexp_replace(seq, "[^a-z]", OTHER_LETTER)
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("sample"), _text("doc_id").alias("read_id"), F.lit(1).alias("mate"),
        seq.alias("seq"), F.translate(plain, LETTERS + OTHER_LETTER, LETTER_QUALITY + OTHER_QUALITY).alias("qual"),
    )


def mix_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two mates per line item, by customer and part type."""
    read_id = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return typed_lines(spark, sf_dir).select(
        _text("o_custkey").alias("sample"), F.col("p_type").alias("lineage"), read_id.alias("read_id"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("mate"),
    )


def haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their share of the customer's total price."""
    orders = table(spark, sf_dir, "orders").select(
        _text("o_custkey").alias("sample"), F.col("o_orderkey").alias("hap_id"), "o_totalprice"
    )
    return shares(orders, ["sample"], "o_totalprice", "frequency").drop("o_totalprice")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as alignments of their order to one of five references."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("hap_id"), _text("o_custkey").alias("sample")
    )
    flag = F.when(F.col("l_returnflag") == "A", 16).when(F.col("l_returnflag") == "N", 272).otherwise(4)
    line_no = F.col("l_linenumber") * F.lit(10**14) + F.col("l_partkey") * F.lit(10**6) + F.col("l_suppkey")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("hap_id"), flag.alias("flag"),
        F.concat(F.lit("strain"), _text("l_suppkey").cast("bigint") % 5).alias("lineage"),
        line_no.alias("line_no"),
    )
    return lines.join(orders, "hap_id").select("sample", "hap_id", "flag", "lineage", "line_no")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their first order date."""
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min(F.to_date("o_orderdate")).alias("collection_date")
    )
    return table(spark, sf_dir, "customer").select("c_custkey").join(first, "c_custkey", "left").select(
        _text("c_custkey").alias("sample"), "collection_date"
    )


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a primer set or none."""
    primer = F.when(F.col("c_nationkey") % 3 == 0, "v3").when(F.col("c_nationkey") % 3 == 1, "v4")
    return table(spark, sf_dir, "customer").select(
        _text("c_custkey").alias("sample"), primer.alias("primer")
    )


# --- lines of files, made from the tables, for the parsers of lineamix.sources -----------------


def _lined(df: DataFrame, lines: Column, first: Column, *keys: str) -> DataFrame:
    """One row per element of ``lines``, numbered from ``first`` on."""
    return df.select(*keys, first.alias("_first"), F.posexplode(lines).alias("_at", "value")).select(
        *keys, (F.col("_first") + F.col("_at")).cast("bigint").alias("line_no"), "value"
    )


def _vcf_body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbered lines of parts with all their cells; the first row of a task brings the suppliers."""
    names, numbers, pieces, sizes, size = None, [], [], [], 0
    holes: dict[int, memoryview] = {}
    # Cells without line items, with the tab before them; both kinds are equally long.
    called, missing = b"\t.:1|1", b"\t.:./."
    step = len(called)

    def row_of_holes(part: int) -> memoryview:
        # Remainders as in SQL, so only those of numbers from 0 on repeat.
        key = part % 10 if part >= 0 and len(names) and names[0] >= 0 else None
        found = holes.get(key)
        if found is None:
            found = memoryview(np.where(np.fmod(part + names, 10) < 3, called, missing).astype(f"S{step}").tobytes())
            if key is not None:
                holes[key] = found
        return found

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), text_array(pieces, sizes)], ["line_no", "value"])

    for batch in batches:
        if names is None and batch.num_rows:
            names = batch.column("names").slice(0, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        for part, part_size, fixed, at, cell in zip(*(batch.column(c).to_pylist() for c in ("p_partkey", "p_size", "fixed", "at", "cell"))):
            row, line, end = row_of_holes(part), [fixed.encode()], 0
            for i, text in sorted(zip(at, cell)):
                line += row[end:i * step], b"\t", text.encode()
                end = (i + 1) * step
            line.append(row[end:])
            long = sum(map(len, line))
            for copy in range(2 if part_size is not None and part_size < 5 else 1):
                numbers.append(part * 2 + 10 + copy)
                sizes.append(long)
                pieces += line
                size += long
            if size >= LINE_BYTES:
                yield batch_of()
                numbers, pieces, sizes, size = [], [], [], 0
    if numbers:
        yield batch_of()


VCF_FILE = "/calls/all.vcf"


def _vcf_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: a variant file has all its lineages in its header."""
    return table(spark, sf_dir, "supplier").agg(F.sort_array(F.collect_list("s_suppkey")).alias("names"))


def vcf_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of ``vcf_lines`` down to the one that names the lineages."""
    title = F.concat_ws("\t", F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"), F.transform("names", lambda k: k.cast("string")))
    lines = F.array(F.lit("##fileformat=VCFv4.2"), F.lit("##INFO=<ID=TYPE>"), title)
    # The file comes out of the generator: joins by a constant would not be hash joins.
    placed = F.transform(lines, lambda line: F.struct(F.lit(VCF_FILE).alias("file"), line.alias("value")))
    return _vcf_names(spark, sf_dir).select(F.posexplode(placed).alias("line_no", "_line")).select(
        "_line.file", F.col("line_no").cast("bigint").alias("line_no"), "_line.value"
    )


def vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as variants of one file, with every field filled; small parts stand there twice.

    Suppliers are the lineages. A cell holds the number of line items and the call; cells without
    line items have a call by rule. A line has a cell for each supplier, so the parts are dealt to
    tasks by number before their lines are made, not by their size.
    """
    called = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(
        F.max("l_returnflag").alias("flag"), F.count(F.lit(1)).alias("n")
    )
    call = F.when(F.col("flag") == "R", "1/1").when(F.col("flag") == "N", "0|1").otherwise("./.")
    # Read as a scalar subquery.
    names = _vcf_names(spark, sf_dir)
    places = names.select(F.posexplode("names").alias("at", "l_suppkey"))
    unknown = F.raise_error(F.lit("line items without a supplier")).cast("struct<at:int,cell:string>")
    cell = F.when(F.col("l_suppkey").isNull(), unknown).when(F.col("at").isNotNull(), F.struct("at", F.concat_ws(":", "n", call).alias("cell")))
    cells = called.join(places, "l_suppkey", "left").groupBy("l_partkey").agg(F.collect_list(cell).alias("cells"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = table(spark, sf_dir, "part").join(cells, F.col("p_partkey") == F.col("l_partkey"))
    # By another key than the join's, or the join's few tasks would stay.
    listed = listed.repartition(tasks, F.xxhash64("p_partkey"))
    fixed = F.concat_ws(
        "\t", F.lit("ref"), _text("p_partkey"), F.concat(F.lit("id"), _text("p_partkey")), F.lit("A"), F.lit("G,T"),
        _text("p_size"), F.when(F.col("p_size") < 10, "low").otherwise("PASS"), F.concat(F.lit("TYPE="), "p_type"), F.lit("DP:GT"),
    )
    # The lower 33 bits count the rows of a task.
    first = F.monotonically_increasing_id() % (1 << 33) == 0
    made = listed.select(
        "p_partkey", "p_size", fixed.alias("fixed"), F.col("cells.at").alias("at"), F.col("cells.cell").alias("cell"),
        F.when(first, names.scalar()).alias("names"),
    ).mapInArrow(_vcf_body, "line_no bigint, value string")
    body = made.select(F.lit(VCF_FILE).alias("file"), "line_no", "value")
    return vcf_head(spark, sf_dir).unionByName(body)


def sam_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as alignment lines, one file per supplier, with mates and tags."""
    mapped = F.col("l_discount") != 0
    size = F.col("l_quantity").cast("int")
    value = F.concat_ws(
        "\t", F.concat(F.lit("r"), _text("l_orderkey")), F.when(mapped, F.col("l_linenumber") * 16).otherwise(4).cast("string"),
        F.when(mapped, F.concat(F.lit("chr"), _text("l_partkey"))).otherwise("*"), F.when(mapped, F.col("l_partkey") + 1).otherwise(0).cast("string"),
        F.lit("60"), F.when(mapped, F.concat(F.lit("2S"), size, F.lit("M1D3I"), F.col("l_linenumber"), F.lit("="))).otherwise("*"),
        F.lit("="), _text("l_partkey"), F.concat(F.lit("-"), size), F.lit("*"), F.lit("*"),
        F.concat(F.lit("NM:i:"), F.col("l_linenumber")), F.when(F.col("l_returnflag") == "R", "XR:Z:a b"),
    )
    file = F.concat(F.lit("/aln/"), _text("l_suppkey"), F.lit(".sam")).alias("file")
    body = table(spark, sf_dir, "lineitem").select(file, (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no"), value.alias("value"))
    head = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("/aln/"), _text("s_suppkey"), F.lit(".sam")).alias("file"), F.lit(-1).cast("bigint").alias("line_no"), F.lit("@HD\tVN:1.6").alias("value")
    )
    return head.unionByName(body)


def fastq_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads of ``fastq`` as lines, one file per source."""
    reads = fastq(spark, sf_dir).select(
        F.concat(F.lit("/reads/"), "sample", F.lit("_1.fastq")).alias("file"), F.col("read_id").cast("bigint").alias("no"),
        F.array(F.concat(F.lit("@"), "read_id", F.lit("/1 more")), F.coalesce("seq", F.lit("")), F.lit("+"), F.coalesce("qual", F.lit(""))).alias("record"),
    )
    return _lined(reads, F.col("record"), F.col("no") * 4, "file")


def posterior_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per customer with the part types of the orders as columns; cells are quantities."""
    amounts = typed_lines(spark, sf_dir).groupBy("o_custkey", "l_orderkey", "p_type").agg(F.sum("l_quantity").alias("q"))
    types = amounts.groupBy("o_custkey").agg(F.array_sort(F.collect_set("p_type")).alias("types"))
    # One order has few part types, one customer few different ones.
    made = amounts.groupBy("o_custkey", "l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "q"))).alias("cells"))
    file = F.concat(F.lit("/post/"), _text("o_custkey"), F.lit("-100x.csv")).alias("file")
    cell = F.transform("types", lambda t: F.coalesce(F.element_at("cells", t), F.lit(0.0)).cast("string"))
    rows = attach(made, types, ["o_custkey"]).select(
        file, (F.col("l_orderkey") + 1).alias("line_no"),
        F.concat_ws(",", F.lit("+5.0e-1"), (F.col("l_orderkey") % 2).cast("string"), cell).alias("value"),
    )
    head = types.select(file, F.lit(0).cast("bigint").alias("line_no"), F.concat_ws(",", F.lit("density"), F.lit("odds"), "types").alias("value"))
    return head.unionByName(rows)


def metadata_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a table separated by white space, one file per nation; some dates are missing."""
    file = F.concat(F.lit("/meta/"), _text("c_nationkey"), F.lit(".txt")).alias("file")
    dated = metadata(spark, sf_dir).select(F.col("sample").alias("key"), "collection_date")
    day = F.when(F.col("c_custkey") % 7 != 0, F.date_format("collection_date", "yyyy-MM-dd"))
    rows = table(spark, sf_dir, "customer").join(dated, F.col("key") == _text("c_custkey")).select(
        file, (F.col("c_custkey") + 1).alias("line_no"),
        F.concat(F.lit(" "), _text("c_custkey"), F.lit(" \t  "), F.coalesce(day, F.lit("NA")), F.lit("  ")).alias("value"),
    )
    head = table(spark, sf_dir, "customer").select(
        file, F.lit(0).cast("bigint").alias("line_no"), F.lit("SRA_ID   CollectionDate").alias("value")
    ).distinct()
    return head.unionByName(rows)


def bed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as intervals with three to six columns."""
    start = F.col("p_partkey") * PART_SPACING
    three = F.concat_ws("\t", F.lit("chr1"), start.cast("string"), (start + F.col("p_size")).cast("string"))
    more = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws("\t", "p_name", _text("p_size"), F.when(F.col("p_size") > 20, "+")))
    return table(spark, sf_dir, "part").select(F.concat_ws("\t", three, more).alias("value"))


def fasta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sequences over several lines; every third has a frequency."""
    frequency = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("10x frequency=0."), _text("doc_id"))).otherwise("none")
    title = F.concat(F.lit(">p"), _text("doc_id"), F.lit(" "), frequency)
    return table(spark, sf_dir, "documents").select(F.concat_ws("\n", title, F.regexp_replace("text", "[ \t\r]", "")).alias("value"))
