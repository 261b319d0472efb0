"""The driver's tables seen as coverage data: lineitem = reads on a day axis, nation = contig, orders = BED lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BIN = 365
FINE_BIN = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(column: str):
    return F.datediff(F.col(column).cast("date"), F.lit("1995-01-01").cast("date")).cast("bigint")


def placed_lines(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem") if lines is None else lines
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return lines.join(suppliers, "l_suppkey").select(
        F.col("l_returnflag").alias("sample"),
        F.concat(F.lit("chr"), F.col("s_nationkey").cast("string")).alias("contig"),
        _day("l_shipdate").alias("start"),
        F.col("l_quantity").cast("bigint").alias("q"),
        F.col("l_linenumber").cast("bigint").alias("ln"),
        "l_orderkey",
        "l_linestatus",
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple covered segments: ``l_quantity`` days from the ship date."""
    return placed_lines(spark, sf_dir).select("sample", "contig", "start", (F.col("start") + F.col("q")).alias("end"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments with flags and CIGAR strings."""
    q, ln = F.col("q"), F.col("ln")
    half = F.call_function("div", q, F.lit(2).cast("bigint"))
    cigar = (
        F.when((q >= 4) & (ln % 2 == 0), F.concat(half, F.lit("M"), ln, F.lit("D"), q - half, F.lit("M")))
        .when(ln % 3 == 0, F.concat(F.lit("5S"), q, F.lit("M")))
        .otherwise(F.concat(q, F.lit("M")))
    )
    flag = F.when((F.col("l_linestatus") == "F") & (ln == 7), 1024).otherwise(0)
    return placed_lines(spark, sf_dir).select(
        "sample",
        F.concat_ws("_", "l_orderkey", "ln").alias("read_id"),
        "contig", "start", cigar.alias("cigar"), flag.alias("flag"), F.lit(60).alias("mapq"),
    )


def sam_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads as SAM lines ``file_path, line_no, value`` of three files, whose read group ids stand for other samples in each."""
    rows = reads(spark, sf_dir).withColumn("file", F.pmod(F.xxhash64("read_id"), F.lit(3)))
    names = samples(spark, sf_dir).select(F.col("sample"), (F.rank().over(Window.orderBy("sample")) - 1).alias("k"))
    # the group id of a sample moves on by one from file to file
    group = lambda k, file: F.concat(F.lit("g"), F.pmod(k + file, F.lit(3)).cast("string"))
    path = F.concat(F.lit("file"), F.col("file").cast("string"))
    heads = names.withColumn("file", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(
        path.alias("file_path"), (F.col("k") + 2).cast("bigint").alias("line_no"),
        F.concat_ws("\t", F.lit("@RG"), F.concat(F.lit("ID:"), group(F.col("k"), F.col("file"))), F.lit("PL:X"), F.concat(F.lit("SM:"), F.col("sample"))).alias("value"),
    )
    fixed = [F.col("read_id"), F.col("flag").cast("string"), F.col("contig"), (F.col("start") + 1).cast("string"), F.col("mapq").cast("string"), F.col("cigar")]
    others = [F.lit(x) for x in ("*", "0", "0", "*", "*", "NM:i:0")]
    lines = rows.join(F.broadcast(names), "sample").select(
        path.alias("file_path"), F.lit(9).cast("bigint").alias("line_no"),
        F.concat_ws("\t", *fixed, *others, F.concat(F.lit("RG:Z:"), group(F.col("k"), F.col("file")))).alias("value"),
    )
    return heads.unionByName(lines)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("sample")).distinct()


def genes(spark: SparkSession, sf_dir: str, first: int = 0, last: int = 6) -> DataFrame:
    """Gene table: one 300-day window per nation and year."""
    years = table(spark, sf_dir, "nation").withColumn("i", F.explode(F.sequence(F.lit(first), F.lit(last))))
    key = F.col("n_nationkey").cast("bigint") * 10 + F.col("i")
    start = (F.col("i") * 365 + 30).cast("bigint")
    return years.select(
        key.alias("line_no"),
        F.concat(F.lit("chr"), F.col("n_nationkey").cast("string")).alias("contig"),
        start.alias("start"),
        (start + 300).alias("end"),
        F.concat("n_name", F.lit("_"), F.col("i").cast("string")).alias("gene_name"),
        F.concat(F.lit("G"), key.cast("string")).alias("gene_id"),
        F.when(F.col("i") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.lit("protein_coding").alias("gene_type"),
    )


def targets_of(gene_rows: DataFrame) -> DataFrame:
    return gene_rows.select(
        F.col("line_no").alias("ordinal"), F.col("gene_name").alias("target_id"), "contig", "start", "end"
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genes, with the all-zero windows beyond the data."""
    return targets_of(genes(spark, sf_dir, 0, 9))


def overlapping_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets plus copies shifted by 150 days, under the same names."""
    base = targets(spark, sf_dir)
    shifted = base.select(
        (F.col("ordinal") + 1000).alias("ordinal"), "target_id", "contig",
        (F.col("start") + 150).alias("start"), (F.col("end") + 150).alias("end"),
    )
    return base.unionByName(shifted)


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exon table: ten 20-day windows per gene; odd nations' last gene has none."""
    rows = genes(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
    kept = rows.where(~((F.col("line_no") % 20 == 16)))
    start = (F.col("start") + F.col("k") * 30).cast("bigint")
    return kept.select(
        "contig", start.alias("start"), (start + 20).alias("end"),
        F.concat(F.lit("E"), F.col("line_no").cast("string"), F.lit("."), F.col("k").cast("string")).alias("exon_id"),
        F.lower("gene_name").alias("gene_name"),
        F.when((F.col("line_no") % 7 == 0) & (F.col("k") == 3), "x").otherwise((F.col("k") + 1).cast("string")).alias(
            "exon_number"
        ),
        F.concat(F.lit("T"), F.col("line_no").cast("string")).alias("transcript_id"),
    )


def region_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region strings, gene lists and malformed text made from customers."""
    key = F.col("c_custkey")
    lo = (key * 37) % 2500 + 1
    good = F.concat(
        F.lit(" chr"), (key % 25).cast("string"), F.lit(":"), F.format_number(lo, 0), F.lit("-"),
        F.format_number(lo + 5 + key % 400, 0),
    )
    text = (
        F.when(key % 11 == 0, F.concat(F.lit("chr"), key.cast("string"), F.lit(":12x-20")))
        .when(key % 13 == 0, F.concat(F.lit("chr1:"), lo.cast("string"), F.lit("-"), lo.cast("string")))
        .when(key % 17 == 0, F.lit("chr2:,-,"))
        .when(key % 7 == 0, F.concat(F.lit("NATION_"), (key % 25).cast("string"), F.lit("_1, ,nation_3_2")))
        .otherwise(good)
    )
    return table(spark, sf_dir, "customer").select(key.cast("bigint").alias("ordinal"), text.alias("target"))


def bed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BED text made from orders, with bad lines among them."""
    key = F.col("o_orderkey")
    start = _day("o_orderdate")
    good = F.concat_ws(
        "\t", F.concat(F.lit("chr"), (F.col("o_custkey") % 25).cast("string")),
        start.cast("string"), (start + key % 40).cast("string"),
    )
    value = (
        F.when(key % 97 == 0, F.concat(F.lit("chr1\tx"), key.cast("string"), F.lit("\t9")))
        .when(key % 89 == 0, F.concat(F.lit("chr1\t"), key.cast("string")))
        .when(key % 83 == 0, F.concat(F.lit("#"), key.cast("string")))
        .when(key % 3 == 0, F.concat(good, F.lit("\tname_"), (key % 50).cast("string")))
        .otherwise(good)
    )
    return table(spark, sf_dir, "orders").select(key.alias("line_no"), value.alias("value"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked gene names made from customers: mixed case, aliases, padded, misspelt."""
    key = F.col("c_custkey")
    name = F.concat(F.lit("NATION_"), (key % 27).cast("string"), F.lit("_"), (key % 7).cast("string"))
    text = (
        F.when(key % 5 == 0, F.lower(name))
        .when(key % 5 == 1, F.concat(F.lit(" "), name, F.lit(" ")))
        .when(key % 5 == 2, F.concat(F.lit("Alias-"), (key % 30).cast("string")))
        .when(key % 5 == 3, F.concat(F.lit("NATOIN"), (key % 25).cast("string"), F.lit("_"), (key % 7).cast("string")))
        .otherwise(name)
    )
    return table(spark, sf_dir, "customer").select(key.cast("bigint").alias("ordinal"), text.alias("symbol"))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("alias-"), F.col("n_nationkey").cast("string")).alias("alias"),
        F.concat("n_name", F.lit("_2")).alias("gene_name"),
    )


def duplicated_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genes, with a later row of the same name for every third one."""
    base = genes(spark, sf_dir)
    later = base.where(F.col("line_no") % 3 == 0).withColumns(
        {"line_no": F.col("line_no") + 5000, "start": F.col("start") + 7, "gene_name": F.lower("gene_name")}
    )
    return base.unionByName(later)


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many short axes: the spans of each customer's orders."""
    start = _day("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("contig"),
        start.alias("start"), (start + 1 + F.col("o_orderkey") % 40).alias("end"),
    )


def pooled_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments in two samples of unequal depth."""
    pool = F.when(F.col("ln") % 7 == 0, "thin").otherwise("deep")
    return placed_lines(spark, sf_dir).select(
        pool.alias("sample"), "contig", "start", (F.col("start") + F.col("q")).alias("end")
    )


def pooled_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = F.when(F.col("l_linenumber") % 7 == 0, "thin").otherwise("deep")
    return table(spark, sf_dir, "lineitem").select(pool.alias("sample")).distinct()
