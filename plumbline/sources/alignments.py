"""Aligned reads as a table: Parquet, or SAM text lines. Binary alignment files are not decoded here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.annotation import sample_names
from plumbline.operators.joins import IntervalSet, keyed_join
from plumbline.sources.lines import fields, part, read_lines
from plumbline.sources.ranges import overlapping

READ_COLUMNS = ["sample", "read_id", "contig", "start", "cigar", "flag", "mapq"]
# Row groups of a read store; small ones let a scan skip more of a file.
ROW_GROUP_BYTES = 16 << 20
# Spans up to these lengths are kept apart in a read store, so that few long reads do not widen the statistics of short ones.
SPAN_CLASSES = tuple(1024 * 16**k for k in range(5))


def read_end() -> Column:
    """Where a read ends on the axis: M, D, N, = and X advance. A read without a CIGAR ends where it starts."""
    steps = F.expr("aggregate(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), 0L, (n, x) -> n + CAST(x AS BIGINT))")
    return F.col("start") + F.coalesce(steps, F.lit(0).cast("bigint"))


def read_alignments(spark: SparkSession, path: str, targets: IntervalSet | None = None) -> DataFrame:
    """Reads from Parquet with the columns of ``READ_COLUMNS``; filters and pruning reach the scan.

    With ``targets``, the reads that overlap one of them. In a store of ``write_alignments``, whose rows have an ``end``,
    the scan skips the row groups that no target reaches; other tables are filtered alike, after the scan.
    """
    rows = spark.read.parquet(path)
    if targets is not None:
        rows = rows if "end" in rows.columns else rows.withColumn("end", read_end())
        rows = overlapping(rows.select(*READ_COLUMNS, "end"), targets)
    return rows.select(*READ_COLUMNS)


def parse_sam(lines: DataFrame, sample: str = "NA") -> DataFrame:
    """Reads from SAM lines; header lines are dropped, the 1-based position becomes 0-based.

    Where the lines have a ``file_path``, the sample of a read is that of its RG tag in the read groups of its own file, or the
    file's first named one where the read has no tag or an unknown one. ``sample`` stands where a file names none.
    """
    records = fields(lines.where(~F.startswith("value", F.lit("@"))), 11)
    columns = [
        part(0).alias("read_id"),
        part(2).alias("contig"),
        (part(3).cast("bigint") - 1).alias("start"),
        part(5).alias("cigar"),
        part(1).cast("int").alias("flag"),
        part(4).cast("int").alias("mapq"),
    ]
    if "file_path" not in lines.columns:
        return records.select(F.lit(sample).alias("sample"), *columns)
    # tags follow the eleven fixed fields; the type of RG is Z
    tags = F.filter(F.slice("parts", 12, F.greatest(F.size("parts") - 11, F.lit(0))), lambda p: F.startswith(p, F.lit("RG:Z:")))
    reads = records.select("file_path", F.substr(F.get(tags, F.lit(0)), F.lit(6)).alias("rg"), *columns)
    groups = header_read_groups(lines, F.col("file_path"))
    named = groups.where("id IS NOT NULL AND sm <> ''").groupBy("sample_file", "id").agg(F.min_by("sm", "ordinal").alias("sm"))
    own = named.select(F.col("sample_file").alias("file_path"), F.col("id").alias("rg"), "sm")
    usual = sample_names(groups).where("sample_name <> 'NA'").select(F.col("sample_file").alias("file_path"), "sample_name")
    # read groups are few for each file, but files may be many
    found = keyed_join(keyed_join(reads, own, ["file_path", "rg"], "left"), usual, ["file_path"], "left")
    return found.withColumn("sample", F.coalesce("sm", "sample_name", F.lit(sample))).select(*READ_COLUMNS)


def read_sam(spark: SparkSession, path: str, sample: str = "NA") -> DataFrame:
    """Reads of SAM text files (gz too), each with the sample of its read group in its own file."""
    return parse_sam(read_lines(spark, path), sample)


def _tag(name: str):
    """Value of a header tag such as ``SN:``; null when the tag is missing."""
    found = F.filter(F.col("parts"), lambda p: F.startswith(p, F.lit(name + ":")))
    return F.substr(F.get(found, F.lit(0)), F.lit(len(name) + 2))


def header_contigs(lines: DataFrame, sample: str = "NA") -> DataFrame:
    """``sample, ordinal, sn, ln`` of the @SQ lines; ``lines`` needs ``line_no``."""
    return fields(lines.where(F.startswith("value", F.lit("@SQ\t"))), 2).select(
        F.lit(sample).alias("sample"), F.col("line_no").alias("ordinal"),
        _tag("SN").alias("sn"), _tag("LN").cast("bigint").alias("ln"),
    )


def header_read_groups(lines: DataFrame, sample_file: str | Column = "") -> DataFrame:
    """``sample_file, ordinal, id, sm`` of the @RG lines."""
    file = sample_file if isinstance(sample_file, Column) else F.lit(sample_file)
    return fields(lines.where(F.startswith("value", F.lit("@RG\t"))), 2).select(
        file.alias("sample_file"), F.col("line_no").alias("ordinal"),
        _tag("ID").alias("id"), _tag("SM").alias("sm"),
    )


def write_alignments(reads: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Write a read store: reads with their ``end``, by class of span and sorted by place.

    Range partitions spread a dominant contig over files, and the statistics of start and end are tight within a class.
    """
    placed = reads.select(*READ_COLUMNS).withColumn("end", read_end())
    span = F.col("end") - F.col("start")
    classed = placed.withColumn("span_class", sum((F.when(span > n, 1).otherwise(0) for n in SPAN_CLASSES), F.lit(0)))
    classed.repartitionByRange("span_class", "contig", "start", "read_id").sortWithinPartitions("span_class", "contig", "start").write.option(
        "parquet.block.size", row_group_bytes
    ).mode("overwrite").parquet(path)
