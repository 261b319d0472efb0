"""Depth computed elsewhere: per-position lines and run-length blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.depth import bin_blocks
from plumbline.operators.joins import IntervalSet
from plumbline.sources.lines import fields, part
from plumbline.sources.ranges import overlapping


def parse_depth_lines(lines: DataFrame, sample: str = "NA") -> DataFrame:
    """``sample, contig, pos, depth`` of per-position lines; 1-based positions become 0-based."""
    return fields(lines, 3).select(
        *_sample(lines, sample), part(0).alias("contig"),
        (part(1).cast("bigint") - 1).alias("pos"), part(2).cast("bigint").alias("depth"),
    )


def parse_depth_blocks(lines: DataFrame, sample: str = "NA") -> DataFrame:
    """``sample, contig, start, end, depth`` of run-length lines; a fractional depth is truncated."""
    return fields(lines, 4).select(
        *_sample(lines, sample), part(0).alias("contig"), part(1).cast("bigint").alias("start"),
        part(2).cast("bigint").alias("end"), part(3).cast("double").cast("bigint").alias("depth"),
    )


def positions_to_blocks(positions: DataFrame, bin_size: int) -> DataFrame:
    """Per-position depth as one-position blocks in bins, the form the interval operators take."""
    return bin_blocks(
        positions.select("sample", "contig", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "depth"),
        bin_size,
    )


def read_depth_lines(spark: SparkSession, path: str, sample: str = "NA") -> DataFrame:
    return parse_depth_lines(spark.read.text(path), sample)


def read_depth_blocks(spark: SparkSession, path: str, sample: str = "NA") -> DataFrame:
    """Per-base BED, compressed or not."""
    return parse_depth_blocks(spark.read.text(path), sample)


def write_depth_store(blocks: DataFrame, path: str) -> None:
    """Keep depth blocks as a table sorted by place, so that many reports share one computation.

    Range partitions spread a dominant contig over files, and min/max statistics let scans skip what targets do not
    touch.
    """
    blocks.repartitionByRange("contig", "start", "sample").sortWithinPartitions("contig", "start").write.mode(
        "overwrite"
    ).parquet(path)


def read_depth_store(spark: SparkSession, path: str, targets: IntervalSet | None = None) -> DataFrame:
    """Blocks of a depth store; with ``targets``, those that overlap one of them, at any number of targets.

    The places of a few targets, as of a gene list, become range predicates that reach the Parquet scan; of many, the
    stretches they span on their contigs do. Which blocks overlap is decided by a join either way.
    """
    blocks = spark.read.parquet(path)
    return blocks if targets is None else overlapping(blocks, targets)


def _sample(lines: DataFrame, sample: str) -> list:
    return ["sample"] if "sample" in lines.columns else [F.lit(sample).alias("sample")]
