"""BED files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.bed import bed_rejects, parse_bed
from plumbline.sources.lines import read_lines


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Usable intervals of BED files, numbered by line; the number goes on from file to file, so it is a key."""
    return parse_bed(read_lines(spark, path, across_files=True))


def read_bed_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Refused lines under the numbers of ``read_bed``, with their file."""
    return bed_rejects(read_lines(spark, path, across_files=True))


def bed_bytes(spark: SparkSession, path: str) -> int:
    """Size of the files behind a path."""
    files = spark.read.format("binaryFile").load(path).select("length")
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


__all__ = ["bed_bytes", "read_bed", "read_bed_rejects"]
