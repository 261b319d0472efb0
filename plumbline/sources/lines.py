"""Text lines with their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.intervals import computed_once
from plumbline.operators.joins import keyed_join


def read_lines(spark: SparkSession, path: str, across_files: bool = False) -> DataFrame:
    """``file_path, line_no, value`` of text files (gz too), numbered from 1 within each file.

    With ``across_files`` the number goes on from file to file, in the order of their paths.

    Rows are counted per file split, the counts are accumulated over the short table of splits, and each row adds its
    place within its split.
    """
    split = ["file_path", "file_block_start"]
    rows = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("file_block_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    per_split = rows.groupBy(*split).agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    # one row per file split
    along = Window.orderBy(*split) if across_files else Window.partitionBy("file_path").orderBy("file_block_start")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_split.select(*split, "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    numbered = keyed_join(rows, offsets, split)
    return numbered.select(
        "file_path", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "value"
    )


def fields(lines: DataFrame, minimum: int) -> DataFrame:
    """Add the tab-separated ``parts`` of ``value``; rows with fewer than ``minimum`` are dropped."""
    split = computed_once(lines, parts=F.split(F.rtrim("value", F.lit("\r\n")), "\t"))
    return split.where(F.size("parts") >= minimum)


def part(i: int) -> Column:
    return F.get(F.col("parts"), F.lit(i))
