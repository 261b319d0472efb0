"""Shared helpers: scratch tables, checked broadcasts, word splitting."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = r"[\x20\x09-\x0D]+"  # separators of plain words
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # separators of alphanumeric words, after lower-casing

# Spark removes the shuffle files of a query when the query ends, instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# A side is broadcast only when counted to have at most this many rows; the callers' rows are narrow (ids and words).
BROADCAST_ROWS = 500_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder below the shared checkpoint folder and read it back.

    The lineage ends there, so a lost executor costs one read, and several consumers share one computation. Nothing else reads
    the shuffle files behind ``df``, which go when it is written.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def forget(*tables: DataFrame) -> None:
    """Remove the files of such tables of ``stored`` as no result still reads."""
    for table in tables:
        spark = table.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when its counted size allows it; Spark chooses the join otherwise."""
    return F.broadcast(df) if rows <= limit else df


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Only texts with other scripts need the slower character map."""
    plain = F.char_length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column, separators: str) -> Column:
    """The words between separators; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(text, separators), ""), F.array().cast("array<string>"))


def hex_sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
