"""Reading only what overlaps the targets, from tables of intervals sorted by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from plumbline.operators.joins import IntervalSet, interval_set, span_join
from plumbline.operators.runs import merge_targets

# At most this many ranges are sent to the scan as predicates: the places, or else the stretch of each contig they span.
MAX_RANGES = 64


def disjoint_places(targets: IntervalSet) -> DataFrame:
    """The union of the targets as ``contig, t_start, t_end``, with the end of the place before on the contig (or null)."""
    merged = merge_targets(targets.intervals.select("contig", F.col("t_start").alias("start"), F.col("t_end").alias("end")), targets.bin_size)
    along = Window.partitionBy("contig").orderBy("start")
    return merged.select("contig", F.col("start").alias("t_start"), F.col("end").alias("t_end"), F.lag("end").over(along).alias("t_before"))


def place_ranges(places: DataFrame) -> list[Row] | None:
    """At most ``MAX_RANGES`` ranges ``contig, t_start, t_end`` that hold all places, or None where there are more contigs."""
    spans = places.groupBy("contig").agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"))
    for ranges in (places.select("contig", "t_start", "t_end"), spans):
        found = ranges.limit(MAX_RANGES + 1).collect()
        if len(found) <= MAX_RANGES:
            return found
    return None


def within_ranges(ranges: list[Row]) -> Column:
    """A predicate of plain comparisons, which reaches the statistics of a Parquet scan."""
    wanted = F.lit(False)
    for r in ranges:
        wanted = wanted | ((F.col("contig") == r.contig) & (F.col("start") < r.t_end) & (F.col("end") > r.t_start))
    return wanted


def overlapping(rows: DataFrame, targets: IntervalSet) -> DataFrame:
    """The rows (``contig, start, end, ...``) that overlap a target, once each, at any number of targets.

    Few ranges become predicates of the scan. Which rows overlap is decided by a join with the union of the targets: of the
    places that a row overlaps, only the first has its forerunner's end at or before the row's start.
    """
    places = disjoint_places(targets)
    ranges = place_ranges(places)
    near = rows if ranges is None else rows.where(within_ranges(ranges))
    met = span_join(near, interval_set(places, targets.bin_size, targets.limit))
    return met.where("t_before IS NULL OR t_before <= start").select(*rows.columns)
