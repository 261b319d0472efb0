"""Maximal runs of low depth, and merging of overlapping intervals.

Runs are found bin by bin, so a window group never exceeds one bin of one sample and target, or one row for each bin of
a sample and target that has blocks. Merged targets that touch an inner bin edge are stitched together; there are at most
two of those per bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.depth import SampleSet, depth_blocks, of_samples, sample_grid, sample_set
from plumbline.operators.joins import IntervalSet, interval_join

TARGET_KEYS = ("sample", "contig", "t_start", "t_end")


def collapse_blocks(blocks: DataFrame, threshold: int, keys: tuple[str, ...] = ("sample", "contig")) -> DataFrame:
    """Merge touching blocks with depth >= threshold into one row; low blocks stay as they are.

    It works in the partitioning the blocks already have, and shrinks well-covered stretches before the target join.
    """
    along = Window.partitionBy(*keys, "bin").orderBy("start")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ok = F.col("depth") >= threshold
    joins_previous = ok & F.lag(ok).over(along) & (F.lag("end").over(along) == F.col("start"))
    return (
        blocks.withColumn("_opens", F.when(joins_previous, 0).otherwise(1))
        .withColumn("_run", F.sum("_opens").over(so_far))
        .groupBy(*keys, "bin", "_run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("depth").alias("depth"))
        .drop("_run")
    )


def stitch_runs(runs: DataFrame, keys: tuple[str, ...], at_edge, sums: tuple[str, ...] = ()) -> DataFrame:
    """Join runs that continue across a bin edge: ``keys, start, end`` plus the summed columns."""
    along = Window.partitionBy(*keys, "_slot").orderBy("start")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.when(F.lag("end").over(along) == F.col("start"), 0).otherwise(1)
    return (
        runs.withColumn("_slot", F.when(~at_edge, F.col("bin")))
        .withColumn("_opens", opens)
        .withColumn("_island", F.sum("_opens").over(so_far))
        .groupBy(*keys, "_slot", "_island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), *[F.sum(c).alias(c) for c in sums])
        .drop("_slot", "_island")
    )


def low_blocks(
    blocks: DataFrame, targets: IntervalSet, samples: DataFrame | SampleSet, threshold: int, min_len: int
) -> DataFrame:
    """Maximal runs of depth < threshold and length >= min_len inside each interval, with their depth sum.

    A low run is what lies between two covered stretches (depth >= threshold) or a covered stretch and the edge, so
    uncovered positions need no rows of their own. Bins with blocks become one row each: the low runs within it, where
    its covered stretches begin and end, and the depth sums around them. A run across bins, touched or not, is the gap
    between two successive rows of a target, and one closing row per sample and target stands at its end.
    """
    samples = sample_set(samples)
    ok = F.col("depth") >= threshold
    hits = interval_join(collapse_blocks(of_samples(blocks, samples), threshold), targets)
    parts = hits.select(
        *TARGET_KEYS, "bin", "start", "end", ok.alias("ok"),
        F.when(ok, 0).otherwise(F.col("depth") * (F.col("end") - F.col("start"))).alias("low_sum"),
    )
    along = Window.partitionBy(*TARGET_KEYS, "bin").orderBy("start")
    before, so_far = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = parts.withColumn("_sum", F.sum("low_sum").over(so_far)).select(
        *TARGET_KEYS, "bin", "ok", "start", "end", "low_sum", "_sum",
        F.last(F.when(F.col("ok"), F.struct("end", "_sum")), ignorenulls=True).over(before).alias("_last"),
    )

    def run(start, end, depth_sum):
        return F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), depth_sum.cast("bigint").alias("depth_sum"))

    within = F.col("ok") & (F.col("start") - F.col("_last.end") >= max(min_len, 1))
    rows = summed.groupBy(*TARGET_KEYS, "bin").agg(
        F.min(F.when(F.col("ok"), F.col("start"))).alias("first"), F.max(F.when(F.col("ok"), F.col("end"))).alias("last"),
        # the sums up to the first and the last covered stretch of the bin
        F.min(F.when(F.col("ok"), F.col("_sum"))).alias("head"), F.max(F.when(F.col("ok"), F.col("_sum"))).alias("upto"),
        F.sum("low_sum").alias("total"),
        F.collect_list(F.when(within, run(F.col("_last.end"), F.col("start"), F.col("_sum") - F.col("_last._sum")))).alias("inner"),
    )
    zero = F.lit(0).cast("bigint")
    closers = sample_grid(targets.intervals, samples).select(
        *TARGET_KEYS, F.lit(2**62).alias("bin"), F.col("t_end").alias("first"), F.lit(None).cast("bigint").alias("last"),
        zero.alias("head"), F.lit(None).cast("bigint").alias("upto"), zero.alias("total"),
        F.array().cast(rows.schema["inner"].dataType).alias("inner"),
    )
    target = Window.partitionBy(*TARGET_KEYS).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.unionByName(closers).withColumn("_before", F.coalesce(F.sum("total").over(target), zero))
    previous = F.last(F.when(F.col("last").isNotNull(), F.struct("last", (F.col("_before") + F.col("upto")).alias("sum"))), ignorenulls=True)
    linked = placed.withColumn("_previous", previous.over(target))
    gap = run(
        F.coalesce("_previous.last", "t_start"), F.col("first"), F.col("_before") + F.col("head") - F.coalesce("_previous.sum", zero)
    )
    found = linked.select(
        *TARGET_KEYS, F.inline(F.when(F.col("first").isNull(), F.col("inner")).otherwise(F.array_append("inner", gap)))
    )
    found = found.withColumn("length", F.col("end") - F.col("start")).where(F.col("length") >= max(min_len, 1))
    if threshold <= 0:  # no depth is below 0
        found = found.where(F.lit(False))
    return found.select(*TARGET_KEYS, "start", "end", "length", "depth_sum")


def zero_runs(blocks: DataFrame, targets: IntervalSet, samples: DataFrame | SampleSet, min_len: int) -> DataFrame:
    """Runs of true depth 0."""
    return low_blocks(blocks, targets, samples, 1, min_len).drop("depth_sum")


def low_totals(low: DataFrame, keys: tuple[str, ...] = TARGET_KEYS) -> DataFrame:
    """Number and total length of low blocks."""
    return low.groupBy(*keys).agg(
        F.count("*").alias("n_lowcov_blocks"), F.sum("length").alias("lowcov_total_bp")
    )


def merge_targets(targets: DataFrame, bin_size: int) -> DataFrame:
    """Merge overlapping and book-ended intervals per contig, like sort and merge on BED files.

    The union of intervals is where their own coverage is at least 1, so the depth operators do it without a
    contig-wide window.
    """
    size = F.lit(bin_size).cast("bigint")
    covered = collapse_blocks(depth_blocks(targets, bin_size, keys=("contig",)), 1, keys=("contig",))
    at_edge = (F.col("start") == F.col("bin") * size) | (F.col("end") == (F.col("bin") + 1) * size)
    return stitch_runs(covered, ("contig",), at_edge).select("contig", "start", "end")
