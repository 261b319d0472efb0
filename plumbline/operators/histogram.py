"""Depth histograms per target and the metrics read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numeric import double_round, population_stdev, ratio_round
from plumbline.operators.depth import SampleSet, clip_to_intervals, of_samples, sample_grid, sample_set
from plumbline.operators.joins import IntervalSet, keyed_join
from plumbline.params import CoverageParams

INTERVAL_KEYS = ("sample", "contig", "t_start", "t_end")


def zero_filled(clips: DataFrame, grid: DataFrame, keys: tuple[str, ...] = INTERVAL_KEYS) -> DataFrame:
    """Additive histogram rows ``keys, depth, n``: positions no block covers end up at depth 0.

    Each target adds its whole length at depth 0 once, and each clip moves its length from depth 0 to its own depth.
    """
    moves = "array(named_struct('depth', depth, 'n', `end` - start), named_struct('depth', 0L, 'n', start - `end`))"
    moved = clips.selectExpr(*keys, f"inline({moves})")
    return moved.unionByName(grid.selectExpr(*keys, "0L AS depth", "t_end - t_start AS n"))


def sum_histogram(rows: DataFrame, keys: tuple[str, ...] = INTERVAL_KEYS) -> DataFrame:
    """``keys, depth, n`` summed, without empty depths."""
    return rows.groupBy(*keys, "depth").agg(F.sum("n").alias("n")).where(F.col("n") != 0)


def depth_histogram(blocks: DataFrame, targets: IntervalSet, samples: DataFrame | SampleSet) -> DataFrame:
    """Number of positions at each depth, per interval and each of ``samples``; blocks of other samples are left out."""
    samples = sample_set(samples)
    clips = clip_to_intervals(of_samples(blocks, samples), targets)
    return sum_histogram(zero_filled(clips, sample_grid(targets.intervals, samples)))


def rollup_histogram(histogram: DataFrame, members: DataFrame, parent: str, small: bool | None = None) -> DataFrame:
    """Merge interval histograms into their parents: ``members`` maps ``contig, t_start, t_end`` to ``parent``.

    Two members at the same place both count, as two exons would.
    """
    mapped = keyed_join(histogram, members, ["contig", "t_start", "t_end"], small=small or None)
    return sum_histogram(mapped.select("sample", parent, "depth", "n"), ("sample", parent))


def median_low(histogram: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Lower median: the smallest depth at which half of the positions are reached."""
    return _with_lower_half(histogram, keys).groupBy(*keys).agg(
        F.min(F.when(F.col("_reached"), F.col("depth"))).cast("double").alias("median_depth")
    )


def median_interp(histogram: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Median as the mean of the two middle positions."""
    return histogram.groupBy(*keys).agg(F.percentile("depth", F.lit(0.5), F.col("n")).alias("median_depth"))


def _with_lower_half(histogram: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    whole = Window.partitionBy(*keys)
    up_to = whole.orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return histogram.withColumn("_reached", F.sum("n").over(up_to) * 2 >= F.sum("n").over(whole))


def metrics(histogram: DataFrame, params: CoverageParams, keys: tuple[str, ...] = INTERVAL_KEYS) -> DataFrame:
    """All scalar metrics of a histogram, one row per ``keys``.

    Every sum is an exact integer, so partial aggregation in any order gives the same rounded values.
    """
    if params.median == "low":
        histogram = _with_lower_half(histogram, keys)
        median = "CAST(min(CASE WHEN _reached THEN depth END) AS DOUBLE)"
    else:
        median = "percentile(depth, 0.5D, n)"
    steps = sorted(params.thresholds)
    sums = {
        "length_bp": "sum(n)",
        "_total": "sum(depth * n)",
        "_squares": "sum(CAST(depth * depth AS DECIMAL(20, 0)) * CAST(n AS DECIMAL(18, 0)))",
        "_median": median,
        "min_depth": "min(depth)",
        "max_depth": "max(depth)",
        "_zero": "sum(IF(depth = 0, n, 0L))",
        **{f"_ge_{t}": f"sum(IF(depth >= {t}, n, 0L))" for t in steps},
    }
    return histogram.groupBy(*keys).agg(*[F.expr(f"{e} AS {name}") for name, e in sums.items()]).select(
        *keys,
        "length_bp",
        ratio_round("_total", "length_bp", 2).alias("mean_depth"),
        double_round("_median", 1).alias("median_depth"),
        "min_depth",
        "max_depth",
        double_round(population_stdev("length_bp", "_total", "_squares"), 2).alias("stdev_depth"),
        ratio_round("_zero", "length_bp", 2, scale=100).alias("pct_zero"),
        *[ratio_round(f"_ge_{t}", "length_bp", 2, scale=100).alias(f"pct_ge_{t}") for t in steps],
    )
