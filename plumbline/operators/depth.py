"""From reads to run-length depth blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.intervals import split_by_bin
from plumbline.operators.joins import IntervalSet, fits_broadcast, interval_join, keyed_join, prune_to_intervals

# Fixed value: flag bits of reads that do not count (unmapped, secondary, QC fail, duplicate).
EXCLUDED_FLAGS = 0x704

# reads with one aligned stretch, clipped or not, take the short way; the others walk the operations that advance
_ONE_STRETCH = "regexp_extract(cigar, '^(?:[0-9]+[SH])*([0-9]+)[M=X](?:[0-9]+[SH])*$', 1)"
_SEGMENTS = f"""
CASE WHEN {_ONE_STRETCH} <> ''
THEN array(named_struct('start', start, 'end', start + CAST({_ONE_STRETCH} AS BIGINT)))
ELSE aggregate(
  regexp_extract_all(cigar, '([0-9]+[MDN=X])', 1),
  CAST(named_struct('pos', start, 'segs', array())
       AS STRUCT<pos: BIGINT, segs: ARRAY<STRUCT<start: BIGINT, end: BIGINT>>>),
  (acc, op) -> named_struct(
    'pos', acc.pos + CAST(rtrim('MDN=X', op) AS BIGINT),
    'segs', IF(endswith(op, 'D') OR endswith(op, 'N'), acc.segs,
               array_append(acc.segs, named_struct(
                 'start', acc.pos, 'end', acc.pos + CAST(rtrim('M=X', op) AS BIGINT))))),
  acc -> acc.segs)
END
"""


def read_filter(reads: DataFrame) -> DataFrame:
    """Drop unmapped, secondary, QC-fail and duplicate reads."""
    return reads.where(F.col("flag").bitwiseAND(F.lit(EXCLUDED_FLAGS)) == 0)


def cigar_segments(reads: DataFrame) -> DataFrame:
    """Covered reference segments of each read: M, = and X cover, D and N only advance, I, S, H and P do neither."""
    others = [c for c in reads.columns if c not in ("start", "cigar")]
    return (
        reads.withColumn("_segs", F.expr(_SEGMENTS))
        .select(*others, F.inline("_segs"))
        .where(F.col("start") < F.col("end"))
    )


def coverage_deltas(segments: DataFrame, bin_size: int, keys: tuple[str, ...] = ("sample", "contig")) -> DataFrame:
    """Depth changes ``keys, bin, pos, delta``: +1 where a segment starts, -1 where it ends, summed per position.

    Segments are cut at bin edges, so each bin starts at depth 0. The sum combines on the map side: however deep a
    pile-up is, it leaves each task as at most one row per breakpoint.
    """
    return sum_deltas(delta_events(split_by_bin(segments, bin_size), keys), keys)


def delta_events(pieces: DataFrame, keys: tuple[str, ...] = ("sample", "contig")) -> DataFrame:
    """The +1 and -1 rows of bin-cut segments."""
    events = "array(named_struct('pos', start, 'delta', 1L), named_struct('pos', `end`, 'delta', -1L))"
    return pieces.selectExpr(*keys, "bin", f"inline({events})")


def sum_deltas(events: DataFrame, keys: tuple[str, ...] = ("sample", "contig")) -> DataFrame:
    """Add up delta rows per position; positions that cancel out are dropped."""
    return events.groupBy(*keys, "bin", "pos").agg(F.sum("delta").alias("delta")).where(F.col("delta") != 0)


def depth_from_deltas(deltas: DataFrame, keys: tuple[str, ...] = ("sample", "contig")) -> DataFrame:
    """Run-length blocks ``keys, bin, start, end, depth`` of depth > 0. A window group is at most one bin wide."""
    along = Window.partitionBy(*keys, "bin").orderBy("pos")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return deltas.select(
        *keys,
        "bin",
        F.col("pos").alias("start"),
        F.lead("pos").over(along).alias("end"),
        F.sum("delta").over(so_far).alias("depth"),
    ).where((F.col("depth") != 0) & F.col("end").isNotNull())


def depth_blocks(
    segments: DataFrame,
    bin_size: int,
    keys: tuple[str, ...] = ("sample", "contig"),
    targets: IntervalSet | None = None,
    samples: DataFrame | SampleSet | None = None,
) -> DataFrame:
    """Run-length depth of segments; with ``targets`` and ``samples``, only in bins that a target touches and of those samples.

    What is not asked for is dropped before the first shuffle.
    """
    pieces = split_by_bin(segments.select(*keys, "start", "end"), bin_size)
    if targets is not None:
        pieces = prune_to_intervals(pieces, targets)
    if samples is not None:
        pieces = of_samples(pieces, samples)
    return depth_from_deltas(sum_deltas(delta_events(pieces, keys), keys), keys)


def bin_blocks(blocks: DataFrame, bin_size: int) -> DataFrame:
    """Cut depth blocks read from a file at bin edges and drop depth 0."""
    return split_by_bin(blocks.where(F.col("depth") != 0), bin_size)


@dataclass(frozen=True)
class SampleSet:
    """The names of the samples to report (one per sequencing run), distinct, and whether they fit a broadcast."""

    names: DataFrame
    small: bool


def sample_set(samples: DataFrame | SampleSet) -> SampleSet:
    """Count the samples of a manifest (``sample``) once; rows without a name are left out."""
    if isinstance(samples, SampleSet):
        return samples
    names = samples.select("sample").where(F.col("sample").isNotNull()).distinct()
    return SampleSet(names, fits_broadcast(names))


def sample_grid(intervals: DataFrame, samples: DataFrame | SampleSet) -> DataFrame:
    """Repeat each interval for every sample: each sample reports each target, so this product is the result's size."""
    known = sample_set(samples)
    return intervals.join(F.broadcast(known.names) if known.small else known.names, how="cross")


def of_samples(rows: DataFrame, samples: DataFrame | SampleSet) -> DataFrame:
    """Rows of the samples asked for, by a semi-join. Depth of other samples, or of none (null), belongs to no row of a report."""
    known = sample_set(samples)
    return keyed_join(rows, known.names, ["sample"], "left_semi", known.small)


def clip_to_intervals(blocks: DataFrame, targets: IntervalSet) -> DataFrame:
    """Blocks clipped to each interval they overlap: ``sample, contig, bin, depth, start, end, t_start, t_end``."""
    return interval_join(blocks, targets).drop("lo", "hi")


def per_base_depth(blocks: DataFrame, targets: IntervalSet, samples: DataFrame | SampleSet) -> DataFrame:
    """Depth at every position of the intervals, zeros included: ``sample, contig, t_start, t_end, pos, depth``.

    One row per position is the output itself; guard large target sets with the BED limits first.
    """
    samples = sample_set(samples)
    clips = interval_join(of_samples(blocks, samples), targets)
    keys = ["sample", "contig", "t_start", "t_end", "bin"]
    spans = sample_grid(targets.bins(), samples)
    opened = clips.select(*keys, "lo", "hi", "start", "end", "depth").unionByName(
        spans.select(*keys, "lo", "hi", F.col("hi").alias("start"), F.col("hi").alias("end"), _zero("depth"))
    )
    along = Window.partitionBy(*keys).orderBy("start", "end")
    gap_from = F.coalesce(F.lag("end").over(along), F.col("lo"))
    runs = F.array(
        F.struct(F.col("_gap").alias("start"), F.col("start").alias("end"), _zero("depth")),
        F.struct(F.col("start"), F.col("end"), F.col("depth")),
    )
    return (
        opened.withColumn("_gap", gap_from)
        .select(*keys, F.inline(F.filter(runs, lambda r: r["start"] < r["end"])))
        .select(
            "sample", "contig", "t_start", "t_end",
            F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"), "depth",
        )
    )


def _zero(name: str) -> Column:
    return F.lit(0).cast("bigint").alias(name)


__all__ = [
    "SampleSet", "bin_blocks", "cigar_segments", "clip_to_intervals", "coverage_deltas", "delta_events", "depth_blocks",
    "depth_from_deltas", "of_samples", "per_base_depth", "read_filter", "sample_grid", "sample_set",
    "sum_deltas",
]
