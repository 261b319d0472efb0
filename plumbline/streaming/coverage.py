"""Streams that keep coverage up to date.

Depth deltas and histograms only add up, so a micro-batch needs no order and no state store: each batch is summed on its
own and written under its batch number. A batch that is repeated after a failure overwrites its own folder, so every
read counts once. ``compact`` sums what is there into one base and commits it in a manifest; readers take the base of
the newest manifest and the batches after it, so that a read costs the base and the batches since the last compaction.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.depth import SampleSet, clip_to_intervals, coverage_deltas, depth_from_deltas, sample_grid
from plumbline.operators.histogram import INTERVAL_KEYS, sum_histogram
from plumbline.operators.joins import IntervalSet
from plumbline.streaming.manifest import Manifest, bases, commit_manifest, read_manifest, remove, whole_batches

DELTA_SCHEMA = "sample string, contig string, bin bigint, pos bigint, delta bigint"
HISTOGRAM_SCHEMA = "sample string, contig string, t_start bigint, t_end bigint, depth bigint, n bigint"


def _append(stream: DataFrame, summed, path: str, checkpoint: str) -> StreamingQuery:
    def save(batch: DataFrame, batch_id: int) -> None:
        summed(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_deltas(segments: DataFrame, path: str, checkpoint: str, bin_size: int) -> StreamingQuery:
    """Add the depth changes of streamed segments (``sample, contig, start, end``) to the delta table at ``path``."""
    return _append(segments, lambda batch: coverage_deltas(batch, bin_size), path, checkpoint)


def _live(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the newest base and of the whole batches after it."""
    return _rows(spark, path, schema, read_manifest(spark, path), whole_batches(spark, path))


def _rows(spark: SparkSession, path: str, schema: str, state: Manifest, batches: list[int]) -> DataFrame:
    folders = [f"{path}/batch_id={n}" for n in batches if n > state.upto]
    folders += [f"{path}/{state.base}"] if state.base else []
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _summed_deltas(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sample", "contig", "bin", "pos").agg(F.sum("delta").alias("delta")).where(F.col("delta") != 0)


def read_deltas(spark: SparkSession, path: str) -> DataFrame:
    """Deltas of all batches, summed per position."""
    return _summed_deltas(_live(spark, path, DELTA_SCHEMA))


def streamed_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Depth blocks of everything that has arrived so far."""
    return depth_from_deltas(read_deltas(spark, path))


def stream_histogram(blocks: DataFrame, targets: IntervalSet, path: str, checkpoint: str) -> StreamingQuery:
    """Add streamed depth blocks (cut at bins; each position once) to the histogram table at ``path``."""

    def summed(batch: DataFrame) -> DataFrame:
        clips = clip_to_intervals(batch, targets)
        covered = clips.select(*INTERVAL_KEYS, "depth", (F.col("end") - F.col("start")).alias("n"))
        return sum_histogram(covered)

    return _append(blocks, summed, path, checkpoint)


def read_histogram(spark: SparkSession, path: str, targets: IntervalSet, samples: DataFrame | SampleSet) -> DataFrame:
    """Histograms of everything that has arrived; positions not covered so far are at depth 0."""
    covered = _live(spark, path, HISTOGRAM_SCHEMA)
    zero = F.lit(0).cast("bigint")
    whole = sample_grid(targets.intervals, samples).select(
        *INTERVAL_KEYS, zero.alias("depth"), (F.col("t_end") - F.col("t_start")).alias("n")
    )
    moves = F.array(F.struct("depth", "n"), F.struct(zero.alias("depth"), (-F.col("n")).alias("n")))
    moved = covered.select(*INTERVAL_KEYS, F.explode(moves).alias("m")).select(*INTERVAL_KEYS, "m.depth", "m.n")
    return sum_histogram(moved.unionByName(whole))


def compact_deltas(spark: SparkSession, path: str) -> None:
    """Sum the deltas that have arrived into a new base; positions that cancel out go."""
    compact(spark, path, DELTA_SCHEMA, _summed_deltas)


def compact_histogram(spark: SparkSession, path: str) -> None:
    """Sum the histogram rows that have arrived into a new base."""
    compact(spark, path, HISTOGRAM_SCHEMA, sum_histogram)


def compact(spark: SparkSession, path: str, schema: str, summed: Callable[[DataFrame], DataFrame]) -> None:
    """Write the sum of the live rows as a new base, commit it, then remove what the manifest before did not need either.

    Until the commit readers see the old state, also when this stops half-way; the folder it left is never read, and goes
    with a later compaction. Batches that arrive or are repeated meanwhile are not lost: those up to the last one summed
    are no longer read, later ones still are. One compaction of a table runs at a time; a second one fails to commit.
    """
    state = read_manifest(spark, path)
    batches = whole_batches(spark, path)
    upto = max([n for n in batches if n > state.upto], default=state.upto)
    if upto == state.upto:
        return
    base = f"base-{upto}-{uuid.uuid4().hex}"
    # a batch that ends after the listing is neither summed nor covered by ``upto``
    rows = summed(_rows(spark, path, schema, state, batches))
    rows.repartitionByRange("contig", "sample").write.parquet(f"{path}/{base}")
    commit_manifest(spark, path, Manifest(state.version + 1, base, upto))
    # readers that began before the commit may still use the old base and its batches
    keep = {base, state.base}
    remove(spark, path, [f"batch_id={n}" for n in batches if n <= state.upto] + [b for b in bases(spark, path) if b not in keep])
