"""Streams give the batch result, also when a batch is repeated."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators.depth import coverage_deltas, depth_blocks
from plumbline.operators.joins import target_places
from plumbline.streaming import coverage
from plumbline.streaming.coverage import (
    compact_deltas, compact_histogram, read_deltas, read_histogram, stream_deltas, streamed_blocks,
)
from plumbline.streaming.manifest import Manifest, bases, commit_manifest, read_manifest

SCHEMA = "sample string, contig string, start bigint, end bigint"


def _rows(df):
    return sorted(tuple(r) for r in df.select("sample", "contig", "start", "end", "depth").collect())


def test_batches_add_up(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "deltas")
    segments = spark.range(900).select(
        F.lit("S").alias("sample"), F.concat(F.lit("c"), F.col("id") % 2).alias("contig"),
        (F.col("id") * 7 % 200).alias("start"), (F.col("id") * 7 % 200 + 1 + F.col("id") % 30).alias("end"),
    )
    want = _rows(depth_blocks(segments, 32))
    for part in range(3):
        segments.where(F.col("start") % 3 == part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        stream_deltas(stream, table, str(tmp_path / "progress"), 32).awaitTermination()
    assert len(list((tmp_path / "deltas").glob("batch_id=*"))) == 3
    assert _rows(streamed_blocks(spark, table)) == want
    # the last batch runs again after a failure: its folder is overwritten
    again = coverage_deltas(segments.where(F.col("start") % 3 == 2), 32)
    again.write.mode("overwrite").parquet(f"{table}/batch_id=2")
    assert _rows(streamed_blocks(spark, table)) == want
    rows = read_deltas(spark, table).count()
    compact_deltas(spark, table)
    assert read_deltas(spark, table).count() == rows and _rows(streamed_blocks(spark, table)) == want
    assert read_manifest(spark, table).upto == 2
    # a batch that is repeated after the compaction counts once all the same
    again.write.mode("overwrite").parquet(f"{table}/batch_id=2")
    assert _rows(streamed_blocks(spark, table)) == want


def _batch(spark, table, number, start):
    rows = spark.createDataFrame([("S", "c", start, start + 10)], SCHEMA)
    coverage_deltas(rows, 64).coalesce(1).write.mode("overwrite").parquet(f"{table}/batch_id={number}")


def _depth(spark, table):
    return sum((r.end - r.start) * r.depth for r in streamed_blocks(spark, table).collect())


def test_reads_cost_the_base_and_later_batches(spark, tmp_path):
    table = str(tmp_path / "deltas")
    assert streamed_blocks(spark, table).count() == 0
    for n in range(6):
        _batch(spark, table, n, 5 * n)
    compact_deltas(spark, table)
    _batch(spark, table, 6, 100)
    files = {f.rsplit("/", 2)[1].split("-")[0] for f in read_deltas(spark, table).inputFiles()}
    assert files == {"base", "batch_id=6"} and _depth(spark, table) == 70
    compact_deltas(spark, table)
    compact_deltas(spark, table)  # nothing new
    assert read_manifest(spark, table).version == 2 and _depth(spark, table) == 70
    # the batches of the first base are gone, those that the manifest before still needed are there
    assert [n.name for n in sorted((tmp_path / "deltas").glob("batch_id=*"))] == ["batch_id=6"]


def test_crash_between_write_and_commit(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "deltas")
    for n in range(3):
        _batch(spark, table, n, 5 * n)

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(coverage, "commit_manifest", crash)
        with pytest.raises(OSError):
            compact_deltas(spark, table)
    assert len(bases(spark, table)) == 1 and read_manifest(spark, table).version == 0 and _depth(spark, table) == 30
    _batch(spark, table, 3, 50)
    compact_deltas(spark, table)
    assert len(bases(spark, table)) == 1 and _depth(spark, table) == 40
    # a batch whose write has not ended is not read
    _batch(spark, table, 4, 60)
    (tmp_path / "deltas" / "batch_id=4" / "_SUCCESS").unlink()
    assert _depth(spark, table) == 40


def test_only_one_writer_commits_a_version(spark, tmp_path):
    path = str(tmp_path / "t")
    commit_manifest(spark, path, Manifest(1, "base-a", 3))
    with pytest.raises(RuntimeError):
        commit_manifest(spark, path, Manifest(1, "base-b", 4))
    assert read_manifest(spark, path) == Manifest(1, "base-a", 3)


def test_histogram_compaction(spark, tmp_path):
    table = str(tmp_path / "histogram")
    targets = target_places(spark.createDataFrame([("c", 0, 20)], "contig string, start bigint, end bigint"), 16)
    samples = spark.createDataFrame([("S",)], "sample string")
    for n in range(3):
        rows = [("S", "c", 0, 20, 2, 3), ("S", "c", 0, 20, 5, 1)]
        spark.createDataFrame(rows, coverage.HISTOGRAM_SCHEMA).write.parquet(f"{table}/batch_id={n}")
    want = sorted(map(tuple, read_histogram(spark, table, targets, samples).collect()))
    compact_histogram(spark, table)
    assert sorted(map(tuple, read_histogram(spark, table, targets, samples).collect())) == want
    assert ("S", "c", 0, 20, 0, 8) in want


def test_staged_rows_are_dealt_by_every_task(spark, tmp_path):
    from checks.report_queries import _staged, _stream

    rows = spark.range(0, 1000, 1, 5).select("id", (F.col("id") % 7).alias("k"))
    folder = _staged(spark, rows)
    # no task takes a third of all rows: each of the five writes what it reads
    largest = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/in").groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert largest <= 70
    got = str(tmp_path / "got")
    stream = _stream(spark, folder, rows.schema)
    assert stream.columns == rows.columns
    query = stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{got}/n={n}")).trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "progress")).start().awaitTermination()
    back = spark.read.parquet(got)
    assert back.select("n").distinct().count() == 3
    assert sorted(r.id for r in back.collect()) == list(range(1000))
    empty = _stream(spark, _staged(spark, rows.limit(0)), rows.schema)
    assert empty.columns == rows.columns
