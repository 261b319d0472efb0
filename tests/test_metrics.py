"""Hand-computed depths."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators.depth import bin_blocks, cigar_segments, depth_blocks, per_base_depth, read_filter
from plumbline.operators.histogram import depth_histogram, metrics
from plumbline.operators.joins import point_interval_join, target_places, target_rejects
from plumbline.operators.runs import low_blocks, merge_targets
from plumbline.params import CoverageParams, parse_thresholds
from plumbline.plans.report import coverage_report

BLOCKS = "sample string, contig string, start bigint, end bigint, depth bigint"


def measure(spark, blocks, start=0, end=10, bin_size=4, threshold=10, min_len=5, **params):
    rows = spark.createDataFrame([("S", "c", *b) for b in blocks] or [("S", "z", 0, 1, 1)], BLOCKS)
    samples = spark.createDataFrame([("S",)], "sample string")
    targets = spark.createDataFrame([("c", start, end)], "contig string, start bigint, end bigint")
    places = target_places(targets, bin_size)
    cut = bin_blocks(rows, bin_size)
    found = metrics(depth_histogram(cut, places, samples), CoverageParams(bin_size=bin_size, **params)).collect()
    low = low_blocks(cut, places, samples, threshold, min_len).orderBy("start").collect()
    assert len(found) == 1
    return found[0], [(r.start, r.end, r.length, r.depth_sum) for r in low]


def positions(depths):
    return [(i, i + 1, d) for i, d in enumerate(depths)]


def test_uniform(spark):
    m, low = measure(spark, [(0, 10, 50)])
    assert (m.mean_depth, m.median_depth, m.min_depth, m.max_depth, m.stdev_depth) == (50, 50, 50, 50, 0)
    assert (m.pct_zero, m.pct_ge_50, m.pct_ge_100) == (0, 100, 0)
    assert low == []


def test_mixed(spark):
    m, _ = measure(spark, positions([0, 0, 5, 10, 20, 30, 50, 100, 100, 100]))
    assert (m.pct_zero, m.mean_depth, m.pct_ge_20, m.median_depth) == (20, 41.5, 60, 25)


def test_inner_and_trailing_gap(spark):
    m, low = measure(spark, [(0, 2, 50), (8, 10, 50)])
    assert (m.pct_zero, m.mean_depth) == (60, 20)
    assert low == [(2, 8, 6, 0)]
    m, low = measure(spark, [(0, 5, 20)])
    assert (m.pct_zero, m.mean_depth) == (50, 10)
    assert low == [(5, 10, 5, 0)]


@pytest.mark.parametrize("median, want", [("interp", 45.0), ("low", 30.0)])
def test_two_blocks(spark, median, want):
    m, _ = measure(spark, [(0, 5, 30), (5, 10, 60)], median=median)
    assert (m.mean_depth, m.median_depth) == (45, want)


def test_low_run_needs_its_length(spark):
    assert measure(spark, [(10, 20, 50)], 0, 20)[1] == [(0, 10, 10, 0)]
    assert measure(spark, [(3, 10, 50)])[1] == []


def test_low_run_keeps_depth_sum_over_bins(spark):
    _, low = measure(spark, [(0, 1, 50), (1, 7, 3), (8, 9, 9), (11, 30, 12)], 0, 30, bin_size=3)
    assert low == [(1, 11, 10, 27)]


def test_threshold_zero_has_no_low_run(spark):
    assert measure(spark, [(3, 10, 50)], threshold=0, min_len=1)[1] == []


def test_population_stdev(spark):
    assert measure(spark, positions([10, 20, 30, 40]), 0, 4)[0].stdev_depth == 11.18


def test_no_data(spark):
    m, low = measure(spark, [])
    assert (m.length_bp, m.mean_depth, m.max_depth, m.pct_zero, m.pct_ge_1) == (10, 0, 0, 100, 0)
    assert low == [(0, 10, 10, 0)]


def test_clip(spark):
    m, _ = measure(spark, [(5, 25, 30)], 10, 20)
    assert (m.length_bp, m.mean_depth, m.pct_zero) == (10, 30, 0)


def test_deep_values_stay_exact(spark):
    m, _ = measure(spark, [(0, 5, 3_000_000_000), (5, 10, 3_000_000_002)])
    assert (m.mean_depth, m.stdev_depth) == (3_000_000_001, 1.0)


def test_negative_coordinates(spark):
    m, low = measure(spark, [(-7, -2, 20)], -8, 2)
    assert (m.length_bp, m.mean_depth, m.pct_zero) == (10, 10, 50)
    assert low == []


def test_thresholds():
    assert parse_thresholds("30, 1,5,5") == (1, 5, 30)
    for bad in ("", "a", "1,-2"):
        with pytest.raises(ValueError):
            parse_thresholds(bad)


def test_cigar_and_flags(spark):
    rows = [
        ("S", "a", "c", 100, "10M", 0), ("S", "b", "c", 100, "2S3M2I4M1D2=1X5N3M4H", 0), ("S", "d", "c", 5, "*", 0),
        ("S", "e", "c", 5, "3M", 4), ("S", "f", "c", 5, "3M", 256), ("S", "g", "c", 5, "3M", 512),
        ("S", "h", "c", 5, "3M", 1024), ("S", "i", "c", 5, "3M", 2048), ("S", "j", "c", 5, "0M", 16),
    ]
    reads = spark.createDataFrame(
        rows, "sample string, read_id string, contig string, start bigint, cigar string, flag int"
    )
    found = cigar_segments(read_filter(reads)).select("read_id", "start", "end").collect()
    assert sorted(tuple(r) for r in found) == [
        ("a", 100, 110), ("b", 100, 103), ("b", 103, 107), ("b", 108, 110), ("b", 110, 111), ("b", 116, 119),
        ("i", 5, 8),
    ]


def test_pile_up_on_one_place(spark):
    """Many copies of one read: the delta sum leaves one row per breakpoint."""
    reads = spark.range(20_000).select(
        F.lit("S").alias("sample"), F.lit("c").alias("contig"), F.lit(3).cast("bigint").alias("start"),
        F.lit(9).cast("bigint").alias("end"),
    )
    blocks = depth_blocks(reads, 5).orderBy("start").collect()
    assert [(r.start, r.end, r.depth) for r in blocks] == [(3, 5, 20_000), (5, 9, 20_000)]


def test_merge_joins_touching_and_nested(spark):
    rows = [("c", 0, 5), ("c", 5, 9), ("c", 20, 40), ("c", 22, 23), ("c", 41, 42), ("d", 3, 4)]
    merged = merge_targets(spark.createDataFrame(rows, "contig string, start bigint, end bigint"), 4)
    assert sorted(tuple(r) for r in merged.collect()) == [("c", 0, 9), ("c", 20, 40), ("c", 41, 42), ("d", 3, 4)]


@pytest.mark.parametrize("lengths", [(1, 3), (40, 90), (1, 90)])
@pytest.mark.parametrize("limit", [None, 0])
def test_crowded_bins_equal_brute_force(spark, lengths, limit):
    """Short and long targets, many in one bin, copies among them, in both join forms."""
    rng = random.Random(7)
    reads = [(rng.choice("ST"), "c", s, s + rng.randint(1, 30)) for s in (rng.randint(-20, 150) for _ in range(300))]
    spans = [(s, s + rng.randint(*lengths)) for s in (rng.choice((rng.randint(-9, 160), 64, 70)) for _ in range(80))]
    depth = {}
    for sample, _, s, e in reads:
        for p in range(s, e):
            depth[sample, p] = depth.get((sample, p), 0) + 1
    want_hist, want_low = {}, set()
    for i, (s, e) in enumerate(spans):
        for sample in "ST":
            run = None
            for p in range(s, e + 1):
                d = depth.get((sample, p), 0)
                if p < e:
                    want_hist[sample, i, d] = want_hist.get((sample, i, d), 0) + 1
                if p < e and d < 12:
                    run = run or [p, 0]
                    run[1] += d
                elif run:
                    want_low.add((sample, i, run[0], p, run[1]))
                    run = None
    rows = spark.createDataFrame(reads, "sample string, contig string, start bigint, end bigint")
    targets = spark.createDataFrame(
        [(i, "t", "c", s, e) for i, (s, e) in enumerate(spans)],
        "ordinal bigint, target_id string, contig string, start bigint, end bigint",
    )
    samples = spark.createDataFrame([("S",), ("T",)], "sample string")
    params = CoverageParams(bin_size=32, low_threshold=12, low_min_len=1)
    places = target_places(targets, 32, limit)
    blocks = depth_blocks(rows, 32, targets=places)
    report = coverage_report(blocks, targets, samples, params, limit=limit)
    assert {(r.sample, r.ordinal, r.depth): r.n for r in report.histogram.collect()} == want_hist
    low = {(r.sample, r.ordinal, r.start, r.end, r.depth_sum) for r in report.low_blocks.collect()}
    assert low == want_low
    by_base = per_base_depth(blocks, places, samples).collect()
    assert len(by_base) == 2 * sum(e - s for s, e in set(spans))
    assert all(r.depth == depth.get((r.sample, r.pos), 0) for r in by_base)
    points = rows.select("contig", F.col("start").alias("pos"))
    joined = point_interval_join(points, places)
    assert joined.count() == sum(1 for r in reads for s, e in set(spans) if s <= r[2] < e)


def test_samples_outside_the_manifest(spark):
    rows = [("S", "c", 0, 4, 30), ("T", "c", 0, 6, 30), (None, "c", 2, 6, 3)]
    cut = bin_blocks(spark.createDataFrame(rows, BLOCKS), 4)
    targets = spark.createDataFrame([("c", 0, 10), ("c", 5, 5), ("c", 9, 2), (None, 1, 2)], "contig string, start bigint, end bigint")
    samples = spark.createDataFrame([("S",), (None,)], "sample string")
    places = target_places(targets, 4)
    found = {(r.sample, r.contig, r.t_start, r.depth): r.n for r in depth_histogram(cut, places, samples).collect()}
    assert found == {("S", "c", 0, 0): 6, ("S", "c", 0, 30): 4, ("S", None, 1, 0): 1}
    low = low_blocks(cut, places, samples, 10, 1).where("contig IS NOT NULL")
    assert [(r.sample, r.start, r.end) for r in low.collect()] == [("S", 4, 10)]
    assert {r.sample for r in per_base_depth(cut, places, samples).collect()} == {"S"}
    assert [r.reason for r in target_rejects(targets).orderBy(F.desc("start")).collect()] == ["start >= end", "start >= end", "no coordinates"]


def test_pruning_of_many_targets(spark):
    start = F.col("id") * 40
    targets = spark.range(200).select(F.lit("c").alias("contig"), start.alias("start"), (start + 5).alias("end"))
    segments = spark.range(20_000).select(F.lit("S").alias("sample"), F.lit("c").alias("contig"), F.col("id").alias("start"), (F.col("id") + 3).alias("end"))
    few, many = target_places(targets, 16), target_places(targets, 16, limit=50)
    assert few.small and not many.small
    pruned = depth_blocks(segments, 16, targets=many)
    assert "LeftSemi" in pruned._jdf.queryExecution().optimizedPlan().toString() and pruned.agg(F.max("end")).first()[0] < 10_000
    samples = spark.createDataFrame([("S",)], "sample string")
    rows = lambda places: sorted(map(tuple, depth_histogram(depth_blocks(segments, 16, targets=places), places, samples).collect()))
    assert rows(few) == rows(many)
