"""Each status rule, their order, and the summaries."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators.classify import classify_exon, classify_target, rationale
from plumbline.operators.summary import page_summary, sample_summary
from plumbline.params import ClassifyParams, CoverageParams
from plumbline.plans.report import coverage_report
from plumbline.operators.depth import bin_blocks

ROW = "mean_depth double, stdev_depth double, pct_zero double, pct_ge_20 double, has_dropout boolean, has_low_exon boolean"


def status(spark, mean=50.0, sd=5.0, zero=0.0, ge20=99.0, dropout=None, low_exon=None, **params):
    row = spark.createDataFrame([(mean, sd, zero, ge20, dropout, low_exon)], ROW)
    p = ClassifyParams(**params)
    out = classify_target(row, p)
    return out.select("coverage_status", rationale(out, p).alias("why")).first()


@pytest.mark.parametrize(
    "values, want",
    [
        ({}, "PASS"),
        ({"zero": 5.01}, "DROP_OUT"),
        ({"zero": 2.0, "dropout": True}, "DROP_OUT"),
        ({"sd": 60.0}, "UNEVEN"),
        ({"mean": 10.0, "sd": 20.0, "ge20": 50.0}, "LOW_COVERAGE"),
        ({"mean": 0.0, "sd": 0.0, "ge20": 0.0}, "LOW_COVERAGE"),
        ({"low_exon": True}, "LOW_EXON"),
        ({"low_exon": True, "sd": 60.0}, "UNEVEN"),
        ({"ge20": 94.99}, "LOW_COVERAGE"),
        ({"zero": 3.0}, "LOW_COVERAGE"),
        ({"zero": 3.0, "pass_max_pct_zero": 3.0}, "PASS"),
        ({"sd": 60.0, "uneven_cv": 1.2}, "PASS"),
    ],
)
def test_rules(spark, values, want):
    assert status(spark, **values).coverage_status == want


def test_rationale(spark):
    assert status(spark, sd=60.0).why == "mean_depth (50.00) > 20 AND CV (1.20) > 1.0 → UNEVEN"
    assert status(spark).why == "pct_ge_20 (99.00%) ≥ 95.0% AND pct_zero (0.00%) ≤ 1.0% → PASS"
    assert status(spark, low_exon=True).why == "One or more exons below threshold → LOW_EXON"


def test_exon(spark):
    rows = spark.createDataFrame([(90.0, 5.0), (89.9, 0.0), (95.0, 5.1)], "pct_ge_20 double, pct_zero double")
    assert [r.status for r in classify_exon(rows, ClassifyParams()).collect()] == ["OK", "LOW_EXON", "LOW_EXON"]


def test_without_threshold_20(spark):
    rows = spark.createDataFrame([(50.0, 1.0, 0.0)], "mean_depth double, stdev_depth double, pct_zero double")
    assert classify_target(rows, ClassifyParams()).first().coverage_status == "LOW_COVERAGE"


SUMMARY = "sample string, length_bp bigint, mean_depth double, pct_ge_20 double, coverage_status string"


def test_sample_summary(spark):
    rows = spark.createDataFrame([("S", 100, 100.0, 100.0, "PASS"), ("S", 300, 20.0, 50.0, "LOW_COVERAGE")], SUMMARY)
    row = sample_summary(rows, CoverageParams()).first()
    assert (row.n_targets, row.n_pass, row.pct_targets_pass) == (2, 1, 50.0)
    assert (row.mean_depth, row.pct_ge_20, row.worst_status) == (40.0, 62.5, "LOW_COVERAGE")
    assert "pct_ge_20" not in sample_summary(rows.drop("pct_ge_20"), CoverageParams(thresholds=(1, 5))).columns


def test_two_severity_orders(spark):
    rows = spark.createDataFrame([("S", 1, 1.0, 1.0, "LOW_COVERAGE"), ("S", 1, 1.0, 1.0, "UNEVEN")], SUMMARY)
    assert sample_summary(rows, CoverageParams()).first().worst_status == "UNEVEN"
    assert page_summary(rows, None, CoverageParams()).first().worst_status == "LOW_COVERAGE"


def test_long_dropout_block(spark):
    """A 600 bp hole is 2% of the target, and still a drop-out."""
    blocks = spark.createDataFrame(
        [("S", "c", 0, 20_000, 40), ("S", "c", 20_600, 30_000, 40)],
        "sample string, contig string, start bigint, end bigint, depth bigint",
    )
    targets = spark.createDataFrame(
        [(1, "t", "c", 0, 30_000), (2, "t", "c", 0, 30_000), (3, "u", "c", 0, 20_000)],
        "ordinal bigint, target_id string, contig string, start bigint, end bigint",
    )
    samples = spark.createDataFrame([("S",)], "sample string")
    params = CoverageParams(bin_size=1000)
    report = coverage_report(bin_blocks(blocks, 1000), targets, samples, params)
    rows = {r.ordinal: r for r in report.targets.collect()}
    assert [rows[i].coverage_status for i in (1, 2, 3)] == ["DROP_OUT", "DROP_OUT", "PASS"]
    assert rows[1].pct_zero == 2.0 and rows[1].lowcov_total_bp == 600
    assert report.low_blocks.where(F.col("ordinal") == 2).count() == 1
