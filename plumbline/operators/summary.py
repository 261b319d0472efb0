"""Report tables: counts by status, per-sample summaries and the displayed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.intervals import format_region
from plumbline.functions.numeric import ratio_round
from plumbline.operators.classify import (
    PAGE_SEVERITY, SUMMARY_SEVERITY, classify_exon, pct_ge_20, rationale, severity, status_text,
)
from plumbline.operators.order import numbered
from plumbline.params import ClassifyParams, CoverageParams


def status_counts(report: DataFrame) -> DataFrame:
    """Targets per sample and status."""
    return report.groupBy("sample", "coverage_status").agg(F.count("*").alias("n"))


def _hundredths(value: Column) -> Column:
    """A two-decimal metric as an exact integer, for order-free weighted sums."""
    return F.round(value * 100).cast("bigint")


def _weighted(total: str, weight: str) -> Column:
    """Length-weighted mean of hundredths, rounded half up to two decimals."""
    return F.expr(
        f"CASE WHEN {weight} > 0 THEN CAST(({total} * 2 + {weight}) div (2L * {weight}) AS DOUBLE) / 100D ELSE 0D END"
    )


def _worst(order: dict[str, int]) -> Column:
    # the status itself breaks ties only between unknown names
    return F.max(F.struct(severity(F.col("coverage_status"), order).alias("rank"), F.col("coverage_status")))


def sample_summary(report: DataFrame, params: CoverageParams, order: dict[str, int] | None = None) -> DataFrame:
    """One row per sample: target counts, length-weighted depth and breadth, and the worst status.

    ``pct_ge_20`` is left out when 20 is not among the thresholds.
    """
    has_20 = 20 in params.thresholds
    length = F.col("length_bp")
    wanted = [
        F.count("*").alias("n_targets"),
        F.count(F.when(F.col("coverage_status") == "PASS", 1)).alias("n_pass"),
        F.sum("length_bp").alias("_bp"),
        F.sum(_hundredths(F.col("mean_depth")) * length).alias("_depth"),
        F.sum(_hundredths(pct_ge_20(report)) * length).alias("_breadth"),
        _worst(order or SUMMARY_SEVERITY).alias("_worst"),
    ]
    sums = report.groupBy("sample").agg(*wanted)
    return sums.select(
        "sample",
        "n_targets",
        "n_pass",
        ratio_round("n_pass", "n_targets", 2, scale=100).alias("pct_targets_pass"),
        _weighted("_depth", "_bp").alias("mean_depth"),
        *([_weighted("_breadth", "_bp").alias("pct_ge_20")] if has_20 else []),
        F.col("_worst.coverage_status").alias("worst_status"),
    )


def page_summary(report: DataFrame, exons: DataFrame | None, params: CoverageParams) -> DataFrame:
    """The numbers of the summary cards: the page's severity order and the count of low exons."""
    cards = sample_summary(report, params, PAGE_SEVERITY).select(
        "sample",
        "n_targets",
        "n_pass",
        F.col("pct_targets_pass").alias("pass_rate"),
        F.col("mean_depth").alias("overall_mean_depth"),
        (F.col("pct_ge_20") if 20 in params.thresholds else F.lit(0.0)).alias("overall_pct_ge_20"),
        "worst_status",
    )
    if exons is None:
        return cards.withColumn("n_low_exons", F.lit(0).cast("bigint"))
    low = exons.groupBy("sample").agg(F.count(F.when(F.col("status") == "LOW_EXON", 1)).alias("n_low_exons"))
    return cards.join(low, "sample", "left").withColumn("n_low_exons", F.coalesce("n_low_exons", F.lit(0)))


def exon_bars(exons: DataFrame) -> DataFrame:
    """Bar chart rows, by gene and exon number."""
    return exons.select(
        "sample", F.col("gene_name").alias("gene"), F.col("exon_number").alias("exon"), "exon_id",
        pct_ge_20(exons).alias("pct20"), F.col("mean_depth").alias("mean"), "status",
    )


def ordered_exons(exons: DataFrame) -> DataFrame:
    return exons.orderBy("sample", "gene_name", "exon_number")


def target_table(report: DataFrame, params: ClassifyParams | None = None) -> DataFrame:
    """Displayed target rows, with the status description and rationale when ``params`` is given."""
    base = report.select(
        "sample", "ordinal", "target_id",
        format_region(F.col("contig"), F.col("start"), F.col("end")).alias("region"),
        "length_bp", "mean_depth", "median_depth", pct_ge_20(report).alias("pct_ge_20"), "pct_zero",
        "coverage_status",
        *([rationale(report, params).alias("rationale"), status_text(F.col("coverage_status")).alias("description")]
          if params else []),
    )
    return base


def gene_table(genes: DataFrame) -> DataFrame:
    """Displayed genes of a region."""
    return genes.select(
        "sample", "ordinal", F.col("target_id").alias("gene"), "gene_type", "strand",
        format_region(F.col("contig"), F.col("start"), F.col("end")).alias("region"),
        "length_bp", "mean_depth", "median_depth", pct_ge_20(genes).alias("pct_ge_20"), "pct_zero",
        "coverage_status",
    )


def exon_table(exons: DataFrame) -> DataFrame:
    """Displayed exon rows."""
    return exons.select(
        "sample", "gene_name", "exon_number", "exon_id",
        format_region(F.col("contig"), F.col("start"), F.col("end")).alias("region"),
        "length_bp", "mean_depth", pct_ge_20(exons).alias("pct_ge_20"), "pct_zero", "status",
    )


def low_block_table(low: DataFrame) -> DataFrame:
    """Displayed low blocks; mean depth to one decimal."""
    return low.select(
        "sample", "ordinal", "target_id",
        format_region(F.col("contig"), F.col("start"), F.col("end")).alias("region"),
        "length", ratio_round("depth_sum", "length", 1).alias("mean_depth"),
    )


def input_order(report: DataFrame) -> DataFrame:
    """Rows by sample in the order the targets were given, with their ``position`` from 1."""
    return numbered(report, ["sample", "ordinal"])


__all__ = [
    "classify_exon", "exon_bars", "exon_table", "gene_table", "input_order", "low_block_table", "ordered_exons",
    "page_summary", "sample_summary", "status_counts", "target_table",
]
