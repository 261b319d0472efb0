"""Ordered status rules for targets and exons, and their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.params import ClassifyParams

# Statuses in order of severity, for the sample summary and for the report page.
SUMMARY_SEVERITY = {"PASS": 0, "LOW_COVERAGE": 1, "LOW_EXON": 2, "UNEVEN": 3, "DROP_OUT": 4}
PAGE_SEVERITY = {"PASS": 0, "LOW_EXON": 1, "UNEVEN": 2, "LOW_COVERAGE": 3, "DROP_OUT": 4}

# One-line description of each status.
STATUS_TEXT = {
    "PASS": "Coverage is adequate across the target region.",
    "LOW_COVERAGE": "Coverage is below the 20x threshold across a significant fraction of the target.",
    "DROP_OUT": "Complete loss of coverage detected in substantial portions of the target.",
    "UNEVEN": "High average coverage but highly variable distribution across the target.",
    "LOW_EXON": "One or more exons have critically low coverage.",
}


def pct_ge_20(df: DataFrame) -> Column:
    """Breadth at 20; 0 when 20 was not among the thresholds."""
    return F.col("pct_ge_20") if "pct_ge_20" in df.columns else F.lit(0.0)


def long_dropouts(low: DataFrame, keys: list[str], params: ClassifyParams) -> DataFrame:
    """Keys with a low block long enough and with mean depth below 0.5."""
    is_long = (F.col("length") >= params.dropout_zero_block_bp) & (F.col("depth_sum") * 2 < F.col("length"))
    return low.where(is_long).select(*keys).distinct().withColumn("has_dropout", F.lit(True))


def exon_is_low(df: DataFrame, params: ClassifyParams) -> Column:
    return (pct_ge_20(df) < params.exon_pct_ge_20) | (F.col("pct_zero") > params.exon_max_pct_zero)


def classify_exon(exons: DataFrame, params: ClassifyParams, column: str = "status") -> DataFrame:
    """Add OK or LOW_EXON."""
    return exons.withColumn(column, F.when(exon_is_low(exons, params), "LOW_EXON").otherwise("OK"))


def classify_target(targets: DataFrame, params: ClassifyParams, column: str = "coverage_status") -> DataFrame:
    """Add the status. ``has_dropout`` and ``has_low_exon`` are optional boolean columns; null counts as false."""

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False)) if name in targets.columns else F.lit(False)

    breadth = pct_ge_20(targets)
    mean = F.col("mean_depth")
    status = (
        F.when((F.col("pct_zero") > params.dropout_pct_zero) | flag("has_dropout"), "DROP_OUT")
        .when((mean > 20) & (F.try_divide("stdev_depth", "mean_depth") > params.uneven_cv), "UNEVEN")
        .when(flag("has_low_exon"), "LOW_EXON")
        .when(breadth < params.pass_pct_ge_20, "LOW_COVERAGE")
        .when(F.col("pct_zero") <= params.pass_max_pct_zero, "PASS")
        .otherwise("LOW_COVERAGE")
    )
    return targets.withColumn(column, status)


def severity(status: Column, order: dict[str, int]) -> Column:
    return F.coalesce(_lookup(status, order), F.lit(0))


def status_text(status: Column) -> Column:
    return F.coalesce(_lookup(status, STATUS_TEXT), F.lit(""))


def _lookup(status: Column, table: dict) -> Column:
    out = None
    for key, value in table.items():
        out = F.when(status == key, F.lit(value)) if out is None else out.when(status == key, F.lit(value))
    return out


def rationale(df: DataFrame, params: ClassifyParams, column: str = "coverage_status") -> Column:
    """Why a target has its status."""
    # The texts below are part of the output.
    status, zero, mean = F.col(column), F.col("pct_zero"), F.col("mean_depth")
    breadth = pct_ge_20(df)
    cv = F.when(mean > 0, F.col("stdev_depth") / mean).otherwise(F.lit(0.0))
    low = F.format_string(f"pct_ge_20 (%.2f%%) < {params.pass_pct_ge_20}%% → LOW_COVERAGE", breadth)
    return (
        F.when(
            status == "PASS",
            F.format_string(
                f"pct_ge_20 (%.2f%%) ≥ {params.pass_pct_ge_20}%% AND pct_zero (%.2f%%) ≤ "
                f"{params.pass_max_pct_zero}%% → PASS",
                breadth, zero,
            ),
        )
        .when(status == "LOW_COVERAGE", low)
        .when(
            (status == "DROP_OUT") & (zero > params.dropout_pct_zero),
            F.format_string(f"pct_zero (%.2f%%) > {params.dropout_pct_zero}%% → DROP_OUT", zero),
        )
        .when(
            status == "DROP_OUT",
            F.lit(f"Long zero-depth block detected (≥ {params.dropout_zero_block_bp} bp) → DROP_OUT"),
        )
        .when(
            status == "UNEVEN",
            F.format_string(
                f"mean_depth (%.2f) > 20 AND CV (%.2f) > {params.uneven_cv} → UNEVEN", mean, cv
            ),
        )
        .when(status == "LOW_EXON", F.lit("One or more exons below threshold → LOW_EXON"))
        .otherwise(status)
    )
