"""Coverage reports for targets, genes with exons, and regions with their genes and exons."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.intervals import parse_region, region_name, split_symbols, strip, target_kind, translate_contig
from plumbline.operators.annotation import exon_lookup, gene_lookup, genes_without_exons, region_overlay, suggest_genes
from plumbline.operators.classify import classify_exon, classify_target
from plumbline.operators.depth import SampleSet, cigar_segments, depth_blocks, read_filter, sample_set
from plumbline.operators.histogram import INTERVAL_KEYS, depth_histogram, metrics, rollup_histogram
from plumbline.operators.joins import IntervalSet, keyed_join, target_places
from plumbline.operators.runs import low_blocks
from plumbline.params import ClassifyParams, CoverageParams
from plumbline.session import cut_lineage
from plumbline.sources.alignments import read_alignments

TARGET_COLUMNS = ["ordinal", "target_id", "contig", "start", "end"]
PLACE = ["contig", "t_start", "t_end"]


@dataclass(frozen=True)
class Measured:
    """Lazy results per sample and distinct interval."""

    histogram: DataFrame
    metrics: DataFrame
    low: DataFrame


class CoverageReport:
    """Result tables of one report. Each is planned when first asked for; a table the mode lacks is None."""

    TABLES = (
        "targets", "low_blocks", "histogram", "exons", "exon_low_blocks", "exon_histogram",
        "genes", "gene_low_blocks", "gene_histogram",
    )

    def __init__(self, params: CoverageParams, classify: ClassifyParams, **tables: DataFrame | Callable | None):
        self.params, self.classify, self._tables = params, classify, tables

    def __getattr__(self, name: str) -> DataFrame | None:
        if name not in CoverageReport.TABLES:
            raise AttributeError(name)
        table = self._tables.get(name)
        if callable(table):
            table = self._tables[name] = table()
        return table

    def replace(self, **tables: DataFrame | None) -> CoverageReport:
        """The same report with some tables given."""
        return CoverageReport(self.params, self.classify, **{**self._tables, **tables})


def samples_of(reads: DataFrame) -> DataFrame:
    """Sample names present in the reads; prefer a header or manifest table, which needs no scan."""
    return reads.select("sample").distinct()


def covered_segments(reads: DataFrame) -> DataFrame:
    """Countable reads as covered segments."""
    return cigar_segments(read_filter(reads)).select("sample", "contig", "start", "end")


def measure(blocks: DataFrame, targets: IntervalSet, samples: DataFrame | SampleSet, params: CoverageParams) -> Measured:
    """Histogram, metrics and low blocks of each distinct interval. ``blocks`` must be cut at the bin size."""
    samples = sample_set(samples)
    histogram = depth_histogram(blocks, targets, samples)
    low = low_blocks(blocks, targets, samples, params.low_threshold, params.low_min_len)
    return Measured(histogram, metrics(histogram, params), low)


def with_low_totals(
    rows: DataFrame, low: DataFrame, keys: tuple[str, ...], classify: ClassifyParams
) -> DataFrame:
    """Add low block totals and the long-dropout flag; both sides are grouped by ``keys`` already."""
    dropout = (F.col("length") >= classify.dropout_zero_block_bp) & (F.col("depth_sum") * 2 < F.col("length"))
    totals = low.groupBy(*keys).agg(
        F.count("*").alias("n_lowcov_blocks"),
        F.sum("length").alias("lowcov_total_bp"),
        F.max(dropout).alias("has_dropout"),
    )
    none = F.lit(0).cast("bigint")
    return rows.join(totals, list(keys), "left").withColumns(
        {
            "n_lowcov_blocks": F.coalesce("n_lowcov_blocks", none),
            "lowcov_total_bp": F.coalesce("lowcov_total_bp", none),
            "has_dropout": F.coalesce("has_dropout", F.lit(False)),
        }
    )


def attach(rows: DataFrame, targets: DataFrame, small: bool | None = None) -> DataFrame:
    """Give interval results back to the targets at that place, however many share it."""
    placed = targets.withColumnsRenamed({"start": "t_start", "end": "t_end"})
    return keyed_join(rows, placed, PLACE, small=small or None)


def _as_target(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({"t_start": "start", "t_end": "end"})


def target_metrics(
    segments: DataFrame, targets: DataFrame, samples: DataFrame, params: CoverageParams, limit: int | None = None
) -> DataFrame:
    """Metrics only, per sample and target."""
    places, samples = target_places(targets, params.bin_size, limit), sample_set(samples)
    blocks = depth_blocks(segments, params.bin_size, targets=places, samples=samples)
    return _as_target(attach(metrics(depth_histogram(blocks, places, samples), params), targets, places.small))


def coverage_report(
    blocks: DataFrame,
    targets: DataFrame,
    samples: DataFrame | SampleSet,
    params: CoverageParams | None = None,
    classify: ClassifyParams | None = None,
    exons: DataFrame | None = None,
    exon_only: bool = False,
    limit: int | None = None,
) -> CoverageReport:
    """Measure and classify targets.

    ``exons`` (``gene_ordinal`` = the target's ordinal, exon columns) makes exons count in the classification. With
    ``exon_only`` a gene's metrics come from its exons together, and only genes without exons are measured whole.
    All intervals, of targets and exons alike, go through one measurement.
    """
    params, classify = params or CoverageParams(), classify or ClassifyParams()
    if exons is None:
        places = target_places(targets, params.bin_size, limit)
        found = measure(blocks, places, samples, params)
        rows = with_low_totals(found.metrics, found.low, INTERVAL_KEYS, classify)
        return CoverageReport(
            params, classify,
            targets=lambda: _classified(attach(rows, targets, places.small), classify),
            low_blocks=lambda: attach_low(found.low, targets, places.small),
            histogram=lambda: attach_histogram(found.histogram, targets, places.small),
        )

    whole = targets
    if exon_only:
        whole = genes_without_exons(targets.withColumnRenamed("ordinal", "gene_ordinal"), exons).withColumnRenamed(
            "gene_ordinal", "ordinal"
        )
    spans = exons.select("contig", "start", "end")
    places = target_places(
        whole.select("contig", "start", "end").unionByName(spans), params.bin_size, limit,
        counted=targets.select("contig", "start", "end").unionByName(spans),
    )
    small = places.small
    found = measure(blocks, places, samples, params)
    rows = with_low_totals(found.metrics, found.low, INTERVAL_KEYS, classify)
    exon_rows = classify_exon(_as_target(attach(rows, exons, small)), classify).drop("has_dropout")
    rolled = rollup(found, exons, targets, params, classify, small) if exon_only else None

    def all_targets() -> DataFrame:
        low_exon = exon_rows.groupBy("sample", F.col("gene_ordinal").alias("ordinal")).agg(
            F.max(F.col("status") == "LOW_EXON").alias("has_low_exon")
        )
        gene_rows = _with_rolled(attach(rows, whole, small), rolled, "targets")
        return _classified(gene_rows.join(low_exon, ["sample", "ordinal"], "left"), classify)

    return CoverageReport(
        params, classify,
        targets=all_targets,
        low_blocks=lambda: _with_rolled(attach_low(found.low, whole, small), rolled, "low_blocks"),
        histogram=lambda: _with_rolled(attach_histogram(found.histogram, whole, small), rolled, "histogram"),
        exons=exon_rows,
        exon_low_blocks=lambda: _exon_parts(found.low, exons, small),
        exon_histogram=lambda: _exon_parts(found.histogram, exons, small),
    )


def _classified(rows: DataFrame, classify: ClassifyParams) -> DataFrame:
    return classify_target(_as_target(rows), classify).drop("has_dropout", "has_low_exon")


def _with_rolled(rows: DataFrame, rolled: CoverageReport | None, table: str) -> DataFrame:
    """Whole-gene rows and, in the exon-only mode, the rolled-up genes."""
    return rows if rolled is None else rows.unionByName(getattr(rolled, table).select(*rows.columns))


def attach_low(low: DataFrame, targets: DataFrame, small: bool | None = None) -> DataFrame:
    """Low blocks of the targets: ``sample, ordinal, target_id, contig, start, end, length, depth_sum``."""
    named = targets.select(
        "ordinal", "target_id", "contig", F.col("start").alias("t_start"), F.col("end").alias("t_end")
    )
    return keyed_join(low, named, PLACE, small=small or None).drop("t_start", "t_end")


def attach_histogram(histogram: DataFrame, targets: DataFrame, small: bool | None = None) -> DataFrame:
    """``sample, ordinal, depth, n`` of the targets."""
    placed = targets.select("ordinal", "contig", F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    return keyed_join(histogram, placed, PLACE, small=small or None).select("sample", "ordinal", "depth", "n")


def _exon_parts(rows: DataFrame, exons: DataFrame, small: bool | None) -> DataFrame:
    placed = exons.select(
        "gene_ordinal", "exon_id", "contig", F.col("start").alias("t_start"), F.col("end").alias("t_end")
    )
    return keyed_join(rows, placed, PLACE, small=small or None)


def rollup(
    found: Measured,
    exons: DataFrame,
    targets: DataFrame,
    params: CoverageParams,
    classify: ClassifyParams,
    small: bool | None = None,
) -> CoverageReport:
    """Gene rows (not yet classified), low blocks and histograms from their exons; start and end stay the gene's."""
    members = exons.select(
        "gene_ordinal", "contig", F.col("start").alias("t_start"), F.col("end").alias("t_end")
    ).withColumnRenamed("gene_ordinal", "ordinal")
    keys = ("sample", "ordinal")
    merged = rollup_histogram(found.histogram, members, "ordinal", small)
    low = keyed_join(found.low, members, PLACE, small=small or None).drop("t_start", "t_end")
    places = targets.withColumnsRenamed({"start": "t_start", "end": "t_end"})
    return CoverageReport(
        params, classify,
        targets=lambda: keyed_join(
            with_low_totals(metrics(merged, params, keys), low, keys, classify), places, ["ordinal"], small=small
        ),
        low_blocks=lambda: keyed_join(low, targets.select("ordinal", "target_id"), ["ordinal"], small=small),
        histogram=merged,
    )


def resolve_targets(
    asked: DataFrame,
    genes: DataFrame,
    aliases: DataFrame,
    order: str = "line_no",
    builtins: DataFrame | None = None,
    contig_style: str | None = None,
    suggestions: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Resolve ``ordinal, target`` strings: regions, or comma-separated gene symbols.

    Returns the targets (``ordinal, target_id, contig, start, end``, one per region or symbol, ``ordinal`` holding the
    asked ordinal and the place in its list, and the gene columns, null for regions) and the failures (``ordinal, target,
    error``). ``builtins`` are genes to fall back on, ``contig_style`` the style to rename contigs to, and with
    ``suggestions`` the error of an unknown gene names up to so many close ones.
    """
    kinds = asked.withColumn("kind", target_kind(F.col("target")))
    regions = parse_region(kinds.where(F.col("kind") == "region"), "target")
    symbols = kinds.where(F.col("kind") == "genes").select(
        "ordinal", "target", F.posexplode(split_symbols(F.col("target"))).alias("part", "symbol")
    )
    keyed = symbols.select(F.struct("ordinal", "part").alias("ordinal"), "symbol")
    found = gene_lookup(keyed, genes, aliases, order, builtins)
    gene_columns = ["gene_name", "gene_id", "strand", "gene_type"]
    targets = regions.where(F.col("error").isNull()).select(
        F.struct("ordinal", F.lit(0).alias("part")).alias("ordinal"),
        region_name(F.col("contig"), F.col("start"), F.col("end")).alias("target_id"), "contig", "start", "end",
        *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in gene_columns],
    ).unionByName(
        found.where(F.col("gene_name").isNotNull()).select(
            "ordinal", F.col("gene_name").alias("target_id"), "contig", "start", "end", *gene_columns
        )
    )
    if contig_style is not None:
        targets = targets.withColumn("contig", translate_contig(F.col("contig"), contig_style))
    unknown = found.where(F.col("gene_name").isNull()).select(F.col("ordinal.ordinal").alias("ordinal"), F.col("symbol").alias("target"))
    why = F.lit("unknown gene")
    if suggestions:
        names = genes.select("gene_name") if builtins is None else genes.select("gene_name").unionByName(builtins.select("gene_name"))
        close = suggest_genes(unknown.select(F.col("target").alias("symbol")), names, aliases, suggestions)
        listed = close.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("rank", "suggestion"))).alias("close"))
        unknown = unknown.withColumn("symbol", F.upper(strip(F.col("target"))))
        unknown = keyed_join(unknown, listed, ["symbol"], "left")
        why = F.when(F.col("close").isNull(), why).otherwise(F.concat(why, F.lit("; close: "), F.array_join("close.suggestion", ", ")))
    failures = (
        kinds.where(F.col("kind") == "malformed").select("ordinal", "target", F.lit("malformed region").alias("error"))
        .unionByName(regions.where(F.col("error").isNotNull()).select(
            "ordinal", "target", F.concat(F.lit("invalid region: "), "error").alias("error")))
        .unionByName(unknown.select("ordinal", "target", why.alias("error")))
    )
    return targets, failures


def target_blocks(
    spark: SparkSession,
    reads_path: str,
    targets: DataFrame,
    params: CoverageParams | None = None,
    samples: DataFrame | SampleSet | None = None,
) -> DataFrame:
    """Depth blocks of the reads at ``reads_path`` that overlap a target (``contig, start, end``), of ``samples`` only.

    In a read store the scan skips what no target reaches. The blocks are right wherever a target lies, and only there.
    """
    bin_size = (params or CoverageParams()).bin_size
    places = target_places(targets, bin_size)
    segments = covered_segments(read_alignments(spark, reads_path, places))
    return depth_blocks(segments, bin_size, targets=places, samples=samples)


def asked_report(
    spark: SparkSession,
    reads_path: str,
    asked: DataFrame,
    genes: DataFrame,
    aliases: DataFrame,
    samples: DataFrame,
    order: str = "line_no",
    builtins: DataFrame | None = None,
    contig_style: str = "chr",
    params: CoverageParams | None = None,
    classify: ClassifyParams | None = None,
) -> tuple[CoverageReport, DataFrame]:
    """From asked targets (``ordinal, target``) and a read store to the report, and the targets that failed with reasons."""
    targets, failures = resolve_targets(asked, genes, aliases, order, builtins, contig_style, suggestions=5)
    targets, samples = cut_lineage(targets), sample_set(samples)
    blocks = target_blocks(spark, reads_path, targets, params, samples)
    return coverage_report(blocks, targets.select(*TARGET_COLUMNS), samples, params, classify), failures


def gene_report(
    blocks: DataFrame,
    genes: DataFrame,
    samples: DataFrame,
    exon_table: DataFrame | None = None,
    exons: bool = False,
    exon_only: bool = False,
    contig_style: str = "chr",
    params: CoverageParams | None = None,
    classify: ClassifyParams | None = None,
) -> CoverageReport:
    """Report on resolved genes (``ordinal`` and gene columns).

    ``exons`` shows exons, ``exon_only`` measures genes by their exons; either makes exons count in the status.
    """
    renamed = genes.withColumn("contig", translate_contig(F.col("contig"), contig_style))
    targets = renamed.select("ordinal", F.col("gene_name").alias("target_id"), "contig", "start", "end")
    if exon_table is None or not (exons or exon_only):
        return coverage_report(blocks, targets, samples, params, classify)
    found = exon_lookup(genes.withColumnRenamed("ordinal", "gene_ordinal"), exon_table).withColumns(
        {"gene_name": F.col("gene"), "contig": translate_contig(F.col("contig"), contig_style)}
    ).drop("gene")
    report = coverage_report(blocks, targets, samples, params, classify, found, exon_only)
    return report if exons else report.replace(exons=None, exon_low_blocks=None, exon_histogram=None)


def region_report(
    blocks: DataFrame,
    regions: DataFrame,
    samples: DataFrame,
    genes: DataFrame,
    builtins: DataFrame | None,
    exon_table: DataFrame,
    exons: bool = False,
    contig_style: str = "chr",
    params: CoverageParams | None = None,
    classify: ClassifyParams | None = None,
    order: str = "line_no",
) -> CoverageReport:
    """Report on regions (``ordinal, contig, start, end``), the genes in them and those genes' exons, clipped.

    Exons always count in the status of the genes, never in that of the region; they are shown only with ``exons``.
    """
    params, classify = params or CoverageParams(), classify or ClassifyParams()
    index = regions.withColumn("contig", translate_contig(F.col("contig"), "chr"))
    # the overlay feeds the count, the places and every table, so it is computed once
    found_genes, found_exons = map(
        cut_lineage, region_overlay(index, genes, builtins, exon_table, order, params.bin_size)
    )
    styled = lambda df: df.withColumn("contig", translate_contig(F.col("contig"), contig_style))
    gene_key = lambda name: F.struct("region_ordinal", F.col(name).alias("gene_name"))
    gene_targets = styled(found_genes).select(
        gene_key("gene_name").alias("ordinal"), F.col("gene_name").alias("target_id"), "contig", "start", "end", "strand", "gene_type"
    )
    exon_targets = styled(found_exons).withColumns(
        {"gene_ordinal": gene_key("region_gene"), "gene_name": F.col("region_gene")}
    ).drop("region_ordinal", "region_gene")
    named = regions.withColumn("target_id", region_name(F.col("contig"), F.col("start"), F.col("end")))
    region_targets = styled(named).select("ordinal", "target_id", "contig", "start", "end")
    places = target_places(
        region_targets.select("contig", "start", "end")
        .unionByName(gene_targets.select("contig", "start", "end"))
        .unionByName(exon_targets.select("contig", "start", "end")),
        params.bin_size,
    )
    small = places.small
    found = measure(blocks, places, samples, params)
    rows = with_low_totals(found.metrics, found.low, INTERVAL_KEYS, classify)
    exon_rows = classify_exon(_as_target(attach(rows, exon_targets, small)), classify).drop("has_dropout")

    def all_genes() -> DataFrame:
        low_exon = exon_rows.groupBy("sample", F.col("gene_ordinal").alias("ordinal")).agg(
            F.max(F.col("status") == "LOW_EXON").alias("has_low_exon")
        )
        return _classified(attach(rows, gene_targets, small).join(low_exon, ["sample", "ordinal"], "left"), classify)

    shown = {
        "exons": exon_rows,
        "exon_low_blocks": lambda: _exon_parts(found.low, exon_targets, small),
        "exon_histogram": lambda: _exon_parts(found.histogram, exon_targets, small),
    }
    return CoverageReport(
        params, classify,
        targets=lambda: _classified(attach(rows, region_targets, small), classify),
        low_blocks=lambda: attach_low(found.low, region_targets, small),
        histogram=lambda: attach_histogram(found.histogram, region_targets, small),
        genes=all_genes,
        gene_low_blocks=lambda: attach_low(found.low, gene_targets, small),
        gene_histogram=lambda: attach_histogram(found.histogram, gene_targets, small),
        **(shown if exons else {}),
    )
