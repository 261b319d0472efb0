"""Report rows in their output layouts, and the writers for them.

Each layout is a plain DataFrame function; the writers add only format and path. A writer makes a folder of part files.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.intervals import bin_of
from plumbline.functions.numeric import ratio_round
from plumbline.operators.classify import pct_ge_20
from plumbline.operators.joins import keyed_join
from plumbline.operators.summary import sample_summary
from plumbline.params import CoverageParams
from plumbline.plans.report import CoverageReport
from plumbline.session import cut_lineage

# Column order of the target table.
TSV_HEAD = [
    "target_id", "contig", "start", "end", "length_bp", "mean_depth", "median_depth", "min_depth", "max_depth",
    "stdev_depth", "pct_zero",
]
TSV_TAIL = ["coverage_status", "n_lowcov_blocks", "lowcov_total_bp"]
# A piece of a JSON document holds the low blocks of so many positions, or the bars of so many depths.
PIECE_SPAN, PIECE_DEPTHS = 1 << 14, 1 << 12
# Output formats and the endings of their paths.
FORMATS = {"json": ".json", "tsv": ".tsv", "multiqc": "_mqc.json"}


def tsv_rows(report: DataFrame, params: CoverageParams) -> DataFrame:
    """One row per sample and target, thresholds ascending."""
    breadth = [f"pct_ge_{t}" for t in sorted(params.thresholds)]
    return report.select(F.col("sample").alias("sample_name"), *TSV_HEAD, *breadth, *TSV_TAIL)


def exon_rows(exons: DataFrame) -> DataFrame:
    """The twelve exon columns, after the sample."""
    breadth_30 = F.col("pct_ge_30") if "pct_ge_30" in exons.columns else F.lit(0.0)
    return exons.select(
        F.col("sample").alias("sample_name"), F.col("gene_name").alias("target_id"), "exon_id", "exon_number",
        "contig", "start", "end", "length_bp", "mean_depth", "median_depth", "pct_zero",
        pct_ge_20(exons).alias("pct_ge_20"), breadth_30.alias("pct_ge_30"),
    )


def low_bed_rows(low: DataFrame) -> DataFrame:
    """BED rows of low blocks: place, target and mean depth."""
    mean = F.format_string("%.1f", ratio_round("depth_sum", "length", 1))
    return low.select(
        F.col("sample").alias("sample_name"), "contig", "start", "end", "target_id",
        F.concat(F.lit("mean_depth="), mean).alias("mean_depth"),
    )


def _low_array(low: DataFrame, keys: list[str]) -> DataFrame:
    item = F.struct(
        "contig", "start", "end", "length",
        ratio_round("depth_sum", "length", 2).alias("mean_depth"),
    )
    return low.groupBy(*keys).agg(
        F.array_sort(F.collect_list(item), lambda a, b: F.when(a["start"] < b["start"], -1).when(
            a["start"] > b["start"], 1).otherwise(F.when(a["end"] < b["end"], -1).otherwise(1))).alias("lowcov_blocks")
    )


def _histogram_map(histogram: DataFrame, keys: list[str]) -> DataFrame:
    bars = F.array_sort(F.collect_list(F.struct("depth", "n")))
    named = F.transform(bars, lambda b: F.struct(b["depth"].cast("string"), b["n"]))
    return histogram.groupBy(*keys).agg(F.map_from_entries(named).alias("histogram"))


def _head(rows: DataFrame, params: CoverageParams, status: str | None) -> list:
    steps = sorted(params.thresholds)
    pairs = [x for t in steps for x in (F.lit(str(t)), F.col(f"pct_ge_{t}"))]
    breadth = F.create_map(*pairs) if pairs else F.from_json(F.lit("{}"), "map<string,double>")
    return [
        *TSV_HEAD, breadth.alias("pct_thresholds"), (F.col(status) if status else F.lit("")).alias("coverage_status"),
        "n_lowcov_blocks", "lowcov_total_bp",
    ]


def _document(rows: DataFrame, params: CoverageParams, status: str | None) -> Column:
    extra = [F.col(c) for c in ("exon_number", "status") if c in rows.columns] + (
        [F.col("exons")] if "exons" in rows.columns else []
    )
    return F.struct(
        *_head(rows, params, status),
        F.coalesce("lowcov_blocks", F.array().cast(
            "array<struct<contig:string,start:bigint,end:bigint,length:bigint,mean_depth:double>>"
        )).alias("lowcov_blocks"),
        "histogram", *extra,
    )


def _inside(json: Column) -> Column:
    """JSON text without its outer brackets."""
    return F.substr(json, F.lit(2), F.char_length(json) - 2)


def _listed(rows: DataFrame, keys: list[str], section: int) -> DataFrame:
    """Pieces ``keys, section, piece, text``, each behind a comma but the first of its document."""
    along = Window.partitionBy(*keys).orderBy("piece")
    lead = F.when(F.lag("piece").over(along).isNull(), "").otherwise(",")
    return rows.select(*keys, F.lit(section).alias("section"), "piece", F.concat(lead, "text").alias("text"))


def document_pieces(
    rows: DataFrame, low: DataFrame, histogram: DataFrame, params: CoverageParams, exons: DataFrame | None = None
) -> DataFrame:
    """``sample, ordinal, section, piece, text``: target documents as ordered pieces, none of which grows with the target.

    Put together by section and piece, the texts of a target are the document of ``target_documents`` and a line end. Low
    blocks go by place and bars by depth into pieces of bounded size. ``exons`` (``sample, gene_ordinal, start, exon_id,
    document``) are one piece each.
    """
    keys = ["sample", "ordinal"]
    text = lambda t: F.lit(t).alias("text")
    fixed = lambda section, t: rows.select(*keys, F.lit(section).alias("section"), F.lit(0).cast("bigint").alias("piece"), text(t))
    head = F.to_json(F.struct(*_head(rows, params, "coverage_status")))
    opened = rows.select(
        *keys, F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("piece"),
        F.concat(F.substr(head, F.lit(1), F.char_length(head) - 1), F.lit(',"lowcov_blocks":[')).alias("text"),
    )
    blocks = _low_array(low.withColumn("piece", F.expr(bin_of("start", PIECE_SPAN))), [*keys, "piece"])
    bars = _histogram_map(histogram.withColumn("piece", F.expr(bin_of("depth", PIECE_DEPTHS))), [*keys, "piece"])
    pieces = [
        opened,
        _listed(blocks.select(*keys, "piece", _inside(F.to_json("lowcov_blocks")).alias("text")), keys, 1),
        fixed(2, '],"histogram":{'),
        _listed(bars.select(*keys, "piece", _inside(F.to_json("histogram")).alias("text")), keys, 3),
        fixed(4, "}" if exons is None else '},"exons":['),
        fixed(6, "}\n" if exons is None else "]}\n"),
    ]
    if exons is not None:
        along = Window.partitionBy("sample", "gene_ordinal").orderBy("start", "exon_id")
        placed = exons.select(
            "sample", F.col("gene_ordinal").alias("ordinal"), F.row_number().over(along).cast("bigint").alias("piece"),
            F.to_json("document").alias("text"),
        )
        asked = keyed_join(placed, rows.select(*keys), keys, "left_semi")
        pieces.append(_listed(asked, keys, 5))
    whole = pieces[0]
    for part in pieces[1:]:
        whole = whole.unionByName(part)
    return whole


def _write_pieces(pieces: DataFrame, path: str) -> None:
    """Text with one document on each line. Pieces of a document are parted by a blank, which JSON allows there.

    A file ends with a line of one blank, since the text format ends each row alike.
    """
    placed = pieces.repartitionByRange("sample", "ordinal").sortWithinPartitions("sample", "ordinal", "section", "piece")
    placed.select("text").write.mode("overwrite").option("lineSep", " ").text(path)


def target_documents(
    rows: DataFrame, low: DataFrame, histogram: DataFrame, params: CoverageParams, exons: DataFrame | None = None
) -> DataFrame:
    """``sample, ordinal, document``: one nested JSON object per sample and target."""
    keys = ["sample", "ordinal"]
    joined = rows.join(_low_array(low, keys), keys, "left").join(_histogram_map(histogram, keys), keys, "left")
    if exons is not None:
        joined = joined.join(exons.withColumnRenamed("gene_ordinal", "ordinal"), keys, "left")
    return joined.select(*keys, F.to_json(_document(joined, params, "coverage_status")).alias("document"))


def exon_documents(report: CoverageReport) -> DataFrame:
    """``sample, gene_ordinal, start, exon_id, document``: one nested object per exon."""
    place = ["sample", "gene_ordinal", "exon_id", "contig", "t_start", "t_end"]
    rows = report.exons.withColumns({"t_start": F.col("start"), "t_end": F.col("end"), "target_id": F.col("exon_id")})
    low = _low_array(report.exon_low_blocks, place)
    bars = _histogram_map(report.exon_histogram, place)
    joined = rows.join(low, place, "left").join(bars, place, "left")
    return joined.select("sample", "gene_ordinal", "start", "exon_id", _document(joined, report.params, None).alias("document"))


def exon_arrays(report: CoverageReport) -> DataFrame:
    """``sample, gene_ordinal, exons``: the nested exon objects of each gene, by start."""
    item = F.struct("start", "exon_id", "document")
    placed = exon_documents(report).groupBy("sample", "gene_ordinal").agg(F.collect_list(item).alias("items"))
    in_order = F.array_sort("items", lambda a, b: F.when(
        (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["exon_id"] < b["exon_id"])), -1).otherwise(1))
    return placed.select("sample", "gene_ordinal", F.transform(in_order, lambda i: i["document"]).alias("exons"))


def report_documents(report: CoverageReport) -> DataFrame:
    """Target documents, with their exons where the report shows them."""
    exons = exon_arrays(report) if report.exons is not None else None
    return target_documents(report.targets, report.low_blocks, report.histogram, report.params, exons)


def gene_documents(report: CoverageReport) -> DataFrame:
    """Documents of the genes found in a region report."""
    return target_documents(report.genes, report.gene_low_blocks, report.gene_histogram, report.params)


def run_documents(report: CoverageReport, **run: str | int | bool) -> DataFrame:
    """``sample, document``: run settings and the status summary of each sample."""
    counts = report.targets.groupBy("sample", "coverage_status").agg(F.count("*").alias("n"))
    summed = counts.groupBy("sample").agg(
        F.sum("n").alias("n_targets"),
        F.sum(F.when(F.col("coverage_status") == "PASS", F.col("n")).otherwise(0)).alias("n_pass"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("coverage_status", "n")))).alias("status_counts"),
    )
    settings = F.struct(
        F.col("sample").alias("sample_name"),
        *[F.lit(v).alias(k) for k, v in run.items()],
        F.array(*[F.lit(t) for t in report.params.thresholds]).alias("thresholds"),
        F.struct(*[F.lit(v).alias(k) for k, v in asdict(report.classify).items()]).alias("classify_params"),
    )
    body = F.struct(
        F.lit("1.0").alias("schema_version"), settings.alias("run"),
        F.struct("n_targets", "n_pass", "status_counts").alias("summary"),
    )
    return summed.select("sample", F.to_json(body).alias("document"))


def multiqc_document(targets: DataFrame, params: CoverageParams, section: str = "Coverage QC") -> DataFrame:
    """One JSON document with a summary row per sample, in the custom-content layout."""
    rows = sample_summary(targets, params)
    values = F.struct(*[c for c in rows.columns if c != "sample"])
    data = F.map_from_entries(F.array_sort(F.collect_list(F.struct("sample", values.alias("row")))))
    body = F.struct(
        F.lit("plumbline").alias("id"),
        F.lit(section).alias("section_name"),
        F.lit("Per-sample targeted-sequencing coverage QC summary.").alias("description"),
        F.lit("table").alias("plot_type"),
        F.struct(
            F.lit("plumbline_table").alias("id"), F.lit(section).alias("title"), F.lit("plumbline").alias("namespace")
        ).alias("pconfig"),
        F.col("data"),
    )
    return rows.agg(data.alias("data")).select(F.to_json(body).alias("document"))


def parse_formats(spec: str) -> list[str]:
    """Comma-separated formats, in order and once each."""
    asked = [part.strip().lower() for part in spec.split(",") if part.strip()]
    for name in asked:
        if name not in FORMATS:
            raise ValueError(f"invalid output format {name!r}; valid formats: {', '.join(FORMATS)}")
    if not asked:
        raise ValueError(f"no output format given; valid formats: {', '.join(FORMATS)}")
    return list(dict.fromkeys(asked))


def _write_tsv(rows: DataFrame, path: str, header: bool = True) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", header=header, quote="", escapeQuotes=False, emptyValue="")


def write_reports(report: CoverageReport, stem: str, formats: str = "tsv", **run: str | int | bool) -> dict[str, str]:
    """Write a report in the asked formats under ``stem`` and return the paths.

    The TSV keeps the order in which the targets were given. The target table is checkpointed first; histograms and low
    blocks, which the JSON form needs as well, are measured when it is asked for.
    """
    wanted = parse_formats(formats)
    targets = cut_lineage(report.targets)
    paths = {name: stem + FORMATS[name] for name in wanted}
    if "tsv" in paths:
        _write_tsv(tsv_rows(targets.orderBy("sample", "ordinal"), report.params), paths["tsv"])
    if "multiqc" in paths:
        multiqc_document(targets, report.params).write.mode("overwrite").text(paths["multiqc"])
    if "json" in paths:
        kept = report.replace(targets=targets)
        # exons of a region's genes are no part of the region's document
        exons = exon_documents(kept) if kept.exons is not None and kept.genes is None else None
        _write_pieces(document_pieces(targets, kept.low_blocks, kept.histogram, kept.params, exons), paths["json"] + "/targets")
        run_documents(kept, **run).select("document").write.mode("overwrite").text(paths["json"] + "/run")
        if report.genes is not None:
            _write_pieces(document_pieces(kept.genes, kept.gene_low_blocks, kept.gene_histogram, kept.params), paths["json"] + "/genes")
    return paths


def _sample_last(rows: DataFrame, *order: str) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c != "sample_name"], "sample_name").orderBy("sample_name", *order)


def write_low_bed(report: CoverageReport, path: str) -> None:
    """Write the low blocks as BED rows by sample; the sample is a further last column."""
    _write_tsv(_sample_last(low_bed_rows(report.low_blocks), "contig", "start"), path, header=False)


def write_exon_tsv(report: CoverageReport, path: str) -> None:
    """Write the exon table by sample; the sample is a further last column."""
    _write_tsv(_sample_last(exon_rows(report.exons), "target_id", "exon_number"), path)
