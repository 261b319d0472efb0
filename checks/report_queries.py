"""Classification, exon modes, summaries, report layouts and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import views
from checks.annotation_queries import _IN_REGION, _REGIONS, _regions
from checks.registry import DEPTH, EXON_TABLE, PLACED, TARGETS, low_runs, metric_columns, query, ratio
from plumbline.operators.classify import STATUS_TEXT, PAGE_SEVERITY, SUMMARY_SEVERITY, rationale, status_text
from plumbline.operators.depth import bin_blocks, depth_blocks
from plumbline.operators.joins import target_places
from plumbline.operators.summary import (
    exon_bars, exon_table, gene_table, input_order, low_block_table, ordered_exons, page_summary, sample_summary,
    status_counts, target_table,
)
from plumbline.params import ClassifyParams, CoverageParams
from plumbline.plans.report import coverage_report, gene_report, region_report
from plumbline.session import checkpoint_dir
from plumbline.sinks.reports import (
    exon_rows, low_bed_rows, multiqc_document, report_documents, run_documents, tsv_rows,
)
from plumbline.streaming.coverage import read_histogram, stream_deltas, stream_histogram, streamed_blocks

BIN = views.BIN
STEPS = (1, 5, 10, 20, 30)
PARAMS = CoverageParams(thresholds=STEPS, low_threshold=10, low_min_len=15, bin_size=BIN)
DEFAULTS = ClassifyParams()
# cut-offs at which every status occurs on this data
CUSTOM = ClassifyParams(
    pass_pct_ge_20=60.0, pass_max_pct_zero=2.0, dropout_pct_zero=10.0, dropout_zero_block_bp=16, uneven_cv=0.25,
    exon_pct_ge_20=5.0, exon_max_pct_zero=8.0,
)

_POOL = "CASE WHEN {} % 7 = 0 THEN 'thin' ELSE 'deep' END"
_SEG = PLACED + f", seg AS (SELECT {_POOL.format('ln')} AS sample, contig, s, s + q AS e FROM placed)"
_HEAD = f"{_SEG}, {DEPTH}, samples AS (SELECT DISTINCT {_POOL.format('l_linenumber')} AS sample FROM lineitem)"


def _days(name: str, source: str, key: str = "k") -> str:
    return f"""{name} AS (
  SELECT x.sample, x.{key}, x.p, coalesce(d.d, 0) AS d
  FROM (SELECT sample, {key}, contig, unnest(range(s, e)) AS p FROM {source}, samples) x
  LEFT JOIN depth d ON d.sample = x.sample AND d.contig = x.contig AND d.p = x.p)"""


def _status(p: ClassifyParams, low_exon: str = "false") -> str:
    return f"""CASE WHEN pct_zero > {p.dropout_pct_zero} OR has_dropout THEN 'DROP_OUT'
      WHEN mean_depth > 20 AND stdev_depth / mean_depth > {p.uneven_cv} THEN 'UNEVEN'
      WHEN {low_exon} THEN 'LOW_EXON'
      WHEN pct_ge_20 < {p.pass_pct_ge_20} THEN 'LOW_COVERAGE'
      WHEN pct_zero <= {p.pass_max_pct_zero} THEN 'PASS' ELSE 'LOW_COVERAGE' END"""


def _rows(days: str, low: str, name: str, key: str, p: ClassifyParams) -> str:
    """Metrics with low totals from a per-day table and a low-run table."""
    return f"""{name} AS (
  SELECT m.*, coalesce(n, 0) AS n_lowcov_blocks, CAST(coalesce(bp, 0) AS BIGINT) AS lowcov_total_bp,
         coalesce(dropped, false) AS has_dropout
  FROM (SELECT sample, {key}, {metric_columns(STEPS)} FROM {days} GROUP BY ALL) m
  LEFT JOIN (SELECT sample AS ls, {key} AS lk, count(*) AS n, sum(len) AS bp,
               bool_or(len >= {p.dropout_zero_block_bp} AND 2 * depth_sum < len) AS dropped
             FROM {low} GROUP BY ALL) l ON l.ls = m.sample AND l.lk = m.{key})"""


_EXON_LOW = lambda p: f"(pct_ge_20 < {p.exon_pct_ge_20} OR pct_zero > {p.exon_max_pct_zero})"


def _plain(p: ClassifyParams) -> str:
    """WITH list up to ``report``: every target classified without exons."""
    return f"""{_HEAD}, {TARGETS}, {_days('tday', 'tgt')}, {low_runs(10, 15)}, {_rows('tday', 'low', 'rows', 'k', p)},
report AS (
  SELECT rows.*, tgt.name AS target_id, tgt.contig, tgt.s, tgt.e, {_status(p)} AS coverage_status
  FROM rows JOIN tgt ON rows.k = tgt.k)"""


def _with_exons(p: ClassifyParams, exon_only: bool = False) -> str:
    """WITH list up to ``xreport`` (exons) and ``report`` (genes), in either exon mode."""
    exon_days = f"{_days('xday', 'exons', 'exon_id')}, {low_runs(10, 15, 'xday', 'xlow', 'exon_id')}"
    if exon_only:
        source = f"""gday AS (
  SELECT xday.sample, gene_line AS k, d FROM xday JOIN exons ON xday.exon_id = exons.exon_id
  UNION ALL SELECT sample, k, d FROM wday), {_days('wday', 'bare')},
bare AS (SELECT * FROM genes WHERE k NOT IN (SELECT gene_line FROM exons)),
{low_runs(10, 15, 'wday', 'wlow')},
glow AS (
  SELECT xlow.sample, gene_line AS k, xlow.s, xlow.e, len, depth_sum FROM xlow JOIN exons ON xlow.exon_id = exons.exon_id
  UNION ALL SELECT sample, k, s, e, len, depth_sum FROM wlow)"""
        parts = source.split(", wday AS")
        bare = parts[1][parts[1].index("bare AS"):].split(",\n")[0]
        wday = "wday AS" + parts[1][: parts[1].index(",\nbare AS")]
        wlow = low_runs(10, 15, "wday", "wlow")
        glow = source[source.index("glow AS"):]
        source = f"{bare}, {wday}, {parts[0]}, {wlow}, {glow}"
    else:
        source = f"{_days('gday', 'genes')}, {low_runs(10, 15, 'gday', 'glow')}"
    return f"""{_HEAD}, {EXON_TABLE}, {exon_days}, {source},
{_rows('xday', 'xlow', 'xrows', 'exon_id', p)},
xreport AS (
  SELECT xrows.*, gene_line, upper(gene_name) AS gene_name, contig, s, e, exon_number,
         CASE WHEN {_EXON_LOW(p)} THEN 'LOW_EXON' ELSE 'OK' END AS status
  FROM xrows JOIN exons ON xrows.exon_id = exons.exon_id),
{_rows('gday', 'glow', 'grows', 'k', p)},
report AS (
  SELECT grows.*, genes.name AS target_id, genes.contig, genes.s, genes.e, {_status(p, 'coalesce(bad, false)')} AS coverage_status
  FROM grows JOIN genes ON grows.k = genes.k
  LEFT JOIN (SELECT sample AS bs, gene_line, bool_or(status = 'LOW_EXON') AS bad FROM xreport GROUP BY ALL) b
    ON b.bs = grows.sample AND b.gene_line = grows.k)"""


_METRICS = ["length_bp", "mean_depth", "median_depth", "min_depth", "max_depth", "stdev_depth", "pct_zero",
            *[f"pct_ge_{t}" for t in STEPS]]
_ALL = ", ".join([*_METRICS, "n_lowcov_blocks", "lowcov_total_bp"])
_PLACE = 'contig, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end"'
_SHOWN = "contig || ':' || format('{:,}', s + 1) || '-' || format('{:,}', e)"


def _blocks(spark, d):
    return depth_blocks(views.pooled_segments(spark, d), BIN)


def _report(spark, d, classify=CUSTOM):
    return coverage_report(
        _blocks(spark, d), views.targets(spark, d), views.pooled_samples(spark, d), PARAMS, classify
    )


def _gene_rows(spark, d):
    return views.genes(spark, d).withColumnRenamed("line_no", "ordinal")


def _gene_report(spark, d, exons=True, exon_only=False, classify=CUSTOM):
    return gene_report(
        _blocks(spark, d), _gene_rows(spark, d), views.pooled_samples(spark, d), views.exons(spark, d),
        exons, exon_only, "chr", PARAMS, classify,
    )


@query("classify_target", f"WITH {_plain(DEFAULTS)} SELECT sample, k AS ordinal, target_id, {_PLACE}, {_ALL}, coverage_status FROM report")
def classified(spark, d):
    return _report(spark, d, DEFAULTS).targets


@query("classify_target_custom", f"WITH {_plain(CUSTOM)} SELECT sample, k AS ordinal, coverage_status FROM report")
def classified_custom(spark, d):
    return _report(spark, d).targets.select("sample", "ordinal", "coverage_status")


def _case(column: str, table: dict, other: str) -> str:
    quoted = lambda v: "'" + v + "'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in table.items()) + f" ELSE {other} END"


@query(
    "status_text",
    f"""WITH {_plain(CUSTOM)}
    SELECT sample, k AS ordinal, {_case('coverage_status', STATUS_TEXT, "''")} AS description,
      CASE coverage_status
        WHEN 'PASS' THEN format('pct_ge_20 ({{:.2f}}%) ≥ 60.0% AND pct_zero ({{:.2f}}%) ≤ 2.0% → PASS', pct_ge_20, pct_zero)
        WHEN 'LOW_COVERAGE' THEN format('pct_ge_20 ({{:.2f}}%) < 60.0% → LOW_COVERAGE', pct_ge_20)
        WHEN 'DROP_OUT' THEN CASE WHEN pct_zero > 10 THEN format('pct_zero ({{:.2f}}%) > 10.0% → DROP_OUT', pct_zero)
          ELSE 'Long zero-depth block detected (≥ 16 bp) → DROP_OUT' END
        WHEN 'UNEVEN' THEN 'mean_depth (' || format('{{:.2f}}', mean_depth) || ') > 20 AND CV (' ||
          CAST(CAST(round(CAST(CAST(stdev_depth / mean_depth AS VARCHAR) AS DECIMAL(30, 20)), 2) AS DECIMAL(20, 2)) AS VARCHAR) || ') > {CUSTOM.uneven_cv} → UNEVEN'
        ELSE coverage_status END AS rationale FROM report""",
)
def texts(spark, d):
    """Descriptions and rationales."""
    report = _report(spark, d).targets
    return report.select(
        "sample", "ordinal", status_text(F.col("coverage_status")).alias("description"), rationale(report, CUSTOM).alias("rationale")
    )


@query(
    "classify_exon",
    f"""WITH {_with_exons(CUSTOM)} SELECT sample, gene_line AS gene_ordinal, exon_id, gene_name, status,
      CAST(exon_number AS BIGINT) AS exon_number, {_PLACE}, {_ALL} FROM xreport""",
)
def exon_status(spark, d):
    return _gene_report(spark, d).exons.drop("transcript_id")


@query("exon_mode", f"WITH {_with_exons(CUSTOM)} SELECT sample, k AS ordinal, {_ALL}, coverage_status FROM report")
def with_exons(spark, d):
    return _gene_report(spark, d).targets.drop("target_id", "contig", "start", "end")


@query(
    "exon_rollup",
    f"WITH {_with_exons(CUSTOM, True)} SELECT sample, k AS ordinal, target_id, {_PLACE}, {_ALL}, coverage_status FROM report",
)
def exon_only(spark, d):
    """Genes measured by their exons; genes without exons fall back to the whole gene."""
    return _gene_report(spark, d, exons=False, exon_only=True).targets


@query(
    "exon_rollup_low_blocks",
    f"""WITH {_with_exons(CUSTOM, True)} SELECT sample, k AS ordinal, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end",
      len AS length, depth_sum FROM glow""",
)
def exon_only_low(spark, d):
    return _gene_report(spark, d, exons=False, exon_only=True).low_blocks.drop("target_id", "contig")


_REGION_MODE = f"""{_HEAD}, {_REGIONS}, {_IN_REGION}, xbase AS (SELECT 1), {EXON_TABLE.split(', exons AS')[1].join(['exons AS', ''])},
tgt AS (SELECT ordinal AS k, contig, s, e FROM regions), {_days('rday', 'tgt')},
gtgt AS (
  SELECT region_ordinal || '/' || name AS k, region_ordinal, contig, greatest(s, rs) AS s, least(e, re) AS e, name, i FROM hits),
{_days('gday', 'gtgt')},
xtgt AS (
  SELECT r.ordinal || '/' || x.exon_id AS k, r.ordinal || '/' || upper(x.gene_name) AS gk, x.contig,
         greatest(x.s, r.s) AS s, least(x.e, r.e) AS e, x.exon_id
  FROM regions r JOIN exons x ON x.contig = r.contig AND greatest(x.s, r.s) < least(x.e, r.e)),
{_days('xday', 'xtgt')},
{low_runs(10, 15, 'rday', 'rlow')}, {low_runs(10, 15, 'gday', 'glow')}, {low_runs(10, 15, 'xday', 'xlow')},
{_rows('rday', 'rlow', 'rrows', 'k', CUSTOM)}, {_rows('gday', 'glow', 'grows', 'k', CUSTOM)}, {_rows('xday', 'xlow', 'xrows', 'k', CUSTOM)},
bad AS (SELECT sample AS bs, gk, bool_or({_EXON_LOW(CUSTOM)}) AS bad FROM xrows JOIN xtgt ON xrows.k = xtgt.k GROUP BY ALL),
greport AS (
  SELECT grows.*, region_ordinal, name, contig, s, e, i, {_status(CUSTOM, 'coalesce(bad, false)')} AS coverage_status
  FROM grows JOIN gtgt ON grows.k = gtgt.k LEFT JOIN bad ON bs = grows.sample AND gk = upper(grows.k))"""


def _region_report(spark, d):
    return region_report(
        _blocks(spark, d), _regions(spark, d), views.pooled_samples(spark, d), views.genes(spark, d),
        views.genes(spark, d, 7, 9), views.exons(spark, d), True, "chr", PARAMS, CUSTOM,
    )


@query("region_mode", f"WITH {_REGION_MODE} SELECT sample, k AS ordinal, {_ALL}, {_status(CUSTOM)} AS coverage_status FROM rrows")
def region_mode(spark, d):
    return _region_report(spark, d).targets.drop("target_id", "contig", "start", "end")


@query(
    "region_mode_genes",
    f"""WITH {_REGION_MODE} SELECT sample, region_ordinal, name AS gene_name, {_ALL}, coverage_status FROM greport""",
)
def region_genes(spark, d):
    return _region_report(spark, d).genes.select(
        "sample", F.col("ordinal.region_ordinal").alias("region_ordinal"), F.col("target_id").alias("gene_name"),
        *_METRICS, "n_lowcov_blocks", "lowcov_total_bp", "coverage_status",
    )


@query(
    "gene_table",
    f"""WITH {_REGION_MODE} SELECT sample, region_ordinal, name AS gene, 'protein_coding' AS gene_type,
      CASE WHEN i % 2 = 0 THEN '+' ELSE '-' END AS strand, {_SHOWN} AS region, length_bp, mean_depth, median_depth,
      pct_ge_20, pct_zero, coverage_status FROM greport""",
)
def genes_shown(spark, d):
    shown = gene_table(_region_report(spark, d).genes)
    return shown.withColumn("region_ordinal", F.col("ordinal.region_ordinal")).drop("ordinal")


@query("status_counts", f"WITH {_plain(CUSTOM)} SELECT sample, coverage_status, count(*) AS n FROM report GROUP BY ALL")
def counts(spark, d):
    return status_counts(_report(spark, d).targets)


def _weighted(column: str) -> str:
    cents = f"CAST(sum(CAST(round({column} * 100) AS BIGINT) * length_bp) AS BIGINT)"
    bp = "CAST(sum(length_bp) AS BIGINT)"
    return f"CAST((2 * {cents} + {bp}) // (2 * {bp}) AS DOUBLE) / 100.0::DOUBLE"


def _summary(order: dict) -> str:
    return f"""SELECT sample, count(*) AS n_targets, count(*) FILTER (coverage_status = 'PASS') AS n_pass,
      {ratio("count(*) FILTER (coverage_status = 'PASS')", 'count(*)', 2, 100)} AS pct_targets_pass,
      {_weighted('mean_depth')} AS mean_depth, {_weighted('pct_ge_20')} AS pct_ge_20,
      arg_max(coverage_status, {_case('coverage_status', order, '0')}) AS worst_status FROM report GROUP BY sample"""


@query("sample_summary", f"WITH {_plain(CUSTOM)} {_summary(SUMMARY_SEVERITY)}")
def summary(spark, d):
    return sample_summary(_report(spark, d).targets, PARAMS)


@query(
    "html_summary",
    f"""WITH {_with_exons(CUSTOM)}, s AS ({_summary(PAGE_SEVERITY)})
    SELECT s.sample, n_targets, n_pass, pct_targets_pass AS pass_rate, mean_depth AS overall_mean_depth,
      pct_ge_20 AS overall_pct_ge_20, worst_status,
      (SELECT count(*) FROM xreport x WHERE x.sample = s.sample AND status = 'LOW_EXON') AS n_low_exons FROM s""",
)
def page(spark, d):
    report = _gene_report(spark, d)
    return page_summary(report.targets, report.exons, PARAMS)


@query(
    "exon_bars",
    f"""WITH {_with_exons(CUSTOM)} SELECT sample, gene_name AS gene, CAST(exon_number AS BIGINT) AS exon, exon_id,
      pct_ge_20 AS pct20, mean_depth AS mean, status FROM xreport""",
)
def bars(spark, d):
    return exon_bars(_gene_report(spark, d).exons)


@query(
    "exon_order",
    f"""WITH {_with_exons(CUSTOM)} SELECT sample, gene_name, CAST(exon_number AS BIGINT) AS exon_number, exon_id FROM xreport""",
)
def in_exon_order(spark, d):
    return ordered_exons(_gene_report(spark, d).exons).select("sample", "gene_name", "exon_number", "exon_id")


@query(
    "input_order",
    f"""WITH {_plain(CUSTOM)}
    SELECT sample, k AS ordinal, target_id, row_number() OVER (ORDER BY sample, k) AS position FROM report""",
)
def in_input_order(spark, d):
    return input_order(_report(spark, d).targets).select("sample", "ordinal", "target_id", "position")


@query(
    "target_table",
    f"""WITH {_plain(CUSTOM)} SELECT sample, k AS ordinal, target_id, {_SHOWN} AS region, length_bp, mean_depth, median_depth,
      pct_ge_20, pct_zero, coverage_status FROM report""",
)
def targets_shown(spark, d):
    return target_table(_report(spark, d).targets)


@query(
    "exon_table",
    f"""WITH {_with_exons(CUSTOM)} SELECT sample, gene_name, CAST(exon_number AS BIGINT) AS exon_number, exon_id,
      {_SHOWN} AS region, length_bp, mean_depth, pct_ge_20, pct_zero, status FROM xreport""",
)
def exons_shown(spark, d):
    return exon_table(_gene_report(spark, d).exons)


@query(
    "low_block_table",
    f"""WITH {_plain(CUSTOM)}, l AS (SELECT low.*, tgt.contig, tgt.name FROM low JOIN tgt ON low.k = tgt.k)
    SELECT sample, k AS ordinal, name AS target_id, {_SHOWN} AS region, len AS length,
      CAST((20 * depth_sum + len) // (2 * len) AS DOUBLE) / 10.0::DOUBLE AS mean_depth FROM l""",
)
def low_shown(spark, d):
    return low_block_table(_report(spark, d).low_blocks)


@query(
    "low_block_bed",
    f"""WITH {_plain(CUSTOM)}, l AS (SELECT low.*, tgt.contig, tgt.name FROM low JOIN tgt ON low.k = tgt.k)
    SELECT sample AS sample_name, {_PLACE}, name AS target_id,
      'mean_depth=' || format('{{:.1f}}', CAST((20 * depth_sum + len) // (2 * len) AS DOUBLE) / 10.0::DOUBLE) AS mean_depth FROM l""",
)
def low_bed(spark, d):
    return low_bed_rows(_report(spark, d).low_blocks)


@query(
    "tsv_report",
    f"WITH {_plain(CUSTOM)} SELECT sample AS sample_name, target_id, {_PLACE}, {_ALL}, coverage_status FROM report",
)
def tsv(spark, d):
    return tsv_rows(_report(spark, d).targets, PARAMS)


@query(
    "exon_tsv",
    f"""WITH {_with_exons(CUSTOM)} SELECT sample AS sample_name, gene_name AS target_id, exon_id,
      CAST(exon_number AS BIGINT) AS exon_number, {_PLACE}, length_bp, mean_depth, median_depth, pct_zero, pct_ge_20, pct_ge_30
    FROM xreport""",
)
def exon_tsv(spark, d):
    return exon_rows(_gene_report(spark, d).exons)


_FIELDS = ["target_id", "contig", "start", "end", *_METRICS[:7]]


def _json(rows: str, ident: str, low: str, days: str, key: str, status: str, extra: str = "") -> str:
    head = ", ".join(
        f"'{f}': " + {"target_id": ident, "start": "CAST(r.s AS BIGINT)", "end": "CAST(r.e AS BIGINT)"}.get(f, f"r.{f}")
        for f in _FIELDS
    )
    steps = ", ".join(f"'{t}': r.pct_ge_{t}" for t in STEPS)
    return f"""SELECT r.sample, r.{key}, {{{head}, 'pct_thresholds': {{{steps}}}, 'coverage_status': {status},
      'n_lowcov_blocks': r.n_lowcov_blocks, 'lowcov_total_bp': r.lowcov_total_bp,
      'lowcov_blocks': coalesce(l.blocks, []), 'histogram': h.bars{extra}}} AS doc FROM {rows} r
      LEFT JOIN (SELECT {low}.sample, {low}.{key}, list({{'contig': t.contig, 'start': CAST({low}.s AS BIGINT),
          'end': CAST({low}.e AS BIGINT), 'length': len,
          'mean_depth': CAST((200 * depth_sum + len) // (2 * len) AS DOUBLE) / 100.0::DOUBLE}} ORDER BY {low}.s) AS blocks
        FROM {low} JOIN (SELECT DISTINCT {key}, contig FROM {rows}) t ON t.{key} = {low}.{key} GROUP BY ALL) l
        ON l.sample = r.sample AND l.{key} = r.{key}
      JOIN (SELECT sample, {key}, map(list(CAST(d AS VARCHAR) ORDER BY d), list(n ORDER BY d)) AS bars
            FROM (SELECT sample, {key}, d, count(*) AS n FROM {days} GROUP BY ALL) GROUP BY ALL) h
        ON h.sample = r.sample AND h.{key} = r.{key}"""


@query(
    "json_report",
    f"""WITH {_plain(CUSTOM)}, docs AS ({_json('report', 'r.target_id', 'low', 'tday', 'k', 'r.coverage_status')})
    SELECT sample, k AS ordinal, CAST(to_json(doc) AS VARCHAR) AS document FROM docs""",
)
def json_report(spark, d):
    return report_documents(_report(spark, d))


_XDOC = _json(
    "xreport", "r.exon_id", "xlow", "xday", "exon_id", "''",
    ", 'exon_number': CAST(r.exon_number AS BIGINT), 'status': r.status",
)


@query(
    "json_report_exons",
    f"""WITH {_with_exons(CUSTOM)}, xdocs AS ({_XDOC}), nested AS (
      SELECT x.sample AS ns, gene_line, list(doc ORDER BY e.s) AS exons
      FROM xdocs x JOIN exons e ON x.exon_id = e.exon_id GROUP BY ALL),
    r0 AS (SELECT report.*, nested.exons AS nx FROM report JOIN nested ON ns = sample AND gene_line = k),
    docs AS ({_json('r0', 'r.target_id', 'glow', 'gday', 'k', 'r.coverage_status', ", 'exons': r.nx")})
    SELECT sample, k AS ordinal, CAST(to_json(doc) AS VARCHAR) AS document FROM docs
    UNION ALL SELECT sample, k, CAST(to_json(doc) AS VARCHAR) FROM (
      {_json("(SELECT * FROM report WHERE k NOT IN (SELECT gene_line FROM exons))", 'r.target_id', 'glow', 'gday', 'k',
             'r.coverage_status')})""",
)
def json_exons(spark, d):
    return report_documents(_gene_report(spark, d))


@query(
    "json_run",
    f"""WITH {_plain(CUSTOM)}, c AS (SELECT sample, coverage_status AS st, count(*) AS n FROM report GROUP BY ALL)
    SELECT sample, CAST(to_json({{'schema_version': '1.0', 'run': {{'sample_name': sample, 'input_path': 'lineitem',
      'thresholds': [{', '.join(map(str, STEPS))}], 'classify_params': {{'pass_pct_ge_20': 60.0::DOUBLE,
      'pass_max_pct_zero': 2.0::DOUBLE, 'dropout_pct_zero': 10.0::DOUBLE, 'dropout_zero_block_bp': 16,
      'uneven_cv': 0.25::DOUBLE, 'exon_pct_ge_20': 5.0::DOUBLE, 'exon_max_pct_zero': 8.0::DOUBLE}}}},
      'summary': {{'n_targets': CAST(sum(n) AS BIGINT),
        'n_pass': CAST(coalesce(sum(n) FILTER (st = 'PASS'), 0) AS BIGINT),
        'status_counts': map(list(st ORDER BY st), list(n ORDER BY st))}}}}) AS VARCHAR) AS document FROM c GROUP BY sample""",
)
def json_run(spark, d):
    return run_documents(_report(spark, d), input_path="lineitem")


@query(
    "multiqc_report",
    f"""WITH {_plain(CUSTOM)}, s AS ({_summary(SUMMARY_SEVERITY)})
    SELECT CAST(to_json({{'id': 'plumbline', 'section_name': 'Coverage QC',
      'description': 'Per-sample targeted-sequencing coverage QC summary.', 'plot_type': 'table',
      'pconfig': {{'id': 'plumbline_table', 'title': 'Coverage QC', 'namespace': 'plumbline'}},
      'data': map(list(sample ORDER BY sample), list({{'n_targets': n_targets, 'n_pass': n_pass,
        'pct_targets_pass': pct_targets_pass, 'mean_depth': mean_depth, 'pct_ge_20': pct_ge_20,
        'worst_status': worst_status}} ORDER BY sample))}}) AS VARCHAR) AS document FROM s""",
)
def multiqc(spark, d):
    return multiqc_document(_report(spark, d).targets, PARAMS)


def _staged(spark, rows, parts: int = 3) -> str:
    """Write rows as files in the shared folder, for a stream of several batches; every task deals its own rows to the parts."""
    folder = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    part = F.pmod(F.monotonically_increasing_id(), F.lit(parts))
    rows.withColumn("_part", part).write.partitionBy("_part").parquet(f"{folder}/in")
    return folder


def _stream(spark, folder: str, schema, batches: int = 3):
    """The files of ``folder`` in about so many batches; a batch is read by as many tasks as its files need."""
    source = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    files = -(-len(source.inputFiles()) // batches)
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    return reader.option("maxFilesPerTrigger", max(1, files)).parquet(f"{folder}/in")


def _block_sql() -> str:
    return f"""SELECT sample, contig, CAST(p // {BIN} AS BIGINT) AS bin, CAST(min(p) AS BIGINT) AS start,
           CAST(max(p) + 1 AS BIGINT) AS "end", CAST(d AS BIGINT) AS depth
    FROM (SELECT *, p - row_number() OVER (PARTITION BY sample, contig, p // {BIN}, d ORDER BY p) AS island FROM depth)
    GROUP BY sample, contig, p // {BIN}, d, island"""


@query("stream_deltas", f"WITH {_SEG}, {DEPTH} {_block_sql()}")
def streamed(spark, d):
    """Reads arriving in batches, then the depth blocks of all of them."""
    lines = views.table(spark, d, "lineitem")
    folder = _staged(spark, lines)
    arriving = views.placed_lines(spark, d, _stream(spark, folder, lines.schema))
    pool = F.when(F.col("ln") % 7 == 0, "thin").otherwise("deep")
    segments = arriving.select(pool.alias("sample"), "contig", "start", (F.col("start") + F.col("q")).alias("end"))
    stream_deltas(segments, f"{folder}/deltas", f"{folder}/progress", BIN).awaitTermination()
    return streamed_blocks(spark, f"{folder}/deltas")


@query(
    "stream_histogram",
    f"""WITH {_HEAD}, {TARGETS}, {_days('tday', 'tgt')}
    SELECT sample, k AS ordinal, CAST(d AS BIGINT) AS depth, count(*) AS n FROM tday GROUP BY ALL""",
)
def streamed_histogram(spark, d):
    """Depth blocks arriving in batches, summed into target histograms."""
    targets = views.targets(spark, d)
    places = target_places(targets, BIN)
    blocks = _blocks(spark, d).drop("bin")
    folder = _staged(spark, blocks)
    arriving = bin_blocks(_stream(spark, folder, blocks.schema), BIN)
    stream_histogram(arriving, places, f"{folder}/histogram", f"{folder}/progress").awaitTermination()
    rows = read_histogram(spark, f"{folder}/histogram", places, views.pooled_samples(spark, d))
    placed = targets.select("ordinal", "contig", F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    return rows.join(placed, ["contig", "t_start", "t_end"]).select("sample", "ordinal", "depth", "n")
