"""BED parsing, limits, sampling and messages."""

from __future__ import annotations

from checks import views
from checks.registry import DAY, query
from plumbline.operators.bed import bed_clip, bed_message, bed_rejects, bed_sample, bed_stats, parse_bed

MAX_TARGETS, MAX_BP = 700, 9_000

_LINES = f"""lines AS (
  SELECT o_orderkey AS line_no, 'chr' || (o_custkey % 25) AS contig, {DAY.format('o_orderdate')} AS s,
         {DAY.format('o_orderdate')} + o_orderkey % 40 AS e, o_orderkey AS k,
         CASE WHEN o_orderkey % 97 = 0 THEN 'int' WHEN o_orderkey % 89 = 0 THEN 'cols'
              WHEN o_orderkey % 83 = 0 THEN 'comment' WHEN o_orderkey % 40 = 0 THEN 'empty' ELSE 'ok' END AS kind
  FROM orders),
bed AS (
  SELECT line_no, contig, s, e, e - s AS bp,
         CASE WHEN k % 3 = 0 THEN 'name_' || (k % 50) ELSE contig || ':' || s || '-' || e END AS name
  FROM lines WHERE kind = 'ok')"""
_OUT = 'line_no, contig, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", name'


@query("src_bed", f"WITH {_LINES} SELECT {_OUT} FROM bed")
def bed(spark, d):
    return parse_bed(views.bed_lines(spark, d))


@query(
    "bed_rejects",
    f"""WITH {_LINES}
    SELECT line_no, CASE kind WHEN 'int' THEN 'non-integer coordinates' WHEN 'cols' THEN 'fewer than 3 columns'
      ELSE 'start >= end' END AS reason FROM lines WHERE kind IN ('int', 'cols', 'empty')""",
)
def rejects(spark, d):
    return bed_rejects(views.bed_lines(spark, d)).select("line_no", "reason")


@query(
    "bed_stats",
    f"""WITH {_LINES}
    SELECT count(*) AS n_targets, CAST(sum(bp) AS BIGINT) AS total_bp, 60000000::BIGINT AS file_bytes,
      count(*) > {MAX_TARGETS} AS exceeds_targets, sum(bp) > {MAX_BP} AS exceeds_bp, true AS exceeds_bytes FROM bed""",
)
def stats(spark, d):
    return bed_stats(bed(spark, d), 60_000_000, MAX_TARGETS, MAX_BP)


_CLIP = f"""clipped AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (ORDER BY line_no) AS n, sum(bp) OVER (ORDER BY line_no) AS total FROM bed)
  WHERE n <= {MAX_TARGETS} AND total <= {MAX_BP})"""


@query("bed_clip", f"WITH {_LINES}, {_CLIP} SELECT {_OUT} FROM clipped")
def clip(spark, d):
    return bed_clip(bed(spark, d), MAX_TARGETS, MAX_BP)


_SAMPLE = f"""drawn AS (
  SELECT * FROM bed ORDER BY md5('42,' || line_no), line_no LIMIT {MAX_TARGETS}),
sampled AS (
  SELECT * FROM (SELECT *, sum(bp) OVER (ORDER BY contig, s, line_no ROWS UNBOUNDED PRECEDING) AS total FROM drawn)
  WHERE total <= {MAX_BP})"""


@query("bed_sample", f"WITH {_LINES}, {_SAMPLE} SELECT {_OUT} FROM sampled")
def sample(spark, d):
    return bed_sample(bed(spark, d), MAX_TARGETS, MAX_BP, seed=42)


def _message(kept: str, head: str, tail: str) -> str:
    return f"""totals AS (SELECT count(*) AS n, CAST(sum(bp) AS BIGINT) AS bp FROM bed),
    kept AS (SELECT count(*) AS kn, CAST(coalesce(sum(bp), 0) AS BIGINT) AS kbp FROM {kept})
    SELECT n AS n_targets, bp AS total_bp, kn AS kept_count, kbp AS kept_bp,
      '{head}' || concat_ws('; ',
        CASE WHEN n > {MAX_TARGETS} THEN 'target count (' || n || ') exceeds --max-targets ({MAX_TARGETS})' END,
        CASE WHEN bp > {MAX_BP} THEN 'total bp (' || format('{{:,}}', bp) || ') exceeds --max-total-bp ({MAX_BP:,})' END,
        'file size (60,000,000 bytes) exceeds --max-bed-bytes (52,428,800)') || {tail} AS message
    FROM totals, kept"""


@query(
    "bed_message",
    f"""WITH {_LINES}, {_CLIP}, {_message('clipped', 'BED guardrails triggered (warn_and_clip): ',
        "'. Retained first ' || kn || ' of ' || n || ' targets (' || format('{:,}', kbp) || ' bp of ' "
        "|| format('{:,}', bp) || ' bp).'")}""",
)
def message(spark, d):
    return bed_message(stats(spark, d), clip(spark, d), "clip", MAX_TARGETS, MAX_BP)


@query(
    "bed_message_sample",
    f"""WITH {_LINES}, {_SAMPLE}, {_message('sampled', 'BED guardrails triggered (warn_and_sample): ',
        "'. Sampled ' || kn || ' of ' || n || ' targets (' || format('{:,}', kbp) || ' bp of ' "
        "|| format('{:,}', bp) || ' bp) with seed=42.'")}""",
)
def message_sample(spark, d):
    return bed_message(stats(spark, d), sample(spark, d), "sample", MAX_TARGETS, MAX_BP, seed=42)


@query(
    "bed_within_limits",
    f"""WITH {_LINES} SELECT count(*) AS n_targets, CAST(sum(bp) AS BIGINT) AS total_bp, count(*) AS kept_count,
      CAST(sum(bp) AS BIGINT) AS kept_bp, 'All BED limits satisfied.' AS message FROM bed""",
)
def within(spark, d):
    rows = bed(spark, d)
    return bed_message(bed_stats(rows, 0, 10**9, 10**12), rows, "clip", 10**9, 10**12)

