"""The list of queries and the SQL fragments they share.

The SQL spreads everything to one row per day and counts, where the Spark side works on run-length blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def ratio(num: str, den: str, digits: int = 2, scale: int = 1) -> str:
    """num/den rounded half up from integers."""
    k = 10**digits
    return (
        f"(CASE WHEN ({den}) > 0 THEN CAST((2 * {k * scale} * CAST({num} AS BIGINT) + CAST({den} AS BIGINT)) "
        f"// (2 * CAST({den} AS BIGINT)) AS DOUBLE) / CAST({k} AS DOUBLE) ELSE 0.0::DOUBLE END)"
    )


DAY = "date_diff('day', DATE '1995-01-01', CAST({} AS DATE))"
PLACED = f"""placed AS (
  SELECT l_returnflag AS sample, 'chr' || s_nationkey AS contig, {DAY.format('l_shipdate')} AS s,
         CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS ln, l_orderkey, l_linestatus
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
SEG = PLACED + ", seg AS (SELECT sample, contig, s, s + q AS e FROM placed)"
# covered parts of the reads, from the rules that made their CIGAR text
READ_SEG = PLACED + """, counted AS (
  SELECT *, q >= 4 AND ln % 2 = 0 AS gapped FROM placed WHERE NOT (l_linestatus = 'F' AND ln = 7)),
seg AS (
  SELECT sample, contig, s, s + q AS e FROM counted WHERE NOT gapped
  UNION ALL SELECT sample, contig, s, s + q // 2 FROM counted WHERE gapped
  UNION ALL SELECT sample, contig, s + q // 2 + ln, s + q + ln FROM counted WHERE gapped)"""
DEPTH = """depth AS (
  SELECT sample, contig, p, count(*) AS d
  FROM (SELECT sample, contig, unnest(range(s, e)) AS p FROM seg) GROUP BY ALL)"""
SAMPLES = "samples AS (SELECT DISTINCT l_returnflag AS sample FROM lineitem)"


def genes(first: int = 0, last: int = 6, name: str = "genes") -> str:
    return f"""{name} AS (
  SELECT CAST(n_nationkey AS BIGINT) * 10 + i AS k, 'chr' || n_nationkey AS contig, 365 * i + 30 AS s,
         365 * i + 330 AS e, n_name || '_' || i AS name, i
  FROM nation, range({first}, {last + 1}) r(i))"""


TARGETS = genes(0, 9, "tgt")
OVERLAPPING = genes(0, 9, "base") + """, tgt AS (
  SELECT k, contig, s, e, name FROM base
  UNION ALL SELECT k + 1000, contig, s + 150, e + 150, name FROM base)"""
# one row per sample, target and day
BY_DAY = """tday AS (
  SELECT x.sample, x.k, x.contig, x.p, coalesce(d.d, 0) AS d
  FROM (SELECT sample, k, contig, unnest(range(s, e)) AS p FROM tgt, samples) x
  LEFT JOIN depth d ON d.sample = x.sample AND d.contig = x.contig AND d.p = x.p)"""


def base(targets: str = TARGETS, seg: str = SEG) -> str:
    """WITH list up to ``tday``."""
    return f"{seg}, {DEPTH}, {SAMPLES}, {targets}, {BY_DAY}"


def metric_columns(thresholds=(1, 5, 10, 20, 30, 50, 100), median: str = "median(d)") -> str:
    n, total = "count(*)", "sum(d)"
    return ", ".join(
        [
            f"CAST({n} AS BIGINT) AS length_bp",
            f"{ratio(total, n)} AS mean_depth",
            f"CAST({median} AS DOUBLE) AS median_depth",
            "CAST(min(d) AS BIGINT) AS min_depth",
            "CAST(max(d) AS BIGINT) AS max_depth",
            f"floor(sqrt(CAST({n} * sum(d * d) - {total} * {total} AS DOUBLE)) / CAST({n} AS DOUBLE) * 100.0::DOUBLE"
            " + 0.5::DOUBLE) / 100.0::DOUBLE AS stdev_depth",
            f"{ratio('count(*) FILTER (d = 0)', n, 2, 100)} AS pct_zero",
            *[f"{ratio(f'count(*) FILTER (d >= {t})', n, 2, 100)} AS pct_ge_{t}" for t in sorted(thresholds)],
        ]
    )


def low_runs(threshold: int, min_len: int, source: str = "tday", name: str = "low", key: str = "k") -> str:
    """Gap-and-island over days below the threshold."""
    return f"""{name} AS (
  SELECT sample, {key}, min(p) AS s, max(p) + 1 AS e, count(*) AS len, CAST(sum(d) AS BIGINT) AS depth_sum
  FROM (SELECT *, p - row_number() OVER (PARTITION BY sample, {key} ORDER BY p) AS island FROM {source}
        WHERE d < {threshold})
  GROUP BY sample, {key}, island HAVING count(*) >= {min_len})"""


EXON_TABLE = genes(0, 6) + """, exons AS (
  SELECT k AS gene_line, contig, s + 30 * j AS s, s + 30 * j + 20 AS e, 'E' || k || '.' || j AS exon_id,
         lower(name) AS gene_name, CASE WHEN k % 7 = 0 AND j = 3 THEN 0 ELSE j + 1 END AS exon_number,
         CASE WHEN k % 7 = 0 AND j = 3 THEN 'x' ELSE CAST(j + 1 AS VARCHAR) END AS exon_text, 'T' || k AS transcript_id
  FROM genes, range(0, 10) r(j) WHERE k % 20 <> 16)"""
