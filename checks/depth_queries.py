"""Depth, interval joins, histograms, metrics and runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import views
from checks.registry import (
    DAY, DEPTH, OVERLAPPING, READ_SEG, SEG, base, low_runs, metric_columns, query, ratio,
)
from plumbline.functions.intervals import clip_interval, length_bp
from plumbline.functions.numeric import double_round, population_stdev, ratio_round
from plumbline.operators.depth import (
    bin_blocks, cigar_segments, clip_to_intervals, coverage_deltas, depth_blocks, per_base_depth, read_filter,
    sample_grid,
)
from plumbline.operators.histogram import INTERVAL_KEYS, depth_histogram, median_interp, median_low, metrics
from plumbline.operators.joins import point_interval_join, target_places
from plumbline.operators.runs import low_blocks, low_totals, merge_targets, zero_runs
from plumbline.params import CoverageParams, parse_thresholds
from plumbline.plans.report import attach, covered_segments, target_metrics
from plumbline.session import checkpoint_dir
from plumbline.sources.alignments import parse_sam, read_alignments, write_alignments
from plumbline.sources.depth_files import parse_depth_blocks, parse_depth_lines

BIN, FINE = views.BIN, views.FINE_BIN


def _places(targets, bin_size=BIN):
    return target_places(targets, bin_size)


def _attached(rows, targets):
    """Target ordinal and values, without the place columns; ten targets per nation are few."""
    return attach(rows, targets.select("ordinal", "contig", "start", "end"), small=True).drop("contig", "t_start", "t_end")


def _histogram(spark, d, targets=None, bin_size=BIN):
    targets = views.targets(spark, d) if targets is None else targets
    places = _places(targets, bin_size)
    blocks = depth_blocks(views.segments(spark, d), bin_size, targets=places)
    return depth_histogram(blocks, places, views.samples(spark, d)), targets


@query(
    "src_reads",
    f"""WITH {READ_SEG.split(', counted')[0]}
    SELECT sample, l_orderkey || '_' || ln AS read_id, contig, CAST(s AS BIGINT) AS start,
      CASE WHEN q >= 4 AND ln % 2 = 0 THEN (q // 2) || 'M' || ln || 'D' || (q - q // 2) || 'M'
           WHEN ln % 3 = 0 THEN '5S' || q || 'M' ELSE q || 'M' END AS cigar,
      CASE WHEN l_linestatus = 'F' AND ln = 7 THEN 1024 ELSE 0 END AS flag, 60 AS mapq
    FROM placed""",
)
def src_reads(spark, d):
    """Reads as SAM text of three files, with a read group for each sample that other files give to another, read back."""
    return parse_sam(views.sam_lines(spark, d))


@query(
    "src_reads_of_targets",
    f"""WITH {READ_SEG.split(', counted')[0]}, spans AS (SELECT sample, l_orderkey || '_' || ln AS read_id, contig, s,
        s + q + CASE WHEN q >= 4 AND ln % 2 = 0 THEN ln ELSE 0 END AS e FROM placed),
      asked AS (SELECT 'chr' || n_nationkey AS contig, 200 * i AS a, 200 * i + 40 AS b FROM nation, range(0, 9) t(i) WHERE n_nationkey % 4 = 1)
    SELECT sample, read_id, contig, CAST(s AS BIGINT) AS start FROM spans
    WHERE EXISTS (SELECT 1 FROM asked WHERE asked.contig = spans.contig AND s < b AND e > a)""",
)
def src_reads_of_targets(spark, d):
    """A read store written and read for targets only."""
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}/reads"
    write_alignments(views.reads(spark, d), path)
    asked = views.table(spark, d, "nation").where("n_nationkey % 4 = 1").select(
        F.concat(F.lit("chr"), F.col("n_nationkey").cast("string")).alias("contig"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(8).cast("bigint"))).alias("i")
    ).select("contig", (F.col("i") * 200).alias("start"), (F.col("i") * 200 + 40).alias("end"))
    return read_alignments(spark, path, target_places(asked, FINE)).select("sample", "read_id", "contig", "start")


@query(
    "src_depth_lines",
    f"""WITH {SEG}, {DEPTH}
    SELECT sample, contig, CAST(p AS BIGINT) AS pos, CAST(d AS BIGINT) AS depth FROM depth WHERE p % 5 <> 0""",
)
def src_depth_lines(spark, d):
    """Depth as text lines, 1-based, with every fifth line cut short, and read back."""
    blocks = depth_blocks(views.segments(spark, d), BIN)
    days = blocks.withColumn("pos", F.explode(F.sequence("start", F.col("end") - 1)))
    whole = F.concat_ws("\t", "contig", (F.col("pos") + 1).cast("string"), F.col("depth").cast("string"))
    cut = F.concat_ws("\t", "contig", F.col("pos").cast("string"))
    lines = days.select("sample", F.when(F.col("pos") % 5 == 0, cut).otherwise(whole).alias("value"))
    return parse_depth_lines(lines)


@query(
    "src_depth_blocks",
    f"""WITH {SEG}, {DEPTH}
    SELECT sample, contig, CAST(p AS BIGINT) AS pos, CAST(d AS BIGINT) AS depth FROM depth""",
)
def src_depth_blocks(spark, d):
    """Run-length lines with fractional depths read back, shown by position since cuts do not matter."""
    blocks = depth_blocks(views.segments(spark, d), BIN)
    value = F.concat_ws(
        "\t", "contig", F.col("start").cast("string"), F.col("end").cast("string"),
        F.concat(F.col("depth").cast("string"), F.lit(".75")),
    )
    parsed = parse_depth_blocks(blocks.select("sample", value.alias("value")))
    return bin_blocks(parsed, FINE).select(
        "sample", "contig", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"), "depth"
    )


@query(
    "read_filter",
    f"""WITH {READ_SEG}
    SELECT sample, contig, count(*) AS n_reads FROM counted GROUP BY ALL""",
)
def read_filter_counts(spark, d):
    return read_filter(views.reads(spark, d)).groupBy("sample", "contig").agg(F.count("*").alias("n_reads"))


@query(
    "cigar_segments",
    f"""WITH {READ_SEG}
    SELECT sample, contig, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM seg""",
)
def cigar(spark, d):
    return cigar_segments(read_filter(views.reads(spark, d))).select("sample", "contig", "start", "end")


@query(
    "clip_interval",
    f"""WITH {SEG}
    SELECT sample, contig, CAST(greatest(s, 400) AS BIGINT) AS start, CAST(least(e, 900) AS BIGINT) AS "end"
    FROM seg WHERE greatest(s, 400) < least(e, 900)""",
)
def clip(spark, d):
    return clip_interval(views.segments(spark, d), F.lit(400).cast("bigint"), F.lit(900).cast("bigint"))


@query(
    "length_bp",
    f"""WITH {SEG} SELECT sample, contig, CAST(sum(e - s) AS BIGINT) AS total_bp FROM seg GROUP BY ALL""",
)
def lengths(spark, d):
    return views.segments(spark, d).groupBy("sample", "contig").agg(
        F.sum(length_bp(F.col("start"), F.col("end"))).alias("total_bp")
    )


@query(
    "coverage_deltas",
    f"""WITH {SEG}, {DEPTH}, edges AS (
      SELECT sample, contig, s AS p, 1 AS v FROM seg UNION ALL SELECT sample, contig, e, -1 FROM seg)
    SELECT sample, contig, CAST(p AS BIGINT) AS pos, CAST(sum(v) AS BIGINT) AS delta FROM edges
    GROUP BY ALL HAVING sum(v) <> 0""",
)
def deltas(spark, d):
    """Changes per position; the pair of rows that a bin edge adds cancels out here."""
    rows = coverage_deltas(views.segments(spark, d), FINE)
    return rows.groupBy("sample", "contig", "pos").agg(F.sum("delta").alias("delta")).where(F.col("delta") != 0)


_RLE = """
    SELECT sample, contig, CAST(p // {b} AS BIGINT) AS bin, CAST(min(p) AS BIGINT) AS start,
           CAST(max(p) + 1 AS BIGINT) AS "end", CAST(d AS BIGINT) AS depth
    FROM (SELECT *, p - row_number() OVER (PARTITION BY sample, contig, p // {b}, d ORDER BY p) AS island FROM depth)
    GROUP BY sample, contig, p // {b}, d, island"""


@query("depth_blocks", f"WITH {SEG}, {DEPTH} {_RLE.format(b=BIN)}")
def blocks_wide(spark, d):
    return depth_blocks(views.segments(spark, d), BIN)


@query("depth_blocks_fine_bins", f"WITH {READ_SEG}, {DEPTH} {_RLE.format(b=FINE)}")
def blocks_fine(spark, d):
    return depth_blocks(covered_segments(views.reads(spark, d)), FINE)


@query(
    "interval_join",
    f"""WITH {base(OVERLAPPING)}
    SELECT sample, k AS ordinal, CAST(d AS BIGINT) AS depth, count(*) AS n FROM tday WHERE d > 0 GROUP BY ALL""",
)
def join_intervals(spark, d):
    """Blocks on overlapping targets, added up per depth."""
    targets = views.overlapping_targets(spark, d)
    places = _places(targets, FINE)
    clips = clip_to_intervals(depth_blocks(views.segments(spark, d), FINE, targets=places), places)
    summed = clips.groupBy(*INTERVAL_KEYS, "depth").agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    return _attached(summed, targets)


@query(
    "point_interval_join",
    f"""WITH {SEG}, points AS (SELECT contig, s AS p FROM placed), {OVERLAPPING}
    SELECT k AS ordinal, count(*) AS n_points, CAST(sum(p) AS BIGINT) AS pos_sum
    FROM points JOIN tgt ON points.contig = tgt.contig AND p >= tgt.s AND p < tgt.e GROUP BY ALL""",
)
def join_points(spark, d):
    targets = views.overlapping_targets(spark, d)
    points = views.segments(spark, d).select("contig", F.col("start").alias("pos"))
    counted = (
        point_interval_join(points, _places(targets, FINE))
        .groupBy("contig", "t_start", "t_end")
        .agg(F.count("*").alias("n_points"), F.sum("pos").alias("pos_sum"))
    )
    return _attached(counted, targets)


@query(
    "per_base_depth",
    f"""WITH {base()}
    SELECT sample, contig, CAST(p AS BIGINT) AS pos, CAST(d AS BIGINT) AS depth FROM tday""",
)
def per_base(spark, d):
    places = _places(views.targets(spark, d))
    blocks = depth_blocks(views.segments(spark, d), BIN, targets=places)
    return per_base_depth(blocks, places, views.samples(spark, d)).select("sample", "contig", "pos", "depth")


_HIST = "SELECT sample, k AS ordinal, CAST(d AS BIGINT) AS depth, count(*) AS n FROM tday GROUP BY ALL"


@query("depth_histogram", f"WITH {base()} {_HIST}")
def histogram(spark, d):
    return _attached(*_histogram(spark, d))


@query("depth_histogram_overlapping", f"WITH {base(OVERLAPPING, READ_SEG)} {_HIST}")
def histogram_overlapping(spark, d):
    targets = views.overlapping_targets(spark, d)
    places = _places(targets, FINE)
    blocks = depth_blocks(covered_segments(views.reads(spark, d)), FINE, targets=places)
    return _attached(depth_histogram(blocks, places, views.samples(spark, d)), targets)


@query(
    "depth_histogram_partial_manifest",
    f"WITH {base()} {_HIST.replace(' GROUP BY ALL', '')} WHERE sample IN (SELECT min(l_returnflag) FROM lineitem) GROUP BY ALL",
)
def histogram_partial(spark, d):
    """Only one of the samples in the blocks is asked for; depth of the others shows nowhere."""
    targets = views.targets(spark, d)
    places = _places(targets)
    asked = views.samples(spark, d).agg(F.min("sample").alias("sample"))
    blocks = depth_blocks(views.segments(spark, d), BIN, targets=places)
    return _attached(depth_histogram(blocks, places, asked), targets)


@query(
    "zero_fill",
    f"""WITH {base()}
    SELECT sample, k AS ordinal, count(*) FILTER (d = 0) AS zero_bp, count(*) AS length_bp FROM tday GROUP BY ALL""",
)
def zeros(spark, d):
    hist, targets = _histogram(spark, d)
    summed = hist.groupBy(*INTERVAL_KEYS).agg(
        F.sum(F.when(F.col("depth") == 0, F.col("n")).otherwise(0)).alias("zero_bp"), F.sum("n").alias("length_bp")
    )
    return _attached(summed, targets)


def _per_target(select: str) -> str:
    return f"WITH {base()} SELECT sample, k AS ordinal, {select} FROM tday GROUP BY ALL"


@query("mean_depth", _per_target(f"{ratio('sum(d)', 'count(*)')} AS mean_depth"))
def mean_depth(spark, d):
    hist, targets = _histogram(spark, d)
    mean = ratio_round("sum(depth * n)", "sum(n)", 2)
    return _attached(hist.groupBy(*INTERVAL_KEYS).agg(mean.alias("mean_depth")), targets)


@query(
    "stdev_depth",
    _per_target(
        "floor(sqrt(CAST(count(*) * sum(d * d) - sum(d) * sum(d) AS DOUBLE)) / CAST(count(*) AS DOUBLE)"
        " * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS stdev_depth"
    ),
)
def stdev_depth(spark, d):
    hist, targets = _histogram(spark, d)
    squares = "sum(CAST(depth * depth AS DECIMAL(20, 0)) * CAST(n AS DECIMAL(18, 0)))"
    value = double_round(population_stdev("sum(n)", "sum(depth * n)", squares), 4)
    return _attached(hist.groupBy(*INTERVAL_KEYS).agg(value.alias("stdev_depth")), targets)


@query(
    "min_max_depth", _per_target("CAST(min(d) AS BIGINT) AS min_depth, CAST(max(d) AS BIGINT) AS max_depth")
)
def min_max(spark, d):
    hist, targets = _histogram(spark, d)
    both = hist.groupBy(*INTERVAL_KEYS).agg(F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"))
    return _attached(both, targets)


@query("median_low", _per_target("CAST(quantile_disc(d, 0.5) AS DOUBLE) AS median_depth"))
def lower_median(spark, d):
    hist, targets = _histogram(spark, d)
    return _attached(median_low(hist, INTERVAL_KEYS), targets)


@query("median_interp", _per_target("CAST(median(d) AS DOUBLE) AS median_depth"))
def interpolated_median(spark, d):
    hist, targets = _histogram(spark, d)
    return _attached(median_interp(hist, INTERVAL_KEYS), targets)


@query("pct_zero", _per_target(f"{ratio('count(*) FILTER (d = 0)', 'count(*)', 2, 100)} AS pct_zero"))
def pct_zero(spark, d):
    hist, targets = _histogram(spark, d)
    return _attached(metrics(hist, CoverageParams(thresholds=())).select(*INTERVAL_KEYS, "pct_zero"), targets)


_CUSTOM = "40, 2,15,2"


@query(
    "pct_ge",
    _per_target(
        ", ".join(
            f"{ratio(f'count(*) FILTER (d >= {t})', 'count(*)', 2, 100)} AS pct_ge_{t}"
            for t in parse_thresholds(_CUSTOM)
        )
    ),
)
def pct_ge(spark, d):
    """Breadth columns made from a threshold list."""
    hist, targets = _histogram(spark, d)
    steps = parse_thresholds(_CUSTOM)
    rows = metrics(hist, CoverageParams(thresholds=steps))
    return _attached(rows.select(*INTERVAL_KEYS, *[f"pct_ge_{t}" for t in steps]), targets)


@query("target_metrics", _per_target(metric_columns()))
def all_metrics(spark, d):
    rows = target_metrics(
        views.segments(spark, d), views.targets(spark, d), views.samples(spark, d), CoverageParams(bin_size=BIN)
    )
    return rows.drop("contig", "start", "end", "target_id")


@query("parse_thresholds", _per_target(metric_columns((0, 4, 15, 40))))
def custom_thresholds(spark, d):
    """The metrics of a list of thresholds given as text."""
    params = CoverageParams(bin_size=BIN, thresholds=parse_thresholds("15, 4,40 ,0,4"))
    rows = target_metrics(views.segments(spark, d), views.targets(spark, d), views.samples(spark, d), params)
    return rows.drop("contig", "start", "end", "target_id")


@query(
    "target_metrics_shuffled",
    f"""WITH {base(OVERLAPPING, READ_SEG)}
    SELECT sample, k AS ordinal, {metric_columns(median='quantile_disc(d, 0.5)')} FROM tday GROUP BY ALL""",
)
def all_metrics_shuffled(spark, d):
    """The form used when the targets are too many to broadcast, with the lower median."""
    rows = target_metrics(
        covered_segments(views.reads(spark, d)), views.overlapping_targets(spark, d), views.samples(spark, d),
        CoverageParams(bin_size=FINE, median="low"), limit=0,
    )
    return rows.drop("contig", "start", "end", "target_id")


@query(
    "round_metrics",
    f"""SELECT l_orderkey, {ratio('CAST(sum(l_quantity) AS BIGINT)', 'count(*)')} AS mean_2,
      {ratio('CAST(sum(l_quantity) AS BIGINT)', 'count(*)', 1)} AS mean_1,
      {ratio('count(*) FILTER (l_quantity >= 20)', 'count(*)', 2, 100)} AS pct FROM lineitem GROUP BY l_orderkey""",
)
def rounding(spark, d):
    lines = views.table(spark, d, "lineitem")
    n, total = "count(*)", "sum(CAST(l_quantity AS BIGINT))"
    return lines.groupBy("l_orderkey").agg(
        ratio_round(total, n, 2).alias("mean_2"),
        ratio_round(total, n, 1).alias("mean_1"),
        ratio_round("count(IF(l_quantity >= 20, 1, NULL))", n, 2, scale=100).alias("pct"),
    )


_LOW = """SELECT sample, k AS ordinal, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", len AS length{} FROM low"""


def _low(spark, d, bin_size, threshold, min_len, targets):
    places = _places(targets, bin_size)
    blocks = depth_blocks(views.segments(spark, d), bin_size, targets=places)
    return low_blocks(blocks, places, views.samples(spark, d), threshold, min_len)


@query("low_blocks", f"WITH {base()}, {low_runs(20, 5)} {_LOW.format(', depth_sum')}")
def low(spark, d):
    targets = views.targets(spark, d)
    return _attached(_low(spark, d, BIN, 20, 5, targets), targets)


@query("low_blocks_fine_bins", f"WITH {base(OVERLAPPING)}, {low_runs(12, 3)} {_LOW.format(', depth_sum')}")
def low_fine(spark, d):
    """Runs stitched over many bin edges, on overlapping targets."""
    targets = views.overlapping_targets(spark, d)
    return _attached(_low(spark, d, FINE, 12, 3, targets), targets)


@query("zero_runs", f"WITH {base()}, {low_runs(1, 1)} {_LOW.format('')}")
def zero(spark, d):
    targets = views.targets(spark, d)
    places = _places(targets, FINE)
    blocks = depth_blocks(views.segments(spark, d), FINE, targets=places)
    return _attached(zero_runs(blocks, places, views.samples(spark, d), 1), targets)


@query(
    "low_totals",
    f"""WITH {base()}, {low_runs(20, 5)}
    SELECT t.sample, t.k AS ordinal, count(low.k) AS n_lowcov_blocks, CAST(coalesce(sum(len), 0) AS BIGINT) AS lowcov_total_bp
    FROM (SELECT sample, k FROM samples, tgt) t LEFT JOIN low ON low.sample = t.sample AND low.k = t.k GROUP BY ALL""",
)
def totals(spark, d):
    targets = views.targets(spark, d)
    places = _places(targets)
    samples = views.samples(spark, d)
    blocks = depth_blocks(views.segments(spark, d), BIN, targets=places)
    found = low_totals(low_blocks(blocks, places, samples, 20, 5))
    every = sample_grid(places.intervals, samples).join(found, list(INTERVAL_KEYS), "left")
    none = F.lit(0).cast("bigint")
    filled = every.withColumns({c: F.coalesce(c, none) for c in ("n_lowcov_blocks", "lowcov_total_bp")})
    return _attached(filled, targets)


@query(
    "merge_targets",
    f"""WITH spans AS (
      SELECT 'cust' || o_custkey AS contig, {DAY.format('o_orderdate')} AS s,
             {DAY.format('o_orderdate')} + 1 + o_orderkey % 40 AS e FROM orders),
    marked AS (
      SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY contig ORDER BY s, e
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM spans),
    islands AS (SELECT *, sum(opens) OVER (PARTITION BY contig ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM marked)
    SELECT contig, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end" FROM islands GROUP BY contig, g""",
)
def merged(spark, d):
    return merge_targets(views.order_spans(spark, d), FINE)
