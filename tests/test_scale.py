"""What must not grow: rows per interval, rows of low runs, scans of read stores, pieces of documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import annotation
from plumbline.operators.annotation import sort_catalogue, suggest_genes
from plumbline.operators.depth import depth_blocks, of_samples, sample_set
from plumbline.operators.joins import interval_join, interval_set, span_join, target_places
from plumbline.operators.order import numbered
from plumbline.operators.runs import low_blocks
from plumbline.params import CoverageParams
from plumbline.plans.report import asked_report, coverage_report, covered_segments, target_blocks
from plumbline.sinks.reports import document_pieces, target_documents, write_reports
from plumbline.sources.alignments import read_alignments, read_sam, write_alignments

READS = "sample string, read_id string, contig string, start bigint, cigar string, flag int, mapq int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def scan_metrics(df):
    """(files, rows) that the scans of an executed plan have read."""
    df.collect()
    found = []

    def walk(plan):
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if plan.getClass().getSimpleName().endswith("QueryStageExec"):
            return walk(plan.plan())
        if plan.getClass().getSimpleName() == "FileSourceScanExec":
            found.append([plan.metrics().apply(name).value() for name in ("numFiles", "numOutputRows")])
        children = plan.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return tuple(map(sum, zip(*found)))


def test_rows_of_an_interval_of_any_length(spark):
    rng = random.Random(1)
    spans = [(f"c{i % 3}", rng.randrange(10**9), int(10 ** rng.uniform(0, 9))) for i in range(400)] + [("c0", 0, 250_000_000), ("c0", -500, 1200)]
    df = spark.createDataFrame([(c, s, s + n) for c, s, n in spans], "contig string, t_start bigint, t_end bigint")
    known = interval_set(df, 1 << 14)
    cells = known.cells()
    assert cells.groupBy("contig", "t_start", "t_end").count().agg(F.max("count")).first()[0] <= 3
    assert cells.count() <= known.rows <= 3 * len(spans)
    left = df.select("contig", F.col("t_start").alias("start"), F.col("t_end").alias("end"))
    joined = span_join(left, known)
    generated = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in generated and generated.count("Join ") == 1
    want = sorted((a, s, s + n, t, t + m) for a, s, n in spans for b, t, m in spans if a == b and s < t + m and t < s + n)
    assert sorted((r.contig, r.start, r.end, r.t_start, r.t_end) for r in joined.collect()) == want


def test_interval_join_on_many_levels(spark):
    rng = random.Random(2)
    blocks = [("S", "c", 10 * i, 10 * i + rng.randint(1, 10), rng.randint(1, 9)) for i in range(-30, 900)]
    targets = [("c", s, s + n) for s, n in ((rng.randint(-400, 9000), int(10 ** rng.uniform(0, 4))) for _ in range(60))]
    for size in (7, 16, 64):
        from plumbline.operators.depth import bin_blocks

        cut = bin_blocks(spark.createDataFrame(blocks, "sample string, contig string, start bigint, end bigint, depth bigint"), size)
        for limit in (None, 0):
            places = target_places(spark.createDataFrame(targets, "contig string, start bigint, end bigint"), size, limit)
            assert len(places.levels) >= 3
            got = interval_join(cut, places).groupBy("t_start", "t_end").agg(F.sum(F.col("depth") * (F.col("end") - F.col("start"))), F.sum(F.col("end") - F.col("start")))
            want = set()
            for _, s, e in set(targets):
                met = [(min(e, b) - max(s, a), d) for _, _, a, b, d in blocks if a < e and b > s]
                if met:
                    want.add((s, e, sum(n * d for n, d in met), sum(n for n, _ in met)))
            assert {tuple(r) for r in got.collect()} == want


def test_low_blocks_against_every_position(spark):
    rng = random.Random(3)
    segments = [(rng.choice("AB"), "c", s, s + rng.randint(1, 25)) for s in (rng.randint(0, 600) for _ in range(120))]
    targets = [("c", 0, 700), ("c", 30, 31), ("c", 100, 420), ("c", 650, 1900), ("d", 5, 90)]
    df = spark.createDataFrame(segments + [("Z", "c", 0, 700)], "sample string, contig string, start bigint, end bigint")
    samples = spark.createDataFrame([("A",), ("B",), ("C",), (None,), ("A",)], "sample string")
    for size, threshold, least in ((16, 2, 3), (50, 1, 1), (1 << 14, 3, 10)):
        places = target_places(spark.createDataFrame(targets, "contig string, start bigint, end bigint"), size)
        got = {tuple(r) for r in low_blocks(depth_blocks(df, size), places, samples, threshold, least).collect()}
        want = set()
        for sample in "ABC":
            for c, lo, hi in targets:
                depth = [sum(s == sample and a == c and x <= p < y for s, a, x, y in segments) for p in range(lo, hi)] + [threshold]
                begin = None
                for i, d in enumerate(depth):
                    if d < threshold and begin is None:
                        begin = i
                    if d >= threshold and begin is not None:
                        if i - begin >= least:
                            want.add((sample, c, lo, hi, lo + begin, lo + i, i - begin, sum(depth[begin:i])))
                        begin = None
        assert got == want


def test_low_blocks_of_a_whole_chromosome(spark):
    """The rows grow with the bins that have blocks, not with the bins of the target."""
    segments = spark.range(40).select(
        F.lit("S").alias("sample"), F.lit("c").alias("contig"), (F.col("id") * 6_000_000).alias("start"), (F.col("id") * 6_000_000 + 100).alias("end"),
    )
    places = target_places(spark.createDataFrame([("c", 0, 250_000_000)], "contig string, start bigint, end bigint"), 1 << 14)
    samples = spark.createDataFrame([("S",)], "sample string")
    low = low_blocks(depth_blocks(segments, 1 << 14, targets=places), places, samples, 1, 50)
    assert "explode(sequence" not in low._jdf.queryExecution().optimizedPlan().toString().split("Window")[0]
    got = low.orderBy("start").collect()
    assert len(got) == 40 and got[0].start == 100 and got[-1].end == 250_000_000 and sum(r.length for r in got) == 250_000_000 - 4000


def test_unwanted_samples_go_before_the_shuffle(spark):
    segments = spark.createDataFrame([("A", "c", 1, 5), ("B", "c", 1, 5), (None, "c", 2, 4)], "sample string, contig string, start bigint, end bigint")
    samples = sample_set(spark.createDataFrame([("A",), ("C",), (None,)], "sample string"))
    kept = depth_blocks(segments, 16, samples=samples)
    assert {r.sample for r in kept.collect()} == {"A"} and {r.sample for r in of_samples(depth_blocks(segments, 16), samples).collect()} == {"A"}
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and plan.index("Window [") < plan.index("Aggregate [") < plan.index("LeftSemi")


def test_numbers_without_one_task(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.randint(0, 10**6), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v long, i long").repartition(7)
    got = numbered(df, ["k", "v", "i"]).collect()
    assert [(r.k, r.v, r.i) for r in sorted(got, key=lambda r: r.position)] == sorted(rows)
    assert sorted(r.position for r in got) == list(range(1, 3001))
    assert numbered(df.limit(0), ["k"]).count() == 0
    table = spark.createDataFrame([("chrX", 1, 2, "x"), ("chr2", 5, 6, "b"), ("chr10", 1, 3, "c"), ("chr2", 5, 6, "a")], "contig string, start long, end long, gene_name string")
    assert [r.gene_name for r in sort_catalogue(table).orderBy("position").collect()] == ["a", "b", "c", "x"]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """200,000 reads of 100 and a few that span a million, on three contigs."""
    path = str(tmp_path_factory.mktemp("reads") / "store")
    at = F.col("id") * 30
    reads = spark.range(200_000).select(
        F.lit("S").alias("sample"), F.col("id").cast("string").alias("read_id"), F.concat(F.lit("c"), F.col("id") % 3).alias("contig"), at.alias("start"),
        F.when(F.col("id") % 20_000 == 7, "50M1000000N50M").otherwise("100M").alias("cigar"), F.lit(0).alias("flag"), F.lit(60).alias("mapq"),
    )
    write_alignments(reads, path, row_group_bytes=1 << 16)
    return path


def test_reads_of_one_gene_skip_the_rest(spark, store):
    whole = read_alignments(spark, store)
    target = spark.createDataFrame([(1, "g", "c1", 3_000_000, 3_010_000)], "ordinal long, target_id string, contig string, start bigint, end bigint")
    places = target_places(target, 1 << 14)
    near = read_alignments(spark, store, places)
    files, rows = scan_metrics(near)
    assert rows < 30_000 and whole.count() == 200_000
    length = F.when(F.col("cigar") == "100M", 100).otherwise(1_000_100)
    want = whole.where((F.col("contig") == "c1") & (F.col("start") < 3_010_000) & (F.col("start") + length > 3_000_000))
    assert rows_of(near) == rows_of(want) and want.count() > 30
    # the report is that of all reads
    samples = spark.createDataFrame([("S",)], "sample string")
    params = CoverageParams()
    pruned = coverage_report(target_blocks(spark, store, target, params), target, samples, params)
    full = coverage_report(depth_blocks(covered_segments(whole), params.bin_size), target, samples, params)
    for table in ("targets", "low_blocks", "histogram"):
        assert rows_of(getattr(pruned, table)) == rows_of(getattr(full, table))


def test_reads_of_many_targets_come_once(spark, store):
    rng = random.Random(5)
    spans = [(f"c{rng.randrange(4)}", s, s + rng.choice((1, 50, 3000, 200_000))) for s in (rng.randrange(6_100_000) for _ in range(150))]
    near = read_alignments(spark, store, target_places(spark.createDataFrame(spans, "contig string, start bigint, end bigint"), 1 << 14))
    got = [r.read_id for r in near.collect()]
    assert len(got) == len(set(got))
    want = set()
    for r in read_alignments(spark, store).collect():
        end = r.start + (100 if r.cigar == "100M" else 1_000_100)
        if any(c == r.contig and r.start < e and end > s for c, s, e in spans):
            want.add(r.read_id)
    assert set(got) == want


def test_reads_without_end_column(spark, tmp_path):
    rows = [("S", "r", "c", 10, "5S10M5N10M", 0, 60), ("S", "t", "c", 100, "10M", 0, 60), ("S", "u", None, None, "*", 4, 0)]
    spark.createDataFrame(rows, READS).write.parquet(str(tmp_path / "plain"))
    places = target_places(spark.createDataFrame([("c", 34, 60)], "contig string, start bigint, end bigint"), 16)
    assert [r.read_id for r in read_alignments(spark, str(tmp_path / "plain"), places).collect()] == ["r"]
    write_alignments(read_alignments(spark, str(tmp_path / "plain")), str(tmp_path / "store"))
    assert rows_of(read_alignments(spark, str(tmp_path / "store"))) == rows_of(spark.createDataFrame(rows, READS))


def test_samples_of_several_files(spark, tmp_path):
    line = lambda name, *tags: "\t".join([name, "0", "c", "11", "60", "5M", "*", "0", "0", "A", "I", *tags]) + "\n"
    (tmp_path / "a.sam").write_text("@RG\tID:1\tSM:one\n@RG\tID:2\tSM:two\n" + line("r1", "RG:Z:2") + line("r2", "NM:i:0", "RG:Z:1") + line("r3") + line("r4", "RG:Z:9"))
    (tmp_path / "b.sam").write_text("@RG\tID:1\tSM:\n@RG\tID:2\tSM:three\n" + line("r5", "RG:Z:1") + line("r6", "RG:Z:2"))
    (tmp_path / "c.sam").write_text("@SQ\tSN:c\n" + line("r7", "RG:Z:1"))
    got = {r.read_id: r.sample for r in read_sam(spark, str(tmp_path / "*.sam"), "NA").collect()}
    assert got == {"r1": "two", "r2": "one", "r3": "one", "r4": "one", "r5": "three", "r6": "three", "r7": "NA"}


def test_candidates_of_names_with_one_prefix(spark):
    names = spark.range(60_000).select(F.format_string("GENE%05d", F.col("id")).alias("gene_name"))
    aliases = spark.createDataFrame([], "alias string, gene_name string")
    asked = spark.createDataFrame([("GENE1234X",), ("gene00017a",), ("GENEA5678",)], "symbol string")
    known = names.select(F.col("gene_name").alias("name"), F.col("gene_name").alias("shown"), F.length("gene_name").cast("int").alias("len"))
    wanted = asked.select(F.upper("symbol").alias("asked"), F.length("symbol").cast("int").alias("asked_len"))
    met = annotation._by_deletions(wanted, known, False)
    assert met.groupBy("asked").count().agg(F.max("count")).first()[0] < 2_000
    got = [tuple(r) for r in suggest_genes(asked, names, aliases).orderBy("symbol", "rank").collect()]
    assert got[:2] == [("GENE00017A", 1, "GENE00017", 0.9), ("GENE00017A", 2, "GENE00007", 0.8)]
    assert [r[2] for r in got[5:10]] == [f"GENE1234{i}" for i in range(5)] and len(got) == 15


def test_suggestions_against_all_pairs(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("ABC1") for _ in range(rng.randint(1, 9)))
    names, asked = sorted({word() for _ in range(150)}), sorted({word() for _ in range(60)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = set()
    for a in asked:
        close = sorted((-(1 - distance(a, b) / max(len(a), len(b))), b) for b in names)
        want |= {(a, i, b, round(-s, 6)) for i, (s, b) in enumerate([c for c in close if -c[0] >= 0.6 - 1e-9][:5], 1)}
    got = suggest_genes(
        spark.createDataFrame([(a,) for a in asked], "symbol string"), spark.createDataFrame([(b,) for b in names], "gene_name string"),
        spark.createDataFrame([], "alias string, gene_name string"),
    )
    assert {tuple(r) for r in got.collect()} == want


def test_documents_in_pieces(spark, tmp_path):
    """A target with very many low blocks is written in bounded rows that make up its document."""
    samples = spark.createDataFrame([("S",)], "sample string")
    segments = spark.range(60_000).select(F.lit("S").alias("sample"), F.lit("c").alias("contig"), (F.col("id") * 40).alias("start"), (F.col("id") * 40 + 20 + F.col("id") % 9).alias("end"))
    targets = spark.createDataFrame([(1, "long", "c", 0, 2_400_000), (2, "none", "d", 5, 8), (3, "short", "c", 100, 300)], "ordinal long, target_id string, contig string, start bigint, end bigint")
    params = CoverageParams(low_threshold=1, low_min_len=5)
    report = coverage_report(depth_blocks(segments, params.bin_size), targets, samples, params)
    pieces = document_pieces(report.targets, report.low_blocks, report.histogram, params).collect()
    assert max(len(r.text) for r in pieces) < 200_000 and len(pieces) > 140
    texts = {}
    for r in sorted(pieces, key=lambda r: (r.ordinal, r.section, r.piece)):
        texts[r.ordinal] = texts.get(r.ordinal, "") + r.text
    whole = {r.ordinal: r.document for r in target_documents(report.targets, report.low_blocks, report.histogram, params).collect()}
    assert texts == {k: v + "\n" for k, v in whole.items()}
    assert len(json.loads(whole[1])["lowcov_blocks"]) >= 60_000 - 1
    paths = write_reports(report, str(tmp_path / "out"), "json", exon_only=False, input_path="x")
    back = [json.loads(line) for f in sorted((tmp_path / "out.json" / "targets").glob("part-*")) for line in f.read_text().split("\n") if line.strip()]
    assert {d["target_id"]: d for d in back} == {json.loads(v)["target_id"]: json.loads(v) for v in whole.values()}
    assert spark.read.json(paths["json"] + "/targets").count() == 3
    assert json.loads(spark.read.text(paths["json"] + "/run").first().value)["run"]["exon_only"] is False


def test_from_asked_targets_to_the_report(spark, store):
    genes = spark.createDataFrame([(1, "chrc1", 3_000_000, 3_010_000, "GENE1", "i", "+", "t"), (2, "chrc2", 100, 900, "OTHER", "i", "-", "t")], "line_no long, contig string, start bigint, end bigint, gene_name string, gene_id string, strand string, gene_type string")
    builtins = genes.where("line_no = 2").withColumn("gene_name", F.lit("SPARE"))
    aliases = spark.createDataFrame([("first", "GENE1")], "alias string, gene_name string")
    asked = spark.createDataFrame([(1, "gene1, First"), (2, "chrc0:1,000-2,000"), (3, "GENE2"), (4, "chr:x"), (5, "spare"), (6, "zzz")], "ordinal long, target string")
    samples = spark.createDataFrame([("S",)], "sample string")
    report, failures = asked_report(spark, store, asked, genes, aliases, samples, builtins=builtins, contig_style="nochr")
    got = {(r.ordinal.ordinal, r.ordinal.part): (r.target_id, r.contig, r.mean_depth) for r in report.targets.collect()}
    assert {k: v[:2] for k, v in got.items()} == {(1, 0): ("GENE1", "c1"), (1, 1): ("GENE1", "c1"), (2, 0): ("chrc0:1000-2000", "c0"), (5, 0): ("SPARE", "c2")}
    assert got[1, 0][2] > 1
    assert {r.ordinal: r.error for r in failures.collect()} == {3: "unknown gene; close: GENE1", 4: "malformed region", 6: "unknown gene"}
