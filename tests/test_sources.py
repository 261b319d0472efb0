"""Files in, files out."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators.annotation import contig_style, gene_lookup, sample_names, suggest_genes
from plumbline.operators.bed import BedLimitError, bed_sample, bed_targets, enforce_limits
from plumbline.operators.depth import bin_blocks, depth_blocks
from plumbline.params import ClassifyParams, CoverageParams
from plumbline.plans.report import coverage_report, covered_segments, gene_report, resolve_targets
from plumbline.sinks.reports import parse_formats, write_exon_tsv, write_low_bed, write_reports
from plumbline.sources.alignments import (
    header_contigs, header_read_groups, parse_sam, read_alignments, write_alignments,
)
from plumbline.sources.bed import bed_bytes, read_bed, read_bed_rejects
from plumbline.sources.catalogue import (
    builtin_aliases, builtin_genes, read_alias_map, read_exon_table, read_gene_table, read_gtf, write_catalogue,
)
from plumbline.operators.joins import target_places
from plumbline.sources.depth_files import (
    positions_to_blocks, read_depth_blocks, read_depth_lines, read_depth_store, write_depth_store,
)
from plumbline.sources.lines import read_lines


def test_lines_are_numbered_across_splits(spark, tmp_path):
    for name, n in (("a", 5000), ("b", 10)):
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = read_lines(spark, str(tmp_path))
        assert lines.count() == 5010
        wrong = lines.where(F.substring("value", 2, 10).cast("bigint") != F.col("line_no"))
        assert wrong.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_dirty_bed(spark, tmp_path):
    path = tmp_path / "t.bed"
    path.write_text(
        "# c\n\ntrack name=x\nbrowser pos\nchr1\t10\t20\tA\nchr1\tx\t20\nchr1\t30\t30\nchr1\t5\nchr2\t1\t9\textra\tz\nchr2\t7\t8\n"
    )
    rows = [tuple(r) for r in read_bed(spark, str(path)).orderBy("line_no").collect()]
    assert rows == [(5, "chr1", 10, 20, "A"), (9, "chr2", 1, 9, "extra"), (10, "chr2", 7, 8, "chr2:7-8")]
    reasons = [(r.line_no, r.reason) for r in read_bed_rejects(spark, str(path)).orderBy("line_no").collect()]
    assert reasons == [(6, "non-integer coordinates"), (7, "start >= end"), (8, "fewer than 3 columns")]
    assert bed_bytes(spark, str(path)) == path.stat().st_size


def test_bed_of_several_files(spark, tmp_path):
    (tmp_path / "a.bed").write_text("chr1\t10\t20\tA\nbad\nchr1\t30\t40\tB\n")
    (tmp_path / "b.bed").write_text("chr2\t10\t20\tC\nchr2\t30\n")
    bed = read_bed(spark, str(tmp_path))
    assert [(r.line_no, r.name) for r in bed.orderBy("line_no").collect()] == [(1, "A"), (3, "B"), (4, "C")]
    kept, _ = enforce_limits(bed, max_targets=2)
    assert sorted(r.name for r in kept.collect()) == ["A", "B"]
    rejects = read_bed_rejects(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.line_no, r.file_path.rsplit("/", 1)[1]) for r in rejects] == [(2, "a.bed"), (5, "b.bed")]


def _large_bed(spark):
    start = F.col("id") * 1000 + 1_000_000
    return spark.range(3000).select(
        (F.col("id") + 1).alias("line_no"), F.lit("chr1").alias("contig"), start.alias("start"),
        (start + 500).alias("end"), F.concat(F.lit("t"), "id").alias("name"),
    )


def test_bed_limits(spark):
    bed = _large_bed(spark)
    kept, message = enforce_limits(bed, max_targets=100)
    assert kept.count() == 100 and kept.agg(F.max("line_no")).first()[0] == 100
    assert message.first().message == (
        "BED guardrails triggered (warn_and_clip): target count (3000) exceeds --max-targets (100). "
        "Retained first 100 of 3000 targets (50,000 bp of 1,500,000 bp)."
    )
    kept, message = enforce_limits(bed, max_targets=10_000)
    assert kept.count() == 3000 and message.first().message == "All BED limits satisfied."
    kept, _ = enforce_limits(bed, max_targets=10_000, max_total_bp=2600)
    assert kept.count() == 5
    with pytest.raises(BedLimitError, match="exceeds --max-targets"):
        enforce_limits(bed, max_targets=100, mode="error")


def test_bed_sample_is_deterministic(spark):
    bed = _large_bed(spark)
    draw = lambda seed: sorted(r.line_no for r in bed_sample(bed, 50, 10**9, seed).collect())
    assert len(draw(1)) == 50
    assert draw(1) == draw(1) != draw(2)


SAM = """@HD\tVN:1.6
@SQ\tSN:chr17\tLN:83257441
@RG\tID:1\tSM:
@RG\tID:2\tPL:X
@RG\tID:3\tSM:SYNTH
r1\t0\tchr17\t101\t60\t50M\t*\t0\t0\tA\tI
r2\t1024\tchr17\t101\t60\t50M\t*\t0\t0\tA\tI
r3\t16\tchr17\t121\t60\t10M5D10M\t*\t0\t0\tA\tI
"""


def test_sam(spark, tmp_path):
    path = tmp_path / "x.sam"
    path.write_text(SAM)
    lines = read_lines(spark, str(path))
    reads = parse_sam(lines, "SYNTH")
    assert contig_style(header_contigs(lines)).first().contig_style == "chr"
    assert sample_names(header_read_groups(lines)).first().sample_name == "SYNTH"
    assert header_contigs(lines).first().ln == 83257441
    write_alignments(reads, str(tmp_path / "reads"))
    again = read_alignments(spark, str(tmp_path / "reads"))
    blocks = depth_blocks(covered_segments(again), 64).orderBy("start").collect()
    assert [(r.start, r.end, r.depth) for r in blocks] == [
        (100, 120, 1), (120, 128, 2), (128, 130, 2), (130, 135, 1), (135, 145, 2), (145, 150, 1)
    ]


def test_depth_files(spark, tmp_path):
    with gzip.open(tmp_path / "d.bed.gz", "wt") as f:
        f.write("chr1\t0\t5\t3.0\nchr1\t5\t7\t0\nshort\t1\t2\nchr1\t7\t9\t2.9\n")
    blocks = read_depth_blocks(spark, str(tmp_path / "d.bed.gz"), "S")
    assert [tuple(r) for r in blocks.collect()] == [
        ("S", "chr1", 0, 5, 3), ("S", "chr1", 5, 7, 0), ("S", "chr1", 7, 9, 2)
    ]
    assert bin_blocks(blocks, 4).count() == 4
    (tmp_path / "d.txt").write_text("chr1\t1\t4\nchr1\t2\nchr1\t3\t6\n")
    lines = read_depth_lines(spark, str(tmp_path / "d.txt"), "S")
    assert [tuple(r) for r in lines.collect()] == [("S", "chr1", 0, 4), ("S", "chr1", 2, 6)]
    assert positions_to_blocks(lines, 100).count() == 2


GTF = """#comment
chr17\tH\tgene\t43044295\t43125482\t.\t-\t.\tgene_id "E1"; gene_type "protein_coding"; gene_name "BRCA1";
chr17\tH\tgene\t5\t9\t.\t-\t.\tgene_id "E2"; gene_type "lncRNA";
chr17\tH\texon\t43044295\t43045802\t.\t-\t.\tgene_id "E1"; transcript_id "T1"; gene_name "BRCA1"; exon_number 23; exon_id "X1"; tag "basic"; tag "MANE_Select";
chr17\tH\texon\t43044295\t43045802\t.\t-\t.\tgene_id "E1"; transcript_id "T2"; gene_name "BRCA1"; exon_number 1; exon_id "X2"; tag "basic";
"""


def test_gtf(spark, tmp_path):
    path = tmp_path / "g.gtf"
    path.write_text(GTF)
    genes, exons = read_gtf(spark, str(path))
    assert [tuple(r) for r in genes.drop("line_no").collect()] == [
        ("chr17", 43044294, 43125482, "BRCA1", "E1", "-", "protein_coding")
    ]
    assert [tuple(r) for r in exons.drop("line_no").collect()] == [
        ("chr17", 43044294, 43045802, "X1", "BRCA1", "23", "T1")
    ]
    write_catalogue(genes, str(tmp_path / "genes"))
    assert spark.read.parquet(str(tmp_path / "genes")).first().contig_rank == 17


def test_tables_and_aliases(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("#contig\tstart\nchr1\t1\t9\tA\tid\t+\tx\nchr1\t1\t9\n")
    assert read_gene_table(spark, str(tmp_path / "g.tsv")).first().gene_name == "A"
    (tmp_path / "e.tsv").write_text("chr1\t1\t9\tX\tA\t2\tT\n")
    assert read_exon_table(spark, str(tmp_path / "e.tsv")).first().exon_number == "2"
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        json.dump({"her2": "ERBB2", "x": "Y"}, f, indent=1)
    assert sorted(tuple(r) for r in read_alias_map(spark, str(tmp_path / "a.json.gz")).collect()) == [
        ("her2", "ERBB2"), ("x", "Y")
    ]


def test_builtin_genes(spark):
    genes, aliases = builtin_genes(spark), builtin_aliases(spark)
    asked = spark.createDataFrame(
        [(1, "brca1"), (2, " Her2 "), (3, "p53"), (4, "NOPE"), (5, "BRCA")], "ordinal bigint, symbol string"
    )
    found = {r.ordinal: r for r in gene_lookup(asked, genes, aliases, "line_no").collect()}
    assert (found[1].contig, found[1].start, found[1].end) == ("chr17", 43044294, 43125482)
    assert [found[i].gene_name for i in (2, 3, 4)] == ["ERBB2", "TP53", None]
    close = suggest_genes(asked.where("ordinal = 5"), genes, aliases).orderBy("rank").collect()
    assert [r.suggestion for r in close][:2] == ["BRCA1", "BRCA2"]
    assert close[0].similarity == 0.8


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_suggestions_equal_brute_force(spark):
    genes, aliases = builtin_genes(spark), builtin_aliases(spark)
    words = ["BRCA", "TP5", "MSH", "ERB2", "CYP2", "KRASS", "A", "XX", "PIK3", "RAD51", "SMAD44", "HER", "GBA2", "FGF"]
    asked = spark.createDataFrame(list(enumerate(words)), "ordinal bigint, symbol string")
    got = {(r.symbol, r.suggestion, r.similarity) for r in suggest_genes(asked, genes, aliases, n=1000).collect()}
    known = [(r.gene_name.upper(), r.gene_name) for r in genes.collect()]
    known += [(r.alias.upper(), r.gene_name) for r in aliases.collect()]
    want = {}
    for w in words:
        for name, shown in known:
            s = 1 - _edits(w, name) / max(len(w), len(name))
            if s >= 0.6 - 1e-9:
                want[w, shown] = max(s, want.get((w, shown), 0))
    assert got == {(w, shown, round(s, 6)) for (w, shown), s in want.items()}
    assert len(got) > 15


def test_resolve_targets(spark):
    asked = spark.createDataFrame(
        [(1, "chr17:43,044,295-43,125,482"), (2, "BRCA1, tp53,"), (3, "chr1:5"), (4, "chr1:5-5"), (5, "ZZZ9")],
        "ordinal bigint, target string",
    )
    targets, failures = resolve_targets(asked, builtin_genes(spark), builtin_aliases(spark))
    rows = [(*r.ordinal, r.target_id, r.start) for r in targets.orderBy("ordinal").collect()]
    assert rows == [
        (1, 0, "chr17:43044295-43125482", 43044294), (2, 0, "BRCA1", 43044294), (2, 1, "TP53", 7668401)
    ]
    assert {(r.ordinal, r.error) for r in failures.collect()} == {
        (3, "malformed region"), (4, "invalid region: order"), (5, "unknown gene")
    }


def _report(spark, tmp_path, **kwargs):
    (tmp_path / "t.bed").write_text("chr1\t0\t100\tA\nchr1\t50\t150\tB\nchr2\t0\t10\tA\n")
    targets = bed_targets(read_bed(spark, str(tmp_path / "t.bed")))
    blocks = spark.createDataFrame(
        [("S1", "chr1", 0, 100, 30), ("S1", "chr1", 100, 120, 5), ("S2", "chr2", 0, 10, 25)],
        "sample string, contig string, start bigint, end bigint, depth bigint",
    )
    params = CoverageParams(bin_size=64, low_min_len=10)
    samples = spark.createDataFrame([("S1",), ("S2",)], "sample string")
    return coverage_report(bin_blocks(blocks, 64), targets, samples, params, ClassifyParams(), **kwargs)


def _text(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_report_files(spark, tmp_path):
    report = _report(spark, tmp_path)
    paths = write_reports(report, str(tmp_path / "out"), "tsv,json,multiqc", input_path="x.sam")
    tsv = _text(tmp_path / "out.tsv").splitlines()
    rows = [line.split("\t") for line in tsv if not line.startswith("sample_name")]
    assert tsv[0].split("\t")[:4] == ["sample_name", "target_id", "contig", "start"] and len(rows) == 6
    first = dict(zip(tsv[0].split("\t"), next(r for r in rows if r[:2] == ["S1", "B"])))
    assert (first["mean_depth"], first["pct_zero"], first["coverage_status"]) == ("16.0", "30.0", "DROP_OUT")
    # a file ends with a line of one blank
    documents = [json.loads(x) for x in _text(tmp_path / "out.json" / "targets").splitlines() if x.strip()]
    assert len(documents) == 6
    b = next(x for x in documents if x["target_id"] == "B" and x["max_depth"] == 30)
    assert b["histogram"] == {"0": 30, "5": 20, "30": 50}
    assert b["lowcov_blocks"] == [{"contig": "chr1", "start": 100, "end": 150, "length": 50, "mean_depth": 2.0}]
    run = [json.loads(x) for x in _text(tmp_path / "out.json" / "run").splitlines()]
    assert {x["run"]["sample_name"]: x["summary"]["n_pass"] for x in run} == {"S1": 1, "S2": 1}
    multiqc = json.loads(_text(tmp_path / "out_mqc.json"))
    assert multiqc["data"]["S1"]["n_targets"] == 3 and multiqc["data"]["S1"]["worst_status"] == "DROP_OUT"
    assert set(paths) == {"tsv", "json", "multiqc"}
    write_low_bed(report, str(tmp_path / "low"))
    assert "chr1\t100\t150\tB\tmean_depth=2.0" in _text(tmp_path / "low")


def test_exon_report(spark, tmp_path):
    genes = spark.createDataFrame(
        [(1, "chr1", 0, 100, "G"), (2, "chr1", 0, 50, "H")],
        "ordinal bigint, contig string, start bigint, end bigint, gene_name string",
    )
    exons = spark.createDataFrame(
        [("chr1", 0, 10, "e1", "g", "1", "t"), ("chr1", 90, 110, "e2", "G", "2", "t"), ("chr2", 0, 9, "e3", "G", "3", "t")],
        "contig string, start bigint, end bigint, exon_id string, gene_name string, exon_number string, transcript_id string",
    )
    blocks = bin_blocks(
        spark.createDataFrame([("S", "1", 0, 100, 30)], "sample string, contig string, start bigint, end bigint, depth bigint"), 64
    )
    samples = spark.createDataFrame([("S",)], "sample string")
    params = CoverageParams(bin_size=64, low_min_len=5)
    report = gene_report(blocks, genes, samples, exons, True, True, "nochr", params)
    rows = {r.target_id: r for r in report.targets.collect()}
    # G: 20 of its 30 exonic positions are covered; H has no exons and is measured whole
    assert (rows["G"].length_bp, rows["G"].start, rows["G"].end, rows["G"].mean_depth) == (30, 0, 100, 20.0)
    assert (rows["G"].n_lowcov_blocks, rows["G"].coverage_status) == (1, "DROP_OUT")
    assert (rows["H"].length_bp, rows["H"].coverage_status) == (50, "PASS")
    whole = gene_report(blocks, genes, samples, exons, True, False, "nochr", params)
    assert {r.target_id: r.coverage_status for r in whole.targets.collect()} == {"G": "LOW_EXON", "H": "PASS"}
    plain = gene_report(blocks, genes, samples, exons, contig_style="nochr", params=params)
    assert {r.target_id: r.coverage_status for r in plain.targets.collect()} == {"G": "PASS", "H": "PASS"}
    write_exon_tsv(whole, str(tmp_path / "exons"))
    assert "G\te1\t1\t1\t0\t10\t10\t30.0\t30.0\t0.0\t100.0\t100.0" in _text(tmp_path / "exons")


def test_formats():
    assert parse_formats(" TSV,json,tsv ") == ["tsv", "json"]
    for bad in ("", "pdf"):
        with pytest.raises(ValueError):
            parse_formats(bad)


def test_depth_store_reads_only_target_ranges(spark, tmp_path, capsys):
    blocks = depth_blocks(
        spark.range(5000).select(
            F.lit("S").alias("sample"), F.concat(F.lit("c"), F.col("id") % 3).alias("contig"),
            F.col("id").alias("start"), (F.col("id") + 5).alias("end"),
        ), 64,
    )
    path = str(tmp_path / "store")
    write_depth_store(blocks, path)
    samples = spark.createDataFrame([("S",)], "sample string")
    params = CoverageParams(bin_size=64)

    def report(n):
        targets = spark.range(n).select(
            F.col("id").alias("ordinal"), F.lit("t").alias("target_id"), F.concat(F.lit("c"), F.col("id") % 2).alias("contig"),
            (F.col("id") * 40).alias("start"), (F.col("id") * 40 + 30).alias("end"),
        )
        places = target_places(targets, 64)
        stored = read_depth_store(spark, path, places)
        rows = coverage_report(stored, targets, samples, params).targets
        want = coverage_report(blocks, targets, samples, params).targets
        assert sorted(map(str, rows.collect())) == sorted(map(str, want.collect()))
        return stored

    few = report(3)
    assert few.where("contig = 'c2'").count() == 0
    few.explain("formatted")
    pushed = next(line for line in capsys.readouterr().out.splitlines() if "PushedFilters" in line)
    assert "EqualTo(contig,c0)" in pushed and "GreaterThan(end,40)" in pushed
    assert report(90).where("contig = 'c2'").count() == 0


def test_exon_files_keep_their_sample(spark, tmp_path):
    from types import SimpleNamespace

    from plumbline.sinks.reports import write_exon_tsv, write_low_bed

    columns = "sample string, gene_name string, exon_id string, exon_number long, contig string, start long, end long, length_bp long, mean_depth double, median_depth double, pct_zero double, pct_ge_20 double, pct_ge_30 double"
    exons = spark.createDataFrame([(s, "G", "e", n, "c", 1, 5, 4, 1.0, 1.0, 0.0, 0.0, 0.0) for s in "AB" for n in (2, 1)], columns)
    low = spark.createDataFrame([(s, "c", 1, 5, "t", 8, 4) for s in "AB"], "sample string, contig string, start long, end long, target_id string, depth_sum long, length long")
    report = SimpleNamespace(exons=exons, low_blocks=low)
    write_exon_tsv(report, str(tmp_path / "exons"))
    write_low_bed(report, str(tmp_path / "low"))
    back = spark.read.csv(str(tmp_path / "exons"), sep="\t", header=True)
    assert sorted((r.sample_name, r.exon_number) for r in back.collect()) == [("A", "1"), ("A", "2"), ("B", "1"), ("B", "2")]
    assert {r.sample_name for r in spark.read.csv(str(tmp_path / "low"), sep="\t").toDF("c", "s", "e", "t", "d", "sample_name").collect()} == {"A", "B"}


def test_depth_store_pushes_the_span_of_many_targets(spark, tmp_path, capsys):
    segments = spark.range(9000).select(
        F.lit("S").alias("sample"), F.concat(F.lit("c"), F.col("id") % 3).alias("contig"),
        F.col("id").alias("start"), (F.col("id") + 5).alias("end"),
    )
    blocks = depth_blocks(segments, 64)
    write_depth_store(blocks, str(tmp_path / "store"))
    targets = spark.range(100).select(
        F.col("id").alias("ordinal"), F.lit("t").alias("target_id"), F.lit("c1").alias("contig"),
        (F.col("id") * 40 + 1000).alias("start"), (F.col("id") * 40 + 1030).alias("end"),
    )
    stored = read_depth_store(spark, str(tmp_path / "store"), target_places(targets, 64))
    stored.explain("formatted")
    pushed = next(line for line in capsys.readouterr().out.splitlines() if "PushedFilters" in line)
    assert "LessThan(start,4990)" in pushed and "GreaterThan(end,1000)" in pushed
    assert stored.where("contig <> 'c1'").count() == 0
    # only blocks that overlap a target, though the span of all was sent
    met = [any(r.start < 40 * i + 1030 and r.end > 40 * i + 1000 for i in range(100)) for r in blocks.where("contig = 'c1'").collect()]
    assert stored.count() == sum(met) < len(met)
