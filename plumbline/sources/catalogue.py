"""Gene and exon catalogues: GTF parsing, the derived tables, alias maps and the built-in genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.annotation import EXON_COLUMNS, GENE_COLUMNS, catalogue_rank
from plumbline.sources.builtin_genes import BUILTIN_ALIASES, BUILTIN_GENES
from plumbline.sources.lines import fields, part, read_lines

# Fixed value: exons are taken from transcripts with this tag.
EXON_TAG = "MANE_Select"


def _attribute(name: str) -> Column:
    """Value of a GTF attribute, unquoted; the last one counts, and a missing one is empty."""
    items = F.transform(F.split(part(8), ";"), lambda a: F.trim(a))
    named = F.filter(items, lambda a: (a == name) | F.startswith(a, F.lit(name + " ")))
    last = F.try_element_at(named, F.lit(-1))
    return F.coalesce(F.trim(F.substr(last, F.lit(len(name) + 2)), F.lit('"')), F.lit(""))


def _features(lines: DataFrame, kind: str) -> DataFrame:
    return fields(lines.where(~F.startswith("value", F.lit("#"))), 9).where(part(2) == kind)


def parse_gtf_genes(lines: DataFrame) -> DataFrame:
    """Gene features; 1-based starts become 0-based, unnamed genes are dropped."""
    return _features(lines, "gene").select(
        *_carried(lines),
        part(0).alias("contig"), (part(3).cast("bigint") - 1).alias("start"), part(4).cast("bigint").alias("end"),
        _attribute("gene_name").alias("gene_name"), _attribute("gene_id").alias("gene_id"),
        part(6).alias("strand"), _attribute("gene_type").alias("gene_type"),
    ).where(F.col("gene_name") != "")


def parse_gtf_exons(lines: DataFrame) -> DataFrame:
    """Exon features of the tagged transcripts; a missing exon number is "0"."""
    number = _attribute("exon_number")
    return _features(lines, "exon").where(F.contains(part(8), F.lit(EXON_TAG))).select(
        *_carried(lines),
        part(0).alias("contig"), (part(3).cast("bigint") - 1).alias("start"), part(4).cast("bigint").alias("end"),
        _attribute("exon_id").alias("exon_id"), _attribute("gene_name").alias("gene_name"),
        F.when(number == "", "0").otherwise(number).alias("exon_number"),
        _attribute("transcript_id").alias("transcript_id"),
    )


def parse_gene_table(lines: DataFrame) -> DataFrame:
    """The seven-column gene table; comment and short lines are skipped."""
    return _table(lines, GENE_COLUMNS)


def parse_exon_table(lines: DataFrame) -> DataFrame:
    return _table(lines, EXON_COLUMNS)


def _table(lines: DataFrame, columns: list[str]) -> DataFrame:
    rows = fields(lines.where(~F.startswith("value", F.lit("#"))), len(columns))
    typed = {"start": "bigint", "end": "bigint"}
    return rows.select(
        *_carried(lines), *[part(i).cast(typed.get(c, "string")).alias(c) for i, c in enumerate(columns)]
    )


def parse_alias_json(documents: DataFrame) -> DataFrame:
    """``alias, gene_name`` rows of JSON objects in ``value``."""
    pairs = F.explode(F.from_json("value", "map<string,string>"))
    return documents.select(pairs.alias("alias", "gene_name"))


def read_gene_table(spark: SparkSession, path: str) -> DataFrame:
    return parse_gene_table(read_lines(spark, path))


def read_exon_table(spark: SparkSession, path: str) -> DataFrame:
    return parse_exon_table(read_lines(spark, path))


def read_alias_map(spark: SparkSession, path: str) -> DataFrame:
    return parse_alias_json(spark.read.text(path, wholetext=True))


def read_gtf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Genes and exons of a GTF file."""
    lines = read_lines(spark, path)
    return parse_gtf_genes(lines), parse_gtf_exons(lines)


def write_catalogue(table: DataFrame, path: str) -> None:
    """Write genes or exons as Parquet in catalogue order, which lets scans prune by contig and start."""
    (
        table.withColumn("contig_rank", catalogue_rank(F.col("contig")))
        .repartitionByRange("contig_rank", "contig", "start")
        .sortWithinPartitions("contig_rank", "contig", "start")
        .write.mode("overwrite").parquet(path)
    )


def builtin_genes(spark: SparkSession) -> DataFrame:
    """The built-in clinical genes with a ``line_no`` in their listed order."""
    rows = [
        (n, c, int(s), int(e), g, i, st, t)
        for n, (g, c, s, e, st, i, t) in enumerate(line.split("\t") for line in BUILTIN_GENES.strip().splitlines())
    ]
    return spark.createDataFrame(
        rows,
        "line_no bigint, contig string, start bigint, end bigint, gene_name string, gene_id string, strand string, "
        "gene_type string",
    )


def builtin_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(alias.lower(), name) for alias, name in BUILTIN_ALIASES.items()], "alias string, gene_name string"
    )


def _carried(lines: DataFrame) -> list[str]:
    return ["line_no"] if "line_no" in lines.columns else []
