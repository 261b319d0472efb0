"""Genes and exons: resolving names, finding genes in regions, exon sets, header metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.intervals import length_bp, overlaps, strip
from plumbline.operators.joins import BROADCAST_ROWS, fits_broadcast, interval_set, keyed_join, span_join
from plumbline.operators.order import numbered
from plumbline.session import cut_lineage

GENE_COLUMNS = ["contig", "start", "end", "gene_name", "gene_id", "strand", "gene_type"]
EXON_COLUMNS = ["contig", "start", "end", "exon_id", "gene_name", "exon_number", "transcript_id"]

# Fixed value: names of contigs without the chr prefix.
BARE_CONTIG = r"^([0-9]{1,2}|X|Y|MT?)$"


def contig_style(contigs: DataFrame) -> DataFrame:
    """Naming style per sample from header contigs (``sample, sn``): chr, nochr or null with an error."""
    counts = contigs.groupBy("sample").agg(
        F.count(F.when(F.startswith("sn", F.lit("chr")), 1)).alias("n_chr"),
        F.count(F.when(F.col("sn").rlike(BARE_CONTIG), 1)).alias("n_bare"),
        F.count("sn").alias("n_contigs"),
    )
    style = F.when((F.col("n_chr") > 0) & (F.col("n_bare") == 0), "chr").when(
        (F.col("n_bare") > 0) & (F.col("n_chr") == 0), "nochr"
    )
    error = F.when(F.col("n_contigs") == 0, "no contigs").when(style.isNull(), "ambiguous contig style")
    return counts.select("sample", style.alias("contig_style"), error.alias("error"))


def sample_names(read_groups: DataFrame) -> DataFrame:
    """First non-empty SM of each file's read groups (``sample_file, ordinal, sm``), else NA."""
    named = F.when(F.col("sm") != "", F.col("sm"))
    first = F.min(F.when(named.isNotNull(), F.struct("ordinal", named.alias("sm"))))
    return read_groups.groupBy("sample_file").agg(F.coalesce(first["sm"], F.lit("NA")).alias("sample_name"))


def alias_map(genes: DataFrame, order: str) -> DataFrame:
    """Lower-cased name to name; the last row by ``order`` wins."""
    return genes.groupBy(F.lower("gene_name").alias("alias")).agg(F.max_by("gene_name", order).alias("gene_name"))


def gene_lookup(
    symbols: DataFrame, genes: DataFrame, aliases: DataFrame, order: str, builtins: DataFrame | None = None
) -> DataFrame:
    """Resolve ``ordinal, symbol`` rows, ignoring case: by the name itself, else through its alias.

    ``aliases`` holds ``alias`` (lower case) and ``gene_name``. Symbols that the catalogue lacks are looked up in ``builtins``
    in the same way. Unknown symbols keep a row with null gene columns.
    """
    record = F.struct(*GENE_COLUMNS)
    known = genes.select(*GENE_COLUMNS, order, F.lit(0).alias("source"))
    if builtins is not None:
        known = known.unionByName(builtins.select(*GENE_COLUMNS, order, F.lit(1).alias("source")))
    of = lambda source: F.max_by(F.when(F.col("source") == source, record), F.when(F.col("source") == source, F.col(order)))
    catalogue = known.groupBy(F.upper("gene_name").alias("name_key")).agg(F.struct(of(0).alias("listed"), of(1).alias("built_in")).alias("r"))
    names = symbols.withColumn("name_key", F.upper(strip(F.col("symbol")))).withColumn("alias", F.lower("name_key"))
    canonical = aliases.groupBy("alias").agg(F.upper(F.max("gene_name")).alias("canonical_key"))
    direct = catalogue.select("name_key", F.col("r").alias("own"))
    via = catalogue.select(F.col("name_key").alias("canonical_key"), F.col("r").alias("via"))
    small = fits_broadcast(known.select("gene_name").unionByName(aliases.select("gene_name")))
    found = keyed_join(names, canonical, ["alias"], "left", small)
    found = keyed_join(found, direct, ["name_key"], "left", small)
    found = keyed_join(found, via, ["canonical_key"], "left", small)
    either = F.coalesce("own.listed", "via.listed", "own.built_in", "via.built_in")
    return found.withColumn("r", either).select("ordinal", "symbol", "r.*")


def gene_lookup_missing(
    symbols: DataFrame, genes: DataFrame, aliases: DataFrame, order: str, builtins: DataFrame | None = None
) -> DataFrame:
    """Symbols that resolve to no gene."""
    return gene_lookup(symbols, genes, aliases, order, builtins).where(F.col("gene_name").isNull()).select("ordinal", "symbol")


def deletions(text: str) -> Column:
    """The spellings of a column with at most two letters deleted, once each. Two texts at up to two edits share one."""
    without = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1)))
    once = without(F.col(text))
    return F.array_distinct(F.concat(F.array(F.col(text)), once, F.flatten(F.transform(once, without))))


def _by_deletions(asked: DataFrame, known: DataFrame, small: bool) -> DataFrame:
    """Pairs of at most two edits: ``asked, asked_len, name, len, shown, edits``, from the deletions they share."""
    keys = known.select("name", "len", "shown", F.explode(deletions("name")).alias("key"))
    wanted = asked.select("asked", "asked_len", F.explode(deletions("asked")).alias("key"))
    met = keyed_join(wanted, keys, ["key"], small=small or None).where(F.abs(F.col("len") - F.col("asked_len")) <= 2)
    pairs = met.select("asked", "asked_len", "name", "len", "shown").distinct()
    return pairs.withColumn("edits", F.levenshtein("asked", "name", 2)).where(F.col("edits") >= 0)


def _by_pieces(asked: DataFrame, known: DataFrame, cutoff: float, small: bool) -> DataFrame:
    """Pairs that may reach ``cutoff``, from an exact filter, with their ``edits``.

    Cut a name into one piece more than the edits allowed, and one piece must occur unchanged in the symbol, shifted by at
    most that many places.
    """
    share = F.lit(1.0 - cutoff)
    # small slack keeps floating point from losing an edit at the exact cutoff
    edits = F.floor(F.greatest("len", "asked_len") * share + 1e-9).cast("int")

    def partner(own: str, other: str) -> Column:
        lo = F.ceil(F.col(own) * cutoff - 1e-9).cast("int")
        hi = F.floor(F.col(own) / cutoff + 1e-9).cast("int")
        return F.explode(F.sequence(F.greatest(lo, F.lit(1)), hi)).alias(other)

    pieces = (
        known.select("name", "len", "shown", partner("len", "asked_len"))
        .withColumn("k", edits)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
        .withColumn("from", F.floor(F.col("i") * F.col("len") / (F.col("k") + 1)).cast("int"))
        .withColumn("to", F.floor((F.col("i") + 1) * F.col("len") / (F.col("k") + 1)).cast("int"))
        .withColumn("piece", F.substr("name", F.col("from") + 1, F.col("to") - F.col("from")))
        .select("name", "len", "shown", "asked_len", "i", "piece")
    )
    windows = (
        asked.select("asked", "asked_len", partner("asked_len", "len"))
        .withColumn("k", edits)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
        .withColumn("from", F.floor(F.col("i") * F.col("len") / (F.col("k") + 1)).cast("int"))
        .withColumn("size", F.floor((F.col("i") + 1) * F.col("len") / (F.col("k") + 1)).cast("int") - F.col("from"))
        .withColumn("first", F.greatest(F.col("from") - F.col("k"), F.lit(0)))
        .withColumn("last", F.least(F.col("from") + F.col("k"), F.col("asked_len") - F.col("size")))
        .where(F.col("first") <= F.col("last"))
        .withColumn("at", F.explode(F.sequence("first", "last")))
        .select("asked", "asked_len", "len", "i", F.substr("asked", F.col("at") + 1, F.col("size")).alias("piece"))
        .distinct()
    )
    pairs = keyed_join(windows, pieces, ["len", "asked_len", "i", "piece"], small=small or None)
    return pairs.select("asked", "asked_len", "name", "len", "shown").distinct().withColumn("edits", F.levenshtein("asked", "name"))


def suggest_genes(
    unknown: DataFrame, names: DataFrame, aliases: DataFrame, n: int = 5, cutoff: float = 0.6
) -> DataFrame:
    """Up to ``n`` close catalogue names per unknown symbol, best first: ``symbol, rank, suggestion, similarity``.

    Similarity is ``1 - levenshtein / longer length``. Names at up to two edits are found by the spellings that both have
    with letters deleted, which names of one family share only where they are alike in all other letters. A symbol whose
    ``n`` best ones are beyond what three edits can reach is settled; only for the others a wider filter is used.
    Aliases count as names and are shown as the gene they stand for.
    """
    known = (
        names.select(F.upper("gene_name").alias("name"), F.col("gene_name").alias("shown"))
        .unionByName(aliases.select(F.upper("alias").alias("name"), F.col("gene_name").alias("shown")))
        .groupBy("name").agg(F.min("shown").alias("shown"))
        .withColumn("len", F.length("name").cast("int"))
    )
    asked = (
        unknown.select(F.upper(strip(F.col("symbol"))).alias("asked")).distinct()
        .withColumn("asked_len", F.length("asked").cast("int")).where(F.col("asked_len") > 0)
    )
    # a name or alias of length n makes at most about n * n deletions or pieces
    spelled = names.select(F.col("gene_name").alias("name")).unionByName(aliases.select(F.col("alias").alias("name")))
    size = spelled.agg(F.coalesce(F.sum(F.length("name") * F.length("name")), F.lit(0))).first()[0]
    small = size <= BROADCAST_ROWS
    similarity = 1.0 - F.col("edits") / F.greatest("len", "asked_len")

    def best(pairs: DataFrame) -> DataFrame:
        close = pairs.withColumn("similarity", similarity).where(F.col("similarity") >= cutoff - 1e-9)
        shown = close.groupBy("asked", "asked_len", "shown").agg(F.max("similarity").alias("similarity"))
        rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("similarity"), "shown"))
        return shown.withColumn("rank", rank).where(F.col("rank") <= n)

    near = cut_lineage(best(_by_deletions(asked, known, small)))
    # three edits reach at most the similarity of a name with three more letters
    reach = F.col("asked_len") / (F.col("asked_len") + 3)
    settled = near.where((F.col("rank") == n) & (F.col("similarity") > reach + 1e-9)).select("asked")
    short = asked.where(reach < cutoff - 1e-9).select("asked")
    done = settled.unionByName(short).distinct()
    others = asked.join(done, "asked", "left_anti")
    found = near.join(done, "asked", "left_semi").unionByName(best(_by_pieces(others, known, cutoff, small)))
    return found.select(
        F.col("asked").alias("symbol"), F.col("rank").cast("bigint").alias("rank"), F.col("shown").alias("suggestion"),
        F.round(F.col("similarity"), 6).alias("similarity"),
    )


def genes_in_region(
    regions: DataFrame, genes: DataFrame, builtins: DataFrame | None, order: str, bin_size: int
) -> DataFrame:
    """Genes overlapping each region (``ordinal, contig, start, end``), once per name: the first by start.

    ``builtins`` supplements names the catalogue did not give. Result: ``region_ordinal`` and the gene columns.
    """
    wanted = regions.select(
        F.col("ordinal").alias("region_ordinal"),
        F.when(F.startswith("contig", F.lit("chr")), F.col("contig"))
        .otherwise(F.concat(F.lit("chr"), "contig")).alias("contig"),
        F.col("start").alias("t_start"), F.col("end").alias("t_end"),
    )
    known = genes.select(*GENE_COLUMNS, order, F.lit(0).alias("source"))
    if builtins is not None:
        known = known.unionByName(builtins.select(*GENE_COLUMNS, order, F.lit(1).alias("source")))
    hits = span_join(known, interval_set(wanted, bin_size))
    record = F.struct("contig", "start", "end", "gene_id", "strand", "gene_type")
    return (
        hits.groupBy("region_ordinal", "gene_name")
        .agg(F.min_by(record, F.struct("source", "start", order)).alias("r"))
        .select("region_ordinal", "r.contig", "r.start", "r.end", "gene_name", "r.gene_id", "r.strand", "r.gene_type")
    )


def exon_lookup(genes: DataFrame, exons: DataFrame) -> DataFrame:
    """Exons of each gene row: same contig and name (ignoring case), overlapping the gene span.

    ``genes`` has ``gene_ordinal``, ``contig``, ``start``, ``end``, ``gene_name``. A non-numeric exon number becomes 0.
    ``gene`` is the gene's own name, as the exon table may spell it in another case.
    """
    wanted = genes.select(
        "gene_ordinal", "contig", F.upper("gene_name").alias("name_key"), F.col("gene_name").alias("gene"),
        F.col("start").alias("gene_start"), F.col("end").alias("gene_end"),
    )
    numbered = exons.withColumn("name_key", F.upper("gene_name")).withColumn("exon_number", exon_number("exon_number"))
    joined = keyed_join(numbered, wanted, ["contig", "name_key"])
    return joined.where(
        overlaps(F.col("start"), F.col("end"), F.col("gene_start"), F.col("gene_end"))
    ).select("gene_ordinal", "gene", *EXON_COLUMNS)


def exon_number(column: str) -> Column:
    text = F.col(column).cast("string")
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def region_overlay(
    regions: DataFrame, genes: DataFrame, builtins: DataFrame | None, exons: DataFrame, order: str, bin_size: int
) -> tuple[DataFrame, DataFrame]:
    """Genes of each region clipped to it, and their exons clipped to it.

    First frame: ``region_ordinal`` and the gene columns; second: ``region_ordinal``, the gene's own name in
    ``region_gene`` (exon tables may spell it in another case) and the exon columns.
    """
    found = genes_in_region(regions, genes, builtins, order, bin_size)
    spans = regions.select(
        F.col("ordinal").alias("region_ordinal"), F.col("start").alias("region_start"), F.col("end").alias("region_end")
    )
    placed = keyed_join(found, spans, ["region_ordinal"])
    clipped_genes = placed.withColumns(
        {"start": F.greatest("start", "region_start"), "end": F.least("end", "region_end")}
    ).drop("region_start", "region_end")
    wanted = placed.select(
        "region_ordinal", "contig", F.upper("gene_name").alias("name_key"), F.col("gene_name").alias("region_gene"),
        F.col("start").alias("gene_start"), F.col("end").alias("gene_end"), "region_start", "region_end",
    )
    numbered = exons.withColumn("name_key", F.upper("gene_name")).withColumn("exon_number", exon_number("exon_number"))
    clipped_exons = (
        keyed_join(numbered, wanted, ["contig", "name_key"])
        .where(overlaps(F.col("start"), F.col("end"), F.col("gene_start"), F.col("gene_end")))
        .withColumns({"start": F.greatest("start", "region_start"), "end": F.least("end", "region_end")})
        .where(F.col("start") < F.col("end"))
        .select("region_ordinal", "region_gene", *EXON_COLUMNS)
    )
    return clipped_genes, clipped_exons


def genes_without_exons(genes: DataFrame, exons: DataFrame) -> DataFrame:
    """Gene rows (``gene_ordinal``) that got no exon; they fall back to whole-gene metrics."""
    return keyed_join(genes, exons.select("gene_ordinal").distinct(), ["gene_ordinal"], "left_anti")


def catalogue_rank(contig: Column) -> Column:
    """chr1..chr22, then X, Y, M, and 99 for the rest."""
    number = F.regexp_extract(contig, "^chr([1-9]|1[0-9]|2[0-2])$", 1).try_cast("bigint")
    return F.coalesce(
        number,
        F.when(contig == "chrX", 23).when(contig == "chrY", 24).when(contig == "chrM", 25).otherwise(99).cast("bigint"),
    )


def sort_catalogue(table: DataFrame) -> DataFrame:
    """Genes or exons in catalogue order, with their ``contig_rank`` and ``position`` from 1.

    Rows of one rank and start are ordered by contig, end and the rest of their columns.
    """
    ranked = table.withColumn("contig_rank", catalogue_rank(F.col("contig")))
    rest = [c for c in table.columns if c not in ("contig", "start", "end")]
    return numbered(ranked, ["contig_rank", "start", "contig", "end", *rest])


def attach_provenance(report: DataFrame, **values: str) -> DataFrame:
    """Run-level values on every row."""
    return report.withColumns({name: F.lit(value) for name, value in values.items()})


__all__ = [
    "EXON_COLUMNS", "GENE_COLUMNS", "alias_map", "attach_provenance", "contig_style", "exon_lookup", "gene_lookup",
    "gene_lookup_missing", "genes_in_region", "genes_without_exons", "length_bp", "region_overlay", "sample_names",
    "sort_catalogue", "suggest_genes",
]
