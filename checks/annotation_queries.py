"""Regions, contig names, gene and exon catalogues, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.registry import EXON_TABLE, genes, query
from plumbline.functions.intervals import (
    format_region, parse_region, region_name, split_symbols, target_kind, translate_contig,
)
from plumbline.operators.annotation import (
    alias_map, attach_provenance, contig_style, exon_lookup, gene_lookup, gene_lookup_missing,
    genes_in_region, genes_without_exons, region_overlay, sample_names, sort_catalogue, suggest_genes,
)
from plumbline.plans.report import resolve_targets
from plumbline.sources.catalogue import (
    parse_alias_json, parse_exon_table, parse_gene_table, parse_gtf_exons, parse_gtf_genes,
)

BIN = views.BIN

_TEXT = """asked AS (
  SELECT CAST(c_custkey AS BIGINT) AS ordinal, c_custkey % 25 AS c, (c_custkey * 37) % 2500 + 1 AS lo,
         (c_custkey * 37) % 2500 + 6 + c_custkey % 400 AS hi,
         CASE WHEN c_custkey % 11 = 0 THEN 'bad' WHEN c_custkey % 13 = 0 THEN 'order'
              WHEN c_custkey % 17 = 0 THEN 'commas' WHEN c_custkey % 7 = 0 THEN 'genes' ELSE 'good' END AS kind
  FROM customer)"""
_REGIONS = _TEXT + """, regions AS (
  SELECT ordinal, 'chr' || c AS contig, lo - 1 AS s, hi AS e FROM asked WHERE kind = 'good')"""


def _regions(spark, d):
    parsed = parse_region(views.region_text(spark, d), "target")
    return parsed.where(F.col("error").isNull()).select("ordinal", "contig", "start", "end")


@query(
    "parse_region",
    f"""WITH {_TEXT}
    SELECT ordinal, CASE WHEN kind = 'good' THEN 'chr' || c END AS contig,
      CAST(CASE WHEN kind = 'good' THEN lo - 1 END AS BIGINT) AS start,
      CAST(CASE WHEN kind = 'good' THEN hi END AS BIGINT) AS "end",
      CASE kind WHEN 'good' THEN NULL WHEN 'order' THEN 'order' ELSE 'format' END AS error FROM asked""",
)
def regions(spark, d):
    return parse_region(views.region_text(spark, d), "target").drop("target")


@query(
    "target_kind",
    f"""WITH {_TEXT}
    SELECT ordinal, CASE kind WHEN 'bad' THEN 'malformed' WHEN 'genes' THEN 'genes' ELSE 'region' END AS kind,
      CASE WHEN kind = 'genes' THEN 'NATION_' || c || '_1|nation_3_2' END AS symbols FROM asked""",
)
def kinds(spark, d):
    text = views.region_text(spark, d).withColumn("kind", target_kind(F.col("target")))
    listed = F.when(F.col("kind") == "genes", F.concat_ws("|", split_symbols(F.col("target"))))
    return text.select("ordinal", "kind", listed.alias("symbols"))


@query(
    "translate_contig",
    """WITH names AS (
      SELECT DISTINCT 'chr' || s_nationkey AS contig FROM supplier
      UNION SELECT DISTINCT CAST(s_nationkey AS VARCHAR) FROM supplier
      UNION SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'MT' ELSE 'chrM' END FROM supplier)
    SELECT contig, CASE WHEN contig = 'MT' THEN 'chrM' WHEN contig LIKE 'chr%' THEN contig ELSE 'chr' || contig END AS chr,
      CASE WHEN contig = 'chrM' THEN 'MT' ELSE replace(contig, 'chr', '') END AS bare FROM names""",
)
def translated(spark, d):
    key = F.col("s_nationkey")
    plain = key.cast("string")
    names = views.table(spark, d, "supplier").select(
        F.explode(F.array(F.concat(F.lit("chr"), plain), plain, F.when(key % 2 == 0, "MT").otherwise("chrM"))).alias("contig")
    ).distinct()
    contig = F.col("contig")
    return names.select(
        contig, translate_contig(contig, "chr").alias("chr"), translate_contig(contig, "nochr").alias("bare")
    )


@query(
    "format_region",
    f"""WITH {_REGIONS}
    SELECT ordinal, contig || ':' || format('{{:,}}', (s + 1) * 1000) || '-' || format('{{:,}}', e * 1000) AS region,
      contig || ':' || ((s + 1) * 1000) || '-' || (e * 1000) AS name FROM regions""",
)
def formatted(spark, d):
    rows = _regions(spark, d)
    start, end = (F.col("start") + 1) * 1000 - 1, F.col("end") * 1000
    return rows.select(
        "ordinal", format_region(F.col("contig"), start, end).alias("region"),
        region_name(F.col("contig"), start, end).alias("name"),
    )


@query(
    "contig_style",
    """WITH c AS (SELECT CASE WHEN l_returnflag = 'N' THEN '' ELSE 'chr' END || (l_suppkey % 25) AS sn, l_returnflag AS sample
      FROM lineitem UNION ALL SELECT 'scaffold_1', l_returnflag FROM lineitem
      UNION ALL SELECT '7', l_returnflag FROM lineitem WHERE l_returnflag = 'R')
    SELECT sample, CASE sample WHEN 'A' THEN 'chr' WHEN 'N' THEN 'nochr' END AS contig_style,
      CASE sample WHEN 'R' THEN 'ambiguous contig style' END AS error FROM c GROUP BY sample""",
)
def style(spark, d):
    lines = views.table(spark, d, "lineitem")
    prefix = F.when(F.col("l_returnflag") == "N", "").otherwise("chr")
    own = F.concat(prefix, (F.col("l_suppkey") % 25).cast("string"))
    odd = F.when(F.col("l_returnflag") == "R", "7").otherwise("scaffold_2")
    names = F.explode(F.array(own, F.lit("scaffold_1"), odd))
    return contig_style(lines.select(F.col("l_returnflag").alias("sample"), names.alias("sn")))


@query(
    "sample_name",
    """WITH rg AS (SELECT o_custkey AS f, o_orderkey AS n, CASE WHEN o_orderkey % 3 = 0 THEN 'S' || o_orderkey
        WHEN o_orderkey % 3 = 1 THEN '' END AS sm FROM orders)
    SELECT CAST(f AS VARCHAR) AS sample_file, coalesce((arg_min(sm, n) FILTER (sm <> '')), 'NA') AS sample_name
    FROM rg GROUP BY f""",
)
def names(spark, d):
    key = F.col("o_orderkey")
    sm = F.when(key % 3 == 0, F.concat(F.lit("S"), key.cast("string"))).when(key % 3 == 1, "")
    groups = views.table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("sample_file"), key.alias("ordinal"), sm.alias("sm")
    )
    return sample_names(groups)


_DUP = genes(0, 6) + """, dup AS (
  SELECT k, contig, s, e, name, k AS id, i FROM genes
  UNION ALL SELECT k + 5000, contig, s + 7, e, lower(name), k, i FROM genes WHERE k % 3 = 0),
uniq AS (SELECT * FROM dup QUALIFY row_number() OVER (PARTITION BY upper(name) ORDER BY k DESC) = 1)"""
_GENE_OUT = """contig, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", name AS gene_name, 'G' || id AS gene_id,
  CASE WHEN i % 2 = 0 THEN '+' ELSE '-' END AS strand, 'protein_coding' AS gene_type"""
_GENE_NULLABLE = """contig, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", name AS gene_name, 'G' || id AS gene_id,
  CASE WHEN i % 2 = 0 THEN '+' WHEN i % 2 = 1 THEN '-' END AS strand,
  CASE WHEN id IS NOT NULL THEN 'protein_coding' END AS gene_type"""
_SYMBOLS = """symbols AS (
  SELECT CAST(c_custkey AS BIGINT) AS ordinal, CASE c_custkey % 5
      WHEN 0 THEN lower('NATION_' || (c_custkey % 27) || '_' || (c_custkey % 7))
      WHEN 1 THEN ' ' || 'NATION_' || (c_custkey % 27) || '_' || (c_custkey % 7) || ' '
      WHEN 2 THEN 'Alias-' || (c_custkey % 30) WHEN 3 THEN 'NATOIN' || (c_custkey % 25) || '_' || (c_custkey % 7)
      ELSE 'NATION_' || (c_custkey % 27) || '_' || (c_custkey % 7) END AS symbol FROM customer),
resolved AS (
  SELECT ordinal, symbol, u.* FROM symbols
  LEFT JOIN uniq u ON upper(u.name) = CASE WHEN symbol LIKE 'Alias-%'
    AND TRY_CAST(substr(symbol, 7) AS INT) IN (SELECT n_nationkey FROM nation)
    THEN 'NATION_' || substr(symbol, 7) || '_2' ELSE upper(trim(symbol)) END)"""


@query(
    "alias_map",
    f"""WITH {_DUP} SELECT lower(name) AS alias, name AS gene_name FROM uniq""",
)
def alias(spark, d):
    return alias_map(views.duplicated_genes(spark, d), "line_no")


@query("gene_lookup", f"WITH {_DUP}, {_SYMBOLS} SELECT ordinal, symbol, {_GENE_NULLABLE} FROM resolved")
def lookup(spark, d):
    return gene_lookup(
        views.symbols(spark, d), views.duplicated_genes(spark, d), views.aliases(spark, d), "line_no"
    )


@query(
    "gene_lookup_missing",
    f"WITH {_DUP}, {_SYMBOLS} SELECT ordinal, symbol FROM resolved WHERE name IS NULL",
)
def missing(spark, d):
    return gene_lookup_missing(
        views.symbols(spark, d), views.duplicated_genes(spark, d), views.aliases(spark, d), "line_no"
    )


@query(
    "suggest_genes",
    f"""WITH {_DUP}, {_SYMBOLS}, unknown AS (SELECT DISTINCT upper(trim(symbol)) AS asked FROM resolved WHERE name IS NULL),
    known AS (
      SELECT upper(name) AS n, min(shown) AS shown FROM (
        SELECT name, name AS shown FROM genes
        UNION ALL SELECT 'alias-' || n_nationkey, n_name || '_2' FROM nation) GROUP BY 1),
    pairs AS (
      SELECT asked, shown, max(1.0::DOUBLE - levenshtein(asked, n)::DOUBLE / greatest(length(asked), length(n))) AS sim
      FROM unknown, known GROUP BY ALL HAVING sim >= 0.6 - 1e-9)
    SELECT asked AS symbol, row_number() OVER (PARTITION BY asked ORDER BY sim DESC, shown) AS rank, shown AS suggestion,
      round(sim, 6) AS similarity FROM pairs QUALIFY rank <= 5""",
)
def suggestions(spark, d):
    return suggest_genes(missing(spark, d), views.genes(spark, d), views.aliases(spark, d))


_IN_REGION = genes(0, 6) + ", " + genes(7, 9, "more") + """, hits AS (
  SELECT r.ordinal AS region_ordinal, r.s AS rs, r.e AS re, g.contig, g.s, g.e, g.name, g.k AS id, g.i
  FROM regions r JOIN (SELECT * FROM genes UNION ALL SELECT * FROM more) g
    ON g.contig = r.contig AND g.s < r.e AND g.e > r.s)"""


@query("genes_in_region", f"WITH {_REGIONS}, {_IN_REGION} SELECT region_ordinal, {_GENE_OUT} FROM hits")
def in_region(spark, d):
    return genes_in_region(
        _regions(spark, d), views.genes(spark, d), views.genes(spark, d, 4, 9), "line_no", BIN
    )


@query(
    "exon_lookup",
    f"""WITH {EXON_TABLE}
    SELECT gene_line AS gene_ordinal, contig, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", exon_id, gene_name,
      CAST(exon_number AS BIGINT) AS exon_number, transcript_id FROM exons""",
)
def exons(spark, d):
    genes_ = views.genes(spark, d).withColumnRenamed("line_no", "gene_ordinal")
    return exon_lookup(genes_, views.exons(spark, d)).drop("gene")


@query(
    "region_overlay_genes",
    f"""WITH {_REGIONS}, {_IN_REGION}
    SELECT region_ordinal, contig, CAST(greatest(s, rs) AS BIGINT) AS start, CAST(least(e, re) AS BIGINT) AS "end",
      name AS gene_name FROM hits""",
)
def overlay_genes(spark, d):
    clipped, _ = region_overlay(
        _regions(spark, d), views.genes(spark, d), views.genes(spark, d, 7, 9), views.exons(spark, d), "line_no", BIN
    )
    return clipped.select("region_ordinal", "contig", "start", "end", "gene_name")


@query(
    "region_overlay_exons",
    f"""WITH {_REGIONS}, {EXON_TABLE}
    SELECT r.ordinal AS region_ordinal, x.contig, CAST(greatest(x.s, r.s) AS BIGINT) AS start,
      CAST(least(x.e, r.e) AS BIGINT) AS "end", x.exon_id, CAST(x.exon_number AS BIGINT) AS exon_number
    FROM regions r JOIN exons x ON x.contig = r.contig AND greatest(x.s, r.s) < least(x.e, r.e)""",
)
def overlay_exons(spark, d):
    _, clipped = region_overlay(
        _regions(spark, d), views.genes(spark, d), views.genes(spark, d, 7, 9), views.exons(spark, d), "line_no", BIN
    )
    return clipped.select("region_ordinal", "contig", "start", "end", "exon_id", "exon_number")


@query(
    "exon_fallback",
    f"WITH {EXON_TABLE} SELECT k AS gene_ordinal, name AS gene_name FROM genes WHERE k NOT IN (SELECT gene_line FROM exons)",
)
def fallback(spark, d):
    genes_ = views.genes(spark, d).withColumnRenamed("line_no", "gene_ordinal")
    return genes_without_exons(genes_, exons(spark, d)).select("gene_ordinal", "gene_name")


@query(
    "attach_provenance",
    f"""WITH {genes(0, 9, 'tgt')} SELECT k AS ordinal, name AS target_id, 'table' AS engine_used, 'lineitem' AS input_path FROM tgt""",
)
def provenance(spark, d):
    return attach_provenance(
        views.targets(spark, d).select("ordinal", "target_id"), engine_used="table", input_path="lineitem"
    )


@query(
    "sort_catalogue",
    f"""WITH {genes(0, 6)}, named AS (SELECT name, s, e, CASE contig WHEN 'chr23' THEN 'chrX' WHEN 'chr24' THEN 'chrY' ELSE contig END AS contig
      FROM genes),
    ranked AS (SELECT *, CASE WHEN contig = 'chrX' THEN 23 WHEN contig = 'chrY' THEN 24
        WHEN CAST(substr(contig, 4) AS INT) BETWEEN 1 AND 22 THEN CAST(substr(contig, 4) AS BIGINT) ELSE 99 END AS r FROM named)
    SELECT name AS gene_name, r AS contig_rank, row_number() OVER (ORDER BY r, s, contig, e, name) AS position FROM ranked""",
)
def catalogue(spark, d):
    """Ranks and places, with the last nations standing for X and Y."""
    contig = F.when(F.col("contig") == "chr23", "chrX").when(F.col("contig") == "chr24", "chrY").otherwise(F.col("contig"))
    table = views.genes(spark, d).withColumn("contig", contig).select("contig", "start", "end", "gene_name")
    return sort_catalogue(table).select("gene_name", "contig_rank", "position")


def _gtf(spark, d):
    """GTF text: gene and exon features, comments, and unnamed genes."""
    rows = views.genes(spark, d)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    named = F.when(F.col("line_no") % 10 == 5, F.lit("")).otherwise(
        F.concat(F.lit(" gene_name "), quoted(F.col("gene_name")), F.lit(";"))
    )
    gene = F.concat_ws(
        "\t", "contig", F.lit("SRC"), F.lit("gene"), (F.col("start") + 1).cast("string"), F.col("end").cast("string"),
        F.lit("."), "strand", F.lit("."),
        F.concat(F.lit("gene_id "), quoted(F.col("gene_id")), F.lit('; gene_type "protein_coding";'), named),
    )
    genes_ = rows.select("line_no", F.explode(F.array(gene, F.concat(F.lit("#"), gene), F.lit("short\tline"))).alias("value"))
    x = views.exons(spark, d)
    number = F.when(F.col("exon_number") == "4", F.lit("")).otherwise(
        F.concat(F.lit(" exon_number "), F.col("exon_number"), F.lit(";"))
    )
    tag = F.when(F.col("exon_number") == "7", F.lit(' tag "basic";')).otherwise(F.lit(' tag "basic"; tag "MANE_Select";'))
    exon = F.concat_ws(
        "\t", "contig", F.lit("SRC"), F.lit("exon"), (F.col("start") + 1).cast("string"), F.col("end").cast("string"),
        F.lit("."), F.lit("+"), F.lit("."),
        F.concat(F.lit("transcript_id "), quoted(F.col("transcript_id")), F.lit("; gene_name "),
                 quoted(F.col("gene_name")), F.lit(";"), number, F.lit(" exon_id "), quoted(F.col("exon_id")), F.lit(";"), tag),
    )
    return genes_.unionByName(x.select(F.lit(0).cast("bigint").alias("line_no"), exon.alias("value")))


@query(
    "src_gtf_genes",
    f"""WITH {genes(0, 6)} SELECT k AS line_no, contig, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end",
      name AS gene_name, 'G' || k AS gene_id, CASE WHEN i % 2 = 0 THEN '+' ELSE '-' END AS strand,
      'protein_coding' AS gene_type FROM genes WHERE k % 10 <> 5""",
)
def gtf_genes(spark, d):
    return parse_gtf_genes(_gtf(spark, d))


@query(
    "src_gtf_exons",
    f"""WITH {EXON_TABLE} SELECT contig, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", exon_id, gene_name,
      CASE exon_text WHEN '4' THEN '0' ELSE exon_text END AS exon_number, transcript_id FROM exons WHERE exon_text <> '7'""",
)
def gtf_exons(spark, d):
    return parse_gtf_exons(_gtf(spark, d)).drop("line_no")


@query(
    "src_gene_table",
    f"""WITH {genes(0, 6)} SELECT k AS line_no, contig, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end",
      name AS gene_name, 'G' || k AS gene_id, CASE WHEN i % 2 = 0 THEN '+' ELSE '-' END AS strand,
      'protein_coding' AS gene_type FROM genes""",
)
def gene_table(spark, d):
    rows = views.genes(spark, d)
    text = F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns if c != "line_no"])
    lines = F.explode(F.array(text, F.lit("#contig\tstart"), F.lit("chr1\t5\t9")))
    return parse_gene_table(rows.select("line_no", lines.alias("value")))


@query(
    "src_exon_table",
    f"""WITH {EXON_TABLE} SELECT contig, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", exon_id, gene_name,
      exon_text AS exon_number, transcript_id FROM exons""",
)
def exon_table(spark, d):
    rows = views.exons(spark, d)
    text = F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns])
    return parse_exon_table(rows.select(text.alias("value")))


@query(
    "src_alias_json",
    "SELECT 'alias-' || n_nationkey AS alias, n_name || '_2' AS gene_name FROM nation",
)
def alias_json(spark, d):
    """One JSON object per region, read back as rows."""
    rows = views.aliases(spark, d).withColumn("part", F.length("gene_name"))
    document = F.to_json(F.map_from_entries(F.collect_list(F.struct("alias", "gene_name"))))
    return parse_alias_json(rows.groupBy("part").agg(document.alias("value")).select("value"))


@query(
    "resolve_targets",
    f"""WITH {_TEXT}, {_DUP}, parts AS (
      SELECT ordinal, 0 AS part, 'NATION_' || c || '_1' AS symbol FROM asked WHERE kind = 'genes'
      UNION ALL SELECT ordinal, 1, 'NATION_3_2' FROM asked WHERE kind = 'genes')
    SELECT ordinal, part, name AS target_id, contig, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end"
      FROM parts JOIN uniq ON upper(name) = symbol
    UNION ALL SELECT ordinal, 0, 'chr' || c || ':' || lo || '-' || hi, 'chr' || c, lo - 1, hi FROM asked WHERE kind = 'good'""",
)
def resolved(spark, d):
    targets, _ = resolve_targets(
        views.region_text(spark, d), views.duplicated_genes(spark, d), views.aliases(spark, d)
    )
    return targets.select("ordinal.ordinal", "ordinal.part", "target_id", "contig", "start", "end")


@query(
    "resolve_failures",
    f"""WITH {_TEXT} SELECT ordinal, CASE kind WHEN 'bad' THEN 'malformed region' WHEN 'order' THEN 'invalid region: order'
      ELSE 'invalid region: format' END AS error FROM asked WHERE kind IN ('bad', 'order', 'commas')""",
)
def failures(spark, d):
    _, failed = resolve_targets(
        views.region_text(spark, d), views.duplicated_genes(spark, d), views.aliases(spark, d)
    )
    return failed.select("ordinal", "error")
