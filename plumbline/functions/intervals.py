"""Interval arithmetic on 0-based half-open coordinates, region strings and contig names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the region string format, 1-based inclusive.
REGION_PATTERN = r"^([^:]+):([0-9,]+)-([0-9,]+)$"


def strip(text: Column) -> Column:
    """Remove surrounding white space of any kind."""
    return F.trim(text, F.lit(" \t\r\n\f\x0b"))


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, so that filters on them do not copy their expressions."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def bin_of(pos: str, bin_size: int) -> str:
    """SQL of the bin number of a position, rounding down for negative positions too."""
    return f"(({pos}) - pmod({pos}, {bin_size}L)) div {bin_size}L"


def bins_of(start: str, end: str, bin_size: int) -> Column:
    """The bins an interval touches, one row each."""
    return F.expr(f"explode(sequence({bin_of(start, bin_size)}, {bin_of(f'{end} - 1', bin_size)}))")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (a_end > b_start)


def length_bp(start: Column, end: Column) -> Column:
    return end - start


def clip_interval(df: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Intersect ``start``/``end`` with a window and drop what becomes empty."""
    return (
        df.withColumns({"start": F.greatest("start", lo), "end": F.least("end", hi)}).where(F.col("start") < F.col("end"))
    )


def split_by_bin(df: DataFrame, bin_size: int) -> DataFrame:
    """Cut ``start``/``end`` intervals at bin edges: one row per touched bin, with its ``bin`` number."""
    return df.where("start < `end`").withColumn("bin", bins_of("start", "`end`", bin_size)).withColumns(
        {
            "start": F.expr(f"greatest(start, bin * {bin_size}L)"),
            "end": F.expr(f"least(`end`, (bin + 1) * {bin_size}L)"),
        }
    )


def format_region(contig: Column, start: Column, end: Column) -> Column:
    """1-based inclusive display form with thousands separators."""
    return F.concat(contig, F.lit(":"), F.format_number(start + 1, 0), F.lit("-"), F.format_number(end, 0))


def region_name(contig: Column, start: Column, end: Column) -> Column:
    """Target name given to a region: 1-based inclusive without separators."""
    return F.concat(contig, F.lit(":"), (start + 1).cast("string"), F.lit("-"), end.cast("string"))


def parse_region(df: DataFrame, text: str) -> DataFrame:
    """Add ``contig``, ``start``, ``end`` and ``error`` (null, "format" or "order") for a region string column.

    Like the 1-based rule it follows, a region whose start is not below its end is rejected.
    """
    stripped = strip(F.col(text))
    number = lambda group: F.regexp_replace(
        F.regexp_extract(stripped, REGION_PATTERN, group), ",", ""
    ).try_cast("bigint")
    parsed = computed_once(
        df, _contig=F.regexp_extract(stripped, REGION_PATTERN, 1), _first=number(2), _last=number(3)
    )
    first, last = F.col("_first"), F.col("_last")
    error = F.when(first.isNull() | last.isNull(), F.lit("format")).when(first >= last, F.lit("order"))
    ok = error.isNull()
    return parsed.withColumns(
        {"contig": F.when(ok, F.col("_contig")), "start": F.when(ok, first - 1), "end": F.when(ok, last), "error": error}
    ).drop("_contig", "_first", "_last")


def target_kind(text: Column) -> Column:
    """"region", "malformed" (a colon, but no region) or "genes"."""
    return (
        F.when(strip(text).rlike(REGION_PATTERN), F.lit("region"))
        .when(F.contains(text, F.lit(":")), F.lit("malformed"))
        .otherwise(F.lit("genes"))
    )


def split_symbols(text: Column) -> Column:
    """Comma-separated gene symbols as a trimmed array without empties."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda s: s != "")


def translate_contig(contig: Column, style: Column | str) -> Column:
    """Rename between the ``chr1``/``chrM`` and ``1``/``MT`` styles; names already in the style stay."""
    style = F.lit(style) if isinstance(style, str) else style
    prefixed = F.startswith(contig, F.lit("chr"))
    bare = F.substr(contig, F.lit(4))
    to_chr = F.when(prefixed, contig).when(contig == "MT", F.lit("chrM")).otherwise(F.concat(F.lit("chr"), contig))
    to_bare = F.when(~prefixed, contig).when(bare == "M", F.lit("MT")).otherwise(bare)
    return F.when(style == "chr", to_chr).otherwise(to_bare)
