"""BED lines to targets, with limits on their number, total length and file size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.intervals import bin_of, computed_once
from plumbline.operators.joins import chunk_of, running_totals
from plumbline.params import DEFAULT_MAX_BED_BYTES, DEFAULT_MAX_TARGETS, DEFAULT_MAX_TOTAL_BP

_INTEGER = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"


def _integer(text: Column) -> Column:
    digits = F.regexp_replace(F.trim(text), "_", "")
    return F.when(text.rlike(_INTEGER), digits.try_cast("bigint"))


def _split(lines: DataFrame) -> DataFrame:
    """Fields and the reject reason of every data line; blank, comment, track and browser lines are left out."""
    text = F.rtrim(F.col("value"), F.lit("\r\n"))
    skipped = (
        (text == "") | F.startswith(text, F.lit("#"))
        | F.startswith(text, F.lit("track")) | F.startswith(text, F.lit("browser"))
    )
    reason = (
        F.when(F.size("_parts") < 3, "fewer than 3 columns")
        .when(F.col("start").isNull() | F.col("end").isNull(), "non-integer coordinates")
        .when(F.col("start") >= F.col("end"), "start >= end")
    )
    split = computed_once(lines.where(~skipped), _parts=F.split(text, "\t"))
    typed = computed_once(
        split,
        contig=F.get("_parts", F.lit(0)),
        start=_integer(F.get("_parts", F.lit(1))),
        end=_integer(F.get("_parts", F.lit(2))),
    )
    return typed.withColumn("reason", reason)


def parse_bed(lines: DataFrame) -> DataFrame:
    """``line_no, contig, start, end, name`` of the usable lines; the name defaults to ``contig:start-end``."""
    name = F.coalesce(
        F.get("_parts", F.lit(3)),
        F.concat("contig", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")),
    )
    return _split(lines).where(F.col("reason").isNull()).select("line_no", "contig", "start", "end", name.alias("name"))


def bed_rejects(lines: DataFrame) -> DataFrame:
    """``line_no, value, reason`` of the lines that were refused, and ``file_path`` where it is known."""
    file = [c for c in lines.columns if c == "file_path"]
    return _split(lines).where(F.col("reason").isNotNull()).select("line_no", "value", "reason", *file)


def bed_stats(
    bed: DataFrame,
    file_bytes: int | Column = 0,
    max_targets: int = DEFAULT_MAX_TARGETS,
    max_total_bp: int = DEFAULT_MAX_TOTAL_BP,
    max_bed_bytes: int = DEFAULT_MAX_BED_BYTES,
) -> DataFrame:
    """One row: number and length of targets, bytes, and which limits are exceeded."""
    size = file_bytes if isinstance(file_bytes, Column) else F.lit(file_bytes).cast("bigint")
    counted = bed.agg(
        F.count("*").alias("n_targets"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("total_bp")
    )
    return counted.withColumn("file_bytes", size).withColumns(
        {
            "exceeds_targets": F.col("n_targets") > max_targets,
            "exceeds_bp": F.col("total_bp") > max_total_bp,
            "exceeds_bytes": F.col("file_bytes") > max_bed_bytes,
        }
    )


def bed_clip(bed: DataFrame, max_targets: int, max_total_bp: int) -> DataFrame:
    """The longest prefix in line order within both limits.

    Lengths are positive, so the running totals rise and the prefix is a plain filter on them.
    """
    sized = bed.withColumns(
        {"_one": F.lit(1).cast("bigint"), "_bp": F.col("end") - F.col("start"), "_chunk": chunk_of("line_no")}
    )
    totals = running_totals(sized, ["_chunk"], ["line_no"], {"_n": "_one", "_total": "_bp"})
    kept = totals.where((F.col("_n") <= max_targets) & (F.col("_total") <= max_total_bp))
    return kept.drop("_one", "_bp", "_chunk", "_n", "_total")


def sample_key(seed: int) -> Column:
    """Hash that orders lines for sampling; it depends on the seed and the line number only."""
    return F.md5(F.concat_ws(",", F.lit(str(seed)), F.col("line_no").cast("string")).cast("binary"))


def bed_sample(bed: DataFrame, max_targets: int, max_total_bp: int, seed: int = 42) -> DataFrame:
    """A uniform sample of ``max_targets`` lines, then the prefix by contig and start within ``max_total_bp``.

    The sample is the lines with the smallest hashes: the same for the same seed, found without a one-task sort.
    """
    hashed = bed.withColumns({"_hash": sample_key(seed), "_one": F.lit(1).cast("bigint")}).withColumn(
        "_chunk", F.substr("_hash", F.lit(1), F.lit(4))
    )
    ranked = running_totals(hashed, ["_chunk"], ["_hash", "line_no"], {"_n": "_one"})
    drawn = ranked.where(F.col("_n") <= max_targets).drop("_hash", "_one", "_chunk", "_n")
    placed = drawn.withColumns({"_bp": F.col("end") - F.col("start"), "_at": F.expr(bin_of("start", 1 << 20))})
    totals = running_totals(placed, ["contig", "_at"], ["start", "line_no"], {"_total": "_bp"})
    return totals.where(F.col("_total") <= max_total_bp).drop("_bp", "_at", "_total")


def bed_message(
    stats: DataFrame,
    kept: DataFrame,
    mode: str,
    max_targets: int = DEFAULT_MAX_TARGETS,
    max_total_bp: int = DEFAULT_MAX_TOTAL_BP,
    max_bed_bytes: int = DEFAULT_MAX_BED_BYTES,
    seed: int = 42,
) -> DataFrame:
    """One row with the text saying which limit was exceeded and what was kept. ``mode``: clip, sample or error."""
    held = kept.agg(
        F.count("*").alias("kept_count"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("kept_bp")
    )
    n, bp = F.col("n_targets"), F.col("total_bp")
    limits = F.concat_ws(
        "; ",
        F.when(F.col("exceeds_targets"), F.format_string(f"target count (%d) exceeds --max-targets ({max_targets})", n)),
        F.when(F.col("exceeds_bp"), F.format_string(f"total bp (%,d) exceeds --max-total-bp ({max_total_bp:,})", bp)),
        F.when(
            F.col("exceeds_bytes"),
            F.format_string(
                f"file size (%,d bytes) exceeds --max-bed-bytes ({max_bed_bytes:,})", F.col("file_bytes")
            ),
        ),
    )
    verb = {"clip": "Retained first", "sample": "Sampled"}
    tail = f" with seed={seed}." if mode == "sample" else "."
    if mode == "error":
        told = F.concat(F.lit("BED guardrail: "), limits)
    else:
        told = F.concat(
            F.lit(f"BED guardrails triggered (warn_and_{mode}): "), limits,
            F.format_string(
                f". {verb[mode]} %d of %d targets (%,d bp of %,d bp){tail}",
                F.col("kept_count"), n, F.col("kept_bp"), bp,
            ),
        )
    exceeded = F.col("exceeds_targets") | F.col("exceeds_bp") | F.col("exceeds_bytes")
    one_row = held.select(F.struct("kept_count", "kept_bp").alias("k")).scalar()
    both = stats.withColumn("_held", one_row).select("*", "_held.kept_count", "_held.kept_bp")
    return both.select(
        "n_targets", "total_bp", "kept_count", "kept_bp",
        F.when(exceeded, told).otherwise(F.lit("All BED limits satisfied.")).alias("message"),
    )


class BedLimitError(ValueError):
    """A limit is exceeded and the policy is to stop."""


def enforce_limits(
    bed: DataFrame,
    file_bytes: int = 0,
    max_targets: int = DEFAULT_MAX_TARGETS,
    max_total_bp: int = DEFAULT_MAX_TOTAL_BP,
    max_bed_bytes: int = DEFAULT_MAX_BED_BYTES,
    mode: str = "clip",
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Apply the policy (clip, sample or error) only when a limit is exceeded: the targets kept, and the message row."""
    limits = dict(max_targets=max_targets, max_total_bp=max_total_bp, max_bed_bytes=max_bed_bytes)
    if mode not in ("clip", "sample", "error"):
        raise ValueError(f"unknown BED policy: {mode}")
    stats = bed_stats(bed, file_bytes, **limits)
    row = stats.first()
    exceeded = row.exceeds_targets or row.exceeds_bp or row.exceeds_bytes
    kept = bed
    if exceeded and mode == "clip":
        kept = bed_clip(bed, max_targets, max_total_bp)
    elif exceeded and mode == "sample":
        kept = bed_sample(bed, max_targets, max_total_bp, seed)
    message = bed_message(stats, kept, mode, seed=seed, **limits)
    if exceeded and mode == "error":
        raise BedLimitError(message.first().message)
    return kept, message


def bed_targets(bed: DataFrame) -> DataFrame:
    """Targets of a BED table; the line number is the key, since names repeat."""
    return bed.select(F.col("line_no").alias("ordinal"), F.col("name").alias("target_id"), "contig", "start", "end")
