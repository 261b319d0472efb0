"""A corpus pipeline: reject toxic documents, drop repeated lines and near copies, decontaminate, mix the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import read_table, stored
from plumbline.llm.decontaminate import drop_contaminated
from plumbline.llm.line_dedup import dedup_lines
from plumbline.llm.mixing import mix, mixture
from plumbline.llm.near_dup import drop_near_duplicates
from plumbline.llm.toxicity import drop_toxic

WORD = r"[^\x20\x09-\x0D]"
ENTROPY = 0.9999  # of the largest possible one; the sources are nearly of one size


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier chain rejects; null and empty texts stay."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that an earlier line equals or resembles; ``n_chars`` counts what is left.

    A document that loses lines and has no word left is dropped, so that copies do not go on as empty texts. Texts that were null,
    empty or without words stay as they are. Rows of one doc_id with equal texts lose the same lines; a null doc_id is earliest.
    """
    kept = dedup_lines(docs)
    kept = kept.filter((F.col("_n_removed") == 0) | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, similarity 0.8): that of the smallest doc_id.

    Null and empty texts resemble nothing and stay.
    """
    return drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item; texts without words stay."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each repeat of a document, with its source's weight and the sort keys of its place.

    Documents that the mixture leaves out come once, with 0 repeats and no place. Columns of ``docs`` by the names of the results
    (n_tokens, weight, repeats, block, pass, turn, place) are replaced; null sources are a source, null texts have no tokens.
    """
    mixed = stored(mix(docs, ENTROPY), "mixed")
    out = mixed.filter("_repeats = 0").withColumns({c: F.lit(None).cast("bigint") for c in ("_pass", "_turn", "_place")})
    names = {f"_{c}": c for c in ("n_tokens", "weight", "repeats", "block", "pass", "turn", "place")}
    columns = [*[c for c in docs.columns if c not in names.values()], *[F.col(k).alias(v) for k, v in names.items()]]
    return mixture(mixed).select(*columns).unionByName(out.select(*columns))


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("near_duplicates", near_copies), ("decontamination", benchmark), ("mixing", mixing)]

ORACLE_SQL = None  # the first stage is a trained model


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result but the last is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
