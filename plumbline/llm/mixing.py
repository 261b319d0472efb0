"""Mixing sources to target weights by temperature.

A source with the share p of the tokens gets the weight p^a, normalised. The exponent a, in [0, 1], is bisected: it is the
largest whose weights reach ``entropy`` times the largest possible entropy, and then, where a source would be repeated more
than ``max_repeats`` times, the smallest above it that keeps the limit. The weights times all tokens are the budgets.

A source fills its budget with whole passes over its documents and one partial pass, each in a block permutation: documents
are dealt to blocks by a hash, a pass visits the blocks in the order of a hash of the pass, and so the documents of a block.
The partial pass takes documents as long as they fit the rest of the budget.

Running sums are two-level, over the blocks of a source and then within the one block where its rest ends, so no task sees
all documents of a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import BLANKS, small, stored, words

BLOCK_ROWS = 2_000
ENTROPY, MAX_REPEATS = 0.95, 4.0
STEPS = 1 << 10  # size classes of sources per doubling


def weights(classes: list[tuple[float, int]], exponent: float) -> list[float]:
    """The normalised weight of one source of each class (tokens of a source, number of sources)."""
    top = max(t for t, _ in classes)
    raw = [(t / top) ** exponent for t, _ in classes]
    total = math.fsum(w * n for w, (_, n) in zip(raw, classes))
    return [w / total for w in raw]


def solve_exponent(classes: list[tuple[float, int]], entropy: float | None = ENTROPY, max_repeats: float | None = MAX_REPEATS) -> float:
    """The exponent that meets the targets; 1 without targets, with one source or with sources of one size."""
    budget = math.fsum(t * n for t, n in classes)
    most = math.log(sum(n for _, n in classes))

    def even(a: float) -> bool:
        w = weights(classes, a)
        return -math.fsum(x * math.log(x) * n for x, (_, n) in zip(w, classes) if x > 0) >= entropy * most

    def within(a: float) -> bool:
        return all(x * budget <= max_repeats * t * (1 + 1e-12) for x, (t, _) in zip(weights(classes, a), classes))

    exponent = 1.0
    if entropy is not None and not even(1.0):
        low, high = 0.0, 1.0
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (mid, high) if even(mid) else (low, mid)
        exponent = low
    if max_repeats is not None and not within(exponent):
        low, high = exponent, 1.0
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (low, mid) if within(mid) else (mid, high)
        exponent = high
    return exponent


def source_budgets(sizes: DataFrame, entropy: float | None = ENTROPY, max_repeats: float | None = MAX_REPEATS) -> DataFrame:
    """``sizes`` (source, n_docs, tokens) with weight, budget, passes and rest.

    The bisection runs on classes of sources of nearly the same size, of which there are a bounded number however many
    sources there are; the weights themselves are computed from the exact sizes. Sources without tokens get no budget.
    """
    with_tokens = sizes.filter("tokens > 0")
    by_size = with_tokens.groupBy(F.floor(F.log2("tokens") * STEPS).alias("k")).agg(F.avg("tokens").alias("t"), F.count("*").alias("n"))
    classes = [(r.t, r.n) for r in by_size.orderBy("k").collect()]
    exponent = solve_exponent(classes, entropy, max_repeats) if classes else 1.0
    top = max((t for t, _ in classes), default=1.0)
    raw = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(top), F.lit(exponent))).otherwise(F.lit(0.0))
    total, tokens = sizes.agg(F.sum(raw), F.sum("tokens")).first()
    rows = sizes.withColumn("weight", raw / F.lit(total or 1.0))
    rows = rows.withColumn("budget", F.round(F.col("weight") * F.lit(float(tokens or 0))).cast("bigint"))
    each = F.greatest(F.col("tokens"), F.lit(1))
    rows = rows.withColumn("passes", F.floor(F.col("budget") / each).cast("bigint"))
    return rows.withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens"))


def n_tokens() -> Column:
    """Words between blanks; null and empty texts have none."""
    return F.size(words(F.col("text"), BLANKS)).cast("bigint")


def _block(n_docs: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("deal"), "doc_id"), F.ceil(n_docs / BLOCK_ROWS)).cast("bigint")


def mix(
    docs: DataFrame, entropy: float | None = ENTROPY, max_repeats: float | None = MAX_REPEATS, keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` (all by default) of every row of ``docs`` with ``_n_tokens``, ``_weight``, ``_repeats`` and ``_block``.

    ``_repeats`` is how often the mixture holds the row: the whole passes of its source and perhaps the partial one. Rows
    that the mixture does not hold have 0, so nothing is lost from the result. A null source is a source of its own. Texts
    without words fill no budget; they come with every whole pass, and with the partial one while its budget lasts. Rows that
    agree in doc_id, source and size get the same number of repeats, in the partial pass too: they are one entry of the
    permutation with their joint size. A source with no tokens at all, and an empty table, give 0 repeats or no rows.
    """
    keep = keep or docs.columns
    narrow = stored(docs.select("doc_id", "source", n_tokens().alias("n")), "sizes")
    sizes = narrow.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("tokens"))
    budgets = stored(source_budgets(sizes, entropy, max_repeats).withColumnRenamed("source", "s"), "budgets")
    plan = small(budgets, budgets.count())
    same = F.col("source").eqNullSafe(F.col("s"))

    dealt = narrow.join(plan, same).select("source", "doc_id", "n", "passes", "rest", _block(F.col("n_docs")).alias("block"))
    turn = F.xxhash64(F.lit("turn"), "source", "block", "passes")
    blocks = dealt.groupBy("source", "block", "passes", "rest").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(W.partitionBy("source").orderBy(turn, "block").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    blocks = blocks.withColumn("before", before)
    # blocks before the end of the rest go whole, the one that crosses it by documents, the others not at all
    fate = F.when(F.col("rest") <= 0, 0).when(F.col("before") + F.col("n") <= F.col("rest"), 2).when(F.col("before") < F.col("rest"), 1).otherwise(0)
    blocks = stored(blocks.select(F.col("source").alias("s2"), F.col("block").alias("b2"), "before", fate.alias("fate")), "blocks")
    cut = blocks.filter("fate = 1")
    n_cut = cut.count()
    inside = dealt.join(small(cut, n_cut), F.col("source").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2")))
    entries = inside.groupBy("source", "block", "doc_id", "n", "passes", "rest", "before").agg((F.count("*") * F.col("n")).alias("size"))
    place = F.xxhash64(F.lit("place"), "doc_id", "passes")
    upto = F.sum("size").over(W.partitionBy("source", "block").orderBy(place, "doc_id", "n").rowsBetween(W.unboundedPreceding, W.currentRow))
    taken = entries.withColumn("upto", upto + F.col("before")).filter("upto <= rest")
    taken = stored(taken.select(F.col("source").alias("s3"), F.col("doc_id").alias("d3"), F.col("n").alias("n3")), "taken")

    rows = docs.select(F.struct(*keep).alias("row"), "doc_id", "source", n_tokens().alias("n"))
    rows = rows.join(plan, same).withColumn("block", _block(F.col("n_docs")))
    n_blocks = blocks.count()
    rows = rows.join(small(blocks, n_blocks), F.col("source").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2")))
    rows = rows.join(
        small(taken, n_cut * BLOCK_ROWS * 2),
        F.col("source").eqNullSafe(F.col("s3")) & F.col("doc_id").eqNullSafe(F.col("d3")) & (F.col("n") == F.col("n3")), "left",
    )
    extra = ((F.col("fate") == 2) | F.col("n3").isNotNull()).cast("bigint")
    results = [F.col("n").alias("_n_tokens"), F.col("weight").alias("_weight"), (F.col("passes") + extra).alias("_repeats"), F.col("block").alias("_block")]
    mine = [F.col("row")[c].alias(c) for c in keep if c not in ("_n_tokens", "_weight", "_repeats", "_block")]
    return rows.select(*mine, *results)


def mixture(mixed: DataFrame) -> DataFrame:
    """The training order: one row per repeat of ``mixed`` (from ``mix``), with ``_pass`` and the sort keys of its place.

    Sorted by ``_pass``, ``_turn`` and ``_place`` the rows of a source are a permutation of its documents in each whole pass.
    """
    passes = mixed.filter("_repeats > 0").withColumn("_pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_repeats") - 1)))
    return passes.withColumn("_turn", F.xxhash64(F.lit("turn"), "source", "_block", "_pass")).withColumn("_place", F.xxhash64(F.lit("place"), "doc_id", "_pass"))


def mixing_report(docs: DataFrame, entropy: float | None = ENTROPY, max_repeats: float | None = MAX_REPEATS) -> DataFrame:
    """``op5_mixing``: (doc_id, source, n_tokens, weight, repeats, pass, turn, place), one row per repeat of a document row.

    A row that the mixture does not hold comes once, with 0 repeats and a null pass, turn and place.
    """
    rows = stored(mix(docs, entropy, max_repeats, keep=["doc_id", "source"]), "mixed")
    none = [F.lit(None).cast("bigint").alias(c) for c in ("_pass", "_turn", "_place")]
    whole = mixture(rows).unionByName(rows.filter("_repeats = 0").select("*", *none))
    names = {"_n_tokens": "n_tokens", "_weight": "weight", "_repeats": "repeats", "_pass": "pass", "_turn": "turn", "_place": "place"}
    return whole.select("doc_id", "source", *[F.col(k).alias(v) for k, v in names.items()])
