"""Benchmark decontamination over a distributed positional inverted index.

The index holds one row (term, doc_id, pos) per token. To find the items of a benchmark in the training texts:

1. Count the benchmark's terms in the training texts and rank them, rarest first, within every window of an item.
2. Post only the terms that are among the ``rarest`` of some window.
3. Shift every posting by the term's place in the item. Postings of one occurrence then agree on (item, doc, shift), so
   intersecting lists is one hash aggregation; a shift stays when all the rarest terms of some window agree.
4. Confirm the windows of the remaining shifts on the texts.

Steps 1 to 3 move rows of rare terms only. The benchmark side is broadcast when counted small and joined otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import NON_WORD, ascii_lower, hex_sha256, small, stored, words


def token_words(text: Column) -> Column:
    return words(ascii_lower(text), NON_WORD)


def build_index(docs: DataFrame, terms: DataFrame | None = None, n_terms: int = 0) -> DataFrame:
    """Postings (term, doc_id, pos) of all tokens, or of the tokens in ``terms`` (one column, ``term``).

    Null and empty texts post nothing. Repeated rows post each time.
    """
    posts = docs.select("doc_id", F.posexplode(token_words(F.col("text"))).alias("pos", "term"))
    if terms is not None:
        posts = posts.join(small(terms, n_terms), "term", "left_semi")
    return posts.select("term", "doc_id", "pos")


def phrase_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """Exact phrases: ``phrases`` (phrase_id, words) against an index of all their words.

    Returns distinct (phrase_id, doc_id, pos) of the first word. Empty or null phrases match nowhere.
    """
    parts = phrases.select("phrase_id", F.size("words").alias("n"), F.posexplode("words").alias("off", "term"))
    hits = index.join(parts, "term").select("phrase_id", "n", "doc_id", (F.col("pos") - F.col("off")).alias("pos"), "off")
    return (
        hits.groupBy("phrase_id", "n", "doc_id", "pos").agg(F.count_distinct("off").alias("found"))
        .filter("found = n").select("phrase_id", "doc_id", "pos")
    )


def proximity_matches(index: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """Pairs of terms (first, second) at most ``within`` words apart, in either order.

    Positions meet in cells of ``within`` words: a left posting looks into its own cell and the two beside it, so a
    frequent term is not paired with all places of the other. Returns (first, second, doc_id, pos, other_pos); a place
    is no neighbour of itself.
    """
    cell = F.floor(F.col("pos") / F.lit(within))
    left = (
        index.join(pairs.select("first", "second").distinct(), F.col("term") == F.col("first"))
        .select("first", "second", "doc_id", "pos", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    )
    right = index.select(F.col("term").alias("second"), "doc_id", F.col("pos").alias("other_pos"), cell.alias("cell"))
    near = left.join(right, ["second", "doc_id", "cell"])
    gap = F.abs(F.col("pos") - F.col("other_pos"))
    return near.filter((gap <= within) & (gap > 0)).select("first", "second", "doc_id", "pos", "other_pos")


def _items(benchmark: DataFrame, window: int) -> DataFrame:
    """One row per distinct word sequence with its ids: (item, ids, words, w)."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("id"), token_words(F.col("text")).alias("words"))
    rows = rows.filter((F.size("words") > 0) & F.col("id").isNotNull())
    return rows.groupBy("words").agg(F.collect_set("id").alias("ids")).select(
        F.xxhash64("words").alias("item"), "ids", "words", F.least(F.lit(window), F.size("words")).alias("w")
    )


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, rarest: int = 2) -> DataFrame:
    """Rows of ``docs`` (all columns) with ``_n_words``, ``_n_hit``, ``_items`` (sorted ids of the matched items).

    A window is ``window`` consecutive words of an item; a shorter item is one window. A word inside an occurrence of a
    window is hit.

    Null and empty texts have no words and are never hit; benchmark rows with a null id or text are ignored. An item text
    given under several ids reports all of them. Every row of a repeated ``doc_id`` (or of a null one) is judged on its own
    text. Other columns are carried along whatever their names; one with a name of the three results is replaced.
    """
    items = stored(_items(benchmark, window), "items")
    sizes = items.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    n_words = sizes[1]
    places = items.select("item", "w", F.size("words").alias("n"), F.posexplode("words").alias("at", "term"))
    terms = places.select("term").distinct()
    counts = build_index(docs, terms, n_words).groupBy("term").agg(F.count("*").alias("cf"))

    # the rarest terms of every window; a term missing in the texts rules its windows out
    ranked = places.join(counts, "term", "left").withColumn("cf", F.coalesce("cf", F.lit(0)))
    starts = ranked.select(
        "item", "at", "term", "cf",
        F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("w") + 1), F.least(F.col("at"), F.col("n") - F.col("w")))).alias("start"),
    )
    anchors = (
        starts.groupBy("item", "start")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct("cf", "at", "term"))), 1, rarest).alias("best"))
        .filter(F.col("best")[0]["cf"] > 0)
    )
    anchors = stored(anchors, "anchors")
    posted = anchors.select("item", F.explode("best").alias("b")).select("item", "b.at", "b.term").distinct()
    wanted = anchors.groupBy("item").agg(F.collect_set(F.sort_array(F.col("best.at"))).alias("sets"))

    index = build_index(docs, posted.select("term").distinct(), n_words)
    shifts = (
        index.join(small(posted, n_words), "term")
        .groupBy("item", "doc_id", (F.col("pos") - F.col("at")).alias("shift"))
        .agg(F.collect_set("at").alias("got"))
        .join(small(wanted, n_words), "item")
        .filter(F.exists("sets", lambda s: F.size(F.array_except(s, F.col("got"))) == 0))
        .select("item", "doc_id", "shift")
    )
    places_of_doc = (
        shifts.join(small(items, n_words), "item")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("shift", "ids", "w", "words")).alias("shifts"))
    )

    # confirm on the text: every window of every shift; what remains are the starts of real occurrences
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.join(places_of_doc, F.col("row.doc_id").eqNullSafe(places_of_doc["doc_id"]), "left").drop("doc_id")
    rows = rows.withColumn("words", token_words(F.col("row.text")))  # after the shuffle, which so carries the texts once

    def confirmed(s: Column) -> Column:
        fits = lambda j: (s["shift"] + j >= 0) & (
            F.slice(F.col("words"), F.greatest(s["shift"] + j, F.lit(0)) + 1, s["w"]) == F.slice(s["words"], j + 1, s["w"])
        )
        starts = F.filter(F.sequence(F.lit(0), F.size(s["words"]) - s["w"]), fits)
        return F.struct(s["ids"].alias("ids"), F.transform(starts, lambda j: F.struct((j + s["shift"]).alias("a"), (j + s["shift"] + s["w"]).alias("b"))).alias("at"))

    found = F.filter(F.transform("shifts", confirmed), lambda s: F.size(s["at"]) > 0)
    rows = rows.select("row", F.size("words").cast("long").alias("n_words"), F.when(F.col("shifts").isNotNull(), found).alias("found"))
    spans = F.array_sort(F.array_distinct(F.flatten("found.at")))
    covered = F.aggregate(
        spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["b"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["end"]))).alias("n"),
        ),
    )["n"]
    results = [
        F.col("n_words").alias("_n_words"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("_n_hit"),
        F.coalesce(F.array_sort(F.array_distinct(F.flatten("found.ids"))), F.array().cast("array<string>")).alias("_items"),
    ]
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ("_n_words", "_n_hit", "_items")], *results)


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of ``op1_decontamination``, one row per document row."""
    rows = contaminated_documents(docs.select("doc_id", "text"), benchmark)
    return rows.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"), hex_sha256(F.array_join("_items", ",")).alias("items_sha256"),
        (F.col("_n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with their own columns."""
    row = docs.select("doc_id", "text", F.struct("*").alias("row"))
    return contaminated_documents(row, benchmark).filter("_n_hit = 0").select("row.*")
