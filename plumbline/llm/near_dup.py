"""MinHash near duplicates by a signature-coordinate inverted join.

A text's signature has ``coords`` coordinates; its terms are the pairs (coordinate, value). Texts at least ``similarity``
alike agree in about that share of the terms, and nearly surely in ``matches`` of them. So the candidates are an overlap
join on these terms:

* Prefix: with terms ordered by frequency, rarest first, texts with ``matches`` common terms share at least ``overlap`` of
  their first ``coords - matches + overlap`` ones. Only those are posted, and of them only terms that occur twice.
* Skip: in every list the text with the most shared terms, which is nearest to what a family has in common, is the pivot
  and compared with the others first. What those links already join is skipped afterwards. Texts of one list share its
  pivot, so what is left is merged by pivots: texts outside a pivot's largest class against all others of the pivot. A
  bound on their similarity spares nearly all of these pairs: of the pivot's shingles they have in common none that one of
  them lacks (a bitmap of the missing ones tells how many at least), and of the rest none that no other open text has.
* Pairs with ``matches`` equal coordinates are confirmed on their full shingle sets.

Equal texts are one class from the start. No group is expanded into all its pairs, and no list is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import UPPER, small, stored
from plumbline.llm.components import components

COORDS, MATCHES, OVERLAP = 64, 36, 4
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_PRINTS = "doc_id bigint, key binary, n_shingles bigint, sig array<int>"
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class WordHashes(dict):
    """64-bit hashes of words, kept for repeated words up to a fixed number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def text_words(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def shingle_hashes(ws: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of the whole sequence if it is shorter."""
    h = np.array([hashes[w] for w in ws], dtype=np.uint64)
    n = min(size, len(h))
    if not n:
        return h
    s = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
        s ^= s >> np.uint64(29)
    for m in _MIX:
        s = (s ^ (s >> np.uint64(30))) * m
    return np.unique(s ^ (s >> np.uint64(31)))


def _signature(s: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    low = np.full(len(mul), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 8192):
        low = np.minimum(low, (s[at : at + 8192, None] * mul + add).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def prints(docs: DataFrame, size: int, coords: int = COORDS) -> DataFrame:
    """(doc_id, key, n_shingles, sig): the class key of the word sequence, the size of its shingle set, its signature."""
    rng = np.random.default_rng(20_011)
    mul = rng.integers(0, 2**63, coords, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, coords, dtype=np.uint64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keys, counts, sigs = [], [], []
            for text in batch.column(1):
                ws = text_words(text.as_py())
                s = shingle_hashes(ws, size, hashes)
                counts.append(len(s))
                keys.append(xxhash.xxh3_128_digest(b" ".join(ws)) if ws else None)
                sigs.append(_signature(s, mul, add) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(sigs, pa.list_(pa.int32()))],
                names=["doc_id", "key", "n_shingles", "sig"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(work, _PRINTS)


_BITS = [f"m{i}" for i in range(4)]


def _compared(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) with the sizes of their shingle sets (n_a, n_b) and of what is ``common``.

    m0 to m3 are 256 bits that the shingles of a set which b lacks. ``texts`` has (rep, text).
    """
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("y"))
    names = ["a", "b", "n_a", "n_b", "common", *_BITS]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = np.zeros((batch.num_rows, 7), dtype=np.int64)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                p, q = (shingle_hashes(text_words(t.as_py()), size, hashes) for t in (x, y))
                lacked = np.setdiff1d(p, q, assume_unique=True)
                bits = np.zeros(256, dtype=np.uint8)
                bits[lacked & np.uint64(255)] = 1
                rows[i, :3] = len(p), len(q), len(p) - len(lacked)
                rows[i, 3:] = np.packbits(bits).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in rows.T.copy())], names=names)

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(work, ", ".join(f"{c} bigint" for c in names))


def _own_shingles(texts: DataFrame, size: int) -> DataFrame:
    """(rep, n, own): the size of each text's shingle set and how many of these no other of ``texts`` has."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_hashes(text_words(t.as_py()), size, hashes).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "s"])

    rows = texts.select("rep", "text").mapInArrow(work, "rep bigint, s array<bigint>").select("rep", F.explode("s").alias("s"))
    once = rows.groupBy("s").agg(F.count("*").alias("n"), F.min("rep").alias("rep")).filter("n = 1")
    own = once.groupBy("rep").agg(F.count("*").alias("own"))
    return rows.groupBy("rep").agg(F.count("*").alias("n")).join(own, "rep", "left").withColumn("own", F.coalesce("own", F.lit(0)))


def _alike(pairs: DataFrame, sigs: DataFrame, matches: int) -> DataFrame:
    """The pairs with at least ``matches`` equal coordinates."""
    left = sigs.select(F.col("rep").alias("a"), F.col("sig").alias("s"))
    right = sigs.select(F.col("rep").alias("b"), F.col("sig").alias("t"))
    equal = F.size(F.filter(F.zip_with("s", "t", lambda x, y: x == y), lambda e: e))
    return pairs.join(left, "a").join(right, "b").filter(equal >= matches).select("a", "b")


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, coords: int = COORDS, matches: int = MATCHES, overlap: int = OVERLAP
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text; more columns are ignored).

    Texts are linked when their sets of ``size``-word shingles have a Jaccard similarity of at least ``percent`` / 100;
    ``component_id`` is the smallest doc_id reachable and ``kept`` marks that document.

    Null, empty and blank texts have no shingles, are linked with nothing and are kept. A text shorter than a shingle is
    one shingle. Repeated rows come back as often as they came; rows of equal words form one class, so of equal doc_ids
    each row is ``kept`` or none. A null doc_id joins the class of an equal text but never leads one: its component is
    null without such a class, and it is not kept with one. An empty table gives an empty table.
    """
    marks = stored(prints(docs, size, coords), "prints")
    with_id = marks.filter("key IS NOT NULL AND doc_id IS NOT NULL")
    classes = with_id.groupBy("key").agg(F.min("doc_id").alias("rep"))
    members = stored(marks.join(classes, "key", "left").select("doc_id", "n_shingles", "rep"), "members")
    sigs = stored(
        with_id.join(classes, "key").filter("doc_id = rep").groupBy("rep").agg(F.first("sig").alias("sig")), "signatures"
    )
    terms = sigs.select("rep", F.posexplode("sig").alias("i", "v")).select(
        "rep", (F.shiftleft(F.col("i").cast("bigint"), 32) + F.col("v").cast("bigint")).alias("term")
    )
    shared = terms.groupBy("term").agg(F.count("*").alias("n")).filter("n > 1")
    ordered = terms.join(shared, "term").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "term"))).alias("t"))
    # terms of one text only come first in the order; they fill the prefix without being posted
    room = F.lit(coords - matches + overlap) - (F.lit(coords) - F.size("t"))
    posted = ordered.filter(room >= overlap).select("rep", F.size("t").alias("m"), F.explode(F.slice("t", 1, room)).alias("t"))
    lists = stored(posted.select("rep", "m", F.col("t.term").alias("term")), "lists")
    all_texts = docs.select(F.col("doc_id").cast("bigint").alias("rep"), F.col("text").cast("string").alias("text"))
    listed = lists.select("rep").distinct()
    texts = stored(all_texts.join(small(listed, listed.count()), "rep", "left_semi").dropDuplicates(["rep"]), "texts")

    linked = 100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))
    pivots = lists.groupBy("term").agg(F.min(F.struct(-F.col("m"), "rep"))["rep"].alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    star = stored(lists.join(pivots, "term").filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), "star")
    near = stored(_compared(star, texts, size), "near")
    links = near.filter(linked).select("a", "b")
    labels = components(links)

    # what the first links left apart: texts outside the largest class of a pivot against all others of the pivot
    members_of = near.select(F.col("a").alias("pivot"), F.col("b").alias("rep"), "n_a", F.col("n_b").alias("n"), (F.col("n_b") - F.col("common")).alias("extra"), *_BITS)
    own_rows = near.select("a", "n_a").distinct().select(F.col("a").alias("pivot"), F.col("a").alias("rep"), "n_a", F.col("n_a").alias("n"), *[F.lit(0).cast("bigint").alias(c) for c in ("extra", *_BITS)])
    placed = members_of.union(own_rows).join(labels, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("label", "rep")).drop("node")
    placed = stored(placed, "placed")
    largest = (
        placed.groupBy("pivot", "label").agg(F.count("*").alias("n"))
        .groupBy("pivot").agg(F.max(F.struct("n", "label"))["label"].alias("top"), F.count("*").alias("labels"))
        .filter("labels > 1").select("pivot", "top")
    )
    open_rows = stored(placed.join(largest, "pivot"), "open")
    own = stored(_own_shingles(texts.join(open_rows.select("rep").distinct(), "rep", "left_semi"), size).select("rep", "own"), "own")
    entries = stored(open_rows.join(own, "rep").withColumn("extra", F.col("extra") - F.col("own")), "entries")
    columns = ("rep", "label", "n", "extra", *_BITS)
    outside = entries.filter("label <> top").select("pivot", "n_a", *[F.col(c).alias(c + "_x") for c in columns])
    others = entries.select(F.col("pivot").alias("same"), "top", *[F.col(c).alias(c + "_y") for c in columns])
    lacked = " + ".join(f"bit_count({m}_x | {m}_y)" for m in _BITS)
    common = f"(n_a - ({lacked}) + least(extra_x, extra_y))"
    met = outside.join(
        others,
        F.expr(f"""pivot = same AND label_x <> label_y AND (label_y = top OR rep_x < rep_y)
          AND 100 * {common} >= {percent} * (n_x + n_y - {common})"""),
    )
    pairs = met.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct()
    pairs = stored(_alike(pairs, sigs, matches), "pairs")
    rest = stored(_compared(pairs, texts, size).filter(linked).select("a", "b"), "rest")
    labels = components(links.union(rest))

    out = members.join(labels, members["rep"] == labels["node"], "left")
    component = F.coalesce("label", "rep", "doc_id")
    alone = F.col("rep").isNull()
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (alone | F.col("doc_id").eqNullSafe(component)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with all columns of ``docs``: that of the smallest doc_id.

    A repeated doc_id leaves one row. Rows without words stay, and so do rows with a null doc_id, which cannot be named.
    """
    kept = near_duplicates(docs, size, percent).filter("kept").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("key"))
    named = rows.filter("key IS NOT NULL").join(kept, F.col("key") == F.col("id"), "left_semi").dropDuplicates(["key"])
    return named.unionByName(rows.filter("key IS NULL")).select("row.*")
