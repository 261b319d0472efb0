"""Groups spelling variants of words by PartEnum signatures.

A word is the set of its lettered places (letter, k-th copy of it), a binary vector. One inserted or deleted letter changes
one place, one replaced letter two, so words at one edit have vectors at a Hamming distance of two at most. PartEnum deals
the places into ``PARTS`` parts; a difference of two places leaves ``PARTS - 2`` parts alike, so each choice of two parts
to leave out gives one signature, the hash of all other places, and near words share at least one.

Words of the same letters in another order share all of them, so a posted key also holds what one edit must leave in place:
with s letters in the shorter word, one of its last s - s // 3 letters, its first ones, or its first and last s // 3. The join
is an equi-join on whole keys and its condition verifies the edit, so that only true pairs leave it. A key depends on both
letters and their order: no group of words with a common beginning or of anagrams meets in one place.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower, stored

RUNS = r"[A-Za-zÀ-ÿ]"
PARTS = 3
FACTOR = 10  # a form occurs at least this many times as often


def noised(doc_id: Column, run: Column) -> Column:
    """The run, or the run without one code point where 31 divides the crc32 of ``<doc_id>:<run>``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def word_counts(docs: DataFrame, letters: int = 7, least: int = 2) -> DataFrame:
    """(word, n): the noised runs of at least ``letters`` code points that occur at least ``least`` times."""
    # a run that loses a code point has one more
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{RUNS}{{{letters},}}"), F.lit(0))).alias("run"))
    found = runs.select("doc_id", ascii_lower(F.col("run")).alias("run")).select(noised(F.col("doc_id"), F.col("run")).alias("word"))
    return found.filter(F.char_length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _part_hashes(word: Column) -> Column:
    """One number per part: the hash of the places dealt to it, in the order of their letters."""
    letters = F.array_sort(F.split(word, ""))
    # sorted letters: the place of the first equal one tells which copy a letter is
    places = F.transform(letters, lambda x, i: F.xxhash64(x, i - F.array_position(letters, x).cast("int")))
    part = lambda k: F.aggregate(places, F.lit(0).cast("bigint"), lambda acc, h: F.when(F.pmod(h, F.lit(PARTS)) == k, F.xxhash64(acc, h)).otherwise(acc))
    return F.array(*[part(k) for k in range(PARTS)])


def signatures(words: DataFrame) -> DataFrame:
    """(key, s, word, n): the posted keys of each of ``words`` (word, n), for partners of its length or one less or more."""
    placed = words.select("word", "n", F.char_length("word").alias("length"), _part_hashes(F.col("word")).alias("parts"))
    posts = placed.select("word", "n", "parts", F.explode(F.array(F.col("length"), F.col("length") - 1)).alias("s"))
    third = F.floor(F.col("s") / 3).cast("int")
    first = lambda k: F.substring("word", F.lit(1), k)
    last = lambda k: F.substring(F.col("word"), F.char_length("word") - k + 1, k)
    kept = F.array(F.xxhash64(F.lit(0), last(F.col("s") - third)), F.xxhash64(F.lit(1), first(F.col("s") - third)), F.xxhash64(F.lit(2), first(third), last(third)))
    rest = [[k for k in range(PARTS) if k not in out] for out in combinations(range(PARTS), 2)]
    signature = F.array(*[F.xxhash64(F.lit(i), *[F.col("parts")[k] for k in left]) for i, left in enumerate(rest)])
    posts = posts.select("word", "n", "s", F.explode(kept).alias("kept"), signature.alias("signatures"))
    posts = posts.select("word", "n", "s", "kept", F.explode("signatures").alias("signature"))
    return posts.select(F.xxhash64("signature", "kept", "s").alias("key"), "s", "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(u, nu, v, nv): each pair of ``words`` (word, n) that differ by one inserted, deleted or replaced code point, once, u < v."""
    posts = signatures(words)
    x, y = posts.toDF("key", "s", "u", "nu"), posts.toDF("key", "s", "v", "nv")
    # s is the length of the shorter one
    meets = (F.col("u") < F.col("v")) & (F.least(F.char_length("u"), F.char_length("v")) == x["s"]) & (F.levenshtein("u", "v", 1) == 1)
    return x.join(y, (x["key"] == y["key"]) & (x["s"] == y["s"]) & meets).select("u", "nu", "v", "nv").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain word -> form of ``forms`` (word, form), a table without cycles.

    Chains halve each round. A form occurs ``FACTOR`` times as often as its word, so they have at most 18 steps.
    """
    known = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = known.select(F.col("word").alias("up"), F.col("root").alias("upper"))
        nxt = known.join(up, known["root"] == up["up"], "left").select("word", F.coalesce("upper", "root").alias("root"), F.col("upper").isNotNull().alias("moved"))
        nxt = stored(nxt, "roots")
        moved = nxt.filter("moved").limit(1).count()
        known = nxt.select("word", "root")
        if not moved:
            return known


def spelling_variants(docs: DataFrame, letters: int = 7, least: int = 2) -> DataFrame:
    """``op11_spelling``: (word, n, n_near, form, form_n, root), one row per word of ``docs`` (doc_id, text).

    The form of a word is its most frequent near word (ties: the smallest in code-point order) if it occurs ``FACTOR`` times
    as often. Null and empty texts have no words, a null doc_id counts as an empty one in the crc32, repeated rows count
    again. Texts of any length are cut by Spark's own functions; an empty table has no words. Other columns are ignored.
    """
    words = stored(word_counts(docs.select("doc_id", "text"), letters, least), "words")
    pairs = stored(near_pairs(words), "near")
    both = pairs.select(F.col("u").alias("word"), F.col("v").alias("near"), F.col("nv").alias("m"))
    both = both.union(pairs.select("v", "u", "nu"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    taken = -F.col("best.m") >= FACTOR * F.col("n")
    judged = stored(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(taken, F.col("best.near")).alias("form"),
            F.when(taken, -F.col("best.m")).alias("form_n"),
        ),
        "judged",
    )
    ends = roots(judged.filter("form IS NOT NULL"))
    return judged.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
