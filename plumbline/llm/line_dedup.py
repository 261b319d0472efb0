"""Line dedup by an exact set-similarity join.

A line is its set of lower-cased words. Lines with equal sets are one class; classes with a Jaccard similarity of at least
``percent`` / 100 match, and a line goes when an equal or matching line stands earlier (by doc_id, then line). Matches are
judged on the input, so the order of removal does not matter.

The join is a prefix join. Words are ordered by rarity, rarest first. Of n words the first n - ceil(s n) + 1 are posted, and
a pair is compared only if it shares one of these, if its sizes fit (length filter), and if the places of the word leave
room for the overlap it needs (positional filter; it holds at the rarest common word). Each posting also carries 64 bits
that its words flip, or 128 for ``LONG`` words and more, which would fill 64; bits that differ cannot be more than the words
that may. Candidates that pass are held against 256 such bits of both sets, which are narrow, before the whole sets meet and are compared.

A line needs only one earlier match, so the pairs of a large group of near copies are not all made. Classes are numbered by
their first lines. First each class meets the earliest one of some couples of its posted keys, which few sets share that are not
alike (of some keys, where it has few), at most one pair each; most of a group end there. Only classes that do not are then paired, by all keys, with all earlier ones.

Rarity comes from counts of hashed words, a table of fixed size that is a constant of the plan. A frequent word is posted in
pairs with the words behind it: two sets whose rarest common word is in the prefix have their second one in the prefix that
is one longer. So the long lists of frequent words are never paired up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import BLANKS, forget, hex_sha256, small, stored, words

BUCKETS = 1 << 17
HASH_BITS = 54
STEPS = 8  # rarity levels per doubling of the count
COUPLES, EARLIEST = 5, 3  # couples of so many keys, those of the smallest hashes, are asked for their earliest class; so many keys if there are less
LONG = 64  # words from which a set has 128 bits instead of 64
FREQUENT = 512  # a frequent bucket has at least this count and three times the median one


def line_words(line: Column) -> Column:
    return words(F.lower(line), BLANKS)


def _rarity(docs: DataFrame) -> tuple[Column, int]:
    """A constant array with the rarity level of every bucket of words, and the first level that is frequent."""
    bucket = F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("bucket")
    found = docs.select(F.explode(F.split(F.lower("text"), BLANKS)).alias("w")).filter("w <> ''")
    counts = found.groupBy(bucket).agg(F.count("*").alias("n"))
    found = {r.bucket: r.n for r in counts.collect()}  # at most BUCKETS rows
    level = lambda n: 1 + int(math.log2(n) * STEPS)
    median = sorted(found.values())[len(found) // 2] if found else 0
    table = [level(found[b]) if b in found else 0 for b in range(BUCKETS)]
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>"), level(max(FREQUENT, 3 * median))


def _tokens(line: str, table: Column) -> Column:
    """The words of the column ``line`` as sorted numbers, rarest first."""
    hashes = F.transform(line_words(F.col(line)), lambda w: F.xxhash64(w))
    # never null, so that the array is sorted as plain numbers
    level = lambda h: F.coalesce(F.get(table, F.pmod(h, F.lit(BUCKETS)).cast("int")), F.lit(0))
    rank = lambda h: F.shiftleft(level(h).cast("bigint"), HASH_BITS)
    numbers = F.transform(hashes, lambda h: rank(h).bitwiseOR(F.shiftrightunsigned(h, 64 - HASH_BITS)))
    return F.sort_array(F.array_distinct(numbers))


def _prefix(percent: int) -> Column:
    n = F.size("tokens")
    return n - F.floor((n * percent + 99) / 100).cast("int") + 1


def _head(frequent: int, percent: int) -> Column:
    """The prefix of ``tokens`` and one more word in 32 bits each, all that postings need; the last bit marks frequent ones."""
    short = lambda t: F.hash(t).bitwiseAND(-2)
    marked = lambda t: F.when(F.shiftright(t, HASH_BITS) < frequent, short(t)).otherwise(short(t) + 1)
    return F.transform(F.slice("tokens", 1, _prefix(percent) + 1), marked)


def _bits(at: Column | None = None) -> Column:
    """64 bits, one flipped by each of ``tokens``; only by those that ``at`` holds for."""
    some = "tokens" if at is None else F.filter("tokens", at)
    one = lambda t: F.call_function("shiftleft", F.lit(1).cast("bigint"), t.bitwiseAND(63).cast("int"))
    return F.aggregate(some, F.lit(0).cast("bigint"), lambda acc, t: acc.bitwiseXOR(one(t)))


def _keys() -> Column:
    """The posted keys of ``head`` (the prefix and one more word): (key, words before its last one that no match by it shares)."""
    length = F.col("length")

    def posted(i: Column) -> Column:
        token = F.get("head", i)
        alone = F.array(F.struct(token.alias("key"), i.alias("place")))
        behind = F.transform(F.slice("head", i + 2, length - i), lambda u, k: F.struct(F.hash(token, u).alias("key"), (i + k).alias("place")))
        return F.when(token.bitwiseAND(1) == 0, alone).otherwise(behind)

    return F.flatten(F.transform(F.sequence(F.lit(0), length - 1), posted))


def _fits(percent: int) -> Column:
    """Whether postings (a, qa, ba, ma) and (b, qb, bb, mb) of one key can be of matching sets, b before a.

    ``q`` holds the size n, the place p and a flag as ``_packed`` does. With an overlap of o: o (100 + s) >= s (na + nb),
    o <= na - pa and o <= nb - pb, and at most na + nb - 2 o words differ. Halves of bits are folded where one side has 64.
    """
    n = {c: f"(q{c} >> 24)" for c in "ab"}
    left = {c: f"({n[c]} - ((q{c} >> 1) & 8388607))" for c in "ab"}
    both = f"({n['a']} + {n['b']})"
    return F.expr(f"""b < a AND 100 * least({n['a']}, {n['b']}) >= {percent} * greatest({n['a']}, {n['b']})
      AND {100 + percent} * least({left['a']}, {left['b']}) >= {percent} * {both}
      AND {100 + percent} * if(least({n['a']}, {n['b']}) < {LONG}, bit_count(ba ^ ma ^ bb ^ mb), bit_count(ba ^ bb) + bit_count(ma ^ mb))
        <= {100 - percent} * {both}""")


def _packed(place: Column, settled: Column) -> Column:
    """The size, a place in the set and a flag in one number: postings are many, and each column of a row takes eight bytes."""
    return F.shiftleft(F.col("n").cast("bigint"), 24).bitwiseOR(F.shiftleft(place.cast("bigint"), 1)).bitwiseOR(settled.cast("bigint"))


def _late(docs: DataFrame, classes: DataFrame, pairs: DataFrame, table: Column, percent: int) -> DataFrame:
    """(late): the classes ``a`` of ``pairs`` (a, b) that match ``b`` and begin after it, judged by whole sets read at their first lines."""
    pairs = stored(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    at = ends.join(classes, "class").groupBy(F.col("first.d").alias("d")).agg(F.collect_list(F.struct(F.col("first.l").alias("l"), "class", "h")).alias("at"))
    at = stored(at, "places")
    n_places = at.agg(F.coalesce(F.sum(F.size("at")), F.lit(0))).first()[0]
    wanted = docs.join(small(at, n_places), F.col("doc_id").eqNullSafe(F.col("d")))
    wanted = wanted.select("d", F.split("text", "\n", -1).alias("line"), F.explode("at").alias("at"))
    wanted = wanted.select("at.class", "at.h", F.struct("d", "at.l").alias("first"), F.get("line", F.col("at.l")).alias("line"))
    wanted = wanted.select("class", "h", "first", _tokens("line", table).alias("tokens"))
    quarter = lambda k: lambda t: F.shiftright(t, 6).bitwiseAND(3) == k
    wanted = wanted.select("class", "h", "first", "tokens", F.array(*[_bits(quarter(k)) for k in range(4)]).alias("wide"))
    # a repeated row gives its lines again, and another text under the same doc_id a line that is not meant
    held = stored(wanted, "sets")
    sets = held.filter(F.xxhash64("tokens") == F.col("h"))
    wide = sets.select("class", F.size("tokens").alias("n"), "wide").dropDuplicates(["class"])
    likely = pairs.join(wide.toDF("a", "na", "wa"), "a").join(wide.toDF("b", "nb", "wb"), "b")
    differ = " + ".join(f"bit_count(wa[{k}] ^ wb[{k}])" for k in range(4))
    likely = stored(likely.filter(f"{100 + percent} * ({differ}) <= {100 - percent} * (na + nb)").select("a", "b"), "likely")
    left = likely.select(F.col("a").alias("class")).union(likely.select("b")).distinct()
    whole = sets.join(small(left, left.count()), "class", "left_semi").select("class", "first", "tokens").dropDuplicates(["class"])
    common = F.size(F.array_intersect("ta", "tb"))
    true = likely.join(whole.toDF("a", "fa", "ta"), "a").join(whole.toDF("b", "fb", "tb"), "b")
    # two classes can begin at one place, where rows of one doc_id have different texts
    true = true.filter((100 * common >= percent * (F.size("ta") + F.size("tb") - common)) & (F.col("fb") < F.col("fa")))
    late = stored(true.select(F.col("a").alias("late")).distinct(), "late")
    forget(pairs, at, held, likely)
    return late


def removed_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, removed): per document the sorted numbers, from 0, of the lines that go; only documents that lose some.

    Lines without words are never removed. Places compare by doc_id and line; a null doc_id comes before all others.
    """
    table, frequent = _rarity(docs)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    n = F.size("tokens")
    half = lambda k: lambda t: F.shiftright(t, 6).bitwiseAND(1) == k
    can_match = n * 100 >= percent * (n + 1)  # otherwise only an equal set is alike enough
    every = stored(
        lines.select("doc_id", "line_no", _tokens("line", table).alias("tokens")).select(
            "doc_id", "line_no", F.xxhash64("tokens").alias("h"), n.alias("n"),
            F.when(n < LONG, _bits()).otherwise(_bits(half(0))).alias("bits"), F.when(n < LONG, F.lit(0).cast("bigint")).otherwise(_bits(half(1))).alias("more"),
            F.when(can_match, _prefix(percent)).alias("length"), F.when(can_match, _head(frequent, percent)).alias("head"),
        ),
        "lines",
    )
    seen = every.filter("n > 0")
    # classes of equal sets (equal hash, size and bits), numbered by their earliest lines, which stand for them
    least = F.min(F.struct("doc_id", "line_no", "length", "head")).alias("f")
    classes = seen.groupBy("h", "n", "bits", "more").agg(least, F.count("*").alias("size"))
    place = lambda c: F.struct(F.col(f"{c}doc_id").alias("d"), F.col(f"{c}line_no").alias("l"))
    classes = classes.select("h", "n", "bits", "more", "size", place("f.").alias("first"), "f.length", "f.head").orderBy("first")
    classes = stored(classes.select(F.monotonically_increasing_id().alias("class"), "*"), "classes")

    def posts(of: DataFrame, keys: Column, settled: Column) -> DataFrame:
        found = of.filter("length IS NOT NULL").select("class", "n", "bits", "more", settled.alias("settled"), F.explode(keys).alias("k"))
        return found.select("k.key", "class", _packed(F.col("k.place"), F.col("settled")).alias("q"), "bits", "more")

    by = F.transform(_keys(), lambda k: F.struct(F.hash(k["key"]).alias("by"), k["key"].alias("key"), k["place"].alias("place")))
    few = F.col("few")
    posted = lambda key, place: F.struct(key.alias("key"), place.alias("place"))
    n_alone = F.when(F.size(few) < COUPLES, EARLIEST).otherwise(0)
    alone = F.transform(F.slice(few, F.lit(1), n_alone), lambda k: posted(k["key"], k["place"]))
    # of a couple it is not known which words before it are shared
    behind = lambda k, i: F.transform(F.slice(few, i + 2, COUPLES), lambda other: posted(F.hash(k["key"], other["key"]), F.lit(0)))
    asking = classes.filter("length IS NOT NULL").withColumn("few", F.slice(F.sort_array(by), 1, COUPLES))  # a column is made once
    some = posts(asking, F.concat(alone, F.flatten(F.transform(few, behind))), F.lit(False)).toDF("key", "a", "qa", "ba", "ma")
    earliest = F.min(F.struct("a", "qa", "ba", "ma")).over(Window.partitionBy("key"))
    met = some.withColumn("e", earliest).select("a", "qa", "ba", "ma", F.col("e.a").alias("b"), *[F.col(f"e.{c}a").alias(f"{c}b") for c in "qbm"])
    soon = _late(docs, classes, met.filter(_fits(percent)).select("a", "b").distinct(), table, percent)

    # one exchange serves both sides, so that classes that are settled stay among the earlier ones
    n_soon = soon.count()
    ends = classes.join(small(soon, n_soon), F.col("class") == F.col("late"), "left")
    both = posts(ends, _keys(), F.col("late").isNotNull())
    x = both.toDF("key", "a", "qa", "ba", "ma")
    y = both.toDF("same", "b", "qb", "bb", "mb")
    pairs = x.join(y, (F.col("key") == F.col("same")) & F.expr("qa & 1 = 0") & _fits(percent)).select("a", "b").distinct()
    later = _late(docs, classes, pairs, table, percent)

    late = small(soon.union(later), n_soon + later.count())
    judged = classes.select("class", "h", "n", "bits", "more", "first", "size").join(late, F.col("class") == F.col("late"), "left").filter("late IS NOT NULL OR size > 1")
    gone = seen.select("doc_id", "line_no", "h", "n", "bits", "more").join(judged, ["h", "n", "bits", "more"])
    gone = gone.filter(F.col("late").isNotNull() | ~place("").eqNullSafe(F.col("first")))
    gone = stored(gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("removed")), "removed")
    forget(every, classes, soon, later)
    return gone


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with the remaining lines as ``text``, and ``_n_lines`` and ``_n_removed``.

    Null texts stay null, empty texts have one line without words. A text that loses all its lines becomes empty. Rows of
    one doc_id are one document, whose equal lines at the same place are the same line. Other columns are carried along
    whatever their names; those of the two results are replaced.
    """
    gone = removed_lines(docs.select("doc_id", "text"), percent).select(F.col("doc_id").alias("id"), "removed")
    n_gone = gone.agg(F.coalesce(F.sum(F.size("removed")), F.lit(0))).first()[0]
    rows = docs.select(F.struct("*").alias("row")).join(small(gone, n_gone), F.col("row.doc_id").eqNullSafe(F.col("id")), "left")
    lines = F.split(F.col("row.text"), "\n", -1)
    left = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("removed", i)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(left)
    mine = [(text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns if c not in ("_n_lines", "_n_removed")]
    return rows.select(
        *mine, F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("_n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("_n_removed"),
    )


def line_report(docs: DataFrame) -> DataFrame:
    """``op6_line_dedup``: (doc_id, n_lines, n_removed, kept_sha256), one row per document row; null texts hash as empty."""
    rows = dedup_lines(docs.select("doc_id", "text"))
    return rows.select(
        "doc_id", F.when(F.col("text").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("_n_lines")).alias("n_lines"),
        F.col("_n_removed").alias("n_removed"), hex_sha256(F.coalesce("text", F.lit(""))).alias("kept_sha256"),
    )
