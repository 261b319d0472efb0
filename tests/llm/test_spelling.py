import random
import re
import zlib
from collections import Counter

from llm_data import rows_of
from pyspark.sql import functions as F

from plumbline.llm.spelling import near_pairs, roots, spelling_variants, word_counts

COLUMNS = ("word", "n", "n_near", "form", "form_n", "root")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    found = {}
    for w, k in n.items():
        others = sorted((-n[v], v) for v in n if near(w, v))
        form = others[0][1] if others and -others[0][0] >= 10 * k else None
        found[w] = (k, len(others), form, n[form] if form else None)
    def root(w):
        return root(found[w][2]) if found[w][2] else w
    return {w: (*v, root(w)) for w, v in found.items()}


def texts(seed, letters, base, rows):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 10))) for _ in range(base)]
    for w in list(words):
        at = rng.randrange(len(w))
        words += [w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[1:] + w[0]]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, rng.choice((" ", "\n", "-1")).join(rng.choices(words, weights, k=60))) for i in range(rows)]


def test_random_texts(spark):
    for seed, letters in ((1, "ab"), (2, "abcdeÀéÿ"), (3, "aBcdEFghé")):
        rows = texts(seed, letters, 30, 60)
        got = {r.word: tuple(r[c] for c in COLUMNS[1:]) for r in spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == brute(rows) and any(v[2] for v in got.values())


def test_near_words_are_all_found(spark):
    rng = random.Random(5)
    words = list({"".join(rng.choice("abc") for _ in range(rng.randint(7, 9))) for _ in range(700)})
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = {(r.u, r.v) for r in near_pairs(df).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_small_cases(spark):
    common = "abcdefgh"
    rows = [(1, f"{common} " * 200_000), (1, "abcdefgx abcdefgx"), (None, "ÀBCDEFGH àBcdefgh ÀBCDEFGH"), (None, None), (3, ""), (4, "short \x00 \U0001f600abcdefg\U0001f600 abcdefg"), (4, "short \x00 \U0001f600abcdefg\U0001f600 abcdefg")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = {r.word: tuple(r[c] for c in COLUMNS[1:]) for r in spelling_variants(docs).collect()}
    assert got == brute(rows)
    assert spelling_variants(docs.limit(0)).count() == 0
    # only documents without words
    assert spelling_variants(docs.filter("doc_id = 3")).count() == 0
    assert word_counts(docs.filter(F.col("text").isNull())).count() == 0


def test_chains(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(17)] + [("a", "w3")]
    got = dict(rows_of(roots(spark.createDataFrame(forms, "word string, form string"))))
    assert got == {w: "w17" for w, _ in forms}
