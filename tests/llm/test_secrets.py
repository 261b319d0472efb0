import hashlib
import random
import re

from llm_data import documents, rows_of

from plumbline.llm.secrets import ORDER, ROLE, WEAK, linked_parts, secret_report, secret_spans

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def check(spark, docs):
    got = {r.doc_id: r for r in secret_report(docs).collect()}
    for r in docs.collect():
        want = base(r.text)
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), r
        assert [got[r.doc_id][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(x[1] == k for x in want) for k in range(3)]
        assert set(filter(None, text.split(","))) <= set(got[r.doc_id].spans.split(","))


def test_table(spark):
    check(spark, documents(spark))


def test_small_cases(spark):
    key = "AKIA" + "A1" * 8
    texts = [
        None, "", "secret=token:abcdefgh", "pässword = x PASSWORD: 'abc' Api_Key=\"abcdef0\" é" + key, "AKIASHORT AKIAAKIA" + "Z" * 16,
        "deadbeef" * 4 + "g" + "0" * 23, "token==" + "=" * 9, "x" * 200_000 + " passwd=1234567 " + "ab" * 40_000,
        "user=alice pass=hunter22 host=db.example.com", "user=alice and nothing more", "host=db.example.com", "pass=hunter22",
        "user=alice" + " " * 500 + "pass=hunter22",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(spark, docs)
    weak = {r.doc_id: r.weak for r in secret_spans(docs).collect()}
    assert [len(weak[i]) for i in range(8, 13)] == [3, 0, 0, 0, 0]
    assert secret_report(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "token=abcdefg", 1), (None, "token=abcdefg", 2)], "doc_id long, text string, strong int")
    assert rows_of(secret_report(odd))[0][1] == 1 and secret_report(odd).count() == 2


def linked(parts, scope):
    """The rule, part by part: parts are (start, rank, end) of one document."""
    role = lambda p: ROLE[ORDER[p[1]]]
    near = lambda p, q: 0 <= max(q[0] - p[2], p[0] - q[2]) <= scope
    ids, secrets = ([p for p in parts if role(p) == r] for r in ("id", "secret"))
    paired_ids = {p for p in ids if any(near(p, q) for q in secrets)}
    paired_secrets = {p for p in secrets if any(near(p, q) for q in ids)}
    ends = {p for p in parts if role(p) == "endpoint" and any(near(p, q) for q in paired_ids) and any(near(p, q) for q in paired_secrets)}
    return paired_ids | paired_secrets | ends


def test_links_against_all_pairs(spark):
    rng = random.Random(7)
    for scope in (1, 20, 200):
        parts = {d: {(s, rng.randrange(len(ORDER)), s + rng.randint(1, 30)) for s in (rng.randrange(1500) for _ in range(25))} for d in "abcd"}
        rows = [(d, *p) for d, ps in parts.items() for p in ps]
        got = linked_parts(spark.createDataFrame(rows, "doc string, start long, rank int, end long"), scope)
        assert sorted(map(tuple, got.collect())) == sorted((d, *p) for d, ps in parts.items() for p in linked(ps, scope))


def test_weak_parts_of_random_texts(spark):
    """Spans found by Python's own matching and linked pair by pair."""
    rng = random.Random(9)
    bits = ["word", "user=alice7", "pass: hunter22!", "37@mail4.example.com", "10.20.3.44", "https://x.example/a", "token = 'abcdef12'", "é" * 9, "1.2.3.4.5", "a" * 150]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(60)]
    found = 0
    for r in secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        text = texts[r.doc_id]
        parts = [(a, k, b) for a, k, b, _ in base(text)]
        for kind, _, quick, pattern in WEAK:
            if re.search(pattern, text):
                assert re.search(quick.replace("|(?i)", "|"), text, re.I)
            parts += [(m.start(), ORDER.index(kind), m.end()) for m in re.finditer(pattern.replace("(?:[a-z][", "(?:[A-Za-z]["), text)]
        want = sorted(p for p in linked(parts, 200) if p[1] >= 3)
        assert sorted(map(tuple, r.weak)) == want, text
        found += len(want)
    assert found > 40


def test_tables_have_linked_parts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert secret_report(docs).filter("spans LIKE '%weak_%'").count() > 0
