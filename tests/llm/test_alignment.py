import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm_data import documents

from plumbline.llm import alignment as al

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def vocabs():
    return al.Vocabularies(al.BYTE_VOCABULARY, al.PIECE_VOCABULARY)


def tokens(vocabs, text):
    """Tokens of the whole text as (id, begin, end), or none."""
    if not text:
        return [], []
    a = vocabs.a.encode(" " + text, add_special_tokens=False).ids
    b = vocabs.b.encode(text)
    raw, out = (" " + text).encode(), []
    for ids, table in ((a, vocabs.bytes_a), (b, vocabs.bytes_b)):
        if b"".join(table[i] for i in ids) != raw:
            return [], []
        at, spans = 0, []
        for i in ids:
            spans.append((i, at, at + len(table[i])))
            at += len(table[i])
        out.append(spans)
    return out


def brute(vocabs, rows):
    found, counts = [], Counter()
    for doc_id, text in rows:
        a, b = tokens(vocabs, text)
        common = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, at = [], [0, 0]
        for e in common:
            sides = []
            for k, x in enumerate((a, b)):
                begin = at[k]
                while at[k] < len(x) and x[at[k]][2] <= e:
                    at[k] += 1
                sides.append(",".join(str(i) for i, *_ in x[begin : at[k]]))
            groups.append("|".join(sides))
        links, j = [], 0
        for x, s, t in a:
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < t:
                links.append((x, b[k][0]))
                k += 1
        counts.update(links)
        found.append((doc_id, len(a), len(b), ";".join(groups), len(groups), links))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [
        (d, n_a, n_b, n, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else "")
        for d, n_a, n_b, text, n, links in found
    ]


def result(df):
    return sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in df.collect()), key=str)


CASES = [
    None, "", " ", "\n", "  a  b ", "plain words, and more.", "été Straße ñandú 日本語 \U0001f600 x", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b ▁c", "▁",
    "tab\tand\r\nnew\n\nlines \x1f \x85  x", "x" * 300 + " " + "é" * 200, "don't stop   now  ", "\x00 zero", "İı ﬁ ½ é  nbsp",
]


def test_table(spark, vocabs):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(al.alignment_report(docs)) == sorted(brute(vocabs, rows), key=str)


def test_small_cases(spark, vocabs, monkeypatch):
    rows = [(i if i != 5 else None, t) for i, t in enumerate(CASES)] * 2
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, pairs string")
    want = sorted(brute(vocabs, rows), key=str)
    assert result(al.alignment_report(docs)) == want
    # few counts that go to every task, and none
    assert result(al.alignment_report(docs, common=40)) == want
    assert result(al.alignment_report(docs, common=0)) == want
    assert al.alignment_report(docs.limit(0)).count() == 0
    assert result(al.alignment_report(docs.filter("doc_id < 2")))[0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_long_texts(spark, vocabs):
    rng = random.Random(3)
    words = ["the", "Straße", "日本語日本語", "x\ny", "a  b", "word,", "\U0001f600\U0001f601", "1234567"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(1, text(30_000)), (2, text(9_000)), (2, text(12_000)), (3, "ab" * 30_000 + " " + text(300)), (4, text(20)), (None, text(11_000) + " ▁ " + text(9_000))]
    assert sum(len(t) > al.LONG for _, t in rows) >= 4
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(al.alignment_report(docs)) == sorted(brute(vocabs, rows), key=str)


def test_groups_are_kept(spark):
    docs = spark.createDataFrame([(1, "été " * 20_000), (2, "été")], "doc_id long, text string")
    for r in al.aligned(docs).collect():
        assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 and r.groups.count(";") + 1 == r.n_groups


def same(x, y):
    for f, g in ((x.prefix, y.prefix), (x.suffix, y.suffix)):
        assert all(np.array_equal(p, q) for p, q in zip(f.lists(), g.lists()))
    c, d = x.closed or al.Closed(), y.closed or al.Closed()
    assert x.cut == y.cut and (c.n_a, c.n_b, c.n_groups, c.text) == (d.n_a, d.n_b, d.n_groups, d.text)
    assert np.array_equal(c.pairs, d.pairs) and np.array_equal(c.counts, d.counts)


def test_fragments_are_a_monoid(vocabs):
    """Any cuts of the bytes and any order of joining give the groups of the whole text."""
    rng = random.Random(8)
    text = "Größe und été 日本語 unbelievable tokenization\n" * 6
    a, b = tokens(vocabs, text)
    whole = al.Tokens.of([i for i, *_ in a], [e for *_, e in a], [i for i, *_ in b], [e for *_, e in b])
    want = al.finished(al.fragment(whole, vocabs), vocabs)
    for _ in range(60):
        parts, rest = [], whole
        for at in sorted(rng.sample(range(1, a[-1][2]), rng.randint(1, 40))):
            part, rest = rest.split(at)
            parts.append(al.fragment(part, vocabs))
        parts.append(al.fragment(rest, vocabs))
        x, y, z = (parts * 3)[:3]
        if len(parts) >= 3:
            x, y, z = parts[:3]
            same(al.joined(al.joined(x, y, vocabs), z, vocabs), al.joined(x, al.joined(y, z, vocabs), vocabs))
        same(al.joined(al.Fragment(), x, vocabs), x)
        same(al.joined(x, al.Fragment(), vocabs), x)
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [al.joined(parts[i], parts[i + 1], vocabs)]
        got = al.finished(parts[0], vocabs)
        assert got.text == want.text and np.array_equal(got.pairs, want.pairs) and np.array_equal(got.counts, want.counts)
