import math
import re
import zlib
from collections import Counter

import numpy as np
from llm_data import documents

from plumbline.llm import pitman_yor
from plumbline.llm.pitman_yor import score_texts, seat


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w] + ["\n"]


def base(rows):
    held = {i: i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter(t for i, x in rows if not held[i] for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    return {
        i: (held[i], len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(x)))
        for i, x in rows
    }


def check(spark, rows, got):
    want = base(rows)
    for r in got:
        w = want[r.doc_id]
        assert tuple(r)[:5] == (r.doc_id, *w[:4]) and abs(r.base_score - w[4]) < 1e-6 * abs(w[4]) + 1e-9
        assert r.score <= 0 and math.isfinite(r.score)


def test_table(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "BUCKET_CHARS", 50_000)
    monkeypatch.setattr(pitman_yor, "BLOCK_TOKENS", 5_000)
    docs = documents(spark)
    got = score_texts(docs).collect()
    assert len(got) == docs.count()
    check(spark, [(r.doc_id, r.text) for r in docs.collect()], got)
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_probabilities_sum_to_one(spark):
    """The words after one context: those that training knows, and the unknown one."""
    train = [(i, x) for i, x in enumerate(["a b a c", "a b b", "c a b a b", "b", ""] * 6) if zlib.crc32(str(i).encode()) % 7 != 2]
    tests = iter(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2)
    texts = {"": next(tests), **{w: next(tests) for w in ("a", "b", "c", "new")}, **{f"new {w}": next(tests) for w in ("a", "b", "c", "new")}}
    rows = train + [(i, x) for x, i in texts.items()]
    got = {r.doc_id: r.score for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    p = {x: 10 ** got[i] for x, i in texts.items()}
    # after an unseen word only the parent speaks: q(w) q(end | w) for each w, and q(end | new) = q(end)
    end = p["new new"] / p["new"]  # q(new)
    start_new = p["new"]
    assert 0 < end < 1 and 0 < start_new < 1
    assert sum(p[w] for w in ("a", "b", "c", "new")) + p[""] < 1


def test_seating_mean():
    # one dish, parent 1: tables of n customers have the known mean of the process
    n, copies = 20, 40_000
    d, s = pitman_yor.DISCOUNT[0], pitman_yor.STRENGTH[0]
    got = seat(np.full(copies, float(n)), np.ones(copies), np.zeros(copies), np.arange(copies).astype(np.uint64) * np.uint64(7919), 0, 1).mean()
    mean = 1.0
    for seated in range(1, n):
        mean += (s + d * mean) / (s + seated)
    assert abs(got - mean) < 0.05


def test_small_cases(spark):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "A a\x1f b"), (4, "x " * 300_000), (5, "é É")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    check(spark, rows, score_texts(docs).collect())
    assert score_texts(docs.limit(0)).count() == 0
    assert score_texts(docs.union(docs)).count() == 12
    only = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert score_texts(only).first().score == 0


def test_scores_do_not_depend_on_buckets(spark, monkeypatch):
    docs, got = documents(spark), []
    for chars in (12_000_000, 50_000):
        monkeypatch.setattr(pitman_yor, "BUCKET_CHARS", chars)
        got.append({r.doc_id: r.score for r in score_texts(docs).collect()})
    assert all(abs(got[0][i] - got[1][i]) < 1e-9 * abs(got[0][i]) + 1e-9 for i in got[0])


def test_a_frequent_context_is_dealt_over_the_buckets(spark, monkeypatch):
    rows = [(i, " ".join(f"the w{(i * 7 + k * k) % 900} x{k % 50}" for k in range(300))) for i in range(60)]
    docs, got = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), []
    for chars, frequent in ((10_000, 4), (10_000, 0.001), (12_000_000, 4)):
        monkeypatch.setattr(pitman_yor, "BUCKET_CHARS", chars)
        monkeypatch.setattr(pitman_yor, "FREQUENT", frequent)
        got.append({r.doc_id: r.score for r in score_texts(docs).collect()})
    assert all(abs(got[0][i] - x[i]) < 1e-9 * abs(x[i]) for x in got[1:] for i in x)
    monkeypatch.setattr(pitman_yor, "FREQUENT", 4)
    hot = pitman_yor.frequent_contexts(docs, 400_000, 40)
    blocks = pitman_yor._blocks(docs, 40, hot, True).filter("bucket >= 0").collect()
    sizes = Counter()
    for b in blocks:
        parts = pitman_yor._unpack(b.data)
        assert len(parts) == 4 and len(set(zip(parts[1].tolist(), *(x.tolist() for x in parts[2])))) == len(parts[1])
        sizes[b.bucket] += len(parts[1])
    assert max(sizes.values()) < 0.15 * sum(sizes.values())


def test_packed_pairs_come_back_and_are_small():
    from plumbline.llm.pitman_yor import _ID, _narrow, _pack, _pack_pairs, _unpack, _unpack_pairs, _wide

    rng = np.random.default_rng(3)
    words = rng.integers(3, 2**48, 3000).astype(np.uint64)
    us = np.sort(words[rng.integers(0, 3000, 20_000)])
    ws = words[np.minimum(rng.zipf(1.3, 20_000), 3000) - 1]
    counts = rng.integers(0, 4, 20_000)
    data = _pack_pairs(us, ws, counts)
    assert all((a == b).all() for a, b in zip(_unpack_pairs(data), (us, ws, counts)))
    # six bytes for the word of each pair alone would be more
    assert len(data) < 4 * len(us)
    extremes = np.array([_ID, 0, 5, _ID, 1], dtype=np.uint64)
    assert (_wide(*_narrow(extremes)) == extremes).all()
    none = np.zeros(0, dtype=np.uint64)
    assert [len(x) for x in _unpack_pairs(_pack_pairs(none, none, none))] == [0, 0, 0]
    floats = np.log10(rng.random(1000))
    assert (_unpack(_pack(floats, [1, None]))[0] == floats).all() and _unpack(_pack(floats, [1, None]))[1] == [1, None]


def test_tables_that_are_done_with_are_removed(spark):
    from pathlib import Path

    from plumbline.session import checkpoint_dir

    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("llm-*/*"))
    got = score_texts(spark.createDataFrame([(1, "a b a b"), (2, "a c")], "doc_id long, text string"))
    assert {p.name for p in set(folder.glob("llm-*/*")) - before} == {"answers"}
    assert got.count() == 2
