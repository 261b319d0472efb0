import hashlib
import random
from collections import Counter

import numpy as np
from llm_data import documents

from plumbline.llm import substring_dedup
from plumbline.llm.substring_dedup import anchors, front_code, merge_runs, remove_repeats, shared_prefix, window_hashes


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, dtype=int)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = 1
        left = bytes(c for c, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


def got(df):
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()]


def test_table(spark):
    docs = documents(spark)
    rows = docs.collect()
    assert sorted(got(remove_repeats(docs))) == sorted(brute([r.text for r in rows], 200))


def test_random_texts(spark, monkeypatch):
    rng = random.Random(5)
    for most in (256, 2):
        monkeypatch.setattr(substring_dedup, "MOST", most)
        parts = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 60))) for _ in range(25)]
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(60)] + [None, "", "a" * 300, "a" * 300, "ab" * 90]
        docs = spark.createDataFrame([(i // 2, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, key int")
        assert sorted(got(remove_repeats(docs, 30, 8))) == sorted(brute(texts, 30))
    assert remove_repeats(docs.limit(0)).count() == 0


def test_rows_of_crowded_seeds(spark, monkeypatch):
    made, counted = Counter(), substring_dedup.stored

    def stored(df, name):
        table = counted(df, name)
        made[name] += table.count()
        return table

    monkeypatch.setattr(substring_dedup, "stored", stored)
    monkeypatch.setattr(substring_dedup, "MOST", 10)
    rng = random.Random(2)
    some = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = some(210)
    texts = [some(150) + passage + some(150) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(got(remove_repeats(docs))) == sorted(brute(texts, 200))
    # most of the 101 strings through an anchor near an end of the passage hold other bytes too
    assert made["strings"] + made["cores"] <= 30 * made["contexts"], made


def test_loser_tree():
    rng = random.Random(3)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 40))) for _ in range(7)]
    merged = list(merge_runs([front_code(r) for r in runs]))
    assert [m[3] for m in merged] == sorted(x for r in runs for x in r)
    assert all(runs[r][p] == item for r, p, _, item in merged)
    assert all(n == shared_prefix(a[3], b[3]) for a, b, n in zip(merged, merged[1:], [m[2] for m in merged[1:]]))
    assert list(merge_runs([])) == [] and list(merge_runs([[], []])) == []


def test_reaches_row_by_row(monkeypatch):
    rng = random.Random(8)
    word = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    for _ in range(50):
        pairs = sorted((word(rng.randint(0, 9)), word(rng.randint(0, 6))) for _ in range(rng.randint(2, 30)))
        rights, lefts = [p[0] for p in pairs], [p[1] for p in pairs]
        prefix = [0] + [shared_prefix(a, b) for a, b in zip(rights, rights[1:])]
        slow = substring_dedup.reaches(rights, lefts, prefix, 7)
        monkeypatch.setattr(substring_dedup, "PAIRWISE", 1)
        assert substring_dedup.reaches(rights, lefts, prefix, 7) == slow
        monkeypatch.setattr(substring_dedup, "PAIRWISE", 100)


def test_anchors():
    data = np.frombuffer(random.Random(1).randbytes(500), dtype=np.uint8)
    hashes = window_hashes(data, 13)
    assert len(hashes) == 488 and len(set(hashes.tolist())) == 488
    assert (window_hashes(data[100:200], 13) == hashes[100:188]).all()
    want = sorted({s + int(np.argmin(hashes[s : s + 21])) for s in range(488 - 20)})
    assert anchors(hashes, 21).tolist() == want
