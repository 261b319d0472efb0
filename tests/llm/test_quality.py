import random
import zlib

import numpy as np
from llm_data import rows_of

from plumbline.llm import quality as q

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = q.quality_scores(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    y, s = np.array([r.quality for r in got]), np.array([r.score for r in got])
    assert len(y) > 1000 and all(r.predicted == (r.score >= 0.5) for r in got)
    good, bad = s[y == 1], s[y == 0]
    auc = np.mean([(g > bad).mean() + (g == bad).mean() / 2 for g in good])
    assert auc > 0.97, auc
    assert ((s >= 0.5) == (y == 1)).mean() > 0.97


def test_tables_add_up():
    """Scores are sums of table entries, and a product of two features needs the table of its pair."""
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(q.FEATURES))).astype(np.float32)
    x[::50, 5] = np.nan
    y = ((x[:, 2] > 0.5) ^ (x[:, 9] > 0.4)).astype(int)
    model = q.fit(x, y)
    assert (2, 9) in model.pairs
    f = model.log_odds(x)
    # rows between a border of the bins and the border of the labels cannot be told apart
    assert ((f > 0) == (y == 1)).mean() > 0.92
    for i in (0, 7, 50):
        want = model.intercept
        for k in range(len(q.FEATURES)):
            want += model.tables[k][0 if np.isnan(x[i, k]) else 1 + sum(x[i, k] >= c for c in model.cuts[k])]
        for (a, b), table in zip(model.pairs, model.pair_tables):
            at = [0 if np.isnan(x[i, k]) else 1 + sum(x[i, k] >= c for c in model.pair_cuts[k]) for k in (a, b)]
            want += table[at[0], at[1]]
        assert abs(want - f[i]) < 1e-9
    again = q.fit(x, y)
    assert np.array_equal(again.log_odds(x), f)


def test_best_cut_is_the_best():
    rng = np.random.default_rng(2)
    for _ in range(50):
        g, h, n = rng.normal(size=9), rng.random(9) * 3, rng.integers(0, 12, 9)
        gains = [
            sum(s.sum() ** 2 / (w.sum() + q.SHRINK) for s, w in ((g[:i], h[:i]), (g[i:], h[i:]))) - g.sum() ** 2 / (h.sum() + q.SHRINK)
            for i in range(1, 9) if n[:i].sum() >= q.LEAST and n[i:].sum() >= q.LEAST
        ]
        want = max([x for x in gains if x > 1e-9], default=0.0)
        assert abs(q._best_cut(g, h, n)[0] - want) < 1e-9


def test_features_use_the_whole_text():
    text = "some words here. " * 50_000
    assert not np.array_equal(q.features(text), q.features(text + "### |" * 5))
    assert np.isnan(q.features(None)[2:]).all() and np.array_equal(q.features(""), q.features(None), equal_nan=True)
    assert np.isfinite(q.features("x")).all() and np.isfinite(q.features("\U0001f600\n\n|")).all()


def test_small_cases(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["the", "of", "house", "garden"]) for _ in range(40)) + "." for _ in range(60)]
    bad = ["".join(rng.choice("#*$% A") for _ in range(120)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(None, "the house"), (None, None), (500, ""), (501, " \n"), (502, "w " * 300_000), (3, bad[0]), (3, bad[0])]
    docs = spark.createDataFrame([(*r, 0.5, "a") for r in rows], "doc_id long, text string, score double, features string")
    labels = [(i, int(i < 60), 0) for i in range(120)] + [(3, 1, 0), (None, 0, 0), (7, None, 0), (9, 5, 0), (999, 1, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, score int")
    got = q.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    plain = [r for r in got if r.doc_id is not None and r.doc_id < 120 and r.doc_id != 3]
    assert sum(r.predicted == (r.doc_id < 60) for r in plain) >= 0.95 * len(plain)
    # a bound on the sample, labels of one kind, no labels, no documents
    assert q.quality_scores(docs, labels, rows=30).count() == len(rows)
    assert {r.predicted for r in q.quality_scores(docs, labels.filter("quality = 1")).collect()} == {1}
    assert {r.score for r in q.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert rows_of(q.quality_scores(docs.limit(0), labels)) == []


def test_labels_held_out_are_not_learnt(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7} " * (i % 5 + 1)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    turned = spark.createDataFrame([(i, 1 - i % 2 if zlib.crc32(str(i).encode()) % 3 == 1 else i % 2) for i in range(200)], "doc_id long, quality int")
    assert sorted(rows_of(q.quality_scores(docs, labels))) == sorted(rows_of(q.quality_scores(docs, turned)))
