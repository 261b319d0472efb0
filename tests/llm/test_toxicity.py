import numpy as np
from llm_data import FOLDER, rows_of

from plumbline.llm.toxicity import Linear, _fit, chain_labels, drop_toxic, fit_chain, score_chain, toxicity


def test_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity(docs, labels.filter("doc_id % 3 <> 0")).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    toxic = [r for r in got if r.toxic]
    clean = [r for r in got if not r.toxic]
    assert sum(r.rejected for r in toxic) > 0.9 * len(toxic)
    assert sum(r.rejected for r in clean) <= 0.005 * len(clean)


def test_chain_feeds_on():
    first = Linear(np.array([5]), np.array([3.0, 0.0, -1.0]))
    second = Linear(np.array([7]), np.array([1.0, 0.0, 4.0, -2.0]))
    p = first.predict(np.array([[np.e - 1]]), np.ones(1), np.zeros((1, 0)))
    assert abs(p[0] - 1 / (1 + np.exp(-2))) < 1e-12
    assert abs(second.predict(np.array([[0.0]]), np.ones(1), p[:, None])[0] - 1 / (1 + np.exp(2 - 4 * p[0]))) < 1e-12
    x = np.array([[1.0, 1], [0, 1], [1, 1], [0, 1]])
    assert _fit(x, np.array([1.0, 0, 1, 0]))[0] > 0.5


def test_small_cases(spark):
    texts = [None, "", "   ", "a bad bad word", "fine words", "fine words", "bad " * 300_000]
    docs = spark.createDataFrame([(i if i < 6 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, probabilities int")
    labels = spark.createDataFrame([(3, 0, 1), (4, 1, 0), (5, 1, None), (99, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity(docs, labels).count() == 7
    assert not any(r[3] for r in rows_of(toxicity(docs, labels.limit(0))))
    assert toxicity(docs.limit(0), labels).count() == 0
    assert drop_toxic(docs, labels, 2.0).columns == docs.columns
    models = fit_chain(docs, chain_labels(labels), ["toxic"])
    assert score_chain(docs, models).count() == 7


def test_table_keeps_columns(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    assert drop_toxic(docs, labels).schema == docs.schema


def test_words_share_their_seven_letter_beginning():
    from plumbline.llm.toxicity import _token_features

    shared = set(_token_features("nastiestxa")) & set(_token_features("nastiestyb"))
    assert len(shared) == 5


def test_only_chosen_features_reach_the_driver(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from plumbline.llm.toxicity import _counted

    texts = [" ".join(f"w{i}x{j}" for j in range(1500)) + (" vile" if i % 2 else " kind") for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 4 // 3, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    taken, whole = [], DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda df: taken.append(whole(df)) or taken[-1])
    models = fit_chain(docs, chain_labels(labels), ["low_quality", "toxic"], most=20)
    assert sum(t.nbytes for t in taken) < 100_000
    # the features of the last model, counted plainly
    have = [set(_counted(t)[0]) for t in texts]
    chi = {}
    for f in set().union(*have):
        n, hit = sum(f in h for h in have), sum(f in h for h in have[1::2])
        if n >= 3:
            chi[f] = (hit - n / 2) ** 2 / (n / 2) * 2
    best = sorted((f for f in chi if chi[f] > 0), key=lambda f: (-chi[f], f))[:20]
    assert models[1].features.tolist() == sorted(best)
