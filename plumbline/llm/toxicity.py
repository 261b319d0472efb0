"""Toxicity by a classifier chain.

The categories are predicted one after the other by linear models; each model sees the text's features and the
probabilities of the categories before it. A later model is trained on out-of-fold predictions of the earlier ones, so it
learns how good these are on unseen texts. Features are the logarithms of the counts of whole tokens and word
beginnings, and of the text's length.

The models are fitted on a bounded sample of the labelled rows (``sample`` rows, those with the smallest hash of their
doc_id); every text is then scored in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import stored

SAMPLE, FEATURES, FOLDS, THRESHOLD = 5_000, 512, 5, 0.5
STARTS = (3, 4, 5, 6, 7)
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def _token_features(token: str) -> list[int]:
    parts = [token] + [f"{token[:n]}\x00" for n in STARTS if len(token) >= n]
    return [xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) - 2**63 for p in parts]


def _tokens(text: str | None) -> Counter:
    return Counter(_TOKEN.findall(text.lower())) if text else Counter()


def _counted(text: str | None) -> tuple[list[int], list[int], int]:
    """The text's features in order, their counts, and the number of tokens."""
    tokens, counts = _tokens(text), Counter()
    for token, n in tokens.items():
        for f in _token_features(token):
            counts[f] += n
    keys = sorted(counts)
    return keys, [counts[k] for k in keys], tokens.total()


def _inputs(counts: np.ndarray, length: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    return np.hstack([np.log1p(counts), np.log1p(length)[:, None], earlier, np.ones((len(counts), 1))])


@dataclass
class Linear:
    """Logistic regression on chosen features and the earlier probabilities."""

    features: np.ndarray  # sorted hashes
    weights: np.ndarray  # one per feature, then for the length, then one per earlier category, then the constant

    def predict(self, counts: np.ndarray, length: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        x = _inputs(counts, length, earlier)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps for the penalised likelihood; the constant is not penalised."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _informative(keys: np.ndarray, n: np.ndarray, hit: np.ndarray, total: float, positive: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The features with the largest chi-square against the label, of those that three texts have, and these values.

    ``n`` texts have a feature, ``hit`` of them with the label, out of ``total`` and ``positive``.
    """
    expected = n * positive / total
    chi = (hit - expected) ** 2 / np.maximum(expected, 1e-9) + (hit - expected) ** 2 / np.maximum(n - expected, 1e-9)
    chi[n < 3] = -1
    best = np.lexsort((keys, -chi))[:most]
    best = best[chi[best] > 0]
    return keys[best], chi[best]


def _chosen_features(counted: DataFrame, categories: list[str], most: int) -> dict[tuple[int, int], np.ndarray]:
    """The features in order for each category and each fold left out (``FOLDS``: none), of texts (id, fold, labels, features).

    Spark counts the texts of a feature; tasks keep their best ones, which alone reach the driver.
    """
    labelled = [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0.0)) for c in categories for k in range(FOLDS)]
    texts = [F.sum((F.col("fold") == k).cast("double")) for k in range(FOLDS)]
    sums = [x.alias(f"s{i}") for i, x in enumerate(texts + labelled)]
    whole = np.array(counted.agg(*sums).first(), dtype=float).reshape(-1, FOLDS)
    rows = counted.select("fold", *categories, F.explode("features").alias("feature"))
    table = rows.groupBy("feature").agg(F.count("*").alias("n"), *sums).filter("n >= 3").drop("n")

    def without(x: np.ndarray, k: int) -> np.ndarray:
        return x.sum(axis=0) - (x[k] if k < FOLDS else 0)

    wanted = [(c, k) for c in range(len(categories)) for k in (range(FOLDS + 1) if c + 1 < len(categories) else [FOLDS])]
    wanted = [(c, k) for c, k in wanted if without(whole[0], k) > 0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {w: (np.zeros(0, dtype=np.int64), np.zeros(0)) for w in wanted}
        for batch in batches:
            keys = batch.column(0).to_numpy()
            x = np.array([c.to_numpy() for c in batch.columns[1:]]).reshape(-1, FOLDS, len(keys))
            for c, k in wanted:
                found = _informative(keys, without(x[0], k), without(x[1 + c], k), without(whole[0], k), without(whole[1 + c], k), most)
                every = [np.concatenate(p) for p in zip(best[c, k], found)]
                first = np.lexsort((every[0], -every[1]))[:most]
                best[c, k] = every[0][first], every[1][first]
        for (c, k), (keys, chi) in best.items():
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array([c] * n, pa.int32()), pa.array([k] * n, pa.int32()), pa.array(keys), pa.array(chi)], names=["c", "k", "feature", "chi"])

    # at most ``most`` rows for each model and task
    got = table.mapInArrow(work, "c int, k int, feature bigint, chi double").toArrow()
    c, k, keys, chi = (got.column(name).to_numpy() for name in ("c", "k", "feature", "chi"))
    out = {}
    for w in wanted:
        mine = np.flatnonzero((c == w[0]) & (k == w[1]))
        out[w] = np.sort(keys[mine[np.lexsort((keys[mine], -chi[mine]))[:most]]])
    return out


def _table(ids: np.ndarray, counts: np.ndarray, rows: np.ndarray, n: int, features: np.ndarray) -> np.ndarray:
    out = np.zeros((n, len(features)))
    if len(features):
        at = np.minimum(np.searchsorted(features, ids), len(features) - 1)
        found = features[at] == ids
        out[rows[found], at[found]] = counts[found]
    return out


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE, most: int = FEATURES) -> list[Linear]:
    """One model per category (0/1 columns of ``labels``), in the order of the chain.

    Labels that are null, or whose text is missing, are left out; with no labelled row at all every model says 0.5, and a
    category with one label only says nearly that label.
    """
    names = [F.col(c).cast("double").alias(c) for c in categories]
    known = labels.select(F.col("doc_id").alias("id"), *names).dropna()
    order = F.xxhash64("id")
    chosen = known.orderBy(order, "id").limit(sample)
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, lengths = zip(*(_counted(x.as_py()) for x in batch.column("text"))) if batch.num_rows else ([], [], [])
            keep = [c for c in batch.schema.names if c != "text"]
            folds = [xxhash.xxh3_64_intdigest(str(i), seed=1) % FOLDS for i in batch.column("id").to_pylist()]
            made = [pa.array(folds, pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32())), pa.array(lengths, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, names=[*keep, "fold", "features", "counts", "tokens"])

    shape = "id bigint, " + ", ".join(f"`{c}` double" for c in categories) + ", fold int, features array<bigint>, counts array<int>, tokens bigint"
    counted = texts.join(F.broadcast(chosen), "id").select(F.col("id").cast("bigint"), *categories, "text").mapInArrow(work, shape)
    counted = stored(counted, "features")
    selected = _chosen_features(counted, categories, most) if counted.take(1) else {}
    if not selected:
        # nothing is known to belong to a category
        return [Linear(np.zeros(0, dtype=np.int64), np.append(np.zeros(k + 1), -30.0)) for k in range(len(categories))]
    # of the texts' features only those of some model come here, as places in their order
    union = np.unique(np.concatenate(list(selected.values())))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            lists = columns["features"]
            keys = lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(union, keys), max(0, len(union) - 1))
            found = union[at] == keys if len(union) else np.zeros(len(keys), dtype=bool)
            cuts = np.append(0, np.cumsum(found))[np.append(0, np.cumsum(lists.value_lengths().to_numpy()))].astype(np.int32)
            columns["features"] = pa.ListArray.from_arrays(cuts, pa.array(at[found].astype(np.int32)))
            columns["counts"] = pa.ListArray.from_arrays(cuts, pa.array(columns["counts"].flatten().to_numpy()[found]))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    got = counted.mapInArrow(reduce, shape.replace("features array<bigint>", "features array<int>")).toArrow()
    n = got.num_rows
    order = np.argsort(got.column("id").to_numpy(), kind="stable")
    got = got.take(pa.array(order))
    lists = got.column("features").combine_chunks()
    counts, length = got.column("counts").combine_chunks().flatten().to_numpy(), got.column("tokens").to_numpy()
    ids, rows = lists.flatten().to_numpy(), np.repeat(np.arange(n, dtype=np.int32), lists.value_lengths().to_numpy())
    fold = got.column("fold").to_numpy()
    models, earlier = [], np.zeros((n, 0))
    for i, c in enumerate(categories):
        y = got.column(c).to_numpy()

        def inputs(features: np.ndarray) -> np.ndarray:
            return _table(ids, counts, rows, n, np.searchsorted(union, features))

        def model(train: np.ndarray, k: int) -> Linear:
            features = selected[i, k]
            x = _inputs(inputs(features), length, earlier)
            return Linear(features, _fit(x[train], y[train]))

        models.append(model(np.ones(n, dtype=bool), FOLDS))
        if c != categories[-1]:
            outside = np.zeros(n)
            for k in range(FOLDS):
                test = fold == k
                if test.any() and not test.all():
                    part = model(~test, k)
                    outside[test] = part.predict(inputs(part.features)[test], length[test], earlier[test])
            earlier = np.hstack([earlier, outside[:, None]])
    return models


def score_chain(docs: DataFrame, models: list[Linear], keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (doc_id) and ``probabilities``, one per category. Null texts have no features."""
    keep = keep or ["doc_id"]
    columns = sorted({int(f) for m in models for f in m.features})
    place = {f: i for i, f in enumerate(columns)}
    parts = [np.array([place[int(f)] for f in m.features], dtype=np.int64) for m in models]

    class Known(dict):
        def __missing__(self, token: str) -> tuple[int, ...]:
            if len(self) > 400_000:
                self.clear()
            self[token] = out = tuple(place[f] for f in _token_features(token) if f in place)
            return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            texts, out = batch.column(batch.num_columns - 1), []
            for at in range(0, batch.num_rows, 512):
                part = texts.slice(at, 512)
                x, length = np.zeros((len(part), len(columns))), np.zeros(len(part))
                for i, text in enumerate(part):
                    tokens = _tokens(text.as_py())
                    length[i] = tokens.total()
                    for token, n in tokens.items():
                        for f in known[token]:
                            x[i, f] += n
                earlier = np.zeros((len(part), 0))
                for m, own in zip(models, parts):
                    earlier = np.hstack([earlier, m.predict(x[:, own], length, earlier)[:, None]])
                out += earlier.tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "probabilities"]
            )

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    shape = rows.drop("_text").schema.add("probabilities", T.ArrayType(T.DoubleType()))
    return rows.mapInArrow(work, shape)


CHAIN = ["low_quality", "toxic"]


def chain_labels(labels: DataFrame) -> DataFrame:
    """The categories that the label table offers: low quality, then toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic, rejected) of every row of ``docs`` (doc_id, text; more columns are ignored).

    ``rejected`` is a toxicity of at least ``threshold``. Null and empty texts have no features, take the models' constant
    and are never rejected. Repeated rows and null ids are rows like any other. Of labels given twice for one doc_id all
    count in the fit. Without any labelled text nothing is rejected.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", (F.length(F.coalesce("text", F.lit(""))) > 0).alias("has"))
    scored = score_chain(rows, fit_chain(docs, chain_labels(labels), CHAIN), ["doc_id", "has"])
    p = F.col("probabilities")
    return scored.select("doc_id", p[0].alias("p_low_quality"), p[1].alias("p_toxic"), (F.col("has") & (p[1] >= threshold)).alias("rejected"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their own columns."""
    models = fit_chain(docs, chain_labels(labels), CHAIN)
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    scored = score_chain(rows, models, ["row"])
    has = F.length(F.coalesce(F.col("row.text"), F.lit(""))) > 0
    return scored.filter(~(has & (F.col("probabilities")[1] >= threshold))).select("row.*")
