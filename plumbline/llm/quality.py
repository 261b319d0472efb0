"""A quality classifier: a generalised additive model with pairwise interactions, learnt by cyclic boosting.

Each text gives a few dozen numbers (``FEATURES``), computed once where the texts lie and written, without a shuffle. A bounded
sample of labelled rows, features only, goes to the driver, where shallow trees are boosted on one feature after the other in
small steps, so that each feature ends up with a lookup table over its bins. Then the pairs of features that explain most of
what is left get tables over two features in the same way. A score is the sum of the entries that a text's bins point to,
added up for whole batches at a time; the tables are a few kilobytes, whatever the size of the corpus.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored

SAMPLE = 20_000  # labelled rows that a model is fitted on at most: those with the smallest hashes of their doc_id
BINS, COARSE = 32, 8  # bins of a feature alone and in a pair, besides the one for missing values
BAGS = 4  # models averaged, each stopped by another quarter of the rows
ROUNDS, PAIR_ROUNDS, PATIENCE = 200, 80, 15
PAIRS = 8
RATE, SHRINK, LEAST = 0.1, 1.0, 5.0  # step, added to a leaf's weight, rows of a leaf at least

FEATURES = (
    "bytes", "words", "word_bytes", "word_spread", "longest_word", "upper", "digit", "blank", "line", "beyond_ascii",
    "stop", "comma", "exclaim", "pipe", "mark", "other_sign", "sign_run", "doubled", "capital_word", "sign_end", "short_word", "distinct_word",
    "top_word", "entropy", "change", "packed", "line_words", "dup_line", "distinct_pair",
)


def _group(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_UPPER, _LOWER, _DIGIT = _group(bytes(range(65, 91))), _group(bytes(range(97, 123))), _group(b"0123456789")
_SPACE = _group(b" \t\n\r\x0b\x0c")
_SIGN = _group(bytes(b for b in range(33, 127) if not chr(b).isalnum()))
_MARK = _group(b"#*$%&<>~^_=+@\\/{}[]")
_CLASS = (_UPPER * 1 + _LOWER * 2 + _DIGIT * 3 + _SPACE * 4 + _SIGN * 5).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """The numbers of one whole text; those that an empty text does not have are missing (nan)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    out = np.full(len(FEATURES), np.nan, dtype=np.float32)
    out[0], out[1] = np.log1p(len(raw)), np.log1p(len(words))
    if not words:
        return out
    a = np.frombuffer(raw, dtype=np.uint8)
    n, hist = len(a), np.bincount(a, minlength=256)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    share = lambda group: hist[group].sum() / n
    sign, space = _SIGN[a], _SPACE[a]
    begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(~space & np.concatenate([space[1:], [True]]))
    p = hist[hist > 0] / n
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    kind = _CLASS[a]
    out[2:] = (
        size.mean(), size.std(), np.log1p(size.max()), share(_UPPER), share(_DIGIT), share(_SPACE), hist[10] / n, hist[128:].sum() / n,
        hist[46] / n, hist[44] / n, hist[33] / n, hist[124] / n, share(_MARK), share(_SIGN), (sign[1:] & sign[:-1]).sum() / n,
        (a[1:] == a[:-1]).sum() / n, _UPPER[a[begin]].mean(), sign[end].mean(), (size <= 3).mean(), len(seen) / len(words),
        max(seen.values()) / len(words), -(p * np.log2(p)).sum(), (kind[1:] != kind[:-1]).sum() / n, len(zlib.compress(raw, 1)) / n,
        np.log1p(len(words) / len(lines)), 1 - len(set(lines)) / len(lines),
        len(np.unique(a[1:].astype(np.int32) << 8 | a[:-1])) / n,
    )
    return out


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, features) of every row of ``docs`` (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([features(t.as_py()) for t in batch.column(1)], dtype=np.float32).reshape(-1, len(FEATURES))
            cuts = pa.array(np.arange(len(rows) + 1) * len(FEATURES), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(cuts, pa.array(rows.ravel()))], names=["doc_id", "features"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(work, "doc_id bigint, features array<float>")


@dataclass
class Model:
    """Lookup tables on the log-odds scale. Bin 0 of each feature is that of missing values."""

    intercept: float
    cuts: list[np.ndarray]
    tables: np.ndarray  # feature x bin
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pair_tables: np.ndarray | None = None  # pair x bin x bin

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Of rows of features."""
        out = np.full(len(x), self.intercept)
        for k, cuts in enumerate(self.cuts):
            out += self.tables[k][binned(x[:, k], cuts)]
        used = {k for pair in self.pairs for k in pair}
        coarse = {k: binned(x[:, k], self.pair_cuts[k]) for k in used}
        for (i, j), table in zip(self.pairs, self.pair_tables if self.pairs else []):
            out += table[coarse[i], coarse[j]]
        return out


def quantile_cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Borders of ``bins`` bins at most: one of the smallest value, which may be that of most rows, and the others of about equal size."""
    x = np.sort(x[~np.isnan(x)])
    above = x[np.searchsorted(x, x[:1], "right")[0] :] if len(x) else x
    return np.unique(above[(np.arange(bins - 1) * len(above)) // (bins - 1)]) if len(above) else above


def binned(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), 0, np.searchsorted(cuts, x, "right") + 1)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SHRINK)


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """(gain, last bin on the left) of the best cut of a row of bins with sums of gradients, weights and rows; (0, -1) if none."""
    if len(g) < 2:
        return 0.0, -1
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    gain = np.where((nl >= LEAST) & (n.sum() - nl >= LEAST), gain, 0.0)
    at = int(gain.argmax())
    return (float(gain[at]), at) if gain[at] > 1e-9 else (0.0, -1)


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return RATE * g.sum() / (h.sum() + SHRINK)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The step of a tree of at most three leaves over the bins of one feature; missing values are a leaf of their own."""
    step = np.zeros(len(g))
    if n[0] >= LEAST:
        step[0] = _leaf(g[0], h[0])
    edges = [1, len(g)]
    for _ in range(2):
        cuts = [(*_best_cut(g[i:j], h[i:j], n[i:j]), i) for i, j in zip(edges, edges[1:])]
        gain, at, first = max(cuts)
        if at < 0:
            break
        edges = sorted([*edges, first + at + 1])
    if len(edges) > 2:
        for i, j in zip(edges, edges[1:]):
            step[i:j] = _leaf(g[i:j], h[i:j])
    return step


def _tree2(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """The step of a tree of depth two over the bins of two features, the better of both orders, and its gain."""
    best, found = np.zeros(g.shape), 0.0
    for turned in (False, True):
        gt, ht, nt = (x.T if turned else x for x in (g, h, n))
        step, total = np.zeros(gt.shape), 0.0
        # the first cut is where the two second cuts gain most
        for at in range(1, gt.shape[0]):
            parts = [(slice(0, at), _best_cut(gt[:at].sum(0), ht[:at].sum(0), nt[:at].sum(0))), (slice(at, None), _best_cut(gt[at:].sum(0), ht[at:].sum(0), nt[at:].sum(0)))]
            gain = sum(cut[0] for _, cut in parts)
            if gain > total:
                total, step = gain, np.zeros(gt.shape)
                for rows, (_, cut) in parts:
                    for cols in (slice(0, cut + 1), slice(cut + 1, None)) if cut >= 0 else ():
                        step[rows, cols] = _leaf(gt[rows, cols], ht[rows, cols])
        if total > found:
            best, found = step.T if turned else step, total
    return best, found


def _loss(f: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, f) - y * f)) if len(y) else 0.0


def _boost(y: np.ndarray, start: np.ndarray, cells: list[np.ndarray], sizes: list[int], tree, rounds: int, fit: np.ndarray, rest: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Tables over ``cells``, each visited once a round in turn, as they were when the loss on ``rest`` was least; and the scores."""
    tables, f = [np.zeros(s) for s in sizes], start.copy()
    best, least, since = [t.copy() for t in tables], _loss(f[rest], y[rest]), 0
    for _ in range(rounds):
        for k, cell in enumerate(cells):
            p = 1 / (1 + np.exp(-f[fit]))
            g, h = (np.bincount(cell[fit], w, sizes[k]) for w in (y[fit] - p, p * (1 - p)))
            step = tree(k, g, h)
            if step.any():
                tables[k] += step
                f += step[cell]
        loss = _loss(f[rest], y[rest])
        if loss < least - 1e-6:
            best, least, since = [t.copy() for t in tables], loss, 0
        else:
            since += 1
            if since > PATIENCE:
                break
    return best, start + sum((t[c] for t, c in zip(best, cells)), np.zeros(len(y)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of rows of features and labels 0 or 1; rows in any order that is always the same give the same model."""
    n, n_features = len(y), len(FEATURES)
    x, y = x.reshape(n, n_features), y.astype(float)
    prior = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    cuts, coarse = ([quantile_cuts(x[:, k], b) for k in range(n_features)] for b in (BINS, COARSE))
    if n == 0 or y.min() == y.max():
        return Model(prior, cuts, np.zeros((n_features, BINS + 1)), [], coarse)
    cells, small = ([binned(x[:, k], c[k]) for k in range(n_features)] for c in (cuts, coarse))
    sizes, counts = [BINS + 1] * n_features, []
    bags, scores = [np.arange(n) % BAGS == b for b in range(BAGS)], []
    tables = np.zeros((n_features, BINS + 1))
    for rest in bags:
        counts = [np.bincount(c[~rest], minlength=BINS + 1) for c in cells]
        start = np.full(n, prior)
        found, f = _boost(y, start, cells, sizes, lambda k, g, h: _tree(g, h, counts[k]), ROUNDS, ~rest, rest)
        tables += np.array(found) / BAGS
        scores.append(f)
    # the pairs that explain most of what is left of the average
    p = 1 / (1 + np.exp(-np.mean(scores, axis=0)))
    side = COARSE + 1
    shape = (side, side)

    def sums(cell: np.ndarray, *weights: np.ndarray) -> list[np.ndarray]:
        return [np.bincount(cell, w, side * side).reshape(shape) for w in weights]

    def gain(pair: tuple[int, int]) -> float:
        return _tree2(*sums(small[pair[0]] * side + small[pair[1]], y - p, p * (1 - p), np.ones(n)))[1]

    pairs = sorted(combinations(range(n_features), 2), key=lambda pair: (-gain(pair), pair))[:PAIRS]
    joint = [small[i] * side + small[j] for i, j in pairs]
    pair_tables = np.zeros((len(pairs), *shape))
    for rest, f in zip(bags, scores):
        counts = [np.bincount(c[~rest], minlength=side * side).reshape(shape) for c in joint]
        tree = lambda k, g, h: _tree2(g.reshape(shape), h.reshape(shape), counts[k])[0].ravel()
        found, _ = _boost(y, f, joint, [side * side] * len(pairs), tree, PAIR_ROUNDS, ~rest, rest)
        pair_tables += np.array(found).reshape(-1, *shape) / BAGS
    return Model(prior, cuts, tables, pairs, coarse, pair_tables)


def held_out(doc_id: Column) -> Column:
    """Whether the crc32 of the doc_id as text leaves 1 modulo 3; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(table: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``rows`` labelled documents that are not held out, in the order of hashes of their doc_id.

    Of a doc_id with several texts the largest features count, of one with several labels the larger label.
    """
    wanted = labels.select(F.col("doc_id").cast("bigint"), F.col("quality").cast("int").alias("y"))
    wanted = wanted.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    wanted = wanted.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(*order).limit(rows)
    one = table.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.max("features").alias("features"), F.max("y").alias("y"))
    found = one.orderBy(*order).limit(rows).select("features", "y").toArrow().combine_chunks()
    x = found["features"].combine_chunks().flatten().to_numpy() if len(found) else np.zeros(0, dtype=np.float32)
    return x.reshape(-1, len(FEATURES)), found["y"].to_numpy()


def scored(table: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of a feature table."""
    sent = table.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-sent.value.log_odds(x))))], names=["doc_id", "score"])

    return table.select("doc_id", "features").mapInArrow(work, "doc_id bigint, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """``op13_quality``: (doc_id, held_out, score, predicted), one row per row of ``docs`` (doc_id, text; more columns are ignored).

    The model learns from at most ``rows`` labels (doc_id, quality) that are not held out; null ids and other labels than 0 and 1
    are no labels, and without any every score is 0.5. Null and empty texts and those of blanks have two features, the others
    are missing. Repeated rows and null ids are scored like any other. Texts are measured whole.
    """
    table = stored(feature_table(docs), "features")
    result = scored(table, fit(*labelled_sample(table, labels, rows)))
    return result.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
