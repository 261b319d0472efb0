"""Quality rules on tokeniser fertility, next to simple text counts.

Public vocabularies measure each text: characters per token, the share of tokens that hold only a part of a character
(byte fallback), and the entropy of the token distribution relative to its largest value. Bands per language reject texts
that a vocabulary takes apart in an unusual way: they come from the quartiles of all the language's texts, drawn towards
those of the corpus where these are few, and widen for short texts. One pass over the
texts without a shuffle writes the measures, which are small; the quartiles are one mergeable aggregate over them.
"""

from __future__ import annotations

import base64
import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import small, stored
from plumbline.llm.near_dup import WordHashes

VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_TOKENS = 100  # shorter texts vary more, and their bands widen by WIDEN * (1 / sqrt(tokens) - 1 / sqrt(PLAIN_TOKENS))
WIDEN = 2.0, 1.0  # for characters per token, times the median; for the fallback share
PRIOR_TEXTS = 10  # the bands of a language of n texts are n / (n + PRIOR_TEXTS) its own, the rest those of the whole corpus
SPREAD, FLOOR = 4.0, 0.10  # a band reaches SPREAD quartile ranges beyond the quartiles, at least FLOOR of the median
ENTROPY = 0.2  # least relative entropy
SLICE = 1_000_000  # characters encoded at once
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = (
    "doc_id bigint, " + ", ".join(f"{c} bigint" for c in _BASE) + ", n_tokens array<bigint>, chars_per_token array<double>, "
    "fallback_share array<double>, entropy array<double>, base_failed boolean, lang string"
)


class Vocabulary:
    """A vocabulary file: tiktoken ranks, or a sentencepiece model."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.part = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
            self.encode = lambda text: self.pieces.encode(text, num_threads=1)
        else:
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            coder = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.part = np.zeros(max(ranks.values()) + 1, dtype=bool)
            for token, i in ranks.items():
                try:
                    token.decode("utf-8")
                except UnicodeDecodeError:
                    self.part[i] = True
            self.encode = coder.encode_ordinary

    def measure(self, text: str) -> tuple[int, float | None, float | None, float | None]:
        """(tokens, characters per token, byte-fallback share, relative entropy); None for an empty text."""
        counts, at = np.zeros(len(self.part), dtype=np.int64), 0
        if len(text) <= SLICE:
            ids, n = np.unique(np.array(self.encode(text), dtype=np.int64), return_counts=True)
        else:
            while at < len(text):
                cut = _CUT.search(text, at + SLICE)
                end = cut.start() if cut else len(text)
                counts += np.bincount(self.encode(text[at:end]), minlength=len(counts))
                at = end
            ids = np.flatnonzero(counts)
            n = counts[ids]
        total = int(n.sum())
        if not total:
            return 0, None, None, None
        p = n / total
        bits = float(-(p * np.log2(p)).sum())
        return total, len(text) / total, float(n[self.part[ids]].sum()) / total, bits / math.log2(total) if total > 1 else 1.0


def base_counts(text: str, hashes: WordHashes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "surrogatepass")
    ws = raw.split()
    # code points are the bytes that do not continue a character
    chars = sum(map(len, ws)) if raw.isascii() else sum(len(w.decode("utf-8", "surrogatepass")) for w in ws)
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line.split(None, 1):
            dup += line in seen
            seen.add(line)
    repeated = 0
    if len(ws) > 5:
        h = np.array([hashes[w] for w in ws], dtype=np.uint64)
        s = np.zeros(len(h) - 4, dtype=np.uint64)
        for i in range(5):
            s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - 4 + i]
            s ^= s >> np.uint64(29)
        _, inverse, n = np.unique(s, return_inverse=True, return_counts=True)
        if n.max() > 1:
            edge = np.zeros(len(h) + 1, dtype=np.int64)
            twice = np.flatnonzero(n[inverse] > 1)
            np.add.at(edge, twice, 1)
            np.add.at(edge, twice + 5, -1)
            repeated = int((np.cumsum(edge) > 0).sum())
    return len(ws), chars, len(_SYMBOLS.findall(text)), dup, repeated


def measures(docs: DataFrame, vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang) the base counts and one list element per vocabulary of every measure."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, vocabs = WordHashes(), [Vocabulary(v) for v in vocabularies]
        for batch in batches:
            out = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_counts(text, hashes)
                failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
                out.append((*base, *map(list, zip(*(v.measure(text) for v in vocabs))), failed))
            columns = list(zip(*out)) if out else [[]] * 10
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)]
                + [pa.array(c, pa.int64()) for c in columns[:5]]
                + [pa.array(columns[5], pa.list_(pa.int64()))]
                + [pa.array(c, pa.list_(pa.float64())) for c in columns[6:9]]
                + [pa.array(columns[9], pa.bool_()), batch.column(2)],
                names=[c.split()[0] for c in _SCHEMA.split(", ")],
            )

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), lang.cast("string")).mapInArrow(work, _SCHEMA)


def bands(rows: DataFrame, n_vocabularies: int) -> DataFrame:
    """(band_lang, n, low, mid, high, most): per language its texts, bounds and median of characters per token, and the largest
    fallback share.

    The last four are lists by vocabulary. The row of a null language holds the bands of the whole corpus.
    """
    judged = rows.filter(F.col("n_tokens")[0] > 0)
    quartiles = lambda c, k: F.percentile_approx(F.col(c)[k], [0.25, 0.5, 0.75], 10_000)
    found = [F.count("*").alias("n")]
    for k in range(n_vocabularies):
        found += [quartiles("chars_per_token", k).alias(f"c{k}"), quartiles("fallback_share", k).alias(f"f{k}")]
    by_lang = judged.filter("lang IS NOT NULL").groupBy(F.col("lang").alias("band_lang")).agg(*found)
    everything = judged.agg(*found).select(F.lit(None).cast("string").alias("band_lang"), "n", *[f"{x}{k}" for k in range(n_vocabularies) for x in "cf"])

    def reach(q, floor):
        return F.greatest((q[2] - q[0]) * SPREAD, floor)

    each = range(n_vocabularies)
    c, f = [F.col(f"c{k}") for k in each], [F.col(f"f{k}") for k in each]
    return by_lang.unionByName(everything).select(
        "band_lang",
        "n",
        F.array(*[q[0] - reach(q, q[1] * FLOOR) for q in c]).alias("low"),
        F.array(*[q[1] for q in c]).alias("mid"),
        F.array(*[q[2] + reach(q, q[1] * FLOOR) for q in c]).alias("high"),
        F.array(*[q[2] + reach(q, F.lit(FLOOR)) for q in f]).alias("most"),
    )


def fertility_rules(docs: DataFrame, vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang; more columns are ignored): base counts, measures and verdict.

    ``base_failed`` is fewer than 10 words, or more than a fifth of the words in repeated 5-word windows. ``kept`` needs a
    passed base and every vocabulary inside the bands of the language. Every text with a token is judged; the bands widen for
    fewer than ``PLAIN_TOKENS`` tokens. Null and empty texts have zero counts, null measures and fail the base. A null language
    takes the bands of the whole corpus, and a language of few texts is drawn towards them. Repeated rows and null ids are
    rows like any other. Texts of any length are encoded in slices cut between words.
    """
    n = len(vocabularies)
    rows = stored(measures(docs, vocabularies), "measures")
    limits = stored(bands(rows, n), "bands")
    usual = limits.filter("band_lang IS NOT NULL")
    # one row each of the corpus' own bands, as constants
    whole = limits.filter("band_lang IS NULL").first()
    joined = rows.join(small(usual, usual.count()), F.col("lang") == F.col("band_lang"), "left")
    own = F.coalesce(F.col("n") / (F.col("n") + PRIOR_TEXTS), F.lit(0.0))

    def drawn(c: str, k: int):
        corpus = F.lit((whole[c] or [None] * n)[k]).cast("double")
        return own * F.coalesce(F.col(c)[k], F.lit(0.0)) + (1 - own) * corpus

    def inside(k: int):
        c = F.col("chars_per_token")[k]
        wider = F.greatest(1 / F.sqrt(F.greatest(F.col("n_tokens")[k], F.lit(1))) - 1 / PLAIN_TOKENS**0.5, F.lit(0.0))
        margin = wider * WIDEN[0] * drawn("mid", k)
        fits = c.between(drawn("low", k) - margin, drawn("high", k) + margin)
        return fits & (F.col("fallback_share")[k] <= drawn("most", k) + wider * WIDEN[1]) & (F.col("entropy")[k] >= ENTROPY)

    verdict = ~F.col("base_failed")
    for k in range(n):
        verdict = verdict & F.coalesce(inside(k), F.lit(True))
    return joined.withColumn("kept", verdict).drop("band_lang", "n", "low", "mid", "high", "most", "lang")
