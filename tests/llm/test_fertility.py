import random
import re
from collections import Counter

import pytest
from llm_data import documents

from plumbline.llm.fertility import VOCABULARIES, Vocabulary, fertility_rules

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute(text):
    text = text or ""
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    hit = {i + k for i in range(len(ws) - 4) if grams[tuple(ws[i : i + 5])] > 1 for k in range(5)}
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def test_table(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in fertility_rules(docs).collect()}
    kept = 0
    for r in docs.collect():
        want, row = brute(r.text), got[r.doc_id]
        assert tuple(row[c] for c in COUNTS) == want
        assert row.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (row.kept and row.base_failed)
        kept += row.kept
    assert kept > 0.85 * len(got)


def test_small_cases(spark):
    texts = [None, "", " \n\t", "a b c d e a b c d e", "x\n\nx\n x\nx", "é ü # *", "w " * 400_000, "\x1f\x85 a"]
    docs = spark.createDataFrame([(i, t, None, 1.5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept double")
    for r in fertility_rules(docs.union(docs)).collect():
        assert tuple(r[c] for c in COUNTS) == brute(texts[r.doc_id])
    assert fertility_rules(docs.limit(0)).count() == 0


@pytest.mark.parametrize("path", [*VOCABULARIES, "/opt/tokenizers/piece_bpe_32k.model"])
def test_slices_measure_alike(path, monkeypatch):
    text = "The old ñandú ran, über 3 hills; " * 200 + "word " * 50
    vocabulary = Vocabulary(path)
    whole = vocabulary.measure(text)
    monkeypatch.setattr("plumbline.llm.fertility.SLICE", 100)
    parts = vocabulary.measure(text)
    if path.endswith("tiktoken"):
        assert parts == whole
    assert 1 < whole[1] < 8 and 0 <= whole[2] < 0.5 and 0 < whole[3] < 1


def test_short_texts_and_small_languages_are_judged(spark):
    rng = random.Random(3)
    garbled = " ".join("".join(rng.choice("bqzxkvj0193#QXZ") for _ in range(4)) for _ in range(14))
    small = [" ".join("".join(rng.choice("\u0430\u0431\u0432\u0433\u0434\u0435\u0438\u043a") for _ in range(4)) for _ in range(20)) for _ in range(40)]
    docs = documents(spark).select("doc_id", "text", "lang")
    usual = docs.filter("lang = 'en' AND length(text) > 1000").orderBy("doc_id").first()
    more = [(-1, garbled, "en"), (-2, " ".join(usual.text.split()[:25]), "en")]
    more += [(-100 - i, t, "xx") for i, t in enumerate(small)]
    rows = fertility_rules(docs.union(spark.createDataFrame(more, docs.schema))).collect()
    got = {r.doc_id: r for r in rows if r.doc_id < 0}
    assert max(got[-1].n_tokens) < 100 and not got[-1].base_failed and not got[-1].kept
    assert got[-2].kept
    judged = [r for i, r in got.items() if i <= -100 and not r.base_failed]
    assert len(judged) > 20 and sum(r.kept for r in judged) > 0.8 * len(judged)
