"""Queries with a statement against it, and small cases of the operators behind them and of the pipeline."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from llm_data import FOLDER, documents, rows_of
from oracle import compare, connect
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from plumbline.llm import decontaminate as dc
from plumbline.llm.common import stored
from plumbline.llm.components import components
from plumbline.llm.line_dedup import dedup_lines, line_report
from plumbline.llm.near_dup import drop_near_duplicates, near_duplicates
from plumbline.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", list(SQL))
def test_statement(spark, name):
    assert compare(spark, connect(FOLDER), name, QUERIES[name], SQL[name], FOLDER) == ""


def test_decontamination_cases(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"x {item} y", 5), (2, "One, two! three", 5), (3, None, 5), (4, "", 5), (None, item[4:], 5), (1, "other", 5), (5, "w " * 100_000 + "short item", 5), (6, item[:-11], 5)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([("a", item), ("b", "Short item"), ("c", None), ("d", ""), ("e", item), (None, "x")], "item_id string, text string")
    got = sorted(rows_of(dc.contaminated_documents(docs, bench).select("doc_id", "_n_words", "_n_hit", "_items")), key=str)
    assert got == sorted([(1, 13, 11, ["a", "e"]), (2, 3, 0, []), (3, 0, 0, []), (4, 0, 0, []), (None, 10, 10, ["a", "e"]), (1, 1, 0, []), (5, 100_002, 2, ["b"]), (6, 9, 0, [])], key=str)
    assert dc.drop_contaminated(docs, bench).columns == docs.columns and dc.drop_contaminated(docs, bench).count() == 5
    assert dc.decontamination_report(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert dc.decontamination_report(docs.limit(0), bench).count() == 0


def test_phrases_and_proximity(spark):
    index = dc.build_index(spark.createDataFrame([(1, "a b c a b"), (2, "b a")], "doc_id long, text string"))
    phrases = spark.createDataFrame([(7, ["a", "b"]), (8, ["b", "c", "a"]), (9, ["a", "a"]), (10, [])], "phrase_id long, words array<string>")
    assert sorted(rows_of(dc.phrase_matches(index, phrases))) == [(7, 1, 0), (7, 1, 3), (8, 1, 1)]
    pairs = spark.createDataFrame([("a", "c"), ("a", "a")], "first string, second string")
    assert sorted(r[2:] for r in rows_of(dc.proximity_matches(index, pairs, 2))) == [(1, 0, 2), (1, 3, 2)]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3), (102, 101)]
    got = dict(rows_of(components(spark.createDataFrame(links, "a long, b long"))))
    assert got == {**{i: 0 for i in range(41)}, **dict.fromkeys((100, 101, 102), 100)}


def test_near_duplicate_cases(spark):
    base = [f"w{i}" for i in range(60)]
    near = base[:59] + ["other"]
    rows = [(5, " ".join(base)), (2, " ".join(near)), (9, " ".join(base)), (3, None), (4, ""), (6, "a b"), (7, "A  b"), (None, "a b"), (None, "z"), (8, "long " * 100_000), (8, "long " * 100_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rep int")
    got = {(r[0], r[2], r[3]) for r in rows_of(near_duplicates(docs, 5))}
    assert got == {(5, 2, False), (2, 2, True), (9, 2, False), (3, 3, True), (4, 4, True), (6, 6, True), (7, 6, False), (None, 6, False), (None, None, True), (8, 8, True)}
    assert sorted(r[0] or 0 for r in rows_of(drop_near_duplicates(docs))) == [0, 0, 2, 3, 4, 6, 8]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_line_cases(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(2, f"Same line\n{long} x\n\nsame  LINE"), (1, f"{long}\nsame line"), (3, None), (4, ""), (None, "same line\nown"), (5, "v " * 100_000)]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, n int, removed string")
    got = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert {k: (r.text, r._n_removed) for k, r in got.items() if k != 5} == {2: ("", 3), 1: (long, 1), 3: (None, 0), 4: ("", 0), None: ("same line\nown", 0)}
    assert got[5].removed == "n" and line_report(docs.limit(0)).count() == 0
    assert dedup_lines(docs).columns == [*docs.columns, "_n_lines", "_n_removed"]


def test_lines_of_one_doc_id_with_two_texts(spark):
    long = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"{long} x"), (1, "some other words"), (2, f"{long} y")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in dedup_lines(docs).collect())
    assert got == [(1, "some other words"), (1, f"{long} x"), (2, "")]


def test_lines_near_the_threshold(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:320]), " ".join(words[:319]), " ".join([*words[45:], *[f"n{i}" for i in range(45)]])]
    texts.append(" ".join([*words[44:], *[f"m{i}" for i in range(44)]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(t.split()) for t in texts]
    late = {j for j in range(5) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert {r.doc_id for r in dedup_lines(docs).filter("_n_removed > 0").collect()} == late == {1, 2, 4}


def test_pairs_of_lines_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    from plumbline.llm import line_dedup

    made = Counter()

    def counted(df, name):
        table = stored(df, name)
        made[name] += table.count()
        return table

    monkeypatch.setattr(line_dedup, "stored", counted)
    words = [f"w{i}" for i in range(24)]
    copies = [" ".join([*words[: i % 24], f"n{i}", *words[i % 24 + 1 :]]) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(copies)] + [(900, " ".join(f"x{i}" for i in range(24)))], "doc_id long, text string")
    assert {r.doc_id for r in dedup_lines(docs).filter("_n_removed = 0").collect()} == {0, 900}
    assert max(made.values()) <= 20 * docs.count(), made


def test_pairs_of_a_group_whose_words_stand_in_earlier_lines(spark, monkeypatch):
    from plumbline.llm import line_dedup

    made = Counter()

    def counted(df, name):
        table = stored(df, name)
        made[name] += table.count()
        return table

    monkeypatch.setattr(line_dedup, "stored", counted)
    words, common = [f"w{i}" for i in range(24)], " ".join(f"f{i}" for i in range(23))
    copies = [" ".join([*words[: i % 24], f"n{i}", *words[i % 24 + 1 :]]) for i in range(300)]
    # the earliest line with any word of the group is one of another kind
    rows = [(0, "\n".join([common] * 400)), *[(1 + i, f"{w} {common}") for i, w in enumerate(words)], *[(100 + i, t) for i, t in enumerate(copies)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in dedup_lines(docs).filter("_n_removed < _n_lines").collect()} == {0, 100}
    assert made["pairs"] <= 20 * docs.count(), made


def test_files_of_shuffles_go_when_a_table_is_stored(spark, tmp_path, monkeypatch):
    from plumbline.llm.common import CLEANUP

    seen, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (seen.append(spark.conf.get(CLEANUP)), write(self, *a, **b))[1])
    before = spark.conf.get(CLEANUP)
    table = stored(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "k")
    assert seen == ["true"] and spark.conf.get(CLEANUP) == before and sorted(r["count"] for r in table.collect()) == [14] * 5 + [15] * 2


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "n_tokens", "weight", "repeats", "pass", "turn", "place"} <= set(rows.columns)
    found = rows.collect()
    times = Counter(r.doc_id for r in found)
    assert all(times[r.doc_id] == max(r.repeats, 1) for r in found) and all((r["pass"] is None) == (r.repeats == 0) for r in found)
    assert 0.5 * documents(spark).count() < len(times) < documents(spark).count()
    assert all(r.text.strip() for r in found)  # no text is left empty
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), FOLDER).columns == docs.columns


def test_pipeline_stages_on_planted_rows(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    lines = [text(30) for _ in range(4)]
    near = [" ".join(["other", *x.split()[1:]]) for x in lines]
    # the same words over other line ends: lines differ, documents are near copies
    long = text(120).split()
    cut = lambda at: "\n".join([" ".join(long[:at]), " ".join(long[at:])])
    rows = [
        (900_001, "\n".join(lines)), (900_002, "\n".join(lines)), (900_003, "\n".join(near)), (900_004, "\n".join([*lines[:2], text(40)])),
        (900_005, cut(40)), (900_006, cut(65)), (900_007, None), (900_008, ""), (900_009, " \n"), (None, text(50)), (900_010, text(50)), (900_010, text(50)),
    ]
    docs = spark.createDataFrame([(*r, "en", "s", 1, "x", 2.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, block string, weight double")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), name)
        left[name] = Counter(r.doc_id for r in docs.select("doc_id").collect())
    ids = {r[0] for r in rows}
    assert set(left["toxicity"]) == ids
    assert set(left["line_dedup"]) == ids - {900_002, 900_003}
    assert set(left["near_duplicates"]) == set(left["decontamination"]) == ids - {900_002, 900_003, 900_006}
    assert left["near_duplicates"][900_010] == 1 and set(left["mixing"]) == set(left["decontamination"])
    kept = {r.doc_id: r for r in docs.collect()}
    assert kept[900_004].text == rows[3][1].split("\n")[2] and kept[900_004].n_chars == len(kept[900_004].text)
    assert kept[900_007].text is None and kept[900_008].text == "" and kept[900_001].n_tokens == 120
