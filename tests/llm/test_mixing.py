import math
import random
from collections import defaultdict

from llm_data import FOLDER

from plumbline.llm.mixing import mix, mixing_report, mixture, solve_exponent
from plumbline.llm.queries import QUERIES


def check(rows, entropy, max_repeats):
    """Budgets and repeats against the rule, from the token counts alone."""
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r._n_tokens
    live = {s: t for s, t in sizes.items() if t}
    total = sum(live.values())
    a = solve_exponent([(t, 1) for t in live.values()], entropy, max_repeats)
    norm = sum((t / total) ** a for t in live.values())
    longest = max(r._n_tokens for r in rows)
    for s, t in sizes.items():
        w = (t / total) ** a / norm if t else 0
        mine = [r for r in rows if r.source == s]
        assert all(abs(r._weight - w) < 0.002 * w + 1e-12 for r in mine)
        budget = round(mine[0]._weight * total)
        passes = budget // t if t else 0
        assert all(r._repeats in (passes, passes + 1) for r in mine)
        drawn = sum(r._repeats * r._n_tokens for r in mine)
        assert budget - longest <= drawn <= budget, (s, budget, drawn)
    return a


def test_exponent():
    even = [(100.0, 1), (100.0, 3)]
    assert solve_exponent(even, 0.9, 2) == 1
    sizes = [(1000.0, 1), (100.0, 1), (10.0, 2)]
    def h(a):
        raw = [t**a for t, n in sizes for _ in range(n)]
        return -sum(x / sum(raw) * math.log(x / sum(raw)) for x in raw) / math.log(4)

    assert abs(h(solve_exponent(sizes, 0.9, None)) - 0.9) < 1e-9
    a = solve_exponent(sizes, 0.9, 3.0)
    raw = [t**a for t, _ in sizes]
    whole = raw[0] + raw[1] + 2 * raw[2]
    assert abs(raw[2] / whole * 1120 / 10 - 3) < 1e-6
    assert solve_exponent(sizes, None, None) == 1


def test_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = mix(docs, 0.995).collect()
    assert len(rows) == docs.count() and check(rows, 0.995, 4.0) < 1
    order = mixture(mix(docs, 0.995))
    assert order.count() == sum(r._repeats for r in rows)


def brute_exponent(sizes, entropy, max_repeats):
    """By small steps instead of bisection, from the sizes of single sources."""
    total, best = sum(sizes), None

    def raw(a):
        w = [(t / max(sizes)) ** a for t in sizes]
        return [x / sum(w) for x in w]

    for i in range(10_000, -1, -1):
        if -sum(x * math.log(x) for x in raw(i / 10_000)) >= entropy * math.log(len(sizes)):
            best = i
            break
    while best < 10_000 and any(x * total > max_repeats * t * (1 + 1e-12) for x, t in zip(raw(best / 10_000), sizes)):
        best += 1
    return best / 10_000


def test_exponent_against_small_steps():
    rng = random.Random(1)
    for _ in range(40):
        sizes = [float(rng.randint(1, 10_000)) for _ in range(rng.randint(2, 9))]
        entropy, repeats = rng.uniform(0.5, 1), rng.uniform(1.5, 20)
        assert abs(solve_exponent([(t, 1) for t in sizes], entropy, repeats) - brute_exponent(sizes, entropy, repeats)) <= 1.01e-4


def test_query_moves_weights(spark):
    """On the given tables the target binds: an exponent below 1, whole and partial passes."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = QUERIES["op5_mixing"](spark, "/root/testdata/sf0.1").collect()
    sizes, weight = defaultdict(int), {}
    seen = {}
    for r in rows:
        assert seen.setdefault(r.doc_id, (r.source, r.n_tokens, r.repeats)) == (r.source, r.n_tokens, r.repeats)
        weight[r.source] = r.weight
    assert len(seen) == docs.count()
    for source, n, _ in seen.values():
        sizes[source] += n
    shares = [t / sum(sizes.values()) for t in sizes.values()]
    entropy = lambda p: -sum(x * math.log(x) for x in p) / math.log(len(p))
    assert entropy(shares) < 0.9999 - 1e-5 and abs(entropy(list(weight.values())) - 0.9999) < 1e-6
    assert {r.repeats for r in rows} >= {0, 1, 2}


def test_whole_passes_are_permutations(spark, monkeypatch):
    monkeypatch.setattr("plumbline.llm.mixing.BLOCK_ROWS", 5)
    data = [(i, "w " * (1 + i % 4), "small" if i < 40 else "large") for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    rows = mixing_report(docs, 0.999, 6.0).collect()
    orders = defaultdict(list)
    for r in rows:
        if r["pass"] is not None:
            orders[r.source, r["pass"]].append((r.turn, r.place, r.doc_id))
    whole = [sorted(x) for (s, p), x in sorted(orders.items()) if s == "small"]
    assert len(whole) >= 4
    for order in whole[:-1]:
        assert sorted(d for *_, d in order) == list(range(40))
    assert len({tuple(d for *_, d in order) for order in whole[:-1]}) == len(whole) - 1
    assert set(d for *_, d in whole[-1]) <= set(range(40))
    assert {r["pass"] for r in rows if r.repeats == 0} <= {None}


def test_small_cases(spark, monkeypatch):
    monkeypatch.setattr("plumbline.llm.mixing.BLOCK_ROWS", 7)
    data = [(i, "w " * (1 + i % 9), "a" if i % 3 else None, i) for i in range(300)] + [(5, "w " * 6, "a", 1)] * 40
    data += [(None, None, "b", 0), (400, "", "b", 0), (401, "x" * 100_000 + " y", "c", 0), (402, "one two three", "d", 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, n int")
    rows = mix(docs, 0.99, 6.0).collect()
    assert len(rows) == len(data)
    sizes = {}
    for r in rows:  # repeated rows are treated alike
        assert sizes.setdefault((r.doc_id, r.source, r._n_tokens), r._repeats) == r._repeats
    assert [r._repeats for r in rows if r.source == "b"] == [0, 0]
    assert mix(docs.limit(0)).count() == 0 and "n" in mix(docs).columns
    plain = [(i, "w " * (1 + i % 9), "abcd"[min(3, i % 11)]) for i in range(2_000)]
    check(mix(spark.createDataFrame(plain, "doc_id long, text string, source string"), 0.97, 3.0).collect(), 0.97, 3.0)
