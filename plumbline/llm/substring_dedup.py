"""Suffix-array dedup: remove every byte of a ``length``-byte string that starts twice.

A string of ``length`` bytes contains an anchor: the smallest hash among its windows of ``seed`` bytes. Equal strings have
equal anchors at equal places, so repeats are found among the suffixes that start at anchors, not among all:

1. Tasks list the anchors of their texts by the hashes of the seed and of the context, the bytes around the anchor that a
   repeat through it can reach. A seed that occurs once needs no sorting, and equal contexts are one from here on.
2. Tasks sort the remaining suffixes (the right contexts, each with its left context reversed) and send them as front-coded
   runs: per suffix the length of the prefix it shares with the one before, and the rest. Suffixes of one seed go to one
   bucket.
3. A bucket merges its runs with a loser tree that carries the shared prefixes along: a comparison starts behind what is
   known to be equal, and needs no bytes when the known lengths differ. The merged order gives the common prefix of
   neighbours, and so of any two suffixes of a seed; left contexts are compared directly.
4. Pairs that reach ``length`` bytes over both sides cover a stretch around the anchor. The stretches of a text are united
   and cut out.

Seeds with more than ``MOST`` different contexts, the ends of very common passages, go another exact way: their strings are
counted by hash, so no task sees such a group whole. The strings of a context fall into ``PARTS`` by the place of the anchor
in them; those of one part have a core in common, and only strings whose core occurs twice are counted themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import small, stored

LENGTH, SEED = 200, 100
MOST = 4_000
PARTS = 4
PAIRWISE = 24  # suffixes of one seed that are compared pair by pair; more go row by row over the sorted orders
BUCKET_ROWS = 20_000
RUN_ROWS = 20_000
PLACES = 2_000_000  # of 28 bytes; a list of places to visit is broadcast up to this number
_MULT = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of every window of ``width`` bytes, by doubling: windows of 1, 2, 4 ... bytes combine to the width."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    power = _mix(data.astype(np.uint64) + np.uint64(1))
    have, out, done = 1, None, 0
    while True:
        if width & have:
            if out is None:
                out, done = power, have
            else:
                m = min(len(out), len(power) - done)
                out, done = _mix(out[:m] * np.uint64(_MULT) + power[done : done + m]), done + have
        have *= 2
        if have > width:
            return out[:n]
        power = _mix(power[: -(have // 2)] * np.uint64(_MULT) + power[have // 2 :])


def anchors(hashes: np.ndarray, windows: int) -> np.ndarray:
    """The places of the leftmost smallest hash among each ``windows`` consecutive ones."""
    if len(hashes) < windows:
        return np.zeros(0, dtype=np.int64)
    low, have = hashes, 1
    while have * 2 <= windows:
        low, have = np.minimum(low[:-have], low[have:]), have * 2
    low = np.minimum(low[: len(hashes) - windows + 1], low[windows - have : len(hashes) - have + 1]) if have < windows else low
    # the smallest value of a window stands at the first place of it with that value
    places = np.flatnonzero(_is_window_minimum(hashes, low, windows))
    return places


def _is_window_minimum(hashes: np.ndarray, low: np.ndarray, windows: int) -> np.ndarray:
    """Whether a hash is the smallest of some window; ties within a window all count, which only adds anchors."""
    n = len(hashes)
    most, have = np.concatenate([np.zeros(windows - 1, np.uint64), low, np.zeros(windows - 1, np.uint64)]), 1
    while have * 2 <= windows:
        most, have = np.maximum(most[:-have], most[have:]), have * 2
    if have < windows:
        most = np.maximum(most[: n], most[windows - have : windows - have + n])
    return hashes == most[:n]


def _contexts(text: bytes, at: int, length: int, seed: int) -> tuple[bytes, bytes]:
    """The bytes before an anchor, reversed, and those from it on, as far as a repeat through it can reach."""
    return text[max(0, at - (length - seed)) : at][::-1], text[at : at + length]


def _raw(text) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def _text_anchors(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(key, doc_id, at, seed, context): all anchors with the hashes of their seed and of their context."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                raw = _raw(text)
                if len(raw) < length:
                    continue
                hashes = window_hashes(np.frombuffer(raw, dtype=np.uint8), seed)
                at = anchors(hashes, length - seed + 1)
                around = [xxhash.xxh3_64_intdigest(raw[max(0, a - length + seed) : a + length], seed=min(a, length - seed)) for a in at.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc.as_py()] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(hashes[at].view(np.int64)),
                     pa.array(np.array(around, dtype=np.uint64).view(np.int64))],
                    names=["key", "at", "seed", "context"],
                )

    return docs.select("key", "text").mapInArrow(work, "key bigint, at int, seed bigint, context bigint")


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix of two strings that agree in the first ``known`` bytes."""
    n = min(len(a), len(b))
    while known < n:
        step = min(16, n - known)
        if a[known : known + step] == b[known : known + step]:
            known += step
        else:
            while a[known] == b[known]:
                known += 1
            return known
    return n


def front_code(run: list[bytes]) -> list[tuple[int, bytes]]:
    """A sorted run as (length of the prefix shared with the item before, rest)."""
    out, last = [], b""
    for item in run:
        n = shared_prefix(last, item)
        out.append((n, item[n:]))
        last = item
    return out


def merge_runs(runs: list[list[tuple[int, bytes]]]) -> Iterator[tuple[int, int, int, bytes]]:
    """Merge front-coded sorted runs: (run, place in the run, prefix shared with the item before, item).

    The tree's nodes hold the losers with the prefix each shares with the last winner. Of two items the one that shares more
    with the last winner is smaller; only equal lengths need a comparison, and it starts behind them.
    """
    width = 1
    while width < max(1, len(runs)):
        width *= 2
    items: list[bytes | None] = [None] * width  # None: the run is at its end, after all others
    shared, place = [0] * width, [0] * width
    for r, run in enumerate(runs):
        if run:
            items[r] = run[0][1]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix is then the one it shares with the winner."""
        x, y = items[a], items[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        n = shared_prefix(x, y, shared[a])
        if (x[n : n + 1], len(x), a) <= (y[n : n + 1], len(y), b):
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    losers = [0] * width
    level = list(range(width))
    at = width
    while len(level) > 1:
        played = [play(level[i], level[i + 1]) for i in range(0, len(level), 2)]
        at //= 2
        for i, (_, loser) in enumerate(played):
            losers[at + i] = loser
        level = [winner for winner, _ in played]
    winner = level[0]
    while items[winner] is not None:
        item = items[winner]
        yield winner, place[winner], shared[winner], item
        place[winner] += 1
        if place[winner] < len(runs[winner]):
            n, rest = runs[winner][place[winner]]
            items[winner], shared[winner] = item[:n] + rest, n
        else:
            items[winner] = None
        node = (winner + width) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def reaches(rights: list[bytes], lefts: list[bytes], prefix: list[int], length: int) -> list[tuple[int, int]]:
    """Of suffixes in order, ``prefix`` shared with the one before: how far repeats of each reach left and right of it.

    (0, 0) where no other one makes ``length`` bytes with it.
    """
    n = len(rights)
    out = [(0, 0)] * n
    if n > PAIRWISE:
        order = sorted(range(n), key=lefts.__getitem__)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n)
        by_right = np.array(prefix)
        by_left = np.array([0] + [shared_prefix(lefts[order[i - 1]], lefts[order[i]]) for i in range(1, n)])

        def common(steps: np.ndarray, i: int) -> np.ndarray:
            """Prefixes that item i of a sorted order shares with all, from those of neighbours."""
            before = np.minimum.accumulate(steps[1 : i + 1][::-1])[::-1]
            return np.concatenate([before, [-length], np.minimum.accumulate(steps[i + 1 :])])

        for i in range(n):
            right, left = common(by_right, i), common(by_left, int(rank[i]))[rank]
            found = right + left >= length
            if found.any():
                out[i] = (int(left[found].max()), int(right[found].max()))
        return out
    for i in range(n):
        low = length + 1
        for j in range(i + 1, n):
            low = min(low, prefix[j])
            left = shared_prefix(lefts[i], lefts[j])
            if low + left >= length:
                out[i] = (max(out[i][0], left), max(out[i][1], low))
                out[j] = (max(out[j][0], left), max(out[j][1], low))
    return out


def _sorted_runs(rows: DataFrame, length: int, seed: int, n_buckets: int) -> DataFrame:
    """Front-coded sorted runs of the contexts of ``rows`` (text, places), by bucket of the seed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush():
            held.sort()
            buckets: dict[int, list] = {}
            for row in held:
                buckets.setdefault(row[2] % n_buckets, []).append(row)
            out = []
            for b, mine in buckets.items():
                coded = front_code([r[0] for r in mine])
                out.append({"bucket": b, "prefix": [c[0] for c in coded], "rest": [c[1] for c in coded], "left": [r[1] for r in mine],
                            "seed": [r[2] for r in mine], "context": [r[3] for r in mine]})
            held.clear()
            return pa.RecordBatch.from_pylist(out, _RUNS_ARROW)

        for batch in batches:
            for text, places in zip(batch.column(0), batch.column(1)):
                raw = _raw(text)
                for p in places.as_py():
                    left, right = _contexts(raw, p["at"], length, seed)
                    held.append((right, left, p["seed"], p["context"]))
                if len(held) >= RUN_ROWS:
                    yield flush()
        if held:
            yield flush()

    return rows.select("text", "places").mapInArrow(work, _RUNS)


_RUNS = "bucket bigint, prefix array<int>, rest array<binary>, left array<binary>, seed array<bigint>, context array<bigint>"
_RUNS_ARROW = pa.schema([
    ("bucket", pa.int64()), ("prefix", pa.list_(pa.int32())), ("rest", pa.list_(pa.binary())), ("left", pa.list_(pa.binary())),
    ("seed", pa.list_(pa.int64())), ("context", pa.list_(pa.int64())),
])


def _merged(runs: DataFrame, length: int, seed: int) -> DataFrame:
    """(seed, context, left, right) of the contexts that others repeat, by merging each bucket's runs."""

    def work(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        merged = merge_runs([list(zip(r["prefix"], r["rest"])) for r in rows])
        out, group = [], []

        def close():
            if len(group) > 1:
                for (s, c, *_), (left, right) in zip(group, reaches([g[2] for g in group], [g[3] for g in group], [g[4] for g in group], length)):
                    if right:
                        out.append({"seed": s, "context": c, "left": left, "right": right})
            group.clear()

        for run, at, shared, item in merged:
            if shared < seed:
                close()
            group.append((rows[run]["seed"][at], rows[run]["context"][at], item, rows[run]["left"][at], shared))
        close()
        return pa.Table.from_pylist(out, pa.schema([("seed", pa.int64()), ("context", pa.int64()), ("left", pa.int32()), ("right", pa.int32())]))

    return runs.groupBy("bucket").applyInArrow(work, "seed bigint, context bigint, left int, right int")


def _parts(at: int, size: int, length: int, seed: int) -> Iterator[tuple[int, int, int, range]]:
    """(part, least left, most left, lefts) of the strings through an anchor of a text of ``size`` bytes.

    ``left`` counts the bytes of a string before its anchor. All strings of a part hold the bytes from the least one before
    the anchor to where the string with the most ends.
    """
    width = -(-(length - seed + 1) // PARTS)
    for k in range(PARTS):
        low, high = k * width, min((k + 1) * width - 1, length - seed)
        lefts = range(max(low, at + length - size), min(high, at) + 1)
        if lefts:
            yield k, low, high, lefts


def _seeded(p: dict, step: int) -> int:
    return (p["seed"] + step * _MULT) & (2**64 - 1)


def _twice(rows: DataFrame, pieces: Callable[[bytes, dict], Iterator[tuple[bytes, int]]], name: str) -> DataFrame:
    """(seed, context, value): the values of the ``pieces`` (hash, value) of each place of ``rows`` (text, places) that occur twice.

    Tasks settle what repeats among their own contexts and send such a hash once, with the weight two. Of what they settle
    themselves, a context has its least and its greatest value and those between may be left out.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def flush():
            kept, reach = [], {}
            for h, found in held.items():
                if len(found) == 1:
                    kept.append((h, *found[0], 1))
                    continue
                kept.append((h, None, None, None, 2))
                for s, c, value in found:
                    r = reach.setdefault((s, c), [value, value])
                    r[0], r[1] = max(r[0], value), min(r[1], value)
            held.clear()
            kept += [(None, s, c, value, 0) for (s, c), r in reach.items() for value in set(r)]
            part = list(zip(*kept)) or [[]] * 5
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(part, kinds)], names=["h", "seed", "context", "value", "weight"])

        for batch in batches:
            for text, places in zip(batch.column(0), batch.column(1)):
                raw = _raw(text)
                for p in places.as_py():
                    for h, value in pieces(raw, p):
                        held.setdefault(h, []).append((p["seed"], p["context"], value))
                    if len(held) > 200_000:
                        yield flush()
        if held:
            yield flush()

    found = stored(rows.select("text", "places").mapInArrow(work, "h binary, seed bigint, context bigint, value int, weight int"), name)
    twice = found.filter("h IS NOT NULL").groupBy("h").agg(F.sum("weight").alias("n")).filter("n > 1").select("h")
    later = found.filter("h IS NOT NULL AND seed IS NOT NULL").join(twice, "h", "left_semi").select("seed", "context", "value")
    return found.filter("h IS NULL").select("seed", "context", "value").union(later)


def _parts_twice(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """(seed, context, low, high): the first and the last part whose core occurs elsewhere, for contexts that have any."""

    def cores(raw: bytes, p: dict) -> Iterator[tuple[bytes, int]]:
        for k, low, high, _ in _parts(p["at"], len(raw), length, seed):
            yield xxhash.xxh3_128_digest(raw[p["at"] - low : p["at"] - high + length], seed=_seeded(p, k)), k

    found = _twice(rows, cores, "cores").groupBy("seed", "context")
    return found.agg(F.min("value").alias("low"), F.max("value").alias("high"))


def _counted(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """(seed, context, left, right) for the contexts of crowded seeds: their strings are counted by hash.

    The hash covers the string, its anchor's seed and its place, so that every start counts once. Only strings of the parts
    from ``low`` to ``high`` of a place are asked for.
    """

    def strings(raw: bytes, p: dict) -> Iterator[tuple[bytes, int]]:
        for k, _, _, lefts in _parts(p["at"], len(raw), length, seed):
            if p["low"] <= k <= p["high"]:
                for left in lefts:
                    s = p["at"] - left
                    yield xxhash.xxh3_128_digest(raw[s : s + length], seed=_seeded(p, left)), left

    found = _twice(rows, strings, "strings").groupBy("seed", "context")
    return found.agg(F.max("value").alias("left"), (F.lit(length) - F.min("value")).alias("right"))


def repeated_stretches(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(key, stretches): per text of ``docs`` (key, text) with repeats, its united (start, end) byte stretches.

    Rows with one key have one text; each of them counts as a text. An end can lie behind that of the text.
    """
    every = stored(_text_anchors(docs, length, seed), "anchors")
    again = every.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed")
    found = stored(every.join(again, "seed", "left_semi"), "repeated")
    groups = found.groupBy("seed", "context").agg(F.count("*").alias("copies"), F.min(F.struct("key", "at")).alias("first"))
    groups = stored(groups, "contexts")
    shared = stored(groups.join(groups.groupBy("seed").agg(F.count("*").alias("contexts")), "seed"), "shared")
    # one text stands for all places with the same context
    wanted = shared.filter("contexts > 1").select("first.key", "contexts", F.struct(F.col("first.at").alias("at"), "seed", "context").alias("p"))
    few, many = wanted.filter(F.col("contexts") <= MOST), wanted.filter(F.col("contexts") > MOST)

    def with_texts(part: DataFrame, n: int) -> DataFrame:
        places = part.groupBy(F.col("key").alias("k")).agg(F.collect_list("p").alias("places"))
        return docs.join(small(places, n, PLACES), F.col("key") == F.col("k")).select("text", "places")  # a repeated row adds what is repeated anyway

    n_few, n_many = few.count(), many.count()
    runs = _sorted_runs(with_texts(few, n_few), length, seed, max(1, n_few // BUCKET_ROWS))
    partial = _merged(runs, length, seed)
    if n_many:
        parts = stored(_parts_twice(with_texts(many, n_many), length, seed), "parts")
        many = many.join(parts, (F.col("p.seed") == parts["seed"]) & (F.col("p.context") == parts["context"]))
        many = many.select("key", F.struct("p.*", "low", "high").alias("p"))
        partial = partial.unionByName(_counted(with_texts(many, n_many), length, seed))
    partial = stored(partial, "reaches")
    # a context that occurs twice is repeated as far as it goes
    whole = shared.filter("copies > 1").select("seed", "context", F.lit(length - seed).alias("left"), F.lit(length).alias("right"))
    spans = partial.unionByName(whole).groupBy("seed", "context").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    hit = found.join(spans, ["seed", "context"])
    span = F.struct(F.greatest(F.col("at") - F.col("left"), F.lit(0)).alias("a"), (F.col("at") + F.col("right")).alias("b"))
    lists = hit.groupBy("key").agg(F.sort_array(F.collect_set(span)).alias("l"))
    # unite what touches; the last stretch of the result is the one that can still grow
    last = lambda acc: F.element_at(acc, -1)
    united = F.aggregate(
        F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), F.slice("l", 1, 1),
        lambda acc, x: F.when(x["a"] > last(acc)["b"], F.array_append(acc, x)).otherwise(
            F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.struct(last(acc)["a"].alias("a"), F.greatest(last(acc)["b"], x["b"]).alias("b")))),
    )
    return lists.select("key", united.alias("stretches"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, ``kept`` (the remaining bytes) and its sha256.

    Texts are their UTF-8 bytes; null is empty. Every byte goes that lies in a string of ``length`` bytes which also starts
    elsewhere, in the same text or another. Rows are texts of their own, also where doc_id or text repeat or are null, so a
    repeated row of at least ``length`` bytes loses all. Cut bytes may split characters. More columns are ignored.
    """
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    spans = stored(repeated_stretches(keyed, length, seed).withColumnRenamed("key", "k"), "stretches")
    n_spans = spans.agg(F.coalesce(F.sum(F.size("stretches")), F.lit(0))).first()[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, stretches in zip(batch.column(1), batch.column(2)):
                raw, kept, end, removed = _raw(text), [], 0, 0
                found = stretches.as_py() or []
                for s in found:
                    kept.append(raw[end : s["a"]])
                    end = min(s["b"], len(raw))
                    removed += end - s["a"]
                kept.append(raw[end:])
                left = b"".join(kept)
                out.append((len(raw), removed, len(found), left, hashlib.sha256(left).hexdigest()))
            part = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(p, pa.int64()) for p in part[:3]), pa.array(part[3], pa.binary()), pa.array(part[4], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    rows = keyed.join(small(spans, n_spans, PLACES), F.col("key") == F.col("k"), "left").select("doc_id", "text", "stretches")
    return rows.mapInArrow(work, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")
