"""Language-model scoring with a hierarchical Pitman-Yor model of word pairs.

A context (the word before) has a restaurant whose dishes are the words after it. Customers are the training tokens; each
table of a dish is a customer of the parent restaurant, which all contexts share, and the parent's base is uniform over the
training words and one more, for all others. Seating follows the Chinese restaurant process and is resampled by Gibbs sweeps: all customers of a dish
leave and are seated again, given the tables of the other dishes. Scores average the predictive probabilities of the sweeps
after the first.

The tokens never become rows. Tasks pack the distinct pairs of some thousand texts into blocks by the context's bucket:

1. Buckets of contexts sum the pairs; buckets of words add up the tokens of a word over all of them and answer.
2. Buckets of contexts seat their pairs once, with the frequencies of the corpus, and tell the tables of a word; buckets of
   words seat the parent, whose sweeps share the tables of all words, and answer with customers and tables.
3. Buckets of contexts sum the pairs again, run the sweeps with the parent's probabilities, and return for every pair of a
   block one probability; each block scores its own texts with them. Only distinct pairs leave a block, never occurrences.

The number of buckets follows the input, so that a bucket holds about ``BUCKET_CHARS`` of text. The pairs of a frequent
context are dealt over all buckets by the word; what its dishes share, the tables of all of them, is summed over the buckets
before every sweep. Which contexts are frequent is estimated from some texts and has no effect on the scores.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import forget, stored
from plumbline.llm.near_dup import WordHashes, text_words

BUCKET_CHARS = 12_000_000
BLOCK_TOKENS = 1_500_000
SAMPLE_CHARS = 4_000_000  # text from which the frequent contexts are estimated
FREQUENT = 4  # a context with more than this part of a bucket's tokens is dealt over all buckets
DISCOUNT, STRENGTH = (0.75, 0.5), (2.0, 5.0)  # of the contexts, of the parent
SWEEPS = 4
STEPWISE = 32  # customers of a dish that are seated one by one; later ones in blocks of a sixteenth of those seated
_ID = np.uint64((1 << 48) - 1)
END, START = np.uint64(1), np.uint64(2)
_BLOCKS = "bucket bigint, chunk string, data binary"


def _coded(x):
    """Arrays as their byte planes, each compressed alone: high bytes hold little, low ones cannot spoil them.

    Unsigned numbers in order are held as the steps from one to the next.
    """
    if isinstance(x, tuple):
        return tuple(_coded(y) for y in x)
    if not isinstance(x, np.ndarray) or x.nbytes < 64:
        return x
    steps = x.dtype.kind == "u" and bool((x[1:] >= x[:-1]).all())
    held = np.diff(x, prepend=x.dtype.type(0)) if steps else np.ascontiguousarray(x)
    planes = held.view(np.uint8).reshape(len(x), x.itemsize).T
    packer = zstandard.ZstdCompressor(level=1)
    return _Planes([x.dtype.str, steps, *(packer.compress(np.ascontiguousarray(p)) for p in planes)])


class _Planes(list):
    """The type of an array, whether it is held as steps, and its compressed byte planes."""

    def array(self) -> np.ndarray:
        unpacker = zstandard.ZstdDecompressor()
        planes = [np.frombuffer(unpacker.decompress(p), dtype=np.uint8) for p in self[2:]]
        x = np.stack(planes, axis=1).view(self[0]).reshape(-1)
        return np.cumsum(x, dtype=x.dtype) if self[1] else x


def _decoded(x):
    if isinstance(x, tuple):
        return tuple(_decoded(y) for y in x)
    return x.array() if isinstance(x, _Planes) else x


def _pack(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(_coded(arrays), protocol=5))


def _unpack(data: bytes) -> tuple:
    return _decoded(pickle.loads(zstandard.ZstdDecompressor().decompress(data)))


def _pack_pairs(us: np.ndarray, ws: np.ndarray, counts: np.ndarray) -> bytes:
    """Pairs in the order of contexts, as places in a list of contexts and in one of words, frequent words first."""
    contexts, which = np.unique(us, return_inverse=True)
    words, place, n = np.unique(ws, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(words), dtype=np.uint32)
    rank[order] = np.arange(len(words), dtype=np.uint32)
    lists = _narrow(contexts), _narrow(words[order])
    return _pack(lists, which.astype(np.uint32), (rank[place],), counts.astype(np.uint32))


def _unpack_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (contexts, words), which, (place,), counts = _unpack(data)
    return _wide(*contexts)[which], _wide(*words)[place], counts


def _bucket(ids: np.ndarray, n: int) -> np.ndarray:
    return ((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(n)


def _narrow(ids: np.ndarray) -> tuple:
    """48-bit numbers as steps from one to the next, in six bytes each; of sorted ones the steps are small."""
    ids = np.diff(ids, prepend=np.uint64(0)) & _ID
    return (ids & np.uint64(0xFFFFFFFF)).astype(np.uint32), (ids >> np.uint64(32)).astype(np.uint16)


def _wide(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.cumsum(low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)), dtype=np.uint64) & _ID


def held_out(doc_id: int | None) -> bool:
    """Texts that are scored but not learned from; a null id is one of them."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 == 2


def _sums(first: np.ndarray, second: np.ndarray, *values: np.ndarray) -> tuple:
    """Distinct pairs in order, the place of each input in them, and the sums of ``values``."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    place = np.empty(len(a), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return a[new], b[new], place, *(np.bincount(place, weights=v, minlength=int(new.sum())) for v in values)


def _contexts(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The word before each one, of texts of such lengths."""
    u = np.empty_like(words)
    u[1:] = words[:-1]
    u[np.cumsum(lengths) - lengths] = START
    return u


def _words(text: str | None, hashes: WordHashes) -> np.ndarray:
    h = [hashes[w] for w in text_words(text)]
    return np.append(np.maximum(np.array(h, dtype=np.uint64) & _ID, np.uint64(3)), END)


def _spread(contexts: np.ndarray, words: np.ndarray, n: int, frequent: np.ndarray) -> np.ndarray:
    """The bucket of each pair: by its context, or by both words where the context is frequent."""
    both = contexts ^ (words * np.uint64(0xBF58476D1CE4E5B9))
    return _bucket(np.where(np.isin(contexts, frequent), both, contexts), n).astype(np.int64)


def frequent_contexts(docs: DataFrame, chars: int, n_buckets: int) -> np.ndarray:
    """Contexts that some texts show to be more than a part of a bucket, in order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = [_words(x.as_py(), hashes) for x in batch.column(0)]
            if texts:
                found, counts = np.unique(_contexts(np.concatenate(texts), np.array([len(x) for x in texts])), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(counts)], names=["context", "n"])

    part = docs.select(F.col("text").cast("string")).sample(fraction=min(1.0, SAMPLE_CHARS / max(chars, 1)), seed=1)
    counted = part.mapInArrow(work, "context bigint, n bigint").groupBy("context").agg(F.sum("n").alias("n"))
    # no more than this many contexts can have such a share
    top = counted.orderBy(F.desc("n"), "context").limit(max(1, int(FREQUENT * n_buckets)))
    total = counted.agg(F.sum("n").alias("total"))
    rows = top.crossJoin(F.broadcast(total)).filter(F.col("n") * (FREQUENT * n_buckets) > F.col("total")).select("context").collect()
    return np.array(sorted(r[0] for r in rows), dtype=np.uint64)


def _blocks(docs: DataFrame, n_buckets: int, frequent: np.ndarray, with_texts: bool) -> DataFrame:
    """(bucket, chunk, data): the distinct pairs of every chunk of texts by bucket.

    With texts, one more row of every chunk, in a bucket of its own below 0, says which texts hold a pair how often.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, task, n_chunks = WordHashes(), TaskContext.get().partitionId(), 0
        ids, words, lengths, size = [], [], [], 0

        def flush():
            nonlocal n_chunks, ids, words, lengths, size
            w = np.concatenate(words)
            n = np.array(lengths)
            u = _contexts(w, n)
            text = np.repeat(np.arange(len(n), dtype=np.uint32), n)
            train = np.repeat(np.array([not held_out(i) for i in ids]), n)
            us, ws, place, counts = _sums(u, w, train)
            bucket = _spread(us, ws, n_buckets, frequent)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            rows = []
            for b in range(n_buckets):
                mine = order[cuts[b] : cuts[b + 1]]
                if not len(mine):
                    continue
                rows.append((b, f"{task}-{n_chunks}", _pack_pairs(us[mine], ws[mine], counts[mine])))
            if with_texts:
                # the pairs in the order of the rows above, and for each the texts of its occurrences
                moved = np.empty_like(order)
                moved[order] = np.arange(len(order))
                place = moved[place]
                at = np.argsort(place, kind="stable")
                many = np.bincount(place, minlength=len(us)).astype(np.uint32)
                rows.append((-1 - (task << 24) - n_chunks, f"{task}-{n_chunks}", _pack(ids, n, cuts, many, text[at])))
            n_chunks, ids, words, lengths, size = n_chunks + 1, [], [], [], 0
            for at in range(0, len(rows), 16):
                part = list(zip(*rows[at : at + 16]))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1]), pa.array(part[2], pa.binary())], names=["bucket", "chunk", "data"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                w = _words(text.as_py(), hashes)
                ids.append(doc.as_py())
                words.append(w)
                lengths.append(len(w))
                size += len(w)
                if size >= BLOCK_TOKENS:
                    yield from flush()
        if ids:
            yield from flush()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(work, _BLOCKS)


def _uniform(keys: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the key and the step only."""
    x = keys + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def seat(customers: np.ndarray, parent: np.ndarray, others: np.ndarray, keys: np.ndarray, level: int, sweep: int) -> np.ndarray:
    """Tables of each dish after seating its customers anew.

    ``parent`` is the dish's probability at the parent and ``others`` the tables of the restaurant's other dishes. The next
    customer opens a table with weight (strength + discount * tables) * parent, against seated - discount * own tables.
    """
    d, strength = DISCOUNT[level], STRENGTH[level]
    tables = (customers > 0).astype(float)
    live, seated = np.flatnonzero(customers > 1), 1
    while len(live):
        more = np.ones(len(live)) if seated < STEPWISE else np.minimum(max(1, seated // 16), customers[live] - seated)
        t = tables[live]
        new = (strength + d * (others[live] + t)) * parent[live]
        chance = new / (new + np.maximum(seated - d * t, 1e-12))
        # one customer opens a table or not; of a block, the expected number is rounded at random
        tables[live] = np.minimum(t + np.floor(more * chance + _uniform(keys[live], 1_000_003 * sweep + seated)), customers[live])
        seated += 1 if seated < STEPWISE else max(1, seated // 16)
        live = live[customers[live] > seated]
    return tables


def _load(blocks: pa.ChunkedArray) -> tuple:
    """All pairs of a bucket: distinct contexts and words, training counts, and per block its places in them."""
    parts = [_unpack_pairs(x.as_py()) for x in blocks]
    us, ws, place, counts = _sums(*(np.concatenate(x) for x in zip(*parts)))
    return us, ws, counts, np.split(place, np.cumsum([len(p[0]) for p in parts])[:-1])


def _by_word(words: np.ndarray, n: int, bucket: int, *values: np.ndarray) -> list[tuple]:
    """(word_bucket, bucket, data) for the buckets of words: what a bucket of contexts tells of its words."""
    to = _bucket(words, n).astype(np.int64)
    return [(int(b), bucket, _pack(_narrow(words[to == b]), *(x[to == b].astype(np.uint64) for x in values))) for b in np.unique(to)]


def _joined(data: list[bytes]) -> tuple:
    """Distinct words of some such rows, the sums of their values, and the words of each row with their places."""
    parts = [_unpack(x) for x in data]
    rows = [_wide(*p[0]) for p in parts]
    words, place = np.unique(np.concatenate(rows), return_inverse=True)
    sums = np.bincount(place, weights=np.concatenate([p[1] for p in parts]), minlength=len(words))
    return words, sums, list(zip(rows, np.split(place, np.cumsum([len(r) for r in rows])[:-1])))


def _groups(us: np.ndarray) -> np.ndarray:
    """The number of each pair's context, of pairs in the order of contexts."""
    return np.cumsum(np.append(True, us[1:] != us[:-1])[: len(us)]) - 1


def _table(names: str, rows: list[tuple]) -> pa.Table:
    """An Arrow table of ``rows``, with the columns and types of a schema such as ``"bucket bigint, data binary"``."""
    types = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    columns = list(zip(*rows)) if rows else [[]] * (names.count(",") + 1)
    return pa.table({c.split()[0]: pa.array(x, types[c.split()[1]]) for c, x in zip(names.split(", "), columns)})


def _shared(groups: np.ndarray, own: np.ndarray, hot: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The sum of ``own`` over the context of each pair; ``hot`` pairs are told it, as others of their context are elsewhere."""
    return np.where(hot >= 0, sums[hot], np.bincount(groups, weights=own)[groups])


def _hot(us: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The place of each context among the frequent ones, or -1."""
    at = np.searchsorted(frequent, us)
    return np.where(np.isin(us, frequent), at, -1)


def parent_tables(words: np.ndarray, customers: np.ndarray, v: int, totals: list[int]) -> np.ndarray:
    """The parent's tables of some words after the first seating and one sweep for each of ``totals``.

    ``v`` counts the words of the whole corpus, ``totals`` the tables of all of them after each seating before.
    """
    uniform = np.full(len(words), 1 / (v + 1))
    tables = seat(customers, uniform, np.full(len(words), v - 1.0), words, 1, 0)
    for sweep, total in enumerate(totals, 1):
        tables = seat(customers, uniform, total - tables, words, 1, sweep)
    return tables


def score_texts(docs: DataFrame, sweeps: int = SWEEPS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text).

    Tokens are the words between blanks, A-Z lower-cased, and one end. Null and empty texts have the end alone. ``score`` is
    the log10 probability under the model, ``base_score`` under add-one word frequencies. A null doc_id is held out. Repeated
    rows are texts of their own and are learned as often as they occur. With nothing to learn from, all tokens are the one
    unknown word and both scores are 0. More columns are ignored. The scores do not depend on the number of buckets.
    """
    chars = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = max(2, -(-chars // BUCKET_CHARS))
    frequent = frequent_contexts(docs, chars, n)
    told, replies = "word_bucket bigint, bucket bigint, data binary", "bucket bigint, data binary"

    def total_pairs(table: pa.Table) -> pa.Table:
        us, ws, counts, _ = _load(table.column("data"))
        mine, train = table.column("bucket")[0].as_py(), counts > 0
        words, place = np.unique(ws, return_inverse=True)
        hot = _hot(us, frequent)
        rows = []
        for kind, some in ((0, train & (hot < 0)), (3, train & (hot >= 0))):
            if some.any():
                rows.append((kind, None, mine, _pack_pairs(us[some], ws[some], counts[some])))
        rows += [(1, *r) for r in _by_word(words, n, mine, np.bincount(place, weights=counts))]
        if (hot >= 0).any():
            rows.append((2, None, mine, _pack(*(np.bincount(hot[hot >= 0], weights=x[hot >= 0], minlength=len(frequent)).astype(np.int64) for x in (train, counts)))))
        return _table(f"kind int, {told}", rows)

    # kind 0: pairs to learn from, 1: words and their tokens, 2: dishes and customers of frequent contexts, 3: their pairs
    pairs = stored(_blocks(docs, n, frequent, False).groupBy("bucket").applyInArrow(total_pairs, f"kind int, {told}"), "pairs")

    def count(table: pa.Table) -> pa.Table:
        words, tokens, asked = _joined(table.column("data").to_pylist())
        out = [
            (b, _pack(_narrow(w), tokens[at].astype(np.uint64)), int((tokens > 0).sum()) * (i == 0), int(tokens.sum()) * (i == 0))
            for i, (b, (w, at)) in enumerate(zip(table.column("bucket").to_pylist(), asked))
        ]
        return _table(f"{replies}, v bigint, n bigint", out)

    counts = stored(pairs.filter("kind = 1").groupBy("word_bucket").applyInArrow(count, f"{replies}, v bigint, n bigint"), "counts")
    v, total = (int(x or 0) for x in counts.agg(F.sum("v"), F.sum("n")).first())
    hot_sums = np.zeros((2, len(frequent) + 1))  # dishes and customers of the frequent contexts; the last place is of no context
    for r in pairs.filter("kind = 2").select("data").toLocalIterator():
        hot_sums[:, :-1] += np.array(_unpack(r[0]))

    def first(key, left: pa.Table, right: pa.Table) -> pa.Table:
        words, c, _ = _joined(right.column("data").to_pylist())
        customers = np.zeros(len(words))
        for data in left.column("data"):
            us, ws, counts = _unpack_pairs(data.as_py())
            counts = counts.astype(float)
            at, group = np.searchsorted(words, ws), _groups(us)
            others = _shared(group, np.ones(len(us)), _hot(us, frequent), hot_sums[0]) - 1
            tables = seat(counts, c[at] / max(total, 1), others, us * np.uint64(31) + ws, 0, 0)
            customers += np.bincount(at, weights=tables, minlength=len(words))
        return _table(told, _by_word(words, n, key[0].as_py(), customers))

    asked = pairs.filter("kind IN (0, 3)").groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(first, told)
    asked = stored(asked, "asked")

    def join_customers(table: pa.Table) -> pa.Table:
        words, customers, _ = _joined(table.column("data").to_pylist())
        return _table("data binary, k bigint", [(_pack(words[customers > 0], customers[customers > 0]), int(customers.sum()))])

    parents = stored(asked.groupBy("word_bucket").applyInArrow(join_customers, "data binary, k bigint"), "parents")
    customers = int(parents.agg(F.sum("k")).first()[0] or 0)
    totals: list[int] = []
    for _ in range(3):

        def all_tables(batches: Iterator[pa.RecordBatch], before: tuple = tuple(totals)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                t = [(int(parent_tables(*_unpack(x.as_py()), v, before).sum()),) for x in batch.column(0)]
                yield from _table("t bigint", t).to_batches()

        totals.append(int(parents.select("data").mapInArrow(all_tables, "t bigint").agg(F.sum("t")).first()[0] or 0))
    forget(parents)
    tables = totals[-1]

    def answer(table: pa.Table) -> pa.Table:
        words, k, asked = _joined(table.column("data").to_pylist())
        t = parent_tables(words, k, v, totals[:-1])
        rows = [(b, _pack(_narrow(w), k[at].astype(np.uint64), t[at].astype(np.uint64))) for b, (w, at) in zip(table.column("bucket").to_pylist(), asked)]
        return _table(replies, rows)

    answers = asked.groupBy("word_bucket").applyInArrow(answer, replies)
    answers = stored(answers.withColumn("kind", F.lit(1)).unionByName(counts.select("bucket", "data", F.lit(0).alias("kind"))), "answers")
    forget(asked, counts)

    def word_values(table: pa.Table, ws: np.ndarray) -> tuple:
        """Tokens, and the probability at the parent, of the words ``ws``."""
        found = []
        for kind in (0, 1):
            got = [_unpack(x) for x, i in zip(table.column("data").to_pylist(), table.column("kind").to_pylist()) if i == kind]
            words = np.concatenate([_wide(*r[0]) for r in got])
            order = np.argsort(words)
            at = order[np.searchsorted(words[order], ws)]
            found += [np.concatenate([r[i] for r in got])[at].astype(float) for i in range(1, 2 + kind)]
        c, k, t = found
        d, s = DISCOUNT[1], STRENGTH[1]
        return c, (np.maximum(k - d * t, 0) + (s + d * tables) / (v + 1)) / (s + customers)

    hot_tables = [hot_sums[0]]  # tables of the frequent contexts before the first sweep, and after each
    if len(frequent):

        def hot_pairs(key, left: pa.Table, right: pa.Table) -> pa.Table:
            rows = []
            for data in left.column("data"):
                us, ws, counts = _unpack_pairs(data.as_py())
                rows.append((_pack(counts.astype(float), word_values(right, ws)[1], us * np.uint64(31) + ws, _hot(us, frequent)),))
            return _table("data binary", rows)

        dealt = pairs.filter("kind = 3").groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(hot_pairs, "data binary")
        dealt = stored(dealt, "frequent")
        for _ in range(sweeps + 1):

            def sweep_all(batches: Iterator[pa.RecordBatch], before: tuple = tuple(hot_tables)) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for x in batch.column(0):
                        counts, parent, keys, hot = _unpack(x.as_py())
                        own = np.ones(len(counts))
                        for i, every in enumerate(before):
                            own = seat(counts, parent, every[hot] - own, keys, 0, i + 1)
                        t = np.bincount(hot, weights=own, minlength=len(frequent))
                        yield from _table("context bigint, t bigint", [(i, int(x)) for i, x in enumerate(t) if x]).to_batches()

            t = dealt.mapInArrow(sweep_all, "context bigint, t bigint").groupBy("context").agg(F.sum("t")).collect()
            hot_tables.append(np.zeros(len(frequent) + 1))
            for i, x in t:
                hot_tables[-1][i] = x
        forget(dealt)
    # the scores are told from the texts again, with the answers
    forget(pairs)

    def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return left.select(["chunk", "bucket", "data"])
        us, ws, counts, places = _load(left.column("data"))
        c, parent = word_values(right, ws)
        group, hot = _groups(us), _hot(us, frequent)
        seated = _shared(group, counts, hot, hot_sums[1])
        own, mean = (counts > 0).astype(float), np.zeros(len(us))
        d, s = DISCOUNT[0], STRENGTH[0]
        for sweep in range(sweeps + 1):
            given = hot_tables[sweep : sweep + 2] if len(frequent) else [hot_sums[0]] * 2
            others = _shared(group, own, hot, given[0]) - own
            own = seat(counts, parent, others, us * np.uint64(31) + ws, 0, sweep + 1)
            if sweep:
                every = _shared(group, own, hot, given[1])
                mean += (np.maximum(counts - d * own, 0) + (s + d * every) * parent) / (s + seated)
        logs, c = np.log10(mean / sweeps), c.astype(np.int64)
        return _table("chunk string, bucket bigint, data binary", [
            (chunk, key[0].as_py(), _pack(c[place].astype(np.uint32 if c.max() < 2**32 else np.uint64), logs[place]))
            for place, chunk in zip(places, left.column("chunk").to_pylist())
        ])

    def gather(table: pa.Table) -> pa.Table:
        buckets = table.column("bucket").to_pylist()
        ids, lengths, cuts, many, text = _unpack(table.column("data")[buckets.index(min(buckets))].as_py())
        c, logs = np.zeros(len(many)), np.zeros(len(many))
        for b, data in zip(buckets, table.column("data")):
            if b >= 0:
                c[cuts[b] : cuts[b + 1]], logs[cuts[b] : cuts[b + 1]] = _unpack(data.as_py())
        base = np.log10((c + 1) / (total + v + 1))
        known, base, logs = (np.bincount(text, weights=x.repeat(many), minlength=len(ids)) for x in (c > 0, base, logs))
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([held_out(i) for i in ids], pa.bool_()),
            "n_tokens": pa.array(lengths.astype(np.int64)), "n_known": pa.array(known.astype(np.int64)),
            "train_tokens": pa.array([total] * len(known), pa.int64()), "base_score": pa.array(base), "score": pa.array(logs),
        })

    sums = _blocks(docs, n, frequent, True).groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(score, "chunk string, bucket bigint, data binary")
    return sums.groupBy("chunk").applyInArrow(
        gather, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )
