"""Aligns the tokens that two vocabularies make of one text, by an associative fragment monoid.

Both vocabularies cut the bytes of a text into tokens. Where tokens of both end, a group ends; tokens of a group whose bytes
overlap are linked. A ``Fragment`` is what is known of a range of bytes whose borders may lie anywhere: an open prefix (the
tokens up to the first common end), closed groups, and an open suffix (the tokens behind the last common end). Joining two
neighbours closes at most one group, and the order in which neighbours are joined does not matter, so the fragments of a
very long text are made in many tasks and joined in a tree of shuffles, a few at a time.

Neither vocabulary has tokens across a blank between two other characters, so the words between such blanks are fragments
that are closed at both sides. A task keeps the fragments of the words that it has met, and a short text is the product of
its words' fragments. Counts of linked pairs are sums over the corpus; the most frequent ones, of a bounded number, go
to every task, and only links of other pairs meet their counts in a shuffle.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored

BYTE_VOCABULARY, PIECE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
LONG = 50_000  # characters beyond which a text is cut and dealt over tasks
PIECE = 16_000  # characters of a cut piece at least
RANGE = 1 << 14  # bytes of a fragment of a long text
FAN = 4  # neighbours joined at once
WORDS = 150_000  # words whose fragments a task keeps, and their characters
WORD_CHARS = 6_000_000
SLICE = 3_000_000  # characters of short texts worked on at once
CHUNK = 4_000  # characters of words encoded as one text
COMMON = 1 << 18  # pairs whose counts go to every task at most
BITS = 20  # of a token's number
_CUT = re.compile(r"(?<=\S) (?=\S)")

_IDS, _ENDS = pa.list_(pa.int32()), pa.list_(pa.int64())
_OUT = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, pairs array<bigint>, counts array<bigint>"
_OUT_NAMES = [c.split()[0] for c in _OUT.split(", ")]
_TOKENS = "a array<int>, ea array<bigint>, b array<int>, eb array<bigint>"
_RANGES = f"row bigint, doc_id bigint, k bigint, at bigint, ok boolean, {_TOKENS}"
_FRAGMENT = (
    "row bigint, doc_id bigint, k bigint, ok boolean, cut boolean, pa array<int>, pea array<bigint>, pb array<int>, peb array<bigint>, "
    "sa array<int>, sea array<bigint>, sb array<int>, seb array<bigint>, n_a bigint, n_b bigint, n_groups bigint, groups string, pairs array<bigint>, counts array<bigint>"
)


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones as they are, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


class Vocabularies:
    """A byte-level vocabulary (A) and one of pieces with byte fallback (B): tokens of words and their bytes."""

    def __init__(self, byte_file: str, piece_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(letters[c] for c in e) if all(c in letters for c in e) else e.encode() for e in entries]
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{piece_file} has pieces across blanks; its texts cannot be cut at blanks")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << BITS:
            raise ValueError("a vocabulary has too many entries")
        self.size_a, self.size_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        ids = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.comma, self.semicolon, self.bar = (np.array([s + i for i in ids], dtype=object) for s in ",;|")

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of a blank and each word, one after the other: (A, its number by word, B, its number by word, back).

        ``back`` tells whether both vocabularies give back the bytes of a word; one that does not has no tokens. Words are
        encoded many at a time as one text, since no token reaches across the blank between two of them.
        """
        texts, chars = [], CHUNK
        for w in words:
            plain = bool(w) and not w[0].isspace() and not w[-1].isspace()
            if chars + len(w) >= CHUNK or not plain:
                texts.append([])
                chars = 0 if plain else CHUNK
            texts[-1].append(w)
            chars += len(w) + 1
        found = [([], []), ([], [])]
        back = np.ones(len(words), dtype=bool)
        at = 0
        for group, *ids in zip(texts, *self._ids([" ".join(t) for t in texts])):
            ends = np.cumsum([len(w.encode()) + 1 for w in group])
            sides = self._by_word(group, ends, ids)
            if sides is None:  # some word of the group does not come back
                sides = [([], []), ([], [])]
                for i, (w, *own) in enumerate(zip(group, *self._ids(group))):
                    one = self._by_word([w], np.array([len(w.encode()) + 1]), own)
                    back[at + i] = one is not None
                    for side, (tokens, n) in zip(sides, one or [([], [0]), ([], [0])]):
                        side[0].extend(tokens)
                        side[1].extend(n)
            for (tokens, counts), (more, n) in zip(found, sides):
                tokens.extend(more)
                counts.extend(n)
            at += len(group)
        (a, n_a), (b, n_b) = ((np.array(x, dtype=np.int64), np.array(n, dtype=np.int64)) for x, n in found)
        return a, n_a, b, n_b, back

    def _ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        encoded = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [e.ids for e in encoded], self.b.encode(texts, num_threads=1)

    def _by_word(self, words: list[str], ends: np.ndarray, ids: list[list[int]]) -> list[tuple[list[int], list[int]]] | None:
        """(tokens, number by word) of both sides; None where a side differs from the bytes or has a token across words."""
        raw, out = (" " + " ".join(words)).encode(), []
        for tokens, table, size in zip(ids, (self.bytes_a, self.bytes_b), (self.size_a, self.size_b)):
            if b"".join([table[i] for i in tokens]) != raw:
                return None
            upto = np.cumsum(size[tokens])
            last = np.searchsorted(upto, ends)
            if not np.array_equal(upto[last], ends):
                return None
            out.append((tokens, np.diff(last, prepend=-1).tolist()))
        return out

    def align(self, a: np.ndarray, ea: np.ndarray, b: np.ndarray, eb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of tokens with their end bytes, the last one common: (common ends, texts of the groups, links, ends of the links).

        The texts have one element per token, A before B in each group, with its separator in front.
        """
        common = ea[eb[np.minimum(np.searchsorted(eb, ea), len(eb) - 1)] == ea]
        ga, gb = np.searchsorted(common, ea), np.searchsorted(common, eb)
        to_a, to_b = np.searchsorted(ea, common, "right"), np.searchsorted(eb, common, "right")
        text = np.empty(len(a) + len(b), dtype=object)
        text[np.arange(len(a)) + np.concatenate([[0], to_b])[ga]] = np.where(np.diff(ga, prepend=-1) > 0, self.semicolon[a], self.comma[a])
        text[np.arange(len(b)) + to_a[gb]] = np.where(np.diff(gb, prepend=-1) > 0, self.bar[b], self.comma[b])
        ends = np.union1d(ea, eb)
        return common, text, a[np.searchsorted(ea, ends)] << BITS | b[np.searchsorted(eb, ends)], ends


def _summed(pairs: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, sorted, with their counts."""
    if counts is None:
        return np.unique(pairs, return_counts=True)
    keys, at = np.unique(pairs, return_inverse=True)
    return keys, np.bincount(at, counts, len(keys)).astype(np.int64)


@dataclass(eq=False)
class Tokens:
    """Tokens of both vocabularies with the bytes at which they end."""

    a: np.ndarray
    ea: np.ndarray
    b: np.ndarray
    eb: np.ndarray

    @staticmethod
    def of(a, ea, b, eb) -> Tokens:
        return Tokens(*(np.asarray(x, dtype=np.int64) for x in (a, ea, b, eb)))

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate([getattr(self, c), getattr(other, c)]) for c in ("a", "ea", "b", "eb")))

    def split(self, at: int) -> tuple[Tokens, Tokens]:
        i, j = np.searchsorted(self.ea, at, "right"), np.searchsorted(self.eb, at, "right")
        return Tokens(self.a[:i], self.ea[:i], self.b[:j], self.eb[:j]), Tokens(self.a[i:], self.ea[i:], self.b[j:], self.eb[j:])

    def lists(self) -> tuple[np.ndarray, ...]:
        return self.a, self.ea, self.b, self.eb


NOTHING = Tokens.of([], [], [], [])


@lru_cache(maxsize=1)
def vocabularies(byte_file: str, piece_file: str) -> Vocabularies:
    """Loaded once in a worker process, whatever the number of its tasks and groups."""
    return Vocabularies(byte_file, piece_file)


@dataclass
class Closed:
    """Whole groups: numbers of tokens and groups, their text (each group with a semicolon in front), and sums of links."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    text: str = ""
    pairs: np.ndarray = field(default_factory=lambda: NOTHING.a)
    counts: np.ndarray = field(default_factory=lambda: NOTHING.a)

    def __add__(self, other: Closed) -> Closed:
        if not other.n_groups or not self.n_groups:
            return self if not other.n_groups else other
        links = _summed(np.concatenate([self.pairs, other.pairs]), np.concatenate([self.counts, other.counts]))
        return Closed(self.n_a + other.n_a, self.n_b + other.n_b, self.n_groups + other.n_groups, self.text + other.text, *links)


@dataclass
class Fragment:
    """A range of bytes; without a common end in it (``cut``), all its tokens are in the prefix."""

    cut: bool = False
    prefix: Tokens = NOTHING
    closed: Closed | None = None
    suffix: Tokens = NOTHING


def _close(tokens: Tokens, vocabs: Vocabularies) -> Closed:
    if not len(tokens.a):
        return Closed()
    common, text, links, _ = vocabs.align(*tokens.lists())
    return Closed(len(tokens.a), len(tokens.b), len(common), "".join(text.tolist()), *_summed(links))


def fragment(tokens: Tokens, vocabs: Vocabularies) -> Fragment:
    """The fragment of the tokens that end in one range of bytes."""
    common = np.intersect1d(tokens.ea, tokens.eb, assume_unique=True)
    if not len(common):
        return Fragment(False, tokens)
    prefix, rest = tokens.split(common[0])
    inner, suffix = rest.split(common[-1])
    return Fragment(True, prefix, _close(inner, vocabs), suffix)


def joined(left: Fragment, right: Fragment, vocabs: Vocabularies) -> Fragment:
    """The fragment of two neighbouring ranges. Associative; the empty fragment changes nothing."""
    if not left.cut and not right.cut:
        return Fragment(False, left.prefix + right.prefix)
    if not left.cut:
        return Fragment(True, left.prefix + right.prefix, right.closed, right.suffix)
    if not right.cut:
        return Fragment(True, left.prefix, left.closed, left.suffix + right.prefix)
    # the first common end of the right range closes what was open in the left one
    return Fragment(True, left.prefix, left.closed + _close(left.suffix + right.prefix, vocabs) + right.closed, right.suffix)


def finished(whole: Fragment, vocabs: Vocabularies) -> Closed:
    """The groups of a whole text, whose prefix is its first group and whose suffix is empty."""
    return _close(whole.prefix, vocabs) + whole.closed if whole.cut else Closed()


class Words:
    """The closed fragments of the words that a task has met."""

    def __init__(self, vocabs: Vocabularies):
        self.vocabs = vocabs
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.texts: list[str] = []
        self.ok, self.n_a, self.n_b, self.n_groups, self.n_links, self.links = (np.zeros(0, dtype=np.int64) for _ in range(6))

    def learn(self, words: list[str]) -> None:
        if not words:
            return
        # aligned as one text; a word that does not come back stands as an empty one
        a, n_a, b, n_b, ok = self.vocabs.encode(words)
        ends = np.cumsum([len(w.encode()) + 1 if o else 0 for w, o in zip(words, ok)])
        groups, text, links, at = self.vocabs.align(a, np.cumsum(self.vocabs.size_a[a]), b, np.cumsum(self.vocabs.size_b[b])) if len(a) else [NOTHING.a] * 4
        to_group, to_link = np.searchsorted(groups, ends, "right"), np.searchsorted(at, ends, "right")
        text, upto = text.tolist(), np.cumsum(n_a + n_b).tolist()
        self.texts += ["".join(text[i:j]) for i, j in zip([0, *upto], upto)]
        for i, w in enumerate(words, len(self.number)):
            self.number[w] = i
            self.chars += len(w)
        new = {"ok": ok, "n_a": n_a, "n_b": n_b, "n_groups": np.diff(to_group, prepend=0), "n_links": np.diff(to_link, prepend=0), "links": links}
        for name, more in new.items():
            setattr(self, name, np.concatenate([getattr(self, name), more]))
        self.first = np.cumsum(self.n_links) - self.n_links

    def product(self, texts: list[str], keep: bool) -> list[list]:
        """The columns of the result, from n_a on, of ``texts``, each the product of its words' fragments."""
        if len(self.number) > WORDS or self.chars > WORD_CHARS:
            self.forget()
        words = [_CUT.split(t) if t else [] for t in texts]
        self.learn(list({w: 0 for ws in words for w in ws if w not in self.number}))
        of, n = self.number, len(texts)
        numbers = [[of[w] for w in ws] for ws in words]
        if self.number:
            numbers = [x if self.ok[x].all() else [] for x in numbers]
        flat = np.array([i for x in numbers for i in x], dtype=np.int64)
        doc = np.repeat(np.arange(n), [len(x) for x in numbers])
        total = lambda c: np.bincount(doc, c[flat], n).astype(np.int64) if len(flat) else np.zeros(n, dtype=np.int64)
        sums = [total(c) for c in (self.n_a, self.n_b, self.n_groups, self.n_links)]
        size = self.n_links[flat]
        at = np.repeat(self.first[flat] - (np.cumsum(size) - size), size) + np.arange(size.sum()) if len(flat) else flat
        keys, counts = np.unique(np.repeat(doc, size) << 2 * BITS | self.links[at], return_counts=True)
        cuts = np.searchsorted(keys, np.arange(n + 1) << 2 * BITS)
        keys &= (1 << 2 * BITS) - 1
        strings = ["".join([self.texts[i] for i in x])[1:] for x in numbers]
        return [
            *[s.tolist() for s in sums], list(map(_digest, strings)), strings if keep else [None] * n,
            pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(keys)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(counts)),
        ]


def _digest(groups: str) -> str:
    return hashlib.sha256(groups.encode()).hexdigest() if groups else ""


def _short(docs: DataFrame, files: tuple[str, str], keep: bool) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(vocabularies(*files))
        for batch in batches:
            sizes, at = batch.column(3).to_pylist(), 0
            while at < len(sizes):
                end, chars = at, 0
                while end < len(sizes) and (end == at or chars + sizes[end] <= SLICE):
                    chars += sizes[end]
                    end += 1
                part = batch.slice(at, end - at)
                columns = words.product([t or "" for t in part.column(2).to_pylist()], keep)
                types = [pa.int64()] * 4 + [pa.string()] * 2
                arrays = [pa.array(c, t) for c, t in zip(columns, types)] + columns[6:]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], names=_OUT_NAMES)
                at = end

    return docs.select("row", "doc_id", "text", F.coalesce(F.char_length("text"), F.lit(0))).mapInArrow(work, _OUT)


def _pieces(docs: DataFrame) -> DataFrame:
    """(row, doc_id, at, piece): texts cut at blanks; ``at`` is the byte of a blank and the text at which the piece's blank stands."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(i) for i in range(3))):
                text, begin, at = text.as_py(), 0, 0
                while begin < len(text):
                    cut = _CUT.search(text, begin + PIECE)
                    end = cut.start() if cut else len(text)
                    piece = text[begin:end]
                    yield pa.RecordBatch.from_pylist([{"row": row.as_py(), "doc_id": doc_id.as_py(), "at": at, "piece": piece}], schema)
                    at += 1 + len(piece.encode())
                    begin = end + 1

    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("piece", pa.string())])
    return docs.select("row", "doc_id", "text").mapInArrow(work, "row bigint, doc_id bigint, at bigint, piece string")


def _by_range(pieces: DataFrame, files: tuple[str, str]) -> DataFrame:
    """The tokens of pieces, one row for each range of bytes in which tokens of a piece end."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabs = vocabularies(*files)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                a, _, b, _, (ok,) = vocabs.encode([r["piece"]])
                rest = Tokens(a, r["at"] + np.cumsum(vocabs.size_a[a]), b, r["at"] + np.cumsum(vocabs.size_b[b]))
                ends = np.union1d(rest.ea, rest.eb)
                for k in np.unique((ends - 1) // RANGE).tolist() or [r["at"] // RANGE]:
                    part, rest = rest.split((k + 1) * RANGE)
                    rows.append((r["row"], r["doc_id"], k, r["at"], bool(ok), *part.lists()))
            yield _batch(rows, _RANGES)

    return pieces.mapInArrow(work, _RANGES)


def _type(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.large_string(), "array<int>": _IDS, "array<bigint>": _ENDS}[name]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    arrays = [pa.array(c, _type(t)).cast(pa.string()) if t == "string" else pa.array(c, _type(t)) for c, (_, t) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def _row(key: tuple, ok: bool, f: Fragment) -> tuple:
    c = f.closed or Closed()
    return (*key, ok, f.cut, *f.prefix.lists(), *f.suffix.lists(), c.n_a, c.n_b, c.n_groups, c.text, c.pairs, c.counts)


def _read(r: dict) -> Fragment:
    p, s = (Tokens.of(*(r[x + c] for c in ("a", "ea", "b", "eb"))) for x in "ps")
    closed = Closed(r["n_a"], r["n_b"], r["n_groups"], r["groups"], np.array(r["pairs"], dtype=np.int64), np.array(r["counts"], dtype=np.int64))
    return Fragment(r["cut"], p, closed, s)


def _long(docs: DataFrame, files: tuple[str, str], keep: bool) -> DataFrame:
    """Long texts: pieces are encoded in tasks of their own, ranges of bytes become fragments, and a tree joins them."""
    pieces = _pieces(docs).repartition("row", "at")
    ranges = _by_range(pieces, files)

    def begin(table: pa.Table) -> pa.Table:
        vocabs = vocabularies(*files)
        rows = sorted(table.to_pylist(), key=lambda r: r["at"])
        tokens = NOTHING
        for r in rows:
            tokens = tokens + Tokens.of(r["a"], r["ea"], r["b"], r["eb"])
        key = (rows[0]["row"], rows[0]["doc_id"], rows[0]["k"])
        return pa.Table.from_batches([_batch([_row(key, all(r["ok"] for r in rows), fragment(tokens, vocabs))], _FRAGMENT)])

    level = stored(ranges.groupBy("row", "k").applyInArrow(begin, _FRAGMENT), "fragments")

    def join(table: pa.Table) -> pa.Table:
        vocabs = vocabularies(*files)
        rows = sorted(table.to_pylist(), key=lambda r: r["k"])
        whole = Fragment()
        for r in rows:
            whole = joined(whole, _read(r), vocabs)
        key = (rows[0]["row"], rows[0]["doc_id"], rows[0]["k"] // FAN)
        return pa.Table.from_batches([_batch([_row(key, all(r["ok"] for r in rows), whole)], _FRAGMENT)])

    last = level.agg(F.max("k")).first()[0] or 0
    while last:
        last //= FAN
        level = stored(level.groupBy("row", F.floor(F.col("k") / FAN)).applyInArrow(join, _FRAGMENT), "fragments")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabs = vocabularies(*files)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                c = finished(_read(r), vocabs) if r["ok"] else Closed()
                text = c.text[1:]
                out.append((r["row"], r["doc_id"], c.n_a, c.n_b, c.n_groups, int(c.counts.sum()), _digest(text), text if keep else None, c.pairs, c.counts))
            yield _batch(out, _OUT)

    return level.mapInArrow(finish, _OUT)


def aligned(docs: DataFrame, files: tuple[str, str] = (BYTE_VOCABULARY, PIECE_VOCABULARY), keep_groups: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) its groups, with the distinct linked pairs of token numbers (a << 20 | b) and their counts.

    Columns: row (a number of the row), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups (``a1,a2|b1;...``, null unless
    ``keep_groups``), pairs, counts. Null and empty texts, and texts whose bytes a vocabulary does not give back, have no tokens.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("row"))
    size = F.coalesce(F.char_length("text"), F.lit(0))
    short = _short(rows.filter(size <= LONG), files, keep_groups)
    return short.union(_long(rows.filter(size > LONG), files, keep_groups))


def alignment_report(docs: DataFrame, files: tuple[str, str] = (BYTE_VOCABULARY, PIECE_VOCABULARY), common: int = COMMON) -> DataFrame:
    """``op12_alignment``: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs``.

    A pair's count is the number of links with it in the corpus; ``n_best`` links have the highest count of their B token.
    At most ``common`` counts go to every task, those of the most frequent pairs; the others are joined. Null and empty
    texts, and those a vocabulary does not give back, have zeros and an empty digest. Repeated rows and null ids are rows
    like any other; more columns are ignored. A text without blanks is encoded in one piece, whatever its length.
    """
    rows = stored(aligned(docs, files, keep_groups=False).drop("groups"), "aligned")
    links = rows.select(F.explode(F.arrays_zip("pairs", "counts")).alias("l")).select("l.pairs", "l.counts")
    counts = links.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("n"))
    counts = stored(counts, "counts")
    target = F.col("pair").bitwiseAND((1 << BITS) - 1)
    best = counts.groupBy(target.alias("b")).agg(F.max("n").alias("most"))
    counts = stored(counts.join(best, target == best["b"]).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    # counts by powers of two tell from which count on pairs are few enough to be sent
    level = F.floor(F.log2("n"))
    found, least, left = dict(counts.groupBy(level).count().collect()), 63, common
    while least and found.get(least - 1, 0) <= left:
        least -= 1
        left -= found.get(least, 0)
    often = F.col("n") >= F.lit(2**least if least else 0)
    sent = counts.filter(often).toArrow().sort_by("pair")
    sent = docs.sparkSession.sparkContext.broadcast([sent[c].to_numpy() for c in ("pair", "n", "best")])
    schema = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, b1 bigint, c1 bigint, pairs array<bigint>, counts array<bigint>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ns, bests = sent.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("counts").flatten().to_numpy()
            sizes = np.diff(pairs.offsets.to_numpy())
            pairs, doc = pairs.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), sizes)
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), dtype=bool)
            total = np.zeros((2, batch.num_rows), dtype=np.int64)
            for out, value in zip(total, (bests, ns)):
                np.add.at(out, doc[known], times[known] * value[at[known]])
            cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[~known], minlength=batch.num_rows))]), pa.int32())
            rest = [pa.ListArray.from_arrays(cuts, pa.array(x[~known])) for x in (pairs, times)]
            kept = [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(total[0]), pa.array(total[1]), *rest], names=[c.split()[0] for c in schema.split(", ")])

    scored = stored(rows.mapInArrow(work, schema), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.counts").alias("times"))
    rare = rare.join(counts.filter(~often), "pair")
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("b2"), F.sum(F.col("times") * F.col("n")).alias("c2"))
    zero = F.lit(0).cast("bigint")
    return scored.join(rare, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("b1") + F.coalesce("b2", zero)).alias("n_best"),
        (F.col("c1") + F.coalesce("c2", zero)).alias("count_sum"), "groups_sha256",
    )
