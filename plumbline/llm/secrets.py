"""Secret scan with multipart credential linking.

Strong patterns are reported wherever they occur. Weak parts (an identifier, a secret or an endpoint that alone proves
nothing) are reported only when complementary parts lie within one scope: an identifier and a secret at most ``scope`` code
points apart, and an endpoint when it has an identifier and a secret within its scope that are each paired, with one
another or with other parts. Strong parts count as partners. Parts meet in an interval join on (document, cell), as semi-joins,
so no pairs are built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import hex_sha256, stored

# Fixed patterns of the strong kinds, in their order: kind, quick test, pattern, least length of the group that counts.
STRONG = [
    ("assign", r"(?i)password|passwd|secret|token|api_?key",
     r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16}", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24}", r"[0-9a-f]{24,}", 0, 24),
]
# Weak kinds: kind, role, quick test, pattern.
WEAK = [
    ("weak_id", "id", r"(?i)(?:client|account|user|login|key)_?(?:id|name)?[\"']?\x20*[:=]",
     r"""(?i)\b(?:client_?id|account_?id|user_?id|user_?name|user|login|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""),
    ("weak_secret", "secret", r"(?i)(?:pwd|pass|signature|private_?key|credential)[\"']?\x20*[:=]",
     r"""(?i)\b(?:pwd|pass|signature|private_?key|credential)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=!@#$%^&*-]{6,}"""),
    ("weak_blob", "secret", r"[A-Za-z0-9+/]{40}", r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{40,}={0,2}"),
    ("weak_mail", "id", r"@[A-Za-z0-9]", r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("weak_address", "endpoint", r"[0-9]\.[0-9]{1,3}\.[0-9]", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])"),
    ("weak_endpoint", "endpoint", r"://|(?i)(?:host|endpoint|server)[\"']?\x20*[:=]",
     r"""(?i)(?:[a-z][a-z0-9+.-]{1,15}://|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9_.:@/?&=%-]{4,}"""),
]
ROLE = {"assign": "secret", "access": "id", "hex": "secret"} | {kind: role for kind, role, _, _ in WEAK}
ORDER = [k[0] for k in STRONG] + [k[0] for k in WEAK]
_SPAN = "struct<start:bigint,rank:int,end:bigint>"


def spans_of(text: Column, kind: str, quick: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Leftmost matches that do not overlap, as (start, rank, end) in code points; those with a short group are dropped.

    The pieces between the matches and the matches themselves add up to their places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    placed = F.aggregate(
        F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(m.alias("m"), b.alias("b"))),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.char_length(x["b"]) + F.char_length(x["m"])).alias("at"),
            F.when(
                F.char_length(F.regexp_extract(x["m"], pattern, group)) >= least,
                F.array_append(acc["out"], F.struct(
                    (acc["at"] + F.char_length(x["b"])).alias("start"), F.lit(ORDER.index(kind)).alias("rank"),
                    (acc["at"] + F.char_length(x["b"]) + F.char_length(x["m"])).alias("end"),
                )),
            ).otherwise(acc["out"]).alias("out"),
        ),
    )["out"]
    return F.when(text.rlike(quick), placed).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _near(x: DataFrame, y: DataFrame, scope: int) -> DataFrame:
    """The spans of ``x`` with a span of ``y`` in the same document at most ``scope`` apart, none inside the other's own."""
    cells = lambda low, high: F.explode(F.sequence(F.floor(F.lit(low) / scope), F.floor(F.lit(high) / scope)))
    left = x.withColumn("cell", cells(F.col("start") - scope, F.col("end") + scope))
    right = y.select(
        F.col("doc").alias("d"), F.col("start").alias("s"), F.col("end").alias("e"), cells(F.col("start"), F.col("end")).alias("c")
    )
    gap = F.greatest(F.col("s") - F.col("end"), F.col("start") - F.col("e"))
    apart = gap >= 0
    return (
        left.join(right, (F.col("doc") == F.col("d")) & (F.col("cell") == F.col("c")) & apart & (gap <= scope), "left_semi")
        .select("doc", "start", "rank", "end").distinct()
    )


def linked_parts(parts: DataFrame, scope: int) -> DataFrame:
    """Of ``parts`` (doc, start, rank, end), those that complementary parts within ``scope`` support.

    Parts that overlap each other are one finding seen twice and do not support one another.
    """
    role = F.element_at(F.create_map(*[F.lit(v) for k in ORDER for v in (ORDER.index(k), ROLE[k])]), F.col("rank"))
    parts = parts.withColumn("role", role)
    ids, secrets, ends = ((parts.filter(F.col("role") == r).drop("role")) for r in ("id", "secret", "endpoint"))
    paired_ids, paired_secrets = _near(ids, secrets, scope), _near(secrets, ids, scope)
    return paired_ids.union(paired_secrets).union(_near(_near(ends, paired_ids, scope), paired_secrets, scope))


def secret_spans(docs: DataFrame, scope: int = 200) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; more columns are ignored): doc_id, ``strong`` and ``weak`` spans.

    Both are arrays of (start, rank, end), in code points, by start and then rank (the place in ``ORDER``). Null and empty
    texts have none. Repeated rows each come back with the same spans; a null doc_id is kept.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    strong = F.concat(*[spans_of(text, *k) for k in STRONG])
    weak = F.concat(*[spans_of(text, kind, quick, pattern) for kind, _, quick, pattern in WEAK])
    seen = docs.select("doc_id", F.when(F.size(weak) > 0, F.md5(text)).alias("digest"), strong.alias("strong"), weak.alias("parts"))
    seen = stored(seen, "spans")
    doc = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("digest"))
    parts = (
        seen.filter(F.size("parts") > 0).select(doc.alias("doc"), F.explode(F.concat("strong", "parts")).alias("p"))
        .select("doc", "p.*").distinct()
    )
    weak_found = linked_parts(stored(parts, "parts"), scope).filter(F.col("rank") >= len(STRONG))
    lists = weak_found.groupBy("doc").agg(F.collect_list(F.struct("start", "rank", "end")).alias("weak"))
    none = F.array().cast(f"array<{_SPAN}>")
    # documents without parts, most of them, do not meet under a null key
    some = seen.filter("digest IS NOT NULL").withColumn("key", doc).join(lists, F.col("key") == F.col("doc"), "left")
    some = some.select("doc_id", "strong", F.coalesce("weak", none).alias("weak"))
    out = some.union(seen.filter("digest IS NULL").select("doc_id", "strong", none))
    return out.select("doc_id", F.array_sort("strong").alias("strong"), F.array_sort("weak").alias("weak"))


def _written(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """The digest columns of ``op9_secrets``, one row per document row."""
    rows = secret_spans(docs)
    count = lambda r: F.size(F.filter("strong", lambda s: s["rank"] == r)).cast("long")
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        hex_sha256(_written(F.col("strong"))).alias("base_sha256"),
        _written(F.array_sort(F.concat("strong", "weak"))).alias("spans"),
    )
