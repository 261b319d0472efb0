"""The queries of the operators in this package over the given tables, with DuckDB statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.alignment import alignment_report
from plumbline.llm.common import read_table
from plumbline.llm.decontaminate import decontamination_report
from plumbline.llm.fertility import fertility_rules
from plumbline.llm.line_dedup import line_report
from plumbline.llm.mixing import mixing_report
from plumbline.llm.near_dup import near_duplicates
from plumbline.llm.pitman_yor import score_texts
from plumbline.llm.quality import quality_scores
from plumbline.llm.secrets import secret_report
from plumbline.llm.spelling import spelling_variants
from plumbline.llm.substring_dedup import remove_repeats
from plumbline.llm.toxicity import toxicity
from plumbline.llm.warc import page_records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


OP1 = r"""WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
d AS (SELECT doc_id, coalesce(ws, []) AS ws FROM w),
i AS (
  SELECT item_id, ws, least(10, len(ws)) AS k FROM (
    SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark) WHERE len(ws) > 0),
iw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS id, k, array_to_string(ws[s:s + k - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS s FROM i)),
dw AS (SELECT doc_id, k, s, array_to_string(ws[s:s + k - 1], ' ') AS g
       FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM i))),
m AS (SELECT doc_id, s, k, id FROM dw JOIN iw USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT doc_id, id FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


@query("op1_decontamination", OP1)
def op1(spark, d):
    return decontamination_report(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"))


OP3 = r"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
k AS (SELECT doc_id, ws, least(4, len(ws)) AS k FROM w WHERE len(ws) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[s:s + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS s FROM k)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(low) AS component_id FROM r GROUP BY node)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN c ON c.node = doc_id"""


@query("op3_minhash", OP3)
def op3(spark, d):
    return near_duplicates(read_table(spark, d, "documents"), size=4)


@query("op9_secrets")
def op9(spark, d):
    return secret_report(read_table(spark, d, "documents"))


@query("op2_fertility")
def op2(spark, d):
    return fertility_rules(read_table(spark, d, "documents"))


OP8 = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS b, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS last FROM p)
SELECT page_id, b AS payload_bytes, d AS payload_digest,
       CASE WHEN b >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN b >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m"""


@query("op8_warc", OP8)
def op8(spark, d):
    return page_records(spark, read_table(spark, d, "pages"))


@query("op10_toxicity")
def op10(spark, d):
    return toxicity(read_table(spark, d, "documents"), read_table(spark, d, "labels"))


@query("op5_mixing")
def op5(spark, d):
    # the sources of the tables are nearly of one size; only a target close to the largest entropy moves their weights
    return mixing_report(read_table(spark, d, "documents"), entropy=0.9999, max_repeats=2.0)


OP6 = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents),
t AS (SELECT doc_id, no, list_sort(list_distinct(list_filter(string_split_regex(
        lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS ws FROM l),
c AS (SELECT row_number() OVER () AS c, ws, len(ws) AS n, min({'d': doc_id, 'l': no}) AS f FROM t WHERE len(ws) > 0 GROUP BY ws),
w AS (SELECT c, n, unnest(ws) AS w FROM c),
o AS (SELECT c, n, w, row_number() OVER (PARTITION BY c ORDER BY k, w) AS i FROM w JOIN (SELECT w, count(*) AS k FROM w GROUP BY w) USING (w)),
p AS (SELECT * FROM o WHERE i <= n - (n * 80 + 99) // 100 + 1),
q AS (SELECT DISTINCT x.c AS a, y.c AS b FROM p x JOIN p y ON x.w = y.w AND x.c < y.c AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
m AS (SELECT CASE WHEN x.f < y.f THEN b ELSE a END AS late FROM q JOIN c x ON x.c = a JOIN c y ON y.c = b
      WHERE 100 * len(list_intersect(x.ws, y.ws)) >= 80 * (x.n + y.n - len(list_intersect(x.ws, y.ws)))),
k AS (SELECT l.doc_id, l.no, line, len(t.ws) > 0 AND (c.c IN (SELECT late FROM m) OR c.f <> {'d': l.doc_id, 'l': l.no}) AS gone
      FROM l JOIN t USING (doc_id, no) LEFT JOIN c ON c.ws = t.ws)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT coalesce(gone, false)), '')) AS kept_sha256
FROM k GROUP BY doc_id"""


@query("op6_line_dedup", OP6)
def op6(spark, d):
    return line_report(read_table(spark, d, "documents"))


@query("op7_pitman_yor")
def op7(spark, d):
    return score_texts(read_table(spark, d, "documents"))


@query("op4_suffix_array")
def op4(spark, d):
    return remove_repeats(read_table(spark, d, "documents")).drop("kept")


OP11 = r"""WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM runs WHERE length(run) >= 7),
bytes AS (SELECT run, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
            lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END)) AS b FROM low),
crc AS (SELECT run, xor(list_reduce(list_transform(b, lambda x: CAST(x AS BIGINT)), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1]), 4294967295), 4294967295) AS h
        FROM bytes, tab),
noised AS (SELECT CASE WHEN h % 31 = 0 THEN run[1:CAST(h % length(run) AS INTEGER)] || run[CAST(h % length(run) AS INTEGER) + 2:] ELSE run END AS word FROM crc),
w AS (SELECT word, count(*) AS n FROM noised WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
x AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, a.n, b.word AS near, b.n AS m FROM x a JOIN x b ON a.cut = b.cut AND a.i = b.i AND length(a.word) = length(b.word) AND a.word <> b.word
      UNION SELECT x.word, x.n, w.word, w.n FROM x JOIN w ON x.cut = w.word
      UNION SELECT w.word, w.n, x.word, x.n FROM x JOIN w ON x.cut = w.word),
f AS (SELECT word, count(*) AS n_near, max(m) AS m FROM p GROUP BY word),
b AS (SELECT f.word, n_near, min(near) AS form, f.m AS form_n FROM f JOIN p ON p.word = f.word AND p.m = f.m GROUP BY ALL),
j AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n
      FROM w LEFT JOIN b USING (word)),
r AS (SELECT word, word AS at, form AS up FROM j UNION ALL SELECT r.word, j.word, j.form FROM r JOIN j ON j.word = r.up)
SELECT j.*, r.at AS root FROM j JOIN r ON r.word = j.word AND r.up IS NULL"""


@query("op11_spelling", OP11)
def op11(spark, d):
    return spelling_variants(read_table(spark, d, "documents"))


@query("op12_alignment")
def op12(spark, d):
    return alignment_report(read_table(spark, d, "documents"))


@query("op13_quality")
def op13(spark, d):
    return quality_scores(read_table(spark, d, "documents"), read_table(spark, d, "labels"))
