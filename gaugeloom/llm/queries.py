"""The queries of this subpackage over the tables in a folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeloom.llm import alignment, capfilter, divergence, licenses, lines, minhash, mixing, packing, ppm, quality, spotsigs, substrings, urlfilter

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), ranks_path())


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), 85)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op3_packing": op3_packing, "op6_minhash": op6_minhash, "op7_url_filter": op7_url_filter, "op9_mixing": op9_mixing}

SQL: dict[str, str] = {}

SQL["op7_url_filter"] = r"""
WITH rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
fit AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS nth
  FROM p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE nth = 1
"""

#: The mix over a table named by {docs}; leaves the rows as CTE ``mixed``.
MIX_CTES = r"""
sized AS (
  SELECT *, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM {docs}),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sized GROUP BY source),
lev AS (
  SELECT *, (1.5 * sum(source_size) OVER () - (sum(2.0::DOUBLE * source_size) OVER f - 2.0::DOUBLE * source_size)) / (sum(w) OVER () - sum(w) OVER f + w) AS level
  FROM per WINDOW f AS (ORDER BY 2.0::DOUBLE * source_size / w, source ASC NULLS LAST)),
tgt AS (
  SELECT source, source_size,
    least(2.0::DOUBLE * source_size, coalesce(max(CASE WHEN 2.0::DOUBLE * source_size / w > level THEN level END) OVER () * w, 0)) AS target
  FROM lev),
goal AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(round(target) / source_size)::BIGINT ELSE 0 END AS epochs FROM tgt),
ranked AS (
  SELECT s.*, g.source_size, g.target, g.epochs, round(g.target)::BIGINT - g.epochs * g.source_size AS rest,
    sum(size) OVER (PARTITION BY s.source ORDER BY key, s.doc_id) - size AS before
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
mixed AS (SELECT *, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM ranked)
"""
SQL["op9_mixing"] = "WITH " + MIX_CTES.format(docs="documents") + "SELECT doc_id, size, source_size, target, taken FROM mixed"


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(_table(spark, sf_dir, "documents"))


QUERIES["op4_spotsigs"] = op4_spotsigs

_ANCHORS = ", ".join(f"'{a}'" for a in sorted(set(spotsigs.ANCHORS)))
_SPOTS = r"""
{name}_w AS (SELECT doc_id, {text} AS t, list_filter(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws FROM {source}),
{name}_c AS (SELECT *, list_transform(ws, lambda w: CASE WHEN w IN ({anchors}) THEN '' ELSE w END) AS cs FROM {name}_w),
{name}_s AS (
  SELECT doc_id, t, list_filter(list_transform(range(1, len(cs) + 1), lambda i: CASE WHEN cs[i] = '' AND len(list_filter(cs[i + 1:i + {reach}], lambda x: x <> '')) > 0
    THEN ws[i] || ' ' || array_to_string(list_filter(cs[i + 1:i + {reach}], lambda x: x <> '')[1:{chain}], ' ') END), lambda s: s IS NOT NULL) AS spots
  FROM {name}_c),
{name} AS (
  SELECT doc_id, CASE WHEN len(spots) > 0 THEN list_sort(list_distinct(list_transform(spots, lambda s: md5(s)[1:8]))) ELSE [md5('=' || t)[1:8]] END AS sigs
  FROM {name}_s)"""
_spots = lambda name, text, source: _SPOTS.format(name=name, text=text, source=source, anchors=_ANCHORS, reach=spotsigs.REACH, chain=spotsigs.CHAIN)

SQL["op4_spotsigs"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (
  SELECT doc_id, text, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next, coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id
  FROM d WINDOW o AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, left(text, length(text) - length(text) // 2) || left(next, length(text) // 2) AS edited FROM n),
{_spots("own", "text", "e")},
{_spots("ed", "edited", "e")}
SELECT e.doc_id, length(e.text)::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256,
  array_to_string(own.sigs, '') AS fingerprint, array_to_string(ed.sigs, '') AS edited_fingerprint,
  len(list_intersect(own.sigs, ed.sigs))::DOUBLE / (len(own.sigs) + len(ed.sigs) - len(list_intersect(own.sigs, ed.sigs))) AS near_edited,
  len(list_intersect(own.sigs, nx.sigs))::DOUBLE / (len(own.sigs) + len(nx.sigs) - len(list_intersect(own.sigs, nx.sigs))) AS near_next
FROM e JOIN own USING (doc_id) JOIN ed USING (doc_id) JOIN own nx ON nx.doc_id = e.next_id
"""


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


QUERIES["op10_licenses"] = op10_licenses

_TEMPLATE_ROWS = ", ".join(f"('{name}', '{text}')" for name, text in licenses.TEMPLATES)
_UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL["op10_licenses"] = rf"""
WITH t AS (SELECT license, list_filter(string_split_regex(translate(text, {_UPPER_LOWER}), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM (VALUES {_TEMPLATE_ROWS}) AS v(license, text)),
ts AS (SELECT license, len(ws) AS n, unnest(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) AS shingle FROM t),
tn AS (SELECT license, count(*) AS shingles, CASE WHEN max(n) <= 6 THEN 8 WHEN max(n) <= 12 THEN 16 WHEN max(n) <= 24 THEN 32 WHEN max(n) <= 48 THEN 64 ELSE 128 END AS size FROM ts GROUP BY license),
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_UPPER_LOWER}), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM documents),
ds AS (SELECT doc_id, unnest(range(0, len(ws) - 4)) AS pos, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS shingle FROM d),
hit AS (SELECT doc_id, pos, shingle, license, shingles, size FROM ds JOIN ts USING (shingle) JOIN tn USING (license)),
win AS (SELECT *, unnest(range(0, 4)) AS back FROM hit),
inside AS (SELECT *, (pos // (size // 4) - back) * (size // 4) AS start FROM win),
held AS (
  SELECT doc_id, license, start, count(DISTINCT shingle)::DOUBLE / any_value(shingles) AS containment
  FROM inside WHERE start >= 0 AND pos < start + size - 4 GROUP BY doc_id, license, start)
SELECT doc_id, license, max(containment) AS containment, min(start)::BIGINT AS first_word, count(*)::BIGINT AS n_windows
FROM held WHERE containment >= 0.8 GROUP BY doc_id, license
"""


def op1_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilter.near_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES["op1_cap_filters"] = op1_cap_filters

SQL["op1_cap_filters"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
u AS (SELECT *, sqrt(list_inner_product(x, x)) AS norm FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_inner_product(a.x, b.x) / (a.norm * b.norm) >= 0.98),
r AS (SELECT a AS id, a AS near FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.near = l.a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.c, e.vec_id) AS component_id, e.vec_id = coalesce(c.c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = e.vec_id LEFT JOIN (SELECT id, min(near) AS c FROM r GROUP BY id) c ON c.id = e.vec_id
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES["op5_quality"] = op5_quality


def op2_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES["op2_fuzzy_lines"] = op2_fuzzy_lines


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES["op8_substrings"] = op8_substrings


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents").select("text", "lang", "source"))


QUERIES["op11_divergence"] = op11_divergence

SQL["op11_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM x),
y AS (SELECT lang, term, sum(n) AS n FROM x GROUP BY ALL),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM y),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT s.lang, s.source, o.source AS item, sum(abs(s.p - o.p)) AS value FROM s JOIN s o ON s.lang = o.lang AND s.term = o.term AND s.source <> o.source GROUP BY ALL) f
  ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
every AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL SELECT s.lang, s.source, 'term', s.term, s.p - l.q FROM s JOIN l USING (lang, term) WHERE s.n > 0 AND s.p > l.q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER r)::INTEGER AS rank FROM every
WINDOW r AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER r <= 50
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks_path(), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES["op12_alignment"] = op12_alignment


def op13_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op13_ppm"] = op13_ppm
