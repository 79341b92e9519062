"""Source divergence audit: how far the term frequencies of a language's sources lie apart.

Shards by language and term are counted and compared by DuckDB inside Spark's tasks; Spark deals them out, adds what
they give and ranks it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeloom.llm.scratch import drop, save

#: A term is a run of ASCII letters and characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that a kept term is in at least; added to each count; the whole of a distribution.
LEAST_DOCS, ADDED, WHOLE = 30, 5, 1_000_000_000
#: Ranks of terms that are listed.
TOP = 50
#: Rows of counts that a shard holds about; DuckDB takes about 2 kB for each while it compares.
SHARD_ROWS = 50_000

_COUNT = rf"""
SELECT lang, source, term, sum(n)::BIGINT AS n, count(*)::BIGINT AS docs
FROM (
  SELECT doc, lang, source, term, count(*) AS n
  FROM (
    SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
    FROM (SELECT row_number() OVER () AS doc, lang, source, text FROM given))
  GROUP BY ALL)
GROUP BY ALL
"""

#: Of a shard's terms those in enough documents of their language; one row of each term counts it.
_KEEP = """
SELECT lang, source, term, sum(n)::BIGINT AS n, (row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1)::BIGINT AS first
FROM given GROUP BY lang, source, term QUALIFY sum(sum(docs)) OVER (PARTITION BY lang, term) >= {least}
"""

#: One shard: counts of its terms (kind 't'), and all groups of all languages with their totals (kind 'g').
_COMPARE = """
WITH g AS MATERIALIZED (SELECT row_number() OVER ()::INTEGER AS id, lang, source, n, v FROM given WHERE kind = 'g'),
l AS (SELECT lang, sum(n) AS n, any_value(v) AS v FROM g GROUP BY lang),
t AS MATERIALIZED (SELECT row_number() OVER ()::INTEGER AS tid, lang, term, sum(n) AS n FROM given WHERE kind = 't' GROUP BY lang, term),
p AS MATERIALIZED (
  SELECT t.tid, g.id, share(c.n, g.n, g.v) AS p FROM given c JOIN g ON g.lang = c.lang AND g.source = c.source JOIN t ON t.lang = c.lang AND t.term = c.term WHERE c.kind = 't'),
q AS (SELECT t.tid, t.term, share(t.n, l.n, l.v) AS q FROM t JOIN l ON l.lang = t.lang),
held AS (SELECT lang, count(*) AS terms FROM t GROUP BY lang),
z AS MATERIALIZED (
  SELECT a.id, b.id AS other, share(0, a.n, a.v) AS own, share(0, b.n, b.v) AS its, held.terms FROM g a JOIN g b ON a.lang = b.lang AND a.id <> b.id JOIN held ON held.lang = a.lang),
-- terms that both lack differ by the same amount; a term that one of them has puts its own difference in the place of that
apart AS (
  SELECT id, other, terms * abs(own - its) AS value FROM z WHERE id < other
  UNION ALL
  SELECT least(p.id, z.other), greatest(p.id, z.other), abs(p.p - coalesce(o.p, z.its)) - abs(z.own - z.its)
  FROM p JOIN z ON z.id = p.id LEFT JOIN p o ON o.tid = p.tid AND o.id = z.other WHERE o.p IS NULL OR p.id < z.other),
pair AS (SELECT id, other, sum(value)::BIGINT AS value FROM apart GROUP BY id, other),
top AS (
  SELECT p.id, q.term AS item, p.p - q.q AS value FROM p JOIN q ON q.tid = p.tid WHERE p.p > q.q
  QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY value DESC, item) <= {top})
SELECT a.lang, least(a.source, b.source) AS source, 'pair' AS part, greatest(a.source, b.source) AS item, pair.value FROM pair JOIN g a ON a.id = pair.id JOIN g b ON b.id = pair.other
UNION ALL SELECT g.lang, g.source, 'term', top.item, top.value FROM top JOIN g ON g.id = top.id
"""


def _query(sql: str, given: pa.Table, names: list[str]) -> pa.Table:
    """The rows of one query over ``given``, by one thread and within memory."""
    import duckdb

    with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as db:
        db.execute(f"CREATE MACRO share(n, total, terms) AS (1 + ({WHOLE}::HUGEINT * (n + {ADDED})) // (total + {ADDED}::HUGEINT * terms))::BIGINT")
        db.register("given", given)
        return db.sql(sql).to_arrow_table().select(names)


def _shards(rows: DataFrame, sql: str, schema: str, whole: bool) -> DataFrame:
    """``sql`` over each batch of rows, or over each whole partition."""
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in [list(batches)] if whole else ([b] for b in batches):
            if part:
                yield from _query(sql, pa.Table.from_batches(part), names).to_batches(max_chunksize=100_000)

    return rows.mapInArrow(work, schema)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, not yet added up over batches of documents."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return _shards(docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").alias("text")), _COUNT, "lang string, source string, term string, n long, docs long", False)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """docs: (text, lang, source, ...). Rows (lang, source, part, item, value, rank) of each language's sources.

    Part 'pair': the other sources of the language by how far the two distributions over kept terms lie apart, all
    of them. Part 'term': kept terms that a source has and of which its share is above the language's, ``top`` of them.
    Shares are whole numbers, so all sums are exact. Ranks run from 1 by falling value, then by item.

    Null lang, source and text are empty; an empty lang or source is one like others. A source without terms is
    compared too; in a language without kept terms all pairs have the value 0. A language of one source has no pairs.
    Repeated rows count each. Other columns are passed over, whatever their names. An empty table gives an empty result.

    Tasks hold a batch of documents, a shuffle partition of counts, or a shard. A shard has about ``shard_rows`` counts, or as
    many as there are pairs of sources, so that the partial sums are no more than the counts. Of a frequent term there is
    a row a source from each batch at most.
    """
    kept = save(_shards(term_counts(docs).repartition("lang", "term"), _KEEP.format(least=int(least_docs)), "lang string, source string, term string, n long, first long", True))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(text("lang"), text("source")).distinct()
    total = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("first"))
    known = groups.join(total, ["lang", "source"], "left").na.fill(0, ["n", "first"])
    terms = F.sum("first").over(W.partitionBy("lang"))  # a row a source
    groups = save(known.select("lang", "source", "n", terms.alias("v")))
    rows = kept.count()
    pairs = groups.groupBy("lang").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("n")).first()["n"] or 0
    shards = max(1, -(-rows // max(shard_rows, pairs)))
    counted = kept.select(F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int").alias("shard"), F.lit("t").alias("kind"), "lang", "source", "term", "n", F.lit(0).cast("long").alias("v"))
    everywhere = groups.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit("g").alias("kind"), "lang", "source", F.lit("").alias("term"), "n", "v")
    sql, names = _COMPARE.format(top=int(top)), ["lang", "source", "part", "item", "value"]
    parts = counted.unionByName(everywhere).groupBy("shard").applyInArrow(lambda given: _query(sql, given, names), "lang string, source string, part string, item string, value long")
    parts = save(parts)
    drop(kept)
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    nth = F.row_number().over(order).alias("rank")
    a, b = groups.select("lang", "source"), groups.select("lang", F.col("source").alias("item"))
    apart = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    apart = apart.unionByName(apart.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    every = a.join(b, "lang").where("source <> item").join(apart, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    leading = parts.where("part = 'term'").select(*names, nth).where(F.col("rank") <= top)
    return every.select(*names, nth).unionByName(leading)
