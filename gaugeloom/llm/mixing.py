"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeloom.llm.scratch import save

#: Tables with a row a source are broadcast up to so many sources.
BROADCAST_SOURCES = 100_000
#: A word is a run of bytes that aren't ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: str) -> Column:
    """A document's random place, the same in every run; rows that repeat a doc_id share it."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """sizes: (source, source_size), a row a source. Adds target: weights repeat over the sources by code point,
    null last; the sources share ``share`` times all words by weight; none gets over ``most`` times its own words,
    and what is over is shared again by weight.

    That ends at min(cap, level * weight) for one level for all. By cap / weight, sources are full up to some
    place, and the level is what is left there over the weight left.
    """
    at = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))  # one row a source
    with_weight = sizes.withColumn("_w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (at - 1) % len(weights) + 1)).withColumn("_cap", most * F.col("source_size"))
    full = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    before = F.sum("_cap").over(full) - F.col("_cap")
    left = F.sum("_w").over(everything) - F.sum("_w").over(full) + F.col("_w")
    with_level = with_weight.withColumn("_level", (share * F.sum("source_size").over(everything) - before) / left)
    level = F.max(F.when(F.col("_cap") / F.col("_w") > F.col("_level"), F.col("_level"))).over(everything)
    return with_level.withColumn("_at", level).withColumn("target", F.least("_cap", F.coalesce(F.col("_at") * F.col("_w"), F.lit(0.0)))).drop("_w", "_cap", "_level", "_at")


def cuts(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "0", rows_per_range: int = 5000) -> DataFrame:
    """A row for each source: source, source_size, target, epochs, cut_key, cut_words.

    Every document of a source is taken ``epochs`` times whole; then those of a smaller key once more, and
    ``cut_words`` words of each document at ``cut_key``, so that the source comes to its rounded target.
    Keys are hashes, so a source's key ranges hold alike many rows: a hot source gets more ranges.
    """
    d = save(docs.select("source", n_words(F.col("text")).alias("size"), order_key(seed).alias("key")))
    per = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = F.round("target").cast("long")
    per = save(targets(per, weights, share, most).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0)).withColumn("rest", goal - F.col("epochs") * F.col("source_size")))
    few = per.count() <= BROADCAST_SOURCES
    small = F.broadcast if few else lambda df: df
    ranges = per.select(F.col("source").alias("s"), F.greatest(F.lit(1), F.ceil(F.col("n") / rows_per_range)).alias("ranges"), "rest")
    u = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2**32
    d = d.join(small(ranges), F.col("source").eqNullSafe(F.col("s"))).withColumn("range", F.floor(u * F.col("ranges")))
    by_range = d.groupBy("source", "rest", "range").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("source").orderBy("range"))
    holds_cut = by_range.withColumn("before", upto - F.col("words")).where("before <= rest and rest < before + words").select(F.col("source").alias("s"), F.col("range").alias("r"), "before")
    inside = d.select("source", "rest", "range", "key", "size").join(small(holds_cut), F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    same = inside.groupBy("source", "rest", "before", "key").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    upto = F.col("before") + F.sum("words").over(W.partitionBy("source").orderBy("key")) - F.col("words")
    cut = same.withColumn("start", upto).where("start <= rest and rest < start + words")
    cut = cut.select(F.col("source").alias("s"), F.col("key").alias("cut_key"), F.floor((F.col("rest") - F.col("start")) / F.col("rows")).alias("cut_words"))
    return save(per.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "epochs", "cut_key", "cut_words"))


def mix(docs: DataFrame, seed: str = "0", **how) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target and taken: how many of its words the mix takes, repeats counted.

    A source's taken words come to its rounded target, less a word for rows that share the cut's doc_id. No
    document gives over twice its size. Null text has no words; null source is a source. Rows without doc_id
    share one key. Columns that have the names of the new ones are replaced, those of any other name stay. Empty tables give empty results.
    """
    new = ["size", "source_size", "target", "taken"]
    names = [c for c in docs.columns if c.lower() not in new]
    plan = cuts(docs.select("doc_id", "text", "source"), seed=seed, **how)
    plan = plan.select(F.struct("*").alias("plan"))
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    # what is there already stays in one column, so that no name can clash
    held = docs.select(F.struct(*(docs[f"`{c}`"] for c in names)).alias("row"), n_words(F.col("text")).alias("size"), order_key(seed).alias("key"), F.col("source").alias("source"))
    out = held.join(plan, F.col("source").eqNullSafe(F.col("plan.source")))
    once = F.when(F.col("key") < F.col("plan.cut_key"), F.col("size")).when(F.col("key") == F.col("plan.cut_key"), F.least("size", "plan.cut_words")).otherwise(0)
    taken = F.col("plan.epochs") * F.col("size") + once
    return out.select(*(F.col("row").getField(c).alias(c) for c in names), "size", "plan.source_size", "plan.target", taken.alias("taken"))


def take(mixed: DataFrame) -> DataFrame:
    """The documents of a mix as rows: each whole copy that was taken, and the first words of a text cut by the budget."""
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, rest), "")
    copies = F.concat(F.array_repeat(F.col("text"), whole), F.when(rest > 0, F.array(head)).otherwise(F.array().cast("array<string>")))
    return mixed.withColumn("text", F.explode(copies))
