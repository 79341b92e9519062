"""Connected components, and linking within buckets without listing all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeloom.llm.scratch import drop, save


#: A vertex is a hub with over one in so many of the rows; so there are fewer hubs than that.
HUBS = 500


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (id, comp) for every id in ``edges`` (a, b: long): comp is the smallest id reachable from it.

    Alternates large-star and small-star steps, each a minimum per vertex (combined before the shuffle)
    joined back on the vertex. Vertices with over a HUBS-th of all rows, of which there are fewer than HUBS, have
    their minimum broadcast, so that one with very many neighbours never needs them in one task.
    """
    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        if _settled(now):
            break
        n = now.count()
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        step = _with_least(both.where("b > a"), least, 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = step.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _with_least(step, low, n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = save(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        drop(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(now.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())


def _with_least(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``rows`` (a, b) with m of ``least`` (a, m, n), where n counts the rows of a among ``total``."""
    hubs = least.where(F.col("n") * HUBS > total)
    held = rows.join(F.broadcast(hubs.select("a", F.col("m").alias("hub_m"))), "a", "left")
    rest = held.where("hub_m is null").select("a", "b").join(least.where(F.col("n") * HUBS <= total).select("a", "m"), "a")
    return held.where("hub_m is not null").select("a", "b", F.col("hub_m").alias("m")).union(rest.select("a", "b", "m"))


def _settled(edges: DataFrame) -> bool:
    """Whether every id has one edge to a smaller one, which has none: all point at the least of their component."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, comp) of those of ``comps`` and further ``links`` (a, b); only components that a link touches are gone through again."""
    of = lambda c: comps.select(F.col("id").alias(c), F.col("comp").alias(f"of_{c}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    after = save(components(ends))
    old = comps.join(after.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    return old.union(after.join(comps.select("id"), "id", "left_anti"))


#: Pivots that a bucket offers in each pass; None: all that are left.
PASSES = (1, 16, None)
#: Pivots of the last pass from which a bucket is crowded; pivots or members that a block of such a bucket has on average at most.
CROWDED, BLOCK = 32, 96


def _blocks(live: DataFrame) -> DataFrame:
    """Rows (key, i, j, id, comp, main, pivot) of crowded buckets (key, id, comp, main, n members, f of them pivots): block i of a
    bucket's pivots beside block j of its members, so that each pivot meets each member in one pair of blocks."""
    many = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    block = lambda n: F.pmod(F.xxhash64("id"), many(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), many(n) - 1))
    pivots = live.where("comp <> main").select("key", block("f").alias("i"), every("n").alias("j"), "id", "comp", "main", F.lit(True).alias("pivot"))
    return pivots.union(live.select("key", every("f").alias("i"), block("n").alias("j"), "id", "comp", "main", F.lit(False).alias("pivot")))


def link(
    rows: DataFrame,
    nodes: DataFrame,
    near: Callable[[str, str], Column],
    verify: Callable[[DataFrame], DataFrame],
    refine: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None,
    crowded: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Components (id, comp) of the verified links between ids that share a bucket.

    rows: (key, id), the buckets with two ids or more. nodes: one row per id, whatever ``near`` needs.
    near(p, q): a cheap native condition on the columns of aliases p and q that no true link violates.
    verify: (a, b) pairs to the pairs that are links.
    refine: called once, after the first pass, with the ids of buckets that aren't settled and ``nodes``; gives
    nodes on which ``near`` can tell more, and the ids that can be linked with no other.
    crowded: compares the buckets that still have over CROWDED pivots in the last pass, without a row for each pair. It gets
    :func:`_blocks` and each id's keys, and gives the links (a, b) of pivots and other members of the same key, i and j that
    join all their components; a pair counts in the least key of both.

    In each pass every bucket offers some pivots outside its largest component; they are compared with the
    bucket's members of other components. Pairs inside one component need no look, so the first passes join
    most of a bucket of close copies by few comparisons. A bucket with one member outside the largest component needs no
    further pass. In the last pass all members outside the largest
    component are pivots: then each pair of the bucket was compared or lies in one component.
    """
    spark = rows.sparkSession
    left = rows = save(rows)
    comps = spark.createDataFrame([], "id long, comp long")
    seen = spark.createDataFrame([], "a long, b long")
    for pivots_each in PASSES:
        first = pivots_each == PASSES[0]
        held = rows.withColumn("comp", F.col("id")) if first else rows.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        if first:  # all components are single ids
            main = held.groupBy("key").agg(F.max("id").alias("main"), (F.count("*") - 1).alias("f"))
        else:
            sizes = held.groupBy("key", "comp").agg(F.count("*").alias("n"))
            main = sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("f")).where("parts > 1").drop("parts")
        live = save(held.join(main, "key"))
        if live.isEmpty():
            break
        own, dense = live, None
        if pivots_each is None:
            keys = live.groupBy("id").agg(F.collect_set("key").alias("keys"))  # as many as an id has bands
            full = live.where(F.col("f") > CROWDED)
            if crowded is not None and not full.isEmpty():
                dense = save(crowded(_blocks(full).join(keys, "id")))
                own = live.where(F.col("f") <= CROWDED)
        free = own.where("comp <> main")
        if pivots_each is None:
            pivots = free.select("key", "id", "comp")
        else:
            part = F.pmod(F.xxhash64("id"), F.lit(pivots_each))
            pivots = free.groupBy("key", part.alias("part")).agg(F.min_by(F.struct("id", "comp"), F.xxhash64("id", "key")).alias("p")).select("key", "p.id", "p.comp")
        told = nodes
        if pivots_each is None:  # a pair is made once: in the least bucket of both, and there not in both orders
            told = nodes.join(keys, "id")
            once = (F.array_min(F.array_intersect("p.keys", "q.keys")) == F.col("p.key")) & ((F.col("comp") == F.col("main")) | (F.col("p_id") < F.col("q.id")))
        p = pivots.withColumnRenamed("comp", "p_comp").join(told, "id").withColumnRenamed("id", "p_id").alias("p")
        q = own.select("key", "id", "comp", "main").join(told, "id").alias("q")
        on = (F.col("p.key") == F.col("q.key")) & (F.col("p_comp") != F.col("comp")) & near("p", "q")
        pairs = p.join(q, on if pivots_each is not None else on & once)
        pairs = pairs.select(F.least("p_id", F.col("q.id")).alias("a"), F.greatest("p_id", F.col("q.id")).alias("b")).distinct()
        pairs = save(pairs if first else pairs.join(seen, ["a", "b"], "left_anti"))
        good = verify(pairs)
        good = save(good if dense is None else good.union(dense))
        if not good.isEmpty():
            comps = save(components(good) if first else merged(comps, good))
        # a bucket is settled for good when its only member outside the largest component was a pivot
        rows = live.where("f > 1").select("key", "id")
        if first and refine is not None:
            nodes, alone = refine(rows.select("id").distinct(), nodes)
            rows = save(rows.join(alone, "id", "left_anti"))
            drop(live)
            live = rows
        drop(left)
        left = live
        seen = seen.union(pairs)
    drop(left)
    return comps
