"""Document fingerprints by spot signatures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Very common words of English, French, German and Spanish, at which signatures are anchored.
ANCHORS = """
the of and to in is it that for on with as was by at this are be from or an not have which
le la les de des du et un une en que qui dans pour par sur au est ne pas ce il elle
der die das und ist ein eine nicht mit von zu den auf im dem sich des auch es an
el los las del y con para no se su al lo como una por más
""".split()
#: Content words in a chain, and the words after an anchor among which they are looked for.
CHAIN, REACH = 3, 8


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def signatures(text: Column) -> Column:
    """The sorted set of spot signatures of a text: 8 hex digits of the MD5 of an anchor and the content words after it.

    Words are runs of letters and digits in lower case. Each anchor is followed by a chain of the next CHAIN
    words that aren't anchors, of the REACH words after it (fewer where those hold fewer; none: no signature).
    A text without a signature has one of its whole content, so that unlike texts without anchors stay unlike.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    content = lambda ws: F.transform(ws, lambda w: F.when(w.isin(ANCHORS), F.lit("")).otherwise(w))

    def chain(ws: Column, cs: Column) -> Column:
        def at(c: Column, i: Column) -> Column:
            after = F.slice(F.filter(F.slice(cs, i + 2, REACH), lambda x: x != ""), 1, CHAIN)
            return F.when(c == "", F.when(F.size(after) > 0, F.concat(F.get(ws, i), F.lit(" "), F.array_join(after, " "))))

        return F.filter(F.transform(cs, at), lambda s: s.isNotNull())

    spots = let(words, lambda ws: let(content(ws), lambda cs: chain(ws, cs)))
    hashes = F.sort_array(F.array_distinct(F.transform(spots, lambda s: F.substring(F.md5(s), 1, 8))))
    return let(hashes, lambda h: F.when(F.size(h) > 0, h).otherwise(F.array(F.substring(F.md5(F.concat(F.lit("="), text)), 1, 8))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets."""
    return let(F.size(F.array_intersect(a, b)).cast("double"), lambda both: both / (F.size(a) + F.size(b) - both))


def edited(text: Column, donor: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the donor's first as many, or all of the donor."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(donor, F.lit(1), half))


#: Ranges of ids that rows are dealt to, at most; as many again for rows without one.
RANGES = 4096


def _nth(place: Column, at: list[int]) -> Column:
    """How many of the rising numbers ``at`` the place comes up to, by halving steps."""
    held, steps = F.lit(at), F.array(*(F.lit(2**i) for i in range(len(at).bit_length() - 1, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(F.coalesce(F.get(held, n + step - 1) <= place, F.lit(False)), step).otherwise(0))


def in_ranges(docs: DataFrame, least: int = 64) -> DataFrame:
    """``docs`` with place (doc_id; a hash of the text without one), placeless (whether there is no doc_id) and range.

    Ranges rise with (not placeless, place). They are cut at quantiles of the places, so they hold about as many
    rows each however the ids lie; rows of one place share a range. Only the cuts, up to RANGES, come to the driver.
    """
    docs = docs.withColumn("placeless", F.col("doc_id").isNull()).withColumn("place", F.coalesce("doc_id", F.xxhash64("text")))
    k = max(1, min(RANGES, docs.count() // least))
    shares = [i / k for i in range(1, k)] or [0.5]
    cuts = docs.groupBy("placeless").agg(F.percentile_approx("place", shares, 4 * RANGES).alias("cuts")).collect()  # two rows
    number = F.lit(0)
    for placeless, at in cuts:
        number = F.when(F.col("placeless") == placeless, _nth(F.col("place"), at) + (0 if placeless else 2 * RANGES)).otherwise(number)
    return docs.withColumn("range", number)


def with_next(docs: DataFrame, least: int = 64) -> DataFrame:
    """(doc_id, text, range, place, donor): rows dealt by ranges of doc_id, and into each range, marked donor, a copy of
    the row that comes next after its last one by descending doc_id (after the very last: the first).

    Only the heads of the ranges are put in one order, not the rows; their number is bounded.
    """
    docs = in_ranges(docs, least)
    heads = docs.groupBy("range", "placeless").agg(F.max("place").alias("head"))
    down = W.orderBy(F.col("range").desc())  # at most 2 * RANGES rows
    first = F.first("head").over(W.orderBy(F.col("range").desc()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    first_placeless = F.first("placeless").over(W.orderBy(F.col("range").desc()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    gives = heads.select(F.coalesce(F.lead("head").over(down), first).alias("place"), F.coalesce(F.lead("placeless").over(down), first_placeless).alias("placeless"), F.col("range").alias("to"))
    donors = docs.drop("range").join(F.broadcast(gives), ["place", "placeless"]).withColumnRenamed("to", "range")
    return docs.withColumn("donor", F.lit(False)).unionByName(donors.withColumn("donor", F.lit(True)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A fingerprint is the whole set of a text's spot signatures, as one string; the likeness of two is the
    Jaccard similarity of the sets. The edited text takes its second half from the next row by descending
    doc_id (after the last: the first; a lone row: itself). Null text is empty. Rows that repeat a doc_id
    follow each other by text; rows without one come last, by a hash of the text. An empty table gives an empty result. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = with_next(docs)
    order = W.partitionBy("range").orderBy("donor", F.col("place").desc(), "text")
    dealt = dealt.withColumn("_next", F.lead("text").over(order)).withColumn("_sigs", signatures(F.col("text")))
    dealt = dealt.withColumn("_next_sigs", F.lead("_sigs").over(order)).where("not donor")
    dealt = dealt.withColumn("_edited", edited(F.col("text"), F.col("_next"))).withColumn("_edited_sigs", signatures(F.col("_edited")))
    return dealt.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        F.array_join("_sigs", "").alias("fingerprint"),
        F.array_join("_edited_sigs", "").alias("edited_fingerprint"),
        likeness(F.col("_sigs"), F.col("_edited_sigs")).alias("near_edited"),
        likeness(F.col("_sigs"), F.col("_next_sigs")).alias("near_next"),
    )


def _part(size: Column, threshold: float) -> Column:
    """Number of the length partition: bounds grow by 1 / threshold, so linked sets lie in the same or in neighbouring ones."""
    return F.floor(F.log(size) / -math.log(threshold)).cast("int")


def similar_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b, similarity), a < b, of class representatives whose signature sets have a Jaccard similarity of
    ``threshold`` or more, and (id, class_id) membership is given by :func:`classes`.

    Sets are partitioned by length. A pair is compared where it shares one of the first signatures, in the order
    of rising frequency, that a similar pair must share; sizes that differ too much are passed over.
    """
    sets = classes(docs).where("id = class_id").select("id", "sigs")
    each = sets.select("id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    often = each.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")
    rare_first = each.join(often, "sig")
    rank = F.row_number().over(W.partitionBy("id").orderBy("df", "sig"))
    alone = F.col("n") - F.count("*").over(W.partitionBy("id"))
    prefix = rare_first.withColumn("nth", rank + alone).where(F.col("nth") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    part = _part(F.col("n"), threshold)
    a = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "sig", part.alias("part"))
    b = prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "sig", F.explode(F.array(part - 1, part, part + 1)).alias("part"))
    sizes = (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9) & (F.col("a") < F.col("b"))
    pairs = a.join(b, ["sig", "part"]).where(sizes).select("a", "b").distinct()
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("sigs").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("sigs").alias("sb")), "b")
    return full.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= threshold)


def classes(docs: DataFrame) -> DataFrame:
    """(id, class_id, sigs): documents with equal signature sets are one class, named by its least doc_id."""
    sigs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), signatures(F.coalesce(F.col("text"), F.lit(""))).alias("sigs"))
    return sigs.withColumn("class_id", F.min("id").over(W.partitionBy(F.xxhash64("sigs"), F.size("sigs"))))
