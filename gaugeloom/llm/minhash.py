"""MinHash near-duplicates by min-max hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeloom.llm.components import link
from gaugeloom.llm.scratch import save
from gaugeloom.llm.shingles import mix, shingle_sets, text_chunks

#: 64 multiply-add hashes; both the least and the greatest value of each are kept: 128 values.
HASHES, BANDS, ROWS = 64, 25, 5
#: Bits in which the 512-bit sketches (4 bits a value) of two linked sets may differ. At a similarity of 0.85 the mean is 38 with a deviation of about 9.
SKETCH_BITS = 84
#: Finer sketches, of 512 further hashes and 2 bits a value, for sets whose buckets the first pass leaves open: mean 154, deviation about 14.
FINE_HASHES, FINE_BITS = 512, 233
#: Odd sketches: the parity of a set's elements in each of so many cells. Two of them differ in no more cells than the sets in elements.
ODD_CELLS = 2048
#: Candidates' texts are picked out by a broadcast of their ids; more ids than this are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_rng = np.random.Generator(np.random.PCG64(7))
_A = (_rng.integers(0, 2**63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_FINE_A = (_rng.integers(0, 2**63, FINE_HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_FINE_B = _rng.integers(0, 2**63, FINE_HASHES, dtype=np.uint64)
_BAND = np.arange(BANDS, dtype=np.uint64)
_PLACES = _rng.integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)
_SUM2 = np.uint64(0xD6E8FEB86659FD93)
SKETCH = [f"s{i}" for i in range(8)]
FINE = [f"f{i}" for i in range(32)]
ODD = [f"o{i}" for i in range(ODD_CELLS // 64)]


def min_max(hashes: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    """Least and greatest value of each hash function over a non-empty set, interleaved: one evaluation gives two values."""
    low, high = np.full(len(a), 2**64 - 1, np.uint64), np.zeros(len(a), np.uint64)
    step = max(1, 131_072 // len(a))
    for i in range(0, len(hashes), step):
        h = a[:, None] * hashes[None, i : i + step] + b[:, None]
        np.minimum(low, h.min(1), out=low)
        np.maximum(high, h.max(1), out=high)
    return np.stack([low, high], 1).ravel()


def bands_of(values: np.ndarray) -> np.ndarray:
    """One key for each band of ROWS values; keys of different bands differ."""
    return mix((mix(values[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)) * _PLACES).sum(2) + _BAND)


def sketches_of(values: np.ndarray, bits: int = 4) -> np.ndarray:
    """Some bits of each value, packed into 64-bit words a set."""
    each = 64 // bits
    top = mix(values).reshape(len(values), -1, each) >> np.uint64(64 - bits)
    return (top << (np.arange(each, dtype=np.uint64) * np.uint64(bits))).sum(2, dtype=np.uint64)


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """The parity of a set's elements in each of ODD_CELLS cells, packed into 64-bit words."""
    odd = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % ODD_CELLS, minlength=ODD_CELLS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


_SCHEMA = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, " + ", ".join(f"{s} long" for s in (*SKETCH, *ODD))


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for s, e, texts in text_chunks(batch, 1):
            sets = list(shingle_sets(texts))
            values = np.stack([min_max(x) if len(x) else np.zeros(2 * HASHES, np.uint64) for x in sets])
            sums = np.array([(x.sum(dtype=np.uint64), mix(x * _SUM2).sum(dtype=np.uint64)) for x in sets], np.uint64).reshape(-1, 2)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(e - s + 1, dtype=np.int32) * BANDS), _signed(bands_of(values).ravel()))
            words = np.concatenate([sketches_of(values), np.stack([odd_sketch(x) for x in sets])], 1)
            yield pa.RecordBatch.from_arrays([ids.slice(s, e - s), pa.array([len(x) for x in sets], pa.int64()), _signed(sums[:, 0]), _signed(sums[:, 1]), bands, *(_signed(words[:, i]) for i in range(words.shape[1]))], names=["doc_id", "n_shingles", "set_a", "set_b", "bands", *SKETCH, *ODD])


def signatures(docs: DataFrame) -> DataFrame:
    """For each row (doc_id, text): set size, a 128-bit hash of the set, band keys and the sketches."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_signatures, _SCHEMA)


def _near(percent: int):
    """No linked pair breaks this: sketches differ in few bits, and the shingles that only one set has, or that odd sketches tell apart, are few enough."""

    def near(p: str, q: str) -> Column:
        bits, odd, fine = (sum((F.bit_count(F.col(f"{p}.{s}").bitwiseXOR(F.col(f"{q}.{s}"))) for s in words), F.lit(0)) for words in (SKETCH, ODD, FINE))
        most = (F.col(f"{p}.n") + F.col(f"{q}.n")) * (100 - percent)  # of |A ^ B| * (100 + percent), where A and B are linked
        apart = (F.col(f"{p}.own") + F.col(f"{q}.own")) * (100 + percent) <= most
        return apart & (bits <= SKETCH_BITS) & (odd * (100 + percent) <= most) & (fine <= FINE_BITS)

    return near


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s, e, texts in text_chunks(batch, 1):
            values = np.stack([min_max(x, _FINE_A, _FINE_B) if len(x) else np.zeros(2 * FINE_HASHES, np.uint64) for x in shingle_sets(texts)])
            words = sketches_of(values, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), *(_signed(words[:, i]) for i in range(32))], names=["id", *FINE])


def _all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s, e, texts in text_chunks(batch, 1):
            sets = list(shingle_sets(texts))
            ids = np.repeat(np.asarray(batch.column(0))[s:e], [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _signed(np.concatenate(sets))], names=["id", "shingle"])


def _similar(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for _, _, a, b in text_chunks(batch, 2, 3):
                for x, y in zip(shingle_sets(a), shingle_sets(b), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                    keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column(0), batch.column(1))], names=["a", "b"])

    return check


def _numbered(classes: DataFrame, sigs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Classes with a number of their own each; and the doc_ids that several sets share, None where there is none.

    A class's number is its least doc_id. Where that is another class's too, all but the one of the least set take numbers
    below all doc_ids; ``least`` is the doc_id then.
    """
    sets = sigs.where("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "set_a", "set_b")
    least = F.struct("n_shingles", "set_a", "set_b")
    repeated = save(sets.groupBy("doc_id").agg((F.min(least) != F.max(least)).alias("_several")).where("_several").select("doc_id"))
    if not repeated.count():
        return classes, None
    order = W.partitionBy("id").orderBy("n_shingles", "set_a", "set_b")  # the texts of one doc_id
    nth = classes.join(repeated, classes.id == repeated.doc_id, "left_semi").select("n_shingles", "set_a", "set_b", "id", F.row_number().over(order).alias("_nth")).where("_nth > 1")
    floor = sets.agg(F.min("doc_id")).first()[0]
    # numbers in the order of a saved table: no two alike, and the same in each run of a task
    moved = save(nth.select("n_shingles", "set_a", "set_b", (F.lit(floor) - 1 - F.monotonically_increasing_id()).alias("_id")))
    return save(classes.join(moved, ["n_shingles", "set_a", "set_b"], "left").withColumn("least", F.col("id")).withColumn("id", F.coalesce("_id", "id")).drop("_id")), repeated


def _texts(docs: DataFrame, sigs: DataFrame, classes: DataFrame, members: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """(doc_id, text): a text of each class of ``members``, under the class's number."""
    if repeated is None:
        return docs.join(members, docs.doc_id == members.id, "left_semi").dropDuplicates(["doc_id"])
    single = docs.join(repeated, "doc_id", "left_anti").join(members, docs.doc_id == members.id, "left_semi").dropDuplicates(["doc_id"])
    # of a doc_id with several sets, the text tells the class; these rows are looked at once more
    some = save(docs.join(repeated, "doc_id", "left_semi").withColumn("row", F.monotonically_increasing_id()))
    own = signatures(some.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "n_shingles", "set_a", "set_b").join(some, "row")
    of = classes.select("id", "least", "n_shingles", "set_a", "set_b")
    own = own.join(of, ["n_shingles", "set_a", "set_b"]).where("doc_id = least").select(F.col("id").alias("doc_id"), "text")
    return single.unionByName(own.join(members, own.doc_id == members.id, "left_semi").dropDuplicates(["doc_id"]))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts are linked when 100 * |A ∩ B| >= percent * |A ∪ B| for their sets of five-word shingles
    (A-Z lower-cased; fewer words: the whole sequence). Equal sets are one class from the start, so any
    number of copies costs one row. Classes meet in bands of min-max values; a pair at 0.85 misses all 25
    bands with probability 4e-7. Candidates are confirmed on the sets of the whole texts.
    Null, empty and blank texts have no shingles and are their own components. Rows that repeat a doc_id
    give one row each, and each text links for itself: rows with one doc_id can stand in different components. Rows without doc_id link nothing, have a null component_id and are kept.
    An empty table gives an empty result. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sigs = save(signatures(docs))
    classes = sigs.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), *(F.first(s).alias(s) for s in (*SKETCH, *ODD)))
    classes, repeated = _numbered(save(classes), sigs)
    keyed = classes.select(F.explode("bands").alias("key"), "id")
    shared = keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key")
    rows = save(keyed.join(shared, "key"))
    members = save(rows.select("id").distinct())
    members = F.broadcast(members) if members.count() <= BROADCAST_IDS else members
    nodes = classes.select("id", F.col("n_shingles").alias("n"), F.lit(0).cast("long").alias("own"), *SKETCH, *ODD, *(F.lit(0).cast("long").alias(f) for f in FINE))
    texts = save(_texts(docs, sigs, classes, members, repeated))

    def verify(pairs: DataFrame) -> DataFrame:
        a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_similar(percent), "a long, b long")

    def refine(ids: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Count the shingles that no other of ``ids`` has: they lie in the symmetric difference of every pair of theirs."""
        own_texts = texts.join(ids, F.col("doc_id") == F.col("id"), "left_semi").select("doc_id", "text")
        fine = own_texts.mapInArrow(_fine, "id long, " + ", ".join(f"{f} long" for f in FINE))
        each = own_texts.mapInArrow(_all_shingles, "id long, shingle long")
        once = each.groupBy("shingle").agg(F.count("*").alias("df"), F.min("id").alias("id")).where("df = 1")
        own = save(once.groupBy("id").agg(F.count("*").alias("found")))
        nodes = nodes.select("id", "n", *SKETCH, *ODD).join(fine, "id").join(own, "id", "left")
        nodes = save(nodes.withColumn("own", F.coalesce("found", F.lit(0)).cast("long")).drop("found"))
        # |A | B| <= |A| / percent for a linked pair, so its difference is at most (100 - percent) / percent of |A|
        return nodes, nodes.where(F.col("own") * percent > F.col("n") * (100 - percent)).select("id")

    comps = link(rows, nodes, _near(percent), verify, refine)
    if repeated is not None:  # components by the least doc_id, whatever the numbers of their classes
        of = comps.join(classes.select("id", "least"), "id")
        comps = comps.join(of.groupBy("comp").agg(F.min("least").alias("_least")), "comp").select("id", F.col("_least").alias("comp"))
        classes = classes.withColumn("own", F.col("least"))
    else:
        classes = classes.withColumn("own", F.col("id"))
    of_class = classes.select("n_shingles", "set_a", "set_b", "id", "own").join(comps, "id", "left").select("n_shingles", "set_a", "set_b", F.coalesce("comp", "own").alias("component_id"))
    out = sigs.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_a")).alias("set_a"), "set_b").join(of_class, ["n_shingles", "set_a", "set_b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
