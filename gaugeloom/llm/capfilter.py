"""Embedding near-duplicates by spherical-cap filters with structured random product codes."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeloom.llm.components import components
from gaugeloom.llm.scratch import save

#: Filters that a vector exceeds on average; one that exceeds fewer takes as many of its best. At a cosine of 0.98, a pair shares
#: each with a probability of about 0.7.
FILTERS_EACH = 28.0
#: Vectors of one task's cell; a filter with more is compared block by block.
BLOCK = 1024
#: Least and greatest number of code words of a block.
SIZES = (48, 2048)
#: A code is taken if each of so many sample pairs at the threshold shares so many filters.
SAMPLE_PAIRS, LEAST_SHARED = 400, 4


class ProductCode:
    """Filter directions: one of ``size`` unit code words for each of ``parts`` blocks of rotated coordinates.

    The directions' number is size ** parts, but a vector is decoded to all that it exceeds ``level`` on by
    walking the code words of each block in falling order and stopping where even the best rest falls short.
    """

    def __init__(self, dims: int, parts: int, size: int, each: float, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.parts, self.size, self.least = parts, size, max(1, int(each))
        padded = -(-dims // parts) * parts
        self.rotation = np.linalg.qr(rng.standard_normal((padded, padded)))[0][:dims]
        words = rng.standard_normal((parts, size, padded // parts))
        self.words = words / np.linalg.norm(words, axis=2, keepdims=True)
        # the level is where a random vector exceeds ``each`` directions on average
        sample = rng.standard_normal((256, dims))
        scores = self.scores(sample / np.linalg.norm(sample, axis=1, keepdims=True))
        total = scores[:, 0]
        for i in range(1, parts):
            total = (total[:, :, None] + scores[:, i][:, None, :]).reshape(len(sample), -1)
        self.level = float(np.quantile(total, max(0.0, 1 - each / size**parts)))

    def scores(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, parts, size): each block's inner products with its code words."""
        blocks = (unit @ self.rotation).reshape(len(unit), self.parts, -1)
        return np.einsum("npd,psd->nps", blocks, self.words)

    def levels(self, scores: np.ndarray) -> np.ndarray:
        """For each vector the level, or what its ``least`` best directions exceed where that is lower."""
        total = np.zeros((len(scores), 1))
        for i in range(self.parts):
            best = -np.sort(-scores[:, i], axis=1)[:, : self.least]
            total = -np.sort(-(total[:, :, None] + best[:, None, :]).reshape(len(scores), -1), axis=1)[:, : self.least]
        return np.minimum(self.level, total[:, -1] - 1e-12)  # sums in another order differ in the last bits

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each vector the numbers of all directions on which it exceeds the level, and of its ``least`` best ones."""
        out = []
        scores = self.scores(unit)
        levels = np.concatenate([np.zeros(0), *(self.levels(scores[i : i + 1024]) for i in range(0, len(scores), 1024))])
        for s, level in zip(scores, levels, strict=True):
            order = np.argsort(-s, axis=1)
            best = np.take_along_axis(s, order, 1)
            rest = np.append(np.cumsum(best[::-1, 0])[::-1][1:], 0.0)
            totals, numbers = np.zeros(1), np.zeros(1, np.int64)
            for part in range(self.parts):
                keep = [np.searchsorted(-best[part], t + rest[part] - level, side="right") for t in totals]
                totals, numbers = (
                    np.concatenate([t + best[part, :k] for t, k in zip(totals, keep, strict=True)] or [np.zeros(0)]),
                    np.concatenate([n * self.size + order[part, :k] for n, k in zip(numbers, keep, strict=True)] or [np.zeros(0, np.int64)]),
                )
            out.append(np.sort(numbers))
        return out


def code_for(dims: int, n: int, least: float = 0.98, seed: int = 11) -> ProductCode:
    """About as many directions as there are vectors under a label, so that a filter holds few that aren't alike.

    Fewer where the caps would be too narrow for pairs at a cosine of ``least``, as in the plane: a filter then holds more vectors,
    but so many are links there too.
    """
    parts = 2 if dims >= 8 else 1
    size = int(np.clip(np.ceil(max(n, 1) ** (1 / parts)), SIZES[0], SIZES[1]))
    while True:
        code = ProductCode(dims, parts, size, min(FILTERS_EACH, size**parts / 4), seed)
        if size == SIZES[0] or dims < 2 or _shared(code, dims, least, seed).min() >= LEAST_SHARED:
            return code
        size = max(SIZES[0], size * 2 // 3)


def _shared(code: ProductCode, dims: int, least: float, seed: int) -> np.ndarray:
    """For each of some random pairs at a cosine of ``least``, the number of filters that both have."""
    rng = np.random.Generator(np.random.PCG64(seed + 1))
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.standard_normal((2, SAMPLE_PAIRS, dims)))
    b -= (b * a).sum(1, keepdims=True) * a
    b = least * a + np.sqrt(max(0.0, 1 - least * least)) * b / np.linalg.norm(b, axis=1, keepdims=True)
    return np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(code.decode(a), code.decode(b), strict=True)])


def _meets(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the exact cosine, rounded to a double, is ``least`` or more; ``least`` is above 0."""
    p, q = ([Fraction(v) for v in x.tolist()] for x in (a, b))
    dot, pp, qq = (sum(x * y for x, y in zip(u, v, strict=True)) for u, v in ((p, q), (p, p), (q, q)))
    bound = (Fraction(least) + Fraction(float(np.nextafter(least, -1.0)))) / 2
    return dot > 0 and dot * dot >= bound * bound * pp * qq


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of equal labels are linked where their cosine, rounded to a double, is ``least`` or more; pairs are
    candidates where they exceed a common filter direction. Equal vectors of a label are one class from the
    start, linked with each other. Vectors that are null, empty, zero, or hold nulls, NaN or
    infinities, and those without label, link with nothing; those of unequal lengths not with each other. Rows without vec_id neither; they
    have a null component_id and are kept. Of rows that repeat a vec_id each counts as a vector. An empty
    table gives an empty result. Other columns are ignored.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("string").alias("label"))
    sound = F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("x", lambda v: v != 0)
    usable = F.coalesce(sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    rows = vectors.withColumn("usable", usable)
    # rows that repeat a vec_id may be several classes, told apart by number
    classes = save(rows.where("usable").groupBy("label", "x").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).withColumn("number", F.monotonically_increasing_id()))
    spark = vectors.sparkSession
    all_links = spark.createDataFrame([], "number long, id long, other long, n long")
    sizes = classes.groupBy(F.size("x").alias("dims"), "label").agg(F.count("*").alias("n")).groupBy("dims").agg(F.max("n").alias("n"))
    for shape in sizes.orderBy("dims").collect():  # a row for each length of vectors
        own = classes.where(F.size("x") == shape["dims"])
        all_links = all_links.union(save(_links(own, code_for(shape["dims"], shape["n"], least), least)))
    comps = components(all_links.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    n_links = all_links.groupBy("number").agg(F.sum("n").alias("linked"))
    of_class = classes.join(n_links, "number", "left").join(comps, "id", "left")
    of_class = of_class.select("label", "x", F.lit(True).alias("usable"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("comp", "id").alias("component_id"))
    out = rows.join(of_class, ["label", "x", "usable"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _first_reached(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the first row that links lead to from it, itself included."""
    near = linked | np.eye(len(linked), dtype=bool)
    first = near.argmax(1)
    while True:
        first = first[first]
        after = np.where(near, first, len(near)).min(1)
        np.minimum.at(after, first, after.copy())  # what was reached before comes along
        if np.array_equal(after, first):
            return first
        first = after


def _links(classes: DataFrame, code: ProductCode, least: float) -> DataFrame:
    """Rows (number, id, other, n): from one cell, the number of vectors linked with the class, and the least id that links within
    the cell lead to, so that they join all that the cell's links join.

    A cell is a filter, or two blocks of a crowded one. A pair is counted in the least filter that both exceed.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(4)
            dense = np.asarray(x.flatten(), dtype="<f8").reshape(len(x), -1) if len(x) else np.zeros((0, 1))
            # else squares of very large or small numbers leave the range; powers of two change no digit
            dense = np.ldexp(dense, -np.frexp(np.abs(dense).max(1, keepdims=True, initial=0.0))[1])
            filters = code.decode(dense / np.sqrt((dense * dense).sum(1, keepdims=True)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array([v.tobytes() for v in dense], pa.binary()), pa.array([f.tolist() for f in filters], pa.list_(pa.int64()))],
                names=["label", "number", "id", "n", "x", "filters"],
            )

    decoded = classes.select("label", "number", "id", "n", "x").mapInArrow(decode, "label string, number long, id long, n long, x binary, filters array<long>")
    decoded = save(decoded)
    keys = decoded.select("label", "number", F.explode("filters").alias("filter"))
    crowd = keys.groupBy("label", "filter").agg(F.count("*").alias("m")).where("m > 1")
    n_groups = max(1, crowd.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0] // (4 * BLOCK))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    cells = keys.join(crowd, ["label", "filter"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("block", "with"), F.greatest("block", "with")
    # small filters share a task's group; each pair of blocks of a crowded one has its own
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label", "filter"), F.lit(n_groups))).otherwise(F.xxhash64("label", "filter", lo, hi))
    cells = cells.select("number", "filter", "label", "block", lo.alias("lo"), hi.alias("hi"), group.alias("group"), (F.col("blocks") == 1).alias("small"))
    dealt = cells.join(decoded.select("number", "id", "n", "x", "filters"), "number")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.sort_values("id")
        for (_, filter_, lo_, hi_), cell in pdf.groupby(["label", "filter", "lo", "hi"], sort=False):
            if len(cell) < 2:
                continue
            x, ids, n = np.frombuffer(b"".join(cell["x"]), "<f8").reshape(len(cell), -1), cell["id"].to_numpy(), cell["n"].to_numpy()
            block = cell["block"].to_numpy()
            unit = x / np.sqrt((x * x).sum(1, keepdims=True))
            cosine = unit @ unit.T
            linked = cosine >= least
            if least > 0:  # the last digits of those at the threshold depend on the order of sums
                margin = (x.shape[1] + 8) * np.finfo(float).eps
                for i, j in np.argwhere(np.triu(np.abs(cosine - least) <= margin, 1)):
                    linked[i, j] = linked[j, i] = _meets(x[i], x[j], least)
            np.fill_diagonal(linked, False)
            if lo_ != hi_:
                linked &= block[:, None] != block[None, :]
            # a common filter of a lower number counts the pair
            lower = [f[f < filter_] for f in cell["filters"]]
            numbers, at = np.unique(np.concatenate(lower), return_inverse=True)
            has = np.zeros((len(cell), len(numbers)), np.float32)
            has[np.repeat(np.arange(len(cell)), [len(f) for f in lower]), at] = 1
            has = has[:, has.sum(0) > 1]
            linked &= ~(has @ has.T > 0.5)
            some = linked.any(1)
            other = ids[_first_reached(linked)]
            out.append(pd.DataFrame({"number": cell["number"].to_numpy()[some], "id": ids[some], "other": other[some], "n": (linked[some] @ n).astype("int64")}))
        return pd.concat(out) if out else pd.DataFrame({"number": [], "id": [], "other": [], "n": []}, dtype="int64")

    return dealt.groupBy("group", "small").applyInPandas(compare, "number long, id long, other long, n long")
