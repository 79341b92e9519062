"""Packing documents into sequences: Martello-Toth dominance, then best fit."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeloom.llm.scratch import save

#: Above so many rows the plan isn't broadcast; it has a row for each step of the packing, whatever the number of pieces.
PLAN_ROWS = 200_000
#: Characters of a run of blanks, letters, digits or others from which a text is encoded by the slower library.
LONG_RUN = 20_000
_RUN = re.compile(r"\s{%d}|[^\W\d_]{%d}|\d{%d}|[^\w\s]{%d}|_{%d}" % ((LONG_RUN,) * 5))


@lru_cache(maxsize=2)
def encoder(ranks_path: str):
    """Texts to ids by the byte-level BPE of a .tiktoken file of ranks: the ids of the tokenizers file of the same vocabulary.

    Strings that the vocabulary lists as special are their own tokens, as in that file. Texts with a run of over
    LONG_RUN characters of one kind go to that file itself, as the pattern of the other can't take them.
    """
    import base64

    import public_tokenizers
    import tiktoken
    import tokenizers

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    whole = tokenizers.Tokenizer.from_file(str(Path(ranks_path).with_suffix(".json")))
    special = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
    ranks = {token: rank for token, rank in ranks.items() if token.decode("utf-8", "replace") not in special}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        if _RUN.search(text):
            return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4")
        return fast.encode_to_numpy(text, allowed_special="all")

    return encode


def pieces(docs: DataFrame, ranks_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): a document's ids and ``end_id``; only longer ones are cut, the first piece may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), end_id).astype("<u4")
                edges = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                for i, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    for column, value in zip(rows, (doc_id, i, s, e - s, zlib.crc32(ids[s:e].tobytes())), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[int, ...]


def reduce_instance(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Fix the bins that dominate every other choice for one of their items, and take them out of ``counts``.

    For an item, from the longest: alone, if nothing fits beside it; with a partner that fills the bin; or,
    if at most one item fits beside it, with the longest that fits. In each case any other bin with the item
    can be turned into this one by an exchange that needs no further bin. What goes can make more items
    dominated, so it is done again until nothing changes.
    """
    fixed: list[tuple[Pattern, int]] = []

    def take(pattern: Pattern, n: int) -> None:
        fixed.append((pattern, n))
        for item in pattern:
            counts[item] -= n
            if not counts[item]:
                del counts[item]

    changed = True
    while changed:
        changed = False
        for item in sorted(counts, reverse=True):
            while (n := counts.get(item, 0)) > 0:
                least = min(counts)
                if item + least > capacity or (item == least and n == 1 and len(counts) == 1):
                    take((item,), n)
                    changed = True
                    continue
                partner = capacity - item
                if counts.get(partner, 0) < (2 if partner == item else 1):
                    rest = counts | {item: n - 1}
                    small = [x for x in sorted(rest) if rest[x]][:2]
                    two = 2 * small[0] if rest[small[0]] > 1 else sum(small) if len(small) > 1 else capacity
                    if item + two <= capacity:
                        break  # two may fit beside it: not dominated
                    partner = max((x for x in rest if rest[x] and x + item <= capacity), default=0)
                    if not partner:
                        break
                # one pair at a time only where a change of the least items could matter; else all that have partners
                take((item, partner), n // 2 if partner == item else min(n, counts[partner]))
                changed = True
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over item counts: bins with equal contents are handled together."""
    open_bins: dict[int, list[tuple[Pattern, int]]] = {}
    for item in sorted(counts, reverse=True):
        left = counts[item]
        while left:
            room = min((r for r in open_bins if r >= item), default=capacity)
            pattern, n = open_bins[room].pop() if room in open_bins else ((), left)
            if room in open_bins and not open_bins[room]:
                del open_bins[room]
            each = room // item
            full = min(n, left // each)
            used = [(each, full)] if full else []
            left -= full * each
            if left and full < n and left < each:
                used.append((left, 1))
                left = 0
            for k, m in used:
                open_bins.setdefault(room - k * item, []).append((pattern + (item,) * k, m))
            if pattern and (over := n - sum(m for _, m in used)):
                open_bins.setdefault(room, []).append((pattern, over))
    return [b for bins in open_bins.values() for b in bins]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first, n, sequence, offset): of the pieces of a length, those of rank first .. first + n - 1 go to sequences from ``sequence`` on, at ``offset``."""
    left = dict(counts)
    rows, rank, sequence = [], dict.fromkeys(counts, 0), 0
    for pattern, n in reduce_instance(left, capacity) + best_fit(left, capacity):
        offset = 0
        for length in pattern:
            rows.append((length, rank[length], n, sequence, offset))
            rank[length] += n
            offset += length
        sequence += n
    return rows


def pack(docs: DataFrame, ranks_path: str, capacity: int = 1024, end_id: int = 2, rows_per_bucket: int = 20_000) -> DataFrame:
    """A row for each piece of each row of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only the counts of the lengths, at most ``capacity`` numbers, come to the driver, which plans on them.
    Pieces find their place by rank among those of their length; ranks are counted in buckets, so that a very
    common length is spread over many tasks. Null text is empty: its piece is ``end_id``. Repeated rows are
    packed each. Rows without doc_id are packed as others. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    cut = save(pieces(docs, ranks_path, capacity, end_id))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = max(1, sum(counts.values()) // rows_per_bucket)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    upto = W.partitionBy("length").orderBy("bucket")
    before = cut.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(upto) - F.col("n")).drop("n")
    rank = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start")) - 1
    ranked = cut.withColumn("rank", rank).join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    rows = plan(counts, capacity)
    planned = spark.createDataFrame(rows, "len int, first long, n long, sequence long, offset long")
    planned = F.broadcast(planned) if len(rows) <= PLAN_ROWS else planned
    placed = ranked.join(planned, (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
