"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Python only tokenises. Groups, links and their counts are made of arrays of token ends by Spark's functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeloom.llm.scratch import drop, save

#: The table of id pairs is broadcast up to so many rows: about 100 MB.
BROADCAST_PAIRS = 1_500_000
#: Characters of a run of one kind from which a text is encoded by the slower library, as the pattern of the other takes time with the square of a run.
LONG_RUN = 1000
#: Every so many characters one is looked at first: a long run holds LONG_RUN // LOOK of them in a row.
LOOK = 20
_RUN, _LOOK = (re.compile(r"\s{%d}|[^\W\d_]{%d}|\d{%d}|(?:[^\w\s]|_){%d}" % ((n,) * 4)) for n in (LONG_RUN, LONG_RUN // LOOK))
#: Tokens that a task holds before it hands them on.
HELD_TOKENS = 1_000_000


def long_run(text: str) -> bool:
    """Whether LONG_RUN characters of one kind stand together."""
    return len(text) >= LONG_RUN and bool(_LOOK.search(text[::LOOK])) and bool(_RUN.search(text))


@lru_cache(maxsize=2)
def byte_tokenizer(ranks_path: str):
    """Text to ids by a .tiktoken file of ranks, special strings as plain text, and the bytes of each id."""
    import base64

    import public_tokenizers
    import tiktoken
    import tokenizers

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = tokenizers.Tokenizer.from_file(str(Path(ranks_path).with_suffix(".json")))
    whole.encode_special_tokens = True
    token = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        token[i] = t

    def encode(text: str) -> np.ndarray:
        if long_run(text):
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.int32)
        return fast.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    return encode, token


@lru_cache(maxsize=2)
def piece_tokenizer(model_path: str):
    """Text to ids by a SentencePiece model, and the bytes of each id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    token = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return (lambda text: np.array(model.encode(text), np.int32)), token


def tokens(docs: DataFrame, ranks_path: str, model_path: str) -> DataFrame:
    """(doc_id, a_ids, a_ends, b_ids, b_ends): tokens and the offsets of the bytes after them in a blank and the text; none
    where the bytes of either don't join to those."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = []
        for encode_side, token in (byte_tokenizer(ranks_path), piece_tokenizer(model_path)):
            sides.append((encode_side, token.__getitem__, np.array([len(t) for t in token], np.int32)))
        none = np.zeros(0, np.int32)
        for batch in batches:
            own, n = [], 0
            for i, text in enumerate(batch.column(1)):
                text, found = text.as_py(), []
                data = (" " + text).encode() if text else b""
                for k, (encode_side, token, size) in enumerate(sides if text else ()):
                    ids = encode_side(text if k else " " + text)
                    if b"".join(map(token, ids.tolist())) != data:
                        found = []
                        break
                    found += [ids, np.cumsum(size[ids], dtype=np.int32)]
                own.append(found or [none] * 4)
                n += sum(map(len, found)) // 2
                if n >= HELD_TOKENS or i + 1 == batch.num_rows:
                    lists = []
                    for side in zip(*own, strict=True):
                        edges = np.cumsum([0, *map(len, side)]).astype(np.int32)
                        lists.append(pa.ListArray.from_arrays(edges, np.concatenate(side)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i + 1 - len(own), len(own)), *lists], names=["doc_id", "a_ids", "a_ends", "b_ids", "b_ends"])
                    own, n = [], 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, "doc_id long, a_ids array<int>, a_ends array<int>, b_ids array<int>, b_ends array<int>")


_TAG, _END, _LOW = 1 << 31, 1 << 32, (1 << 32) - 1


def merged_ends(a_ends: Column, b_ends: Column) -> Column:
    """The ends of both in one sorted array, as numbers: end, then 0 or 1 for a or b, then the place among its own. An end that
    is both stands twice, a's first.

    An element's place less its place among its own is how many of the other's ends come before it: so each finds the
    other's token in which it lies without a search.
    """
    end = lambda e: F.shiftleft(e.cast("long"), 32)
    return F.sort_array(F.concat(F.transform(a_ends, lambda e, i: end(e) + i), F.transform(b_ends, lambda e, j: end(e) + F.lit(_TAG) + j)))


def stretches(ends: Column) -> Column:
    """Ends of both cut the text into stretches; each lies in one token of either side, and two tokens that overlap share
    one stretch. Those of the merged ends in order, as place of a's token * 2 ** 32 + place of b's, and -1 behind
    each whose end is one of both."""

    def one(x: Column, p: Column) -> Column:
        own = x.bitwiseAND(F.lit(_TAG - 1))
        of_a = own * F.lit(_END - 1) + p  # (own, p - own)
        of_b = F.shiftleft(p.cast("long"), 32) - own * F.lit(_END - 1)  # (p - own, own)
        return F.when(x.bitwiseAND(F.lit(_TAG)) == 0, of_a).when(x.bitwiseXOR(F.get(ends, p - 1)) < _END, F.lit(-1)).otherwise(of_b)

    return F.transform(ends, one)


def links(stretches: Column, a_ids: Column, b_ids: Column, width: int) -> Column:
    """For each pair of tokens whose bytes overlap, a's id * width + b's id."""
    return F.transform(F.filter(stretches, lambda v: v >= 0), lambda v: a_ids[F.shiftright(v, 32)] * width + b_ids[v.bitwiseAND(F.lit(_LOW))])


def group_ends(stretches: Column) -> Column:
    """The last stretch of each group."""
    return F.filter(stretches, lambda v, k: F.get(stretches, k + 1) == -1)


def groups(last: Column, a: Column, b: Column) -> Column:
    """The groups as text, from their last stretches and the ids as strings."""

    def one(g: Column, k: Column) -> Column:
        before = F.get(last, k - 1)
        a_at, b_at = F.shiftright(g, 32), g.bitwiseAND(F.lit(_LOW))
        single = g - F.coalesce(before, F.lit(-_END - 1)) == _END + 1  # one token of either side
        part = lambda ids, at, was: F.array_join(F.slice(ids, (was + 2).cast("int"), (at - was).cast("int")), ",")
        whole = F.concat(part(a, a_at, F.coalesce(F.shiftright(before, 32), F.lit(-1))), F.lit("|"), part(b, b_at, F.coalesce(before.bitwiseAND(F.lit(_LOW)), F.lit(-1))))
        return F.when(single, F.concat(a[a_at], F.lit("|"), b[b_at])).otherwise(whole)

    return F.array_join(F.transform(last, one), ";")


def align(docs: DataFrame, ranks_path: str, model_path: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A: a blank and the text by the byte-level vocabulary; B: the text by the SentencePiece model, which adds the blank.
    Special strings are plain text. Byte offsets where tokens of both end cut them into groups; tokens are linked
    where their bytes overlap. A pair of ids counts the documents that hold it linked; n_best are the links whose
    count is their A id's greatest, count_sum adds the counts of all links. groups_sha256 is of 'a1,a2|b1;a3|b2,b3'.

    Null and empty texts, and those of which either side's bytes don't join to a blank and the text (U+2581 in it), have
    no tokens: zeros and ''. Repeated rows count each as a document; rows without doc_id have a row too. Other columns
    are passed over, whatever their names. An empty table gives an empty result.

    All arrays are those of one document, and all that is made of them takes time in proportion to its length (with its logarithm
    for sorting). A pair is counted once a document, and by each task before it is dealt; the table of pairs comes back to the documents by
    a broadcast up to ``broadcast_pairs`` rows, else by a join, which Spark splits where a pair is in very many documents.
    """
    width = len(piece_tokenizer(model_path)[1])
    kind = "int" if width * len(byte_tokenizer(ranks_path)[1]) < 2**31 else "long"
    number = lambda c: c.cast("long")
    a, b, last = F.col("a_ids"), F.col("b_ids"), F.col("last")
    cut = tokens(docs, ranks_path, model_path).withColumn("ends", merged_ends(F.col("a_ends"), F.col("b_ends")))
    cut = cut.select("doc_id", "a_ids", "b_ids", number(F.size(F.array_intersect("a_ends", "b_ends"))).alias("n_groups"), stretches(F.col("ends")).alias("stretches"))
    cut = cut.select("doc_id", "a_ids", "b_ids", "n_groups", "stretches", group_ends(F.col("stretches")).alias("last"), a.cast("array<string>").alias("a"), b.cast("array<string>").alias("b"))
    told = cut.select(
        "doc_id", number(F.size(a)).alias("n_a"), number(F.size(b)).alias("n_b"), "n_groups", links(F.col("stretches"), a.cast(f"array<{kind}>"), b, width).alias("links"),
        F.when(F.col("n_groups") > 0, F.sha2(groups(last, F.col("a"), F.col("b")), 256)).otherwise("").alias("groups_sha256"),
    )
    held = save(told.withColumn("row", F.monotonically_increasing_id()))
    table = held.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    first = F.floor(F.col("pair") / width)
    table = save(table.withColumn("best", F.col("count") == F.max("count").over(W.partitionBy(first))))
    rows = table.count()
    small = F.broadcast(table) if rows <= broadcast_pairs else table
    each = held.select("row", F.explode("links").alias("pair"))
    sums = each.join(small, "pair").groupBy("row").agg(F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))
    own = held.withColumn("n_links", number(F.size("links"))).drop("links")
    out = own.join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"])
    out = save(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
    drop(held)
    drop(table)
    return out
