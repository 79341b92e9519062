"""Scores of a language model: prediction by partial matching over bytes, learned from the corpus.

The model is a trie of byte contexts with counts. What a text costs is a sum over its grams (ORDER bytes of context and
the byte after them), so the trie is never held whole: a chunk of texts asks for the cost of its distinct grams,
the trie is dealt by the ends of its contexts, and the costs come back to the chunk. Tokens are counted in the same way.
Keys travel sorted and packed, a row for each chunk and part of the trie.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeloom.llm.scratch import drop, save

#: Bytes of context; with the byte after them and a mark they fit in 64 bits.
ORDER = 5
#: Bytes of text that a chunk holds about, and that are looked at together; one text is never cut.
CHUNK_BYTES, BLOCK_BYTES = 64 << 20, 4 << 20
#: Bytes of context by which the trie is dealt where the counts of so many bytes are few enough to be sent to every task, and else.
FINE, COARSE, SENT_COUNTS = 3, 2, 1_000_000
#: Bytes of text to a part of the trie and of the tokens.
PART_BYTES = 32 << 20
#: Before a text, and behind its last word: neither can stand in a word.
BLANK, END = 0x20, 0x0A
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def held_out(doc_id: str) -> Column:
    """Rows that training never sees: those whose crc32(doc_id as text) leaves 1 when divided by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def stream(text: str | None) -> bytes:
    """The words in lower case (A-Z only), a blank between them, and the end."""
    return b" ".join((text or "").encode().translate(_LOWER).split()) + bytes([END])


def words(streamed: bytes) -> list[bytes]:
    """The tokens of a stream: its words, and the end."""
    return [*streamed[:-1].split(), bytes([END])]


def grams(streams: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The gram of each byte of each stream, the byte itself lowest; and how many each has. Blanks stand before a text."""
    sizes = np.array([len(s) for s in streams], np.int64)
    pad = bytes([BLANK]) * order
    raw = np.frombuffer(b"".join(x for s in streams for x in (pad, s)), np.uint8)
    out = np.zeros(max(len(raw) - order, 0), np.uint64)
    for i in range(order + 1):
        out = out << np.uint64(8) | raw[i : len(raw) - order + i]
    # grams that end in the blanks before a text are none
    starts = np.cumsum(sizes + order) - sizes - order
    keep = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return out[keep], sizes


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted one stands among sorted keys, and whether it does."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def log10_costs(asked: np.ndarray, known: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray], order: int, dealt: int) -> np.ndarray:
    """log10 of the probability of each asked gram's last byte.

    ``known`` are sorted training grams with ``counts``, all those that share their last ``dealt`` context bytes with an
    asked one; ``low`` are the counts of all training grams of ``dealt`` bytes. From the longest context that training
    has, a byte seen there has the share count / (total + distinct), and all others together distinct / (total + distinct):
    the escape. After an escape the next shorter context is asked without the bytes that the longer one has. Below the
    empty context all bytes that training lacks are alike likely.
    """
    byte = np.uint64(8)
    # counts of each order, from the longest: grams of n + 1 bytes
    tables: list[tuple[np.ndarray, np.ndarray]] = []
    table = (known, counts)
    for n in range(order, -1, -1):
        if n < order:
            whole = table[0] & np.uint64((1 << 8 * (n + 1)) - 1)
            table = _sums(whole, table[1])
        if n == dealt - 1:
            table = low
        tables.append(table)
    out = np.zeros(len(asked))
    open_ = np.arange(len(asked))
    longer_total, longer_kinds = np.zeros(len(asked)), np.zeros(len(asked))  # what the longer context takes from the next
    for level, n in enumerate(range(order, -1, -1)):
        keys, own = tables[level]
        context, first, kinds = np.unique(keys >> byte, return_index=True, return_counts=True)
        total = np.add.reduceat(own, first).astype(float) if len(keys) else np.zeros(0)
        mask = np.uint64((1 << 8 * (n + 1)) - 1)
        key = asked[open_] & mask
        node, has_node = _find(context, key >> byte)
        at, seen = _find(keys, key)
        node_total = np.where(has_node, total[node] if len(total) else 0, 0)
        node_kinds = np.where(has_node, kinds[node] if len(kinds) else 0, 0)
        left, kinds_left = node_total - longer_total, node_kinds - longer_kinds
        asks = kinds_left > 0
        whole = np.where(asks, left + kinds_left, 1)
        out[open_] += np.log10(np.where(asks, np.where(seen, own[at] if len(own) else 1, kinds_left) / whole, 1.0))
        # of what stays open: what this context's bytes take from the next shorter one
        rest = ~(seen & asks)
        open_, longer_kinds = open_[rest], node_kinds[rest]
        if n:
            below, below_own = tables[level + 1]
            place, _ = _find(below, keys & np.uint64((1 << 8 * n) - 1))
            taken = np.add.reduceat(below_own[place], first).astype(float) if len(keys) else np.zeros(0)
            longer_total = np.where(has_node[rest], taken[node[rest]] if len(taken) else 0, 0)
    kinds = len(tables[-1][0])
    out[open_] -= math.log10(256 - kinds) if len(open_) else 0.0
    return out


def _prepare(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """(doc_id, held_out, chunk, stream): texts dealt to chunks as they are read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            chunks, streams = [], []
            for text in batch.column(2):
                streams.append(stream(text.as_py()))
                if size and size + len(streams[-1]) > chunk_bytes:
                    chunk, size = chunk + 1, 0
                size += len(streams[-1])
                chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(chunks, pa.int64()), pa.array(streams, pa.binary())], names=["doc_id", "held_out", "chunk", "stream"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, held_out boolean, chunk long, stream binary")


def pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit numbers, or doubles, as compressed bytes."""
    steps = np.diff(keys, prepend=keys[:1] * 0) if keys.dtype == np.uint64 else keys
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, dtype=np.uint64) -> np.ndarray:
    steps = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n).T.copy().view(dtype)[:, 0] if n else np.zeros(0, dtype)
    return np.cumsum(steps, dtype=np.uint64) if dtype == np.uint64 else steps


def hashed(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


class _Distinct:
    """Distinct keys and their counts, added up block by block."""

    def __init__(self):
        self.held, self.waiting, self.n = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.n += len(keys)
        if self.n > len(self.held[0]) + 1_000_000:
            self.all()

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.held, *self.waiting]
        self.held, self.waiting, self.n = _sums(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])), [], 0
        return self.held


def _blocks(streams: list[bytes]) -> Iterator[slice]:
    first, size = 0, 0
    for i, s in enumerate(streams):
        size += len(s)
        if size >= BLOCK_BYTES or i + 1 == len(streams):
            yield slice(first, i + 1)
            first, size = i + 1, 0


def _gram_block(streams: list[bytes], held: list[bool], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, and how often training has each."""
    found, sizes = grams(streams, order)
    found = found << np.uint64(1) | np.repeat(~np.array(held, bool), sizes)
    found.sort()
    first = np.flatnonzero(np.append(True, found[1:] >> np.uint64(1) != found[:-1] >> np.uint64(1)))
    return found[first] >> np.uint64(1), np.add.reduceat((found & np.uint64(1)).astype(np.int64), first)


def _token_block(streams: list[bytes], held: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    asked: Counter = Counter()
    for s, h in zip(streams, held, strict=True):
        asked.update(dict.fromkeys(words(s), 0) if h else words(s))
    return _sums(hashed(list(asked)), np.fromiter(asked.values(), np.int64, len(asked)))


def _asked(prepared: DataFrame, block: Callable, part: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(chunk, part, size, keys, counts): the distinct keys that ``block`` finds in a chunk, a row for each part that has some."""

    def rows(chunk: int, distinct: _Distinct) -> pa.RecordBatch:
        keys, counts = distinct.all()
        at = part(keys)
        order = np.argsort(at, kind="stable")
        keys, counts, at = keys[order], counts[order], at[order]
        edges = [*np.flatnonzero(np.append(True, at[1:] != at[:-1])).tolist(), len(at)] if len(at) else [0]
        cuts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        columns = [[chunk] * len(cuts), [int(at[c.start]) for c in cuts], [c.stop - c.start for c in cuts], [pack(keys[c]) for c in cuts], [pack(counts[c]) for c in cuts]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "part", "size", "keys", "counts"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, distinct = None, _Distinct()
        for batch in batches:
            chunks = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist(), len(chunks)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if at is not None and chunks[a] != at:
                    yield rows(at, distinct)
                    distinct = _Distinct()
                at = int(chunks[a])
                streams, held = batch.column(1).slice(a, b - a).to_pylist(), batch.column(2).slice(a, b - a).to_pylist()
                for cut in _blocks(streams):
                    distinct.add(*block(streams[cut], held[cut]))
        if at is not None:
            yield rows(at, distinct)

    return prepared.select("chunk", "stream", "held_out").mapInArrow(work, "chunk long, part long, size long, keys binary, counts binary")


def _answered(asked: DataFrame, kind: str, answer: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(chunk, kind, size, keys, values): each asked key with its answer, which is worked out by part from all counts there.

    Each part adds two rows of chunk -1, whose size is how often training has its keys ('total'), and how many it has ('kinds').
    """

    def work(given: pa.Table) -> pa.Table:
        sizes = given.column("size").to_pylist()
        each = [unpack(k.as_py(), n) for k, n in zip(given.column("keys"), sizes, strict=True)]
        counts = [unpack(c.as_py(), n, np.int64) for c, n in zip(given.column("counts"), sizes, strict=True)]
        keys, n = _sums(np.concatenate(each), np.concatenate(counts))
        values = answer(keys, n)
        told = [pack(values[np.searchsorted(keys, own)]) for own in each]
        sums = [int(n.sum()), int((n > 0).sum())]
        columns = [given.column("chunk").to_pylist() + [-1, -1], [kind] * len(each) + ["total", "kinds"], sizes + sums, given.column("keys").to_pylist() + [None, None], told + [None, None]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "kind", "size", "keys", "values"])

    return asked.groupBy("part").applyInArrow(work, "chunk long, kind string, size long, keys binary, values binary")


def _low_counts(prepared: DataFrame, width: int) -> DataFrame:
    """(gram, n): training's grams of ``width`` bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct = _Distinct()
        for batch in batches:
            streams = batch.column(0).to_pylist()
            for cut in _blocks(streams):
                found = np.sort(grams(streams[cut], width - 1)[0])
                first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
                distinct.add(found[first], np.diff(np.append(first, len(found))))
        keys, n = distinct.all()
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["gram", "n"])

    each = prepared.where("not held_out").select("stream").mapInArrow(work, "gram long, n long")
    return each.groupBy("gram").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, order: int = ORDER, chunk_bytes: int = CHUNK_BYTES, sent_counts: int = SENT_COUNTS, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words in lower case (A-Z only) and one end. The model learns from the rows that aren't held out and
    scores all. ``score`` is the log10 of the probability that it gives to the words with a blank between
    them and the end; ``base_score`` takes tokens alone, by their counts with half a count added. Tokens are told apart by
    64 bits of hash.

    Null text is empty: only an end. Rows without doc_id are trained on and have a row each; repeated rows count each. Where all rows are
    held out nothing is learned: each byte is one of 256. Other columns are passed over, whatever their names. An
    empty table gives an empty result.

    A task holds a chunk of texts (of one input partition, ``chunk_bytes`` at most) with the costs of its distinct grams and
    tokens, or a part: the distinct grams of all chunks that share the ends of their contexts. Counts of three bytes are sent to
    all tasks up to ``sent_counts`` of them; beyond, the trie is dealt by two bytes, of which there are 65,536 at most.
    """
    spark = docs.sparkSession
    prepared = save(_prepare(docs, chunk_bytes))
    dealt = FINE
    low = save(_low_counts(prepared, FINE))
    if low.count() > sent_counts:
        dealt, low = COARSE, save(_low_counts(prepared, COARSE))
    counts = low.orderBy("gram").toArrow()  # sent_counts rows at most, or one for each pair of bytes
    low_counts = (counts.column("gram").to_numpy().astype(np.uint64), counts.column("n").to_numpy())
    size = prepared.agg(F.sum(F.octet_length("stream"))).first()[0] or 0
    parts = max(-(-size // part_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = lambda x: x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
    by_context = lambda keys: (spread(keys >> np.uint64(8) & np.uint64((1 << 8 * dealt) - 1)) % np.uint64(parts)).astype(np.int64)
    by_hash = lambda keys: (keys % np.uint64(parts)).astype(np.int64)

    def cost(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        return log10_costs(keys, keys[n > 0], n[n > 0], low_counts, order, dealt)

    costs = _answered(_asked(prepared, lambda s, h: _gram_block(s, h, order), by_context), "gram", cost)
    counted = save(_answered(_asked(prepared, _token_block, by_hash), "token", lambda keys, n: n.astype(float)))
    sums = {r["kind"]: r["n"] for r in counted.where("chunk = -1").groupBy("kind").agg(F.sum("size").alias("n")).collect()}
    total, kinds = sums.get("total", 0), sums.get("kinds", 0)
    told = costs.unionByName(counted).where("chunk >= 0")
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def table(told: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray]:
        rows = [(unpack(k, n), unpack(v, n, np.float64)) for c, n, k, v in zip(*(told.column(c).to_pylist() for c in ("kind", "size", "keys", "values")), strict=True) if c == kind]
        keys, values = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
        place = np.argsort(keys, kind="stable")  # what two tasks have read of a chunk is there twice
        return keys[place], values[place]

    def work(texts: pa.Table, told: pa.Table) -> pa.Table:
        streams = texts.column("stream").to_pylist()
        keys, cost = table(told, "gram")
        token_keys, token_counts = table(told, "token")
        out: dict[str, list] = {n: [] for n in names[2:]}
        whole = math.log10(total + 0.5 * (kinds + 1))
        for cut in _blocks(streams):
            found, sizes = grams(streams[cut], order)
            costs = cost[np.searchsorted(keys, found)]
            ends = np.cumsum(sizes)
            tokens = [words(s) for s in streams[cut]]
            distinct = list({w for own in tokens for w in own})
            seen = dict(zip(distinct, token_counts[np.searchsorted(token_keys, hashed(distinct))].tolist(), strict=True))
            logs = {w: math.log10(c + 0.5) - whole for w, c in seen.items()}
            for own, start, end in zip(tokens, ends - sizes, ends, strict=True):
                values = (len(own), sum(seen[w] > 0 for w in own), total, math.fsum(map(logs.__getitem__, own)), float(np.sum(costs[start:end])))
                for n, x in zip(names[2:], values, strict=True):
                    out[n].append(x)
        made = [pa.array(out[n], pa.float64() if n.endswith("score") else pa.int64()) for n in names[2:]]
        return pa.table([texts.column("doc_id"), texts.column("held_out"), *made], names=names)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = save(prepared.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(work, schema))
    for done in (prepared, low, counted):
        drop(done)
    return out
