"""Removal of byte strings that documents before have too: merged Burrows-Wheeler transforms of shards."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeloom.llm.anchors import GRAM, WIDTH, anchors
from gaugeloom.llm.bwt import repeated
from gaugeloom.llm.scratch import save
from gaugeloom.llm.shingles import chunks, mix

#: Bytes of text whose anchors one bucket gathers, and which one part of the documents holds.
BUCKET_BYTES, PART_BYTES = 16_000_000, 6_000_000
#: Bytes of text whose anchors a task holds at a time.
HELD_BYTES = 10_000_000
#: Where doc_id is null: after all others.
LAST = 2**63 - 1

_ENTRIES = "bucket long, kind int, doc binary, addr binary, count binary, lo binary, span binary, anchor binary, run binary"
_MARKS = "part long, kind int, addr binary, doc binary, lo binary, hi binary, anchor binary"
_STRINGS = "bucket long, addr binary, doc binary, lo binary, anchor binary, sizes binary, bytes binary"


def _pack(a: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _unpack(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view("<u8")[:, 0]


def _diffs(a: np.ndarray) -> bytes:
    return zlib.compress(np.diff(a.astype("<i4"), prepend=np.int32(0)).tobytes(), 1)


def _undiff(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<i4"), dtype=np.int64)


def _entries(n_buckets: int):
    """Per HELD_BYTES of a batch: for each bucket of anchors one row with all their runs; and, of runs that a smaller document among them has, just the places."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, addrs = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            encoded = [t.encode() if t else b"" for t in batch.column(2).to_pylist()]
            for s, e in chunks(encoded, HELD_BYTES):
                yield from rows_of(ids[s:e], addrs[s:e], encoded[s:e])

    def rows_of(doc: np.ndarray, addr: np.ndarray, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        found = [(a[0] + s, *a[1:]) for s, e in chunks(texts) for a in [anchors(texts[s:e])]]
        if not found:
            return
        text, lo, hi, anchor, run = (np.concatenate(x) for x in zip(*found, strict=True))
        anchor, run = anchor & np.uint64((1 << 48) - 1), run >> np.uint64(24)
        # the same run in a smaller document of the batch settles it here
        order = np.lexsort((doc[text], run, anchor))
        new = np.ones(len(order), bool)
        new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (run[order][1:] != run[order][:-1])
        least = doc[text[order]][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else doc[:0]
        later = np.zeros(len(order), bool)
        later[order] = doc[text[order]] > least
        rows = []
        bucket = (mix(anchor) % np.uint64(n_buckets)).astype(np.int64)
        for kind, some in ((0, ~later), (1, later)):
            at = np.flatnonzero(some)
            b = bucket[at] if kind == 0 else np.full(len(at), int(addr[0]) % n_buckets)
            at = at[np.argsort(b, kind="stable")]
            for part in np.split(at, np.flatnonzero(np.diff(np.sort(b))) + 1):
                if not len(part):
                    continue
                t, count = np.unique(text[part], return_counts=True)
                rows.append({
                    "bucket": int(b.min() if kind else bucket[part[0]]), "kind": kind, "doc": doc[t].astype("<i8").tobytes(), "addr": addr[t].astype("<i8").tobytes(), "count": count.astype("<i4").tobytes(),
                    "lo": _diffs(lo[part]), "span": (hi - lo)[part].astype(np.uint8).tobytes(), "anchor": _pack(anchor[part], 6) if kind == 0 else b"", "run": _pack(run[part], 5) if kind == 0 else b"",
                })
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("doc", "addr", "count", "lo", "span", "anchor", "run"))]))

    return work


def _by_part(n_parts: int, kind: int, addr, doc, lo, hi, anchor) -> list[dict]:
    """The marks or requests as one row a part of the documents."""
    if not len(addr):
        return []
    part = addr % n_parts
    order = np.argsort(part, kind="stable")
    out = []
    for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        packed = {n: x[at].astype("<i8").tobytes() for n, x in (("addr", addr), ("doc", doc), ("anchor", anchor.astype(np.int64)))}
        if kind == 0:
            packed["doc"] = packed["anchor"] = b""
        out.append({"part": int(part[at[0]]), "kind": kind, **packed, "lo": lo[at].astype("<i4").tobytes(), "hi": hi[at].astype("<i4").tobytes()})
    return out


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
    return out.astype({c.split()[0]: {"long": "int64", "int": "int32"}.get(c.split()[1], object) for c in schema.split(", ")})


def _match(n_parts: int):
    """Of one bucket: marks for runs that a smaller document has whole; requests for the bytes of runs whose anchor others have in other runs."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[dict] = []
        columns: tuple[list, ...] = ([], [], [], [], [], [])
        for r in pdf.rename(columns={"count": "n"}).itertuples():
            count = np.frombuffer(r.n, "<i4")
            doc, addr = (np.repeat(np.frombuffer(x, "<i8"), count) for x in (r.doc, r.addr))
            lo = _undiff(r.lo)
            hi = lo + np.frombuffer(r.span, np.uint8)
            if r.kind == 1:
                rows += _by_part(n_parts, 0, addr, doc, lo, hi, lo)
                continue
            for c, x in zip(columns, (doc, addr, lo, hi, _unpack(r.anchor, 6), _unpack(r.run, 5)), strict=True):
                c.append(x)
        if columns[0]:
            doc, addr, lo, hi, anchor, run = (np.concatenate(c) for c in columns)
            _, group, count = np.unique(anchor, return_inverse=True, return_counts=True)
            several = np.flatnonzero(count[group] > 1)
            doc, addr, lo, hi, anchor, run, group = (x[several] for x in (doc, addr, lo, hi, anchor, run, group))
            order = np.lexsort((doc, run, group))
            doc, addr, lo, hi, anchor, run, group = (x[order] for x in (doc, addr, lo, hi, anchor, run, group))
            if len(doc):
                new_group = np.append(True, group[1:] != group[:-1])
                new_run = new_group | np.append(True, run[1:] != run[:-1])
                least = doc[np.flatnonzero(new_run)][np.cumsum(new_run) - 1]
                later = doc > least
                g = np.cumsum(new_group) - 1
                at = np.flatnonzero(new_group)
                mixed = (np.add.reduceat(new_run.astype(np.int64), at) > 1) & (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at))
                ask = mixed[g] & ~later
                for kind, some in ((0, later), (1, ask)):
                    rows += _by_part(n_parts, kind, addr[some], doc[some], lo[some], hi[some], anchor[some])
        return _frame(rows, _MARKS)

    return work


def _texts(pdf: pd.DataFrame) -> dict[int, bytes]:
    return {a: t.encode() if t else b"" for a, t in zip(pdf["addr"].to_numpy(), pdf["text"], strict=True)}


def _fetch(n_buckets: int):
    """The bytes of the requested runs, for the bucket of their anchor."""

    def work(docs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(docs):
            return _frame([], _STRINGS)
        texts = _texts(docs)
        addr, doc, anchor = (np.frombuffer(b"".join(asked[c]), "<i8") for c in ("addr", "doc", "anchor"))
        lo, hi = (np.frombuffer(b"".join(asked[c]), "<i4") for c in ("lo", "hi"))
        bucket = (mix(anchor.astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rows = []
        for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            strings = [texts[a][s : e + WIDTH] for a, s, e in zip(addr[at].tolist(), lo[at].tolist(), hi[at].tolist(), strict=True)]
            sizes = np.array([len(s) for s in strings], "<i4")
            rows.append({"bucket": int(bucket[at[0]]), "addr": addr[at].tobytes(), "doc": doc[at].tobytes(), "lo": lo[at].tobytes(), "anchor": anchor[at].tobytes(), "sizes": sizes.tobytes(), "bytes": b"".join(strings)})
        return _frame(rows, _STRINGS)

    return work


def _windows(n_parts: int):
    """Of one bucket: marks for the windows that a smaller document has, from the blocks of the merged transforms."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        addr, doc, anchor = (np.frombuffer(b"".join(pdf[c]), "<i8") for c in ("addr", "doc", "anchor"))
        lo, sizes = (np.frombuffer(b"".join(pdf[c]), "<i4").astype(np.int64) for c in ("lo", "sizes"))
        data = b"".join(pdf["bytes"])
        ends = np.cumsum(sizes)
        # equal strings, which one document may hold twice, are worked on once
        number: dict[bytes, int] = {}
        of = np.array([number.setdefault(data[e - n : e], len(number)) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)])
        strings = list(number)
        owner = np.full(len(strings), LAST)
        np.minimum.at(owner, of, doc)
        keep = may_share(strings)
        kept = np.flatnonzero(keep)
        string, place, starts = repeated([strings[i] for i in kept], WIDTH)
        string = kept[string] if len(kept) else string
        lengths = np.array([len(s) for s in strings], np.int64)
        whole = place + WIDTH <= lengths[string]
        if not whole.any():
            return _frame([], _MARKS)
        at = np.flatnonzero(starts)
        least = np.minimum.reduceat(np.where(whole, owner[string], LAST), at)[np.cumsum(starts) - 1]
        hit = np.flatnonzero(whole & (least < LAST))
        first = np.full((len(strings), 2 * WIDTH - GRAM), LAST)
        first[string[hit], place[hit]] = least[hit]
        # all holders of a string, by their own doc
        rows = []
        some = keep[of]
        dup = first[of[some]] < doc[some][:, None]
        padded = np.zeros((len(dup), dup.shape[1] + 2), np.int8)
        padded[:, 1:-1] = dup
        change = np.diff(padded, axis=1)
        i, s = np.nonzero(change == 1)
        _, e = np.nonzero(change == -1)
        rows += _by_part(n_parts, 0, addr[some][i], doc[some][i], lo[some][i] + s, lo[some][i] + e - 1, lo[some][i])
        return _frame(rows, _MARKS)

    return work


def may_share(strings: list[bytes]) -> np.ndarray:
    """Strings that may have a window in common with another: each window holds one part of WIDTH - 7 bytes that
    begins at a multiple of 8 in one of them, so parts at those places are looked up at all places of the others."""
    cut = WIDTH - 7
    on_grid: dict[bytes, set[int]] = {}
    for i, s in enumerate(strings):
        for p in range(0, len(s) - cut + 1, 8):
            on_grid.setdefault(s[p : p + cut], set()).add(i)
    out = np.zeros(len(strings), bool)
    met: set[bytes] = set()  # a part that very many have is looked through once
    for i, s in enumerate(strings):
        for p in range(len(s) - cut + 1):
            part = s[p : p + cut]
            other = on_grid.get(part)
            if other is not None and (len(other) > 1 or i not in other):
                out[i] = True
                met.add(part)
    for part in met:
        out[list(on_grid[part])] = True
    return out


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _remove(docs: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
    addr = np.frombuffer(b"".join(marks["addr"]), "<i8")
    order = np.argsort(addr, kind="stable")
    lo, hi = (np.frombuffer(b"".join(marks[c]), "<i4")[order] for c in ("lo", "hi"))
    addr = addr[order]
    out = []
    for key, doc, null, text in zip(docs["addr"].to_numpy(), docs["doc"].to_numpy(), docs["is_null"].to_numpy(), docs["text"], strict=True):
        data = text.encode() if text else b""
        s, e = np.searchsorted(addr, key), np.searchsorted(addr, key, side="right")
        spans = removed = 0
        if e > s:
            cover = np.bincount(lo[s:e], minlength=len(data) + 1) - np.bincount(hi[s:e] + WIDTH, minlength=len(data) + 1)
            gone = np.cumsum(cover)[:-1] > 0
            removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            data = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((None if null else doc, len(data) + removed, removed, spans, data))
    frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    return frame.astype({"doc_id": "Int64", "n_bytes": "int64", "n_removed": "int64", "n_spans": "int64"})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans and kept, the bytes that stay.

    A byte goes where a string of WIDTH bytes over it also starts in a document of a smaller doc_id; texts are
    UTF-8 bytes, strings don't cross documents, and all are judged on the input.

    Windows of equal bytes pick equal anchors, so they meet in the bucket of the anchor's hash, together with
    their neighbours of the same anchor as one run. Runs with equal bytes (a 48-bit and a 40-bit hash) are
    settled by their least document; a batch settles its own before the shuffle, so that a very common
    passage gives a row a batch. Where an anchor stands in unequal runs, the bucket fetches each distinct
    run once, transforms shards of them, and merges the transforms; blocks of the merged order with a common
    prefix of WIDTH bytes are the repeated windows, and their least documents settle them.

    Null text is empty, null doc_id comes after all others; equal doc_ids remove nothing from each other,
    and rows repeated whole get equal results. An empty table gives an empty result. Other columns are ignored.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    docs = docs.select(doc.alias("doc"), F.col("doc_id").isNull().alias("is_null"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("addr", F.shiftrightunsigned(F.xxhash64("doc", "text"), 1))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_buckets, n_parts = total // BUCKET_BYTES + 1, total // PART_BYTES + 1
    entries = docs.select("doc", "addr", "text").mapInArrow(_entries(n_buckets), _ENTRIES)
    found = save(entries.groupBy("bucket").applyInPandas(_match(n_parts), _MARKS))
    parts = docs.withColumn("part", F.col("addr") % n_parts)
    asked = parts.groupBy("part").cogroup(found.where("kind = 1").groupBy("part")).applyInPandas(_fetch(n_buckets), _STRINGS)
    within = asked.groupBy("bucket").applyInPandas(_windows(n_parts), _MARKS)
    marks = found.where("kind = 0").union(within)
    return parts.groupBy("part").cogroup(marks.groupBy("part")).applyInPandas(_remove, _RESULT)
