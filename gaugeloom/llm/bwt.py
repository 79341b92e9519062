"""Burrows-Wheeler transforms of string collections, merged by refining their interleave."""

from __future__ import annotations

import numpy as np

#: Ends each string; no byte of UTF-8 text.
END = 0xFF


def shard_transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(transform, suffix array) of distinct strings in rising order, each closed by END; suffixes are places in their concatenation."""
    text = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    symbols = text.astype(np.int64)
    symbols[text == END] += np.arange(len(strings))  # the end of a lesser string is less
    _, rank = np.unique(symbols, return_inverse=True)
    step = 1
    while rank.max() + 1 < len(rank):
        after = np.zeros(len(rank), np.int64)
        after[:-step] = rank[step:] + 1
        _, rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)
        step *= 2
    order = np.empty(len(rank), np.int64)
    order[rank] = np.arange(len(rank))
    return text[order - 1], order


def _pairs(transform: np.ndarray) -> np.ndarray:
    """For each row the two symbols before its suffix, as one number that orders by the first of them."""
    longer = np.empty(len(transform), np.int64)  # where the suffix that is longer by one symbol stands
    longer[np.argsort(transform, kind="stable")] = np.arange(len(transform))
    return (transform[longer].astype(np.uint16) << np.uint16(8)) | transform


def merge(*transforms: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of some transforms: for each row of the merged order the number of its transform; and where blocks begin.

    After rounds over k symbols the interleave has the rows in the order of their first k symbols: a round deals them by the
    symbols before each, two at a time, keeping their order, which sorts them by two symbols more. No suffix is compared or
    sorted again. Without ``depth`` it goes on until nothing moves. With it, after rounds over that many symbols a block is
    a set of suffixes with a common prefix of ``depth`` symbols: what began no block has that LCP or more.
    """
    of = np.repeat(np.arange(len(transforms), dtype=np.uint8 if len(transforms) < 256 else np.uint16), [len(t) for t in transforms])
    block = np.zeros(len(of), np.int32)
    starts = np.zeros(len(of), bool)
    single, double = np.concatenate(transforms), np.concatenate([_pairs(t) for t in transforms])
    done = 0
    while len(of):
        own = single if depth is not None and (depth - done) % 2 else double
        symbol = np.empty(len(of), own.dtype)
        symbol[np.argsort(of, kind="stable")] = own
        deal = np.argsort(symbol, kind="stable")
        was, of = of, of[deal]
        done += 1 if own is single else 2
        if depth is None:
            if np.array_equal(was, of):
                break
            continue
        symbol, block = symbol[deal], block[deal]
        starts[0] = True
        np.not_equal(symbol[1:], symbol[:-1], out=starts[1:])
        starts[1:] |= block[1:] != block[:-1]
        if done >= depth:
            break
        block = np.cumsum(starts, dtype=np.int32)
    return of, starts


def weave(of: np.ndarray, *rows: np.ndarray) -> np.ndarray:
    """Rows of all transforms in merged order."""
    out = np.empty(len(of), rows[0].dtype)
    out[np.argsort(of, kind="stable")] = np.concatenate(rows)
    return out


def repeated(strings: list[bytes], width: int, shard_bytes: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merged order of all suffixes of ``strings``, cut into blocks with a common prefix of ``width`` bytes.

    Gives for each row the number of its string, its place there, and whether it begins a block. Rows with
    under ``width`` bytes to their string's end share no block with others. Strings must be distinct.
    """
    order = sorted(range(len(strings)), key=lambda i: strings[i] + b"\xff")
    count = max(2, -(-sum(len(s) + 1 for s in strings) // shard_bytes))
    shards = [order[k::count] for k in range(count)]  # dealt in turn, so that each spans the whole order
    done = []
    for shard in shards:
        transform, suffixes = shard_transform([strings[i] for i in shard])
        sizes = np.array([len(strings[i]) + 1 for i in shard], np.int64)
        begin = np.cumsum(sizes) - sizes
        string = np.repeat(np.array(shard, np.int64), sizes)
        place = np.arange(len(string)) - np.repeat(begin, sizes)
        done.append((transform, string[suffixes], place[suffixes]))
    # all shards at once: a merge of merged ones would go over most rows several times, and to the end of their suffixes
    of, starts = merge(*(d[0] for d in done), depth=width)
    return weave(of, *(d[1] for d in done)), weave(of, *(d[2] for d in done)), starts
