import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gaugeloom.llm import packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_plan_is_a_packing_near_the_bound():
    rng = random.Random(1)
    for capacity, n in ((10, 30), (100, 300), (1024, 5000)):
        for _ in range(30):
            counts = Counter(min(capacity, 1 + int(rng.paretovariate(0.7) * rng.random() * capacity / 8)) for _ in range(rng.randrange(1, n)))
            left = dict(counts)
            used = defaultdict(list)
            for length, first, m, sequence, offset in packing.plan(counts, capacity):
                assert first == counts[length] - left[length]
                left[length] -= m
                for i in range(m):
                    used[sequence + i].append((offset, length))
            assert not any(left.values())
            for parts in used.values():
                at = 0
                for offset, length in parts:
                    assert offset == at
                    at += length
                assert at <= capacity
            bound = -(-sum(k * v for k, v in counts.items()) // capacity)
            over_half = sum(v for k, v in counts.items() if 2 * k > capacity)
            assert len(used) <= 11 / 9 * max(bound, over_half) + 1


def test_reduction_keeps_the_optimum():
    def optimum(items, capacity):
        best = [len(items)]

        def place(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for b in set(bins):
                if b >= items[i]:
                    rest = list(bins)
                    rest.remove(b)
                    place(i + 1, [*rest, b - items[i]])
            place(i + 1, [*bins, capacity - items[i]])

        place(0, [])
        return best[0]

    rng = random.Random(2)
    for _ in range(150):
        items = sorted((rng.randrange(1, 21) for _ in range(9)), reverse=True)
        counts = dict(Counter(items))
        fixed = packing.reduce_instance(counts, 20)
        rest = sorted((k for k, v in counts.items() for _ in range(v)), reverse=True)
        assert sum(n for _, n in fixed) + (optimum(rest, 20) if rest else 0) == optimum(items, 20)


def test_pieces_round_trip(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", None, "Hello  world\n\n x", "ab " * 2000, "é<|endoftext|>", "a <|endoftext|> b", "word " * 1023, "word " * 1024, "a" * 5000] + [f"n{i} " * (i * 7 % 90) for i in range(200)]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)] + [(3, texts[3], 1), (None, "x", 1)], "doc_id long, text string, piece int")
    rows = packing.pack(df, RANKS, rows_per_bucket=20).collect()
    own = defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        parts = sorted(own[i], key=lambda r: (r.piece, r.sequence_id))[:: 2 if i == 3 else 1]
        assert [r.piece for r in parts] == list(range(-(-len(ids) // 1024)))
        assert sum(r.length for r in parts) == len(ids) and all(r.length == 1024 for r in parts[1:])
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in parts)
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.pack(df.limit(0), RANKS).count() == 0


def test_ids_of_long_runs_are_those_of_the_vocabulary():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder(RANKS)
    for text in ("\n" * 60_000, " " * 60_000 + "x", "a" * 30_000, "7" * 30_000, "!" * 30_000, "_" * 30_000, "\n " * 30_000, "é" * 30_000, "\n" * 19_999 + "x"):
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
    for text in ("\n", " ", "a"):
        assert len(encode(text * 2_000_000)) > 0
