import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from gaugeloom.llm import ppm

COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, order):
    """A dictionary of contexts, and exclusion byte by byte."""
    is_held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for i, (_, t) in enumerate(rows)}
    trie, count = defaultdict(Counter), Counter()
    for i, (d, _) in enumerate(rows):
        if not is_held(d):
            count.update([*tokens[i], "\n"])
            data = b" " * order + " ".join(tokens[i]).encode() + b"\n"
            for p in range(order, len(data)):
                for n in range(order + 1):
                    trie[data[p - n : p]][data[p]] += 1
    whole, kinds = sum(count.values()), len(count)
    out = []
    for i, (d, _) in enumerate(rows):
        own = [*tokens[i], "\n"]
        base = sum(math.log10((count[t] + 0.5) / (whole + 0.5 * (kinds + 1))) for t in own)
        data, score = b" " * order + " ".join(tokens[i]).encode() + b"\n", 0.0
        for p in range(order, len(data)):
            gone: set[int] = set()
            for n in range(order, -1, -1):
                node = trie.get(data[p - n : p], {})
                left = {s: c for s, c in node.items() if s not in gone}
                if not left:
                    continue
                total = sum(left.values()) + len(left)
                if data[p] in left:
                    score += math.log10(left[data[p]] / total)
                    break
                score += math.log10(len(left) / total)
                gone |= set(left)
            else:
                score -= math.log10(256 - len(gone))
        out.append((d, is_held(d), len(own), sum(count[t] > 0 for t in own), whole, base, score))
    return out


def close(found, wanted):
    key = lambda r: tuple(repr(round(x, 6)) if isinstance(x, float) else repr(x) for x in r)
    found, wanted = sorted(map(tuple, found), key=key), sorted(wanted, key=key)
    assert [r[:5] for r in found] == [r[:5] for r in wanted]
    for f, w in zip(found, wanted, strict=True):
        assert f[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def given(spark, rows):
    return spark.createDataFrame([(t, "x", d, 1, b"y") for d, t in rows], "text string, WORD string, doc_id long, chunk int, stream binary").repartition(3)


@pytest.mark.parametrize(("order", "chunk_bytes", "sent_counts"), [(6, 1 << 20, 10**6), (5, 300, 0), (4, 60, 10**6)])
def test_equals_a_plain_trie(spark, order, chunk_bytes, sent_counts):
    rng = random.Random(order + chunk_bytes)
    vocabulary = ["The", "the", "there", "mango", "Éa", "日本", "x" * 30, "\U0001f600", "a\x00b", "on", "ono", "nono"]
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(rng.choice(vocabulary) for _ in range(rng.randrange(15)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "  \n "), (None, "no id"), (None, None), (3, "another text of id 3"), *rows[:4], (200, "mango there " * 300)]
    df = ppm.score(given(spark, rows), order, chunk_bytes, sent_counts, part_bytes=500)
    assert df.columns == COLUMNS
    close(df.collect(), plain(rows, order))


def test_nothing_learned_and_no_rows(spark):
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = [(i, "some words") for i in held]
    df = ppm.score(given(spark, rows))
    close(df.collect(), plain(rows, ppm.ORDER))
    assert all(r["score"] == pytest.approx(-11 * math.log10(256)) for r in df.collect())
    assert ppm.score(given(spark, [])).collect() == []


def test_probabilities_of_a_context_sum_to_one():
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(1))
    streams = [bytes(rng.choice(np.frombuffer(b"abcde ", np.uint8), 400)) + b"\n" for _ in range(3)]
    found, _ = ppm.grams(streams, 3)
    keys, n = ppm._sums(found, np.ones(len(found), np.int64))
    low = ppm._sums(keys & np.uint64(0xFFFF), n)
    for context in (b"abc", b"eee", b"zab", b"zza", b"zzz", b"   "):
        asked = np.array([int.from_bytes(context, "big") << 8 | s for s in range(256)], np.uint64)
        known = (keys >> np.uint64(8) & np.uint64(0xFFFF)) == (asked[0] >> np.uint64(8) & np.uint64(0xFFFF))
        assert np.sum(10 ** ppm.log10_costs(asked, keys[known], n[known], low, 3, 2)) == pytest.approx(1)


def test_beats_single_tokens_on_unseen_texts(spark):
    """Held-out text in which each word mostly has the same one behind it."""
    rng = random.Random(4)
    known = ["".join(rng.choices("abcdefgh", k=rng.randrange(3, 9))) for _ in range(60)]

    def text():
        at, out = rng.randrange(60), []
        for _ in range(80):
            out.append(known[at])
            at = (at + 1) % 60 if rng.random() < 0.8 else rng.randrange(60)
        return " ".join(out)

    found = ppm.score(given(spark, [(i, text()) for i in range(200)])).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert found[0] > 0.7 * found[1]
