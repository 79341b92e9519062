import random
import time

import numpy as np

from gaugeloom.llm import bwt, substrings


def test_merged_transform_is_that_of_all_strings():
    rng = random.Random(2)
    for n in (0, 1, 2, 7, 40):
        strings = list({bytes(rng.choices(b"ab", k=rng.randrange(0, 60))) for _ in range(n)})
        for width in (3, 10):
            string, place, starts = bwt.repeated(strings, width, shard_bytes=200)
            assert sorted(zip(string.tolist(), place.tolist(), strict=True)) == sorted((i, p) for i, s in enumerate(strings) for p in range(len(s) + 1))
            blocks = {}
            for s, p, b in zip(string, place, np.cumsum(starts), strict=True):
                if p + width <= len(strings[s]):
                    blocks.setdefault(int(b), set()).add(strings[s][p : p + width])
            assert all(len(x) == 1 for x in blocks.values())
            assert len(blocks) == len({x for b in blocks.values() for x in b})
        order = sorted(range(len(strings)), key=lambda i: strings[i] + b"\xff")
        full, _ = bwt.shard_transform([strings[i] for i in order])
        a, b = (bwt.shard_transform([strings[i] for i in order[k::2]])[0] for k in (0, 1))
        of_b, _ = bwt.merge(a, b)
        assert np.array_equal(bwt.weave(of_b, a, b), full)


def brute(rows, width=50):
    least = {}
    data = [((d if d is not None else 2**63), (t or "").encode()) for d, t in rows]
    for d, b in data:
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            least[w] = min(least.get(w, d), d)
    out = []
    for (d, b), (doc_id, _) in zip(data, rows, strict=True):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if least[b[p : p + width]] < d:
                gone[p : p + width] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc_id, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), kept))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(1, 7)))
    shared = [" ".join(word() for _ in range(rng.randrange(9, 60))) for _ in range(12)]
    rows = []
    for i in range(140):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            s = rng.choice(shared)
            kind = rng.randrange(4)
            if kind == 0:
                parts.append(s)
            elif kind == 1:
                a = rng.randrange(len(s))
                parts.append(s[a : a + rng.randrange(30, 120)])
            elif kind == 2:
                a = rng.randrange(len(s))
                parts.append(s[:a] + word() + s[a + 1 :])
            else:
                parts.append(" ".join(word() for _ in range(20)))
        rows.append((rng.randrange(10_000) * 1000 + i, "".join(parts)))
    rows += [(3, "x" * 300), (4, "x" * 120 + "y" + "x" * 49), (9, "x" * 49), (11, "xy" * 200), (12, "yx" * 100), (13, None), (14, ""), (None, shared[0]), (rows[5][0], rows[5][1]), (rows[6][0], shared[1] + "!")]
    return rows


def test_same_bytes_go_as_by_all_windows(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(d, t, b"") for d, t in rows], "doc_id long, text string, kept binary").repartition(5)
    got = lambda: sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(df).collect()), key=str)
    want = brute(rows)
    assert got() == want
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(substrings, "PART_BYTES", 5000)
    assert got() == want
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_strings_that_may_share_a_window():
    rng = random.Random(11)
    some = lambda n: bytes(rng.choices(b"ab", k=n))
    common = [some(60), some(49)]
    strings = list({some(rng.randrange(14)) + rng.choice(common)[rng.randrange(8) :] + some(rng.randrange(14)) for _ in range(300)} | {some(70) for _ in range(50)})
    windows = [{s[p : p + 50] for p in range(len(s) - 49)} for s in strings]
    keep = substrings.may_share(strings)
    for i, w in enumerate(windows):
        assert keep[i] or not any(w & x for j, x in enumerate(windows) if j != i)
    # the time grows with the strings, not with the square of those that share a part
    many = [some(15) + common[0] + i.to_bytes(3, "big") for i in range(12_000)]
    began = time.process_time()
    assert substrings.may_share(many).all()
    assert time.process_time() - began < 10
