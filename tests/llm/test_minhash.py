import random

import numpy as np

from gaugeloom.llm import minhash


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choices(words, k=120) for _ in range(12)]
    out = []
    for i in range(150):
        w = list(base[rng.randrange(12)])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out


def test_same_components_as_all_pairs(spark):
    rows = [(i * 3, t) for i, t in enumerate(texts())]
    rows += [(1, None), (2, ""), (4, " \t\n"), (5, "One two"), (7, "one  TWO"), (8, "one two three"), (10, "é É"), (11, "x " * 30000), (13, "X " * 30001)]
    df = spark.createDataFrame([(d, t, 9, "x") for d, t in rows], "doc_id long, text string, comp int, n_shingles string")
    got = sorted(tuple(r) for r in minhash.near_duplicates(df).collect())
    assert got == brute(rows)


def test_one_hot_bucket_of_unequal_copies(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(140)]
    rows = []
    for i in range(200):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 5, 8])):
            w[rng.randrange(140)] = f"r{rng.random()}"
        rows.append((i, " ".join(w)))
    got = sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_odd_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for n, other in ((10, 3), (150, 20), (4000, 900)):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.append(a[other:], rng.integers(0, 2**63, other, dtype=np.uint64))
        apart = sum(int(x).bit_count() for x in minhash.odd_sketch(a) ^ minhash.odd_sketch(b))
        assert apart <= len(np.setxor1d(a, b)) and (n > 200 or apart >= 0.9 * len(np.setxor1d(a, b)))


def test_few_pairs_of_unlinked_copies_are_compared(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        w = [f"b{j}" for j in range(140)]
        for j in rng.sample(range(0, 140, 10), rng.choice([1, 2, 2, 2])):
            w[j] = f"r{rng.random()}"
        rows.append((i, " ".join(w)))
    made, real = [], minhash.link

    def link(rows, nodes, near, verify, refine):
        def counted(pairs):
            good = verify(pairs)
            made.append((pairs.count(), good.count()))
            return good

        return real(rows, nodes, near, counted, refine)

    monkeypatch.setattr(minhash, "link", link)
    got = sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)
    assert len(made) > 1 and all(pairs <= 1.3 * good + 5 for pairs, good in made[1:]), made


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (9, "A b c d e f")], "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(3, 2, 3, True), (3, 2, 3, True), (None, 2, None, True), (9, 2, 3, False)], key=str)


def rows_of(spark, rows):
    return sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())


def test_texts_of_one_doc_id_link_each_for_itself(spark):
    """Whatever the order of the rows."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    a, b, c = ([word() for _ in range(80)] for _ in range(3))
    near = lambda w: " ".join([*w[:40], word(), *w[41:]])
    rows = [(3, " ".join(a)), (3, " ".join(b)), (9, near(a)), (12, near(b)), (2, " ".join(c)), (3, near(c)), (12, near(a)), (-5, " ".join(b)), (9, near(a))]
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: r[1])):
        assert rows_of(spark, order) == brute(order)


def test_clashing_ids_at_random(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(40), t) for t in texts()[:110]] + [(rng.randrange(40), None), (7, "")]
    assert rows_of(spark, rows) == brute(rows)


def test_a_task_hashes_few_texts_at_a_time():
    import pyarrow as pa

    texts = ["ab cd " * 50_000, None, "é ", "x " * 150_000, "", "y " * 150_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    out = list(minhash._signatures(iter([batch])))
    assert [b.column(0).to_pylist() for b in out] == [[0, 1, 2], [3, 4], [5]]
    assert [n for b in out for n in b.column(1).to_pylist()] == [2, 0, 1, 1, 0, 1]
