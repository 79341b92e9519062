import random

from pyspark.sql import functions as F

from gaugeloom.llm import components


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_chains_stars_and_hubs(spark, monkeypatch):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 140)] + [(5000, i) for i in range(5001, 5400)] + [(9000 + i, 8000) for i in range(300)]
    edges += [(rng.randrange(20_000, 20_400), rng.randrange(20_000, 20_400)) for _ in range(250)]
    want = brute([e for e in edges if e[0] != e[1]])
    for hubs in (500, 4):
        monkeypatch.setattr(components, "HUBS", hubs)
        got = components.components(spark.createDataFrame(edges, "a long, b long"))
        assert sorted(map(tuple, got.collect())) == sorted(want.items())
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_further_links_join_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    edges = [e for e in edges if e[0] != e[1]]
    more = [(rng.randrange(400), rng.randrange(400)) for _ in range(60)] + [edges[0], (900, 901), (901, 899)]
    comps = components.components(spark.createDataFrame(edges, "a long, b long"))
    got = components.merged(comps, spark.createDataFrame(more, "a long, b long"))
    want = brute([e for e in edges + more if e[0] != e[1]])
    assert sorted(map(tuple, got.collect())) == sorted(want.items())


def test_settled_buckets_are_not_read_again(spark, monkeypatch):
    # 400 buckets of two unlike ids, and one where three of four are linked in turn
    rows = [(k, 10 * k + i) for k in range(400) for i in (0, 1)] + [(-1, i) for i in (7001, 7002, 7003, 7004)]
    links = {(7001, 7002), (7002, 7003)}
    nodes = spark.createDataFrame(sorted({(i,) for _, i in rows}), "id long")
    sizes, asked = [], []

    def verify(pairs):
        got = [tuple(r) for r in pairs.collect()]
        asked.append(len(got))
        return spark.createDataFrame([p for p in got if p in links], "a long, b long")

    save = components.save
    monkeypatch.setattr(components, "save", lambda df: (sizes.append(df.count()) if "main" in df.columns else None, save(df))[1])
    comps = components.link(spark.createDataFrame(rows, "key long, id long"), nodes, lambda p, q: F.lit(True), verify)
    assert sorted(map(tuple, comps.collect())) == [(7001, 7001), (7002, 7001), (7003, 7001)]
    assert sizes[0] == 804 and all(n <= 4 for n in sizes[1:]) and sum(asked) == 405  # 7001 and 7003 are joined by then
