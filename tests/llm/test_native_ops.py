"""The URL filter, fingerprints, license scan, mix and cap filters on small tables with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from gaugeloom.llm import capfilter, licenses, mixing, spotsigs, urlfilter

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def judged(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow")


def test_urls(spark):
    rng = random.Random(1)
    urls = [None, "", "no scheme", "://", "http://", "http://com", "http://COM/", "x://a.b.com/en/?q#f", "http://example.com/en/x", "http://www.example.com/en/", "http://a.www.example.com/en/y", "http://xexample.com/en/", "http://net/es/1", "http://a.net/fr", "http://a.net/fr/", "http://e.com://x/", "é://é.net/es/", "http://a.com?/en/", "http://a.com#x", "http://a.net/es/\nb", "h://" + "a." * 5000 + "net/es/"]
    urls += [f"http://{'.'.join(rng.choices(['www', 'example', 'com', 'net', 'a'], k=rng.randrange(1, 5)))}/{rng.choice(['en', 'es', 'fr', 'x'])}{rng.choice(['', '/', '/1'])}" for _ in range(300)]
    df = spark.createDataFrame([(i, u, 7) for i, u in enumerate(urls)] + [(0, None, 7)], "page_id long, url string, host int")
    got = urlfilter.judge(df, RULES).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged(urls[r.page_id])
    assert urlfilter.judge(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in urlfilter.judge(df, []).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"k{i}" for i in range(3000)]
    listed = set(random.Random(4).sample(keys, 700))
    table = lambda ks: spark.createDataFrame([(k,) for k in sorted(ks)], "key string")
    c = urlfilter.Cascade.build(table(listed), table(keys), len(listed), len(keys))
    assert len(c.levels) >= 2
    df = table(keys)
    assert {r.key for r in df.where(c.holds(df.key)).collect()} == listed


def signatures(text):
    words = [w for w in re.split(r"[^\w]|_", text.lower()) if w]
    spots = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            after = [x for x in words[i + 1 : i + 1 + spotsigs.REACH] if x not in spotsigs.ANCHORS][: spotsigs.CHAIN]
            if after:
                spots.add(hashlib.md5(" ".join([w, *after]).encode()).hexdigest()[:8])
    return spots or {hashlib.md5(("=" + text).encode()).hexdigest()[:8]}


@pytest.mark.parametrize("ids_per_range", [1, 7, 1000])
def test_fingerprints(spark, ids_per_range, monkeypatch):
    rng = random.Random(2)
    words = [*spotsigs.ANCHORS, *(f"wört{i}" for i in range(40))]
    texts = {-5: "", 3: None, 4: "é", 5: "alone words here", 6: "😀" * 5 + " the of cat sat"}
    texts |= {i * i + 10: " ".join(rng.choices(words, k=rng.randrange(1, 80))) for i in range(60)}
    texts[10**12] = texts[10]
    df = spark.createDataFrame([(d, t, "x") for d, t in texts.items()], "doc_id long, text string, n_chars string")
    monkeypatch.setattr(spotsigs.with_next, "__defaults__", (ids_per_range,))
    got = {r.doc_id: r for r in spotsigs.fingerprints(df).collect()}
    order = sorted(texts, reverse=True)
    assert len(got) == len(texts)
    for at, d in enumerate(order):
        own, nxt = texts[d] or "", texts[order[(at + 1) % len(order)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + nxt[:half]
        r = got[d]
        a, b, n = signatures(own), signatures(edited), signatures(nxt)
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == "".join(sorted(a)) and r.edited_fingerprint == "".join(sorted(b))
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b)) and r.near_next == pytest.approx(len(a & n) / len(a | n))
    assert spotsigs.fingerprints(df.limit(0)).count() == 0


def test_fingerprints_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "the cat sat"), (1, "the cat sat"), (None, "of dogs ran"), (None, None)], "doc_id long, text string")
    assert spotsigs.fingerprints(df).count() == 4


def test_similar_pairs_are_those_of_all_pairs(spark):
    rng = random.Random(9)
    base = [[rng.choice([*spotsigs.ANCHORS[:20], *(f"w{i}" for i in range(30))]) for _ in range(60)] for _ in range(4)]
    texts = []
    for _ in range(40):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"v{rng.randrange(9)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [signatures(t) for t in texts]
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    reps = sorted(first.values())
    want = {(i, j) for i in reps for j in reps if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-12}
    assert {(r.a, r.b) for r in spotsigs.similar_pairs(df, 0.8).collect()} == want


def test_licenses(spark):
    fill = " ".join(f"w{i}" for i in range(500))
    rows = [(1, None), (2, ""), (3, f"{fill} Released under the MIT License. {fill}"), (4, "released UNDER the\nmit license"), (5, "released under mit license now"), (6, f"{fill} {licenses.TEMPLATES[4][1].replace('any person', 'every person')} {fill}"), (7, "x" * 100_000), (None, "Licensed under CC BY 4.0"), (8, f"Licensed under CC BY 4.0 {fill} Licensed under CC BY 4.0")]
    df = spark.createDataFrame([(d, t, 0.5) for d, t in rows], "doc_id long, text string, containment double")
    got = {(r.doc_id, r.license): r for r in licenses.scan(df).collect()}
    assert set(got) == {(3, "mit"), (4, "mit"), (6, "mit-grant"), (None, "cc-by-4.0"), (8, "cc-by-4.0")}
    assert got[(3, "mit")].containment == 1.0 and 0.8 <= got[(6, "mit-grant")].containment < 1
    assert licenses.scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(df, [("short", "too few words")])


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "b", "ä", None, "hot", "hot", "hot"])) for i in range(2000)]
    rows += [(9001, None, "a"), (9002, "", "void"), (9003, "w " * 50_000, "long"), (None, "w w w", "b"), (None, "w w", "b"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    for rows_per_range in (5000, 20):
        got = mixing.mix(df, rows_per_range=rows_per_range).collect()
        assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
        size, taken, target = {}, {}, {}
        for r in got:
            size[r.source] = size.get(r.source, 0) + r.size
            taken[r.source] = taken.get(r.source, 0) + r.taken
            target[r.source] = r.target
        assert all(r.source_size == size[r.source] for r in got)
        assert all(abs(taken[s] - target[s]) <= 2 for s in size)
        names = sorted((s for s in size if s is not None)) + [None]
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        want, open_, left = {}, set(names), 1.5 * sum(size.values())
        while open_:
            total = sum(weight[s] for s in open_)
            over = {s for s in open_ if left * weight[s] / total > 2 * size[s]}
            if not over:
                want |= {s: left * weight[s] / total for s in open_}
                break
            want |= {s: 2.0 * size[s] for s in over}
            left -= sum(2 * size[s] for s in over)
            open_ -= over
        assert target == pytest.approx(want)
    mixed = mixing.mix(df)
    words = sum(len((r.text or "").split()) for r in mixing.take(mixed).collect())
    assert words == sum(r.taken for r in mixed.collect())
    assert mixing.mix(df.limit(0)).count() == 0


def test_vectors(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    base = rng.standard_normal((30, 24))
    rows = []
    for i in range(400):
        v = base[rng.integers(30)] + rng.standard_normal(24) * rng.choice([0.0, 0.05, 0.12, 0.2])
        rows.append((i * 2, [float(x) for x in v.astype("f4")], int(rng.integers(2))))
    rows += [(1001, [float(x) * 1e30 for x in rows[0][1]], rows[0][2]), (1003, None, 1), (1005, [0.0] * 24, 1), (1007, [float("nan")] + [1.0] * 23, 1), (1009, [None] + [1.0] * 23, 1), (1011, rows[0][1], None), (1013, [1.0, 2.0], 1), (1015, [], 1), (1017, [float("inf")] * 24, 0)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    ok = [(i, np.array(x), l) for i, x, l in rows if x is not None and len(x) == 24 and l is not None and None not in x and np.isfinite(x).all() and np.any(x)]
    linked = {i: set() for i, _, _ in ok}
    for i, x, a in ok:
        for j, y, b in ok:
            if i != j and a == b and (x / np.linalg.norm(x)) @ (y / np.linalg.norm(y)) >= 0.98:
                linked[i].add(j)
    got = {r.vec_id: r for r in capfilter.near_vectors(df).collect()}
    assert len(got) == len(rows)
    have, want = sum(r.n_links for r in got.values()), sum(map(len, linked.values()))
    assert want > 1000 and 0.995 * want <= have <= want
    assert all(r.n_links <= len(linked.get(i, ())) and r.kept == (r.component_id == i) for i, r in got.items())
    assert capfilter.near_vectors(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.001], 1), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted((r.vec_id or 0, r.n_links) for r in capfilter.near_vectors(twice).collect()) == [(0, 0), (3, 2), (3, 2), (4, 2)]


def test_chains_of_near_vectors_are_one_component(spark):
    # each is near the next one only; of two large ids side by side neither is the other's least neighbour
    ids = [1, 10, 11, 2, 12, 13, 3, 14, 15, 4]
    rows = [(i, [float(np.cos(0.19 * k)), float(np.sin(0.19 * k))], 1) for k, i in enumerate(ids)]
    rows += [(i + 1000, x, 2) for i, x, _ in rows]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in capfilter.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    for k, i in enumerate(ids):
        n = 1 if k in (0, len(ids) - 1) else 2
        assert got[i] == (n, 1, i == 1) and got[i + 1000] == (n, 1001, i == 1)


def test_components_of_a_cell():
    rng = np.random.Generator(np.random.PCG64(3))
    for n, share in ((1, 0.5), (2, 0.5), (40, 0.02), (40, 0.05), (300, 0.003)):
        linked = np.triu(rng.random((n, n)) < share, 1)
        linked |= linked.T
        want = np.arange(n)
        for _ in range(n):
            want = np.where(linked | np.eye(n, dtype=bool), want, n).min(1)
        assert np.array_equal(capfilter._first_reached(linked), want)
    place = rng.permutation(500)  # a chain in any order
    linked = np.zeros((500, 500), bool)
    linked[place[1:], place[:-1]] = linked[place[:-1], place[1:]] = True
    assert not capfilter._first_reached(linked).any()


def test_unequal_vectors_of_one_id_count_each(spark):
    rows = [(1, [1.0, 0.0, 0.0], 1), (1, [0.0, 1.0, 0.0], 1), (2, [1.0, 0.01, 0.0], 1), (3, [1.0, 0.0, 0.01], 1), (4, [0.0, 1.0, 0.01], 1)]
    got = sorted((r.vec_id, r.n_links) for r in capfilter.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1), (1, 2), (2, 2), (3, 2), (4, 1)]


def test_each_vector_has_filters_and_near_ones_share_some():
    rng = np.random.Generator(np.random.PCG64(17))
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal(a.shape)
    b -= (b * a).sum(1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    for n in (2000, 50000):
        code = capfilter.code_for(64, n)
        own, other = code.decode(a), code.decode(b)
        assert min(map(len, own)) >= 28
        assert sum(len(np.intersect1d(x, y)) > 0 for x, y in zip(own, other, strict=True)) >= 0.998 * len(a)


def test_near_vectors_of_few_dimensions_and_at_the_threshold(spark):
    rng = np.random.Generator(np.random.PCG64(23))
    angle = rng.permutation(1500) * (2 * np.pi / 1500)  # each is near those of 11.48 degrees on both sides
    flat = np.stack([np.cos(angle), np.sin(angle)], 1)
    ties = [(90_000, [1.0, 0.0, 0.0, 0.0], 2), (90_001, [49.0, 9.0, 3.0, 3.0], 2), (90_002, [49.0, 9.0, 3.0, 3.01], 2), (90_003, [0.0, 7.0, 0.0, 0.0], 3), (90_004, [3.0, 49.0, 9.0, 3.0], 3)]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(flat)] + ties
    got = {r.vec_id: r.n_links for r in capfilter.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert {got[i] for i in range(1500)} == {94}
    assert [got[i] for i, _, _ in ties] == [1, 2, 1, 1, 1]
    assert capfilter._shared(capfilter.code_for(8, 10**6), 8, 0.98, 99).min() > 0


def test_columns_of_any_name_stay(spark):
    from gaugeloom.llm import lines

    names = ["epochs", "cut_key", "_key", "key", "plan", "row", "a.b", "Taken", "removed", "_id", "text_hash", "line"]
    rows = [(1, "a b c d e f", "s", *range(len(names))), (2, "a b c d e f", "s", *range(len(names)))]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    mixed = mixing.mix(df)
    assert mixed.columns == ["doc_id", "text", "source", *(n for n in names if n != "Taken"), "size", "source_size", "target", "taken"]
    assert sum(r.taken for r in mixed.collect()) == 18 and mixed.first()["a.b"] == 6
    once = lines.dedup_lines(df)
    assert once.columns == ["doc_id", "text", "source", *names, "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.text, r.removed, r.n_removed) for r in once.collect()) == [(1, "a b c d e f", 8, 0), (2, "", 8, 1)]


def test_ranges_hold_rows_of_sparse_and_clustered_ids(spark):
    import random

    rng = random.Random(9)
    ids = [rng.randrange(-(2**63), 2**63) for _ in range(1500)] + list(range(10_000, 11_500)) + [None] * 800
    rng.shuffle(ids)
    texts = {i: f"text the {i} of words and {rng.random()}" for i in ids if i is not None}
    rows = [(i, texts.get(i, f"no id {n}")) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    most = spotsigs.in_ranges(df, 100).groupBy("range").count().agg({"count": "max"}).first()[0]
    assert most <= 300
    got = {r.doc_id: r.edited_sha256 for r in spotsigs.fingerprints(df).collect() if r.doc_id is not None}
    order = sorted(texts, reverse=True)
    for i, j in zip(order, order[1:], strict=False):
        n = len(texts[i])
        assert got[i] == hashlib.sha256((texts[i][: n - n // 2] + texts[j][: n // 2]).encode()).hexdigest()
    assert len(got) == len(order)
