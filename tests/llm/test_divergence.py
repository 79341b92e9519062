import random
import re
from collections import Counter, defaultdict

import pytest

from gaugeloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, VALUE string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    kept = {lang: [t for t, n in c.items() if n >= least] for lang, c in docs.items()}
    share = lambda c, terms: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in terms) + 5 * len(terms)) for t in terms}
    out = []
    for lang, source in groups:
        terms, own = kept[lang], counts[lang, source]
        p = share(own, terms)
        q = share(sum((counts[g] for g in groups if g[0] == lang), Counter()), terms)
        pairs = []
        for other in {g[1] for g in groups if g[0] == lang} - {source}:
            o = share(counts[lang, other], terms)
            pairs.append((sum(abs(p[t] - o[t]) for t in terms), other))
        leading = [(p[t] - q[t], t) for t in terms if own[t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", leading)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i) for i, (value, item) in enumerate(found, 1) if part == "pair" or i <= top]
    return sorted(out)


def found(spark, rows, **how):
    return sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(3), **how).collect())


@pytest.mark.parametrize("shard_rows", [1, 10, 50_000])
def test_equals_plain_counts(spark, shard_rows):
    rng = random.Random(shard_rows)
    words = ["The", "the", "mango", "É", "é", "ßa", "a_b", "x1y", "z", "kiwi", "日本", "\U0001f600", "'quote'"]
    rows = []
    for i in range(120):
        text = rng.choice([" ", "\n", "-"]).join(rng.choice(words) for _ in range(rng.randrange(12)))
        rows.append((i % 100, rng.choice([text, text, text, None, ""]), rng.choice(["en", "en", "fr", None, ""]), rng.choice(["a", "b", "B", "é", None]), "x", 1, None))
    rows += rows[:9]
    rows.append((7, "lone", "xx", "a", None, None, None))
    rows.append((8, "mango " * 20_000, "en", "hot", None, None, None))
    assert found(spark, rows, least_docs=6, top=3, shard_rows=shard_rows) == plain(rows, 6, 3)


def test_languages_without_kept_terms_have_pairs_of_value_0(spark):
    rows = [(1, "one", "en", "a", None, None, None), (2, None, "en", "b", None, None, None), (3, None, None, None, None, None, None)]
    assert found(spark, rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_no_rows(spark):
    assert found(spark, []) == []


def test_large_counts_stay_exact(spark):
    """A share of over 2 ** 63 / 1e9 occurrences doesn't fit in 64 bits before it is divided."""
    import pyarrow as pa

    rows = [("g", "en", "a", "", 3 * 10**10, 2), ("g", "en", "b", "", 10, 2), ("t", "en", "a", "x", 2 * 10**10, 0), ("t", "en", "a", "y", 10**10, 0), ("t", "en", "b", "x", 10, 0)]
    given = pa.Table.from_pylist([dict(zip(("kind", "lang", "source", "term", "n", "v"), r, strict=True)) for r in rows])
    got = divergence._query(divergence._COMPARE.format(top=5), given, ["part", "item", "value"]).to_pylist()
    p = [1 + 10**9 * (n + 5) // (total + 10) for n, total in ((2 * 10**10, 3 * 10**10), (10**10, 3 * 10**10), (10, 10), (0, 10))]
    assert {"part": "pair", "item": "b", "value": abs(p[0] - p[2]) + abs(p[1] - p[3])} in got
