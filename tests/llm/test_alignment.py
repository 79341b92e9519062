import hashlib
import random
import time
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gaugeloom.llm import alignment

RANKS, MODEL = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    hidden = [x for x in range(256) if x not in shown]
    char = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}

    def tokens(text):
        if not text:
            return [], []
        ids = a.encode(" " + text, add_special_tokens=False).ids
        ta = [(i, bytes(char[c] for c in a.id_to_token(i))) for i in ids]
        tb = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            tb.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        data = (" " + text).encode()
        return (ta, tb) if b"".join(t for _, t in ta) == data == b"".join(t for _, t in tb) else ([], [])

    return tokens


def plain(rows, tokens):
    """Every pair of tokens is looked at."""
    docs = []
    for doc_id, text in rows:
        spans = []
        for side in tokens(text):
            at, own = 0, []
            for i, t in side:
                own.append((i, at, at + len(t)))
                at += len(t)
            spans.append(own)
        a, b = spans
        pairs = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        text = ";".join("|".join(",".join(str(i) for i, _, e in side if lo < e <= hi) for side in (a, b)) for lo, hi in zip([0, *ends], ends, strict=False))
        docs.append((doc_id, len(a), len(b), len(ends), pairs, text))
    count = Counter(p for d in docs for p in set(d[4]))
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return [(d, na, nb, ng, len(p), sum(count[x] == best[x[0]] for x in p), sum(count[x] for x in p), hashlib.sha256(t.encode()).hexdigest() if t else "") for d, na, nb, ng, p, t in docs]


TEXTS = [
    None, "", " ", "a", "The cat sat on the mat.\nIt sat.", "  leading and   inner blanks", "<|endoftext|> and <s> </s> <unk> <0x41> are text", "U+2581 ▁ here", "naïve café – “quotes” 日本語のテキスト 🙂🙃",
    "tab\tand\r\nlines\n\n\n", "3.14159 1,000,000 0x1F", "zero\x00byte", "donttokenizethisverylongword" * 3, "é", "‍️", "A" * 40, "....!!!!????",
]


def given(spark, rows):
    return spark.createDataFrame([(t, d, "x", 1, None) for d, t in rows], "text string, doc_id long, pairs string, ROW int, n_best string").repartition(3)


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("broadcast_pairs", [0, 10**6])
def test_equals_all_pairs(spark, both, broadcast_pairs):
    rng = random.Random(5)
    parts = [t for t in TEXTS if t]
    rows = [*enumerate(TEXTS), (None, "no id"), (3, "twice"), (3, "twice"), (4, "other text of one id")]
    rows += [(100 + i, "".join(rng.choice(parts)[: rng.randrange(1, 12)] + rng.choice(["", " "]) for _ in range(rng.randrange(1, 30)))) for i in range(40)]
    assert got(alignment.align(given(spark, rows), RANKS, MODEL, broadcast_pairs)) == sorted(plain(rows, both), key=repr)


def test_no_rows(spark):
    assert got(alignment.align(given(spark, []), RANKS, MODEL)) == []


def test_long_texts_take_time_in_proportion(spark):
    """Half a million tokens in a text, and one group that goes through a whole text."""
    word = "thereationing of "
    rows = [(1, word * 60_000), (2, "ab" * 3000), (3, "!" * 200_000), (4, "x" * 1500 + " y")]
    spark.range(1).count()
    began = time.time()
    found = {r["doc_id"]: r for r in alignment.align(given(spark, rows), RANKS, MODEL).collect()}
    assert time.time() - began < 90
    r = found[1]
    assert r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] and r["n_a"] > 200_000
    assert all(found[i]["n_a"] > 0 for i in (2, 3, 4))


def test_long_runs_are_found_without_reading_every_character():
    rng = random.Random(8)
    kinds = ["ab\u00e9\u4e2d", " \n\t", "0189", ".,_-"]
    for _ in range(3000):
        text = "".join("".join(rng.choices(rng.choice(kinds), k=rng.choice([1, 7, 19, 40]))) for _ in range(rng.randrange(20)))
        run = "".join(rng.choices(rng.choice(kinds), k=alignment.LONG_RUN + rng.randrange(-25, 25)))
        text = text + run + text[::-1]
        assert alignment.long_run(text) == bool(alignment._RUN.search(text))
    plain = " ".join(rng.choices(["word", "and", "numbers 12,"], k=200_000))
    began = time.process_time()
    assert not alignment.long_run(plain)
    fast = time.process_time() - began
    began = time.process_time()
    assert not alignment._RUN.search(plain)
    assert fast < 0.5 * (time.process_time() - began)
