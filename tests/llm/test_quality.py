import random
import zlib

import numpy as np

from gaugeloom.llm import quality


def test_gradients_agree_with_differences():
    rng = np.random.Generator(np.random.PCG64(1))
    model = quality.AttentionMil()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, per_text, label = rng.standard_normal((9, quality.DIMS)) / 10, np.array([2, 3, 4]), np.array([0.0, 1.0, 1.0])

    def loss():
        y = model.forward(x, per_text)["y"]
        return -(label * np.log(y) + (1 - label) * np.log(1 - y)).mean()

    grads = model.gradients(x, per_text, label)
    for k, p in model.p.items():
        i = tuple(rng.integers(0, s) for s in p.shape)
        was = p[i]
        p[i] = was + 1e-5
        up = loss()
        p[i] = was - 1e-5
        down = loss()
        p[i] = was
        assert abs((up - down) / 2e-5 - grads[k][i]) < 1e-5, k


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        words = ["".join(rng.choices("etaoinshr", k=rng.randrange(2, 9))) for _ in range(rng.randrange(30, 300))]
        if not good:
            at = rng.randrange(0, max(1, len(words) - 60))
            words[at : at + 60] = [w.upper() + "!!" for w in words[at : at + 60]]
        rows.append((i, " ".join(words), 1.0))
        labels.append((i, int(good)))
    extra = [(1000, None, 1.0), (1001, "", 1.0), (None, "a b", 1.0), (1002, "x" * 200_000, 1.0), (5, rows[5][1], 1.0)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, score double")
    table = spark.createDataFrame([*labels, (None, 1), (7, None), (8, 5)], "doc_id long, quality int")
    got = quality.judge(docs, table).collect()
    assert len(got) == 605 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    truth = dict(labels)
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.9
    assert quality.judge(docs.limit(0), table).count() == 0
    assert {r.score for r in quality.judge(docs, table.limit(0)).collect()} == {0.5}


def test_all_labelled_documents_train_beside_an_oversized_one(spark):
    rows, keep = quality.thinned(np.array([100, 2, 5]), 15)
    assert keep.tolist() == [8, 2, 5] and rows.tolist() == [0, 12, 25, 37, 50, 62, 75, 87, 100, 101, 102, 103, 104, 105, 106]
    rows, keep = quality.thinned(np.array([4, 2, 5]), 11)
    assert keep.tolist() == [4, 2, 5] and rows.tolist() == list(range(11))
    assert quality.thinned(np.array([4, 2, 5]), 2)[1].tolist() == [1, 1, 1]
    rng = random.Random(6)
    text = lambda n, good: " ".join(w if good else w.upper() + "!!" for w in ("".join(rng.choices("etaoinshr", k=5)) for _ in range(n)))
    docs = [(i, text(20000 if i == min(j for j in range(99) if zlib.crc32(str(j).encode()) % 5) else 80, i % 2 == 0)) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i, _ in docs], "doc_id long, quality int")
    model = quality.train(df, labels, train_passages=300)
    got = model.score([t.encode() for _, t in docs])
    assert np.mean((got >= 0.5) == np.array([i % 2 == 0 for i, _ in docs])) >= 0.95
