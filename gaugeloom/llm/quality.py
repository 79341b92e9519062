"""Quality scores by attention-based multiple-instance learning over passages."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeloom.llm.shingles import BASE, BASE_INVERSE, BYTE_HASH, CHUNK, LOWER, SPACE, mix, powers, text_chunks

#: Words of a passage. Features: classes of bytes, hashed pairs of bytes, hashed words, and three more.
PASSAGE, CLASSES, PAIRS, WORDS = 64, 48, 160, 256
DIMS = CLASSES + PAIRS + WORDS + 3
EMBED, ATTEND = 32, 16
#: Labelled documents that training uses at most, and their passages.
TRAIN_DOCS, TRAIN_PASSAGES = 4000, 120_000

_CLASS = np.full(256, 0, np.int64)
_CLASS[0x80:0xC0], _CLASS[0xC0:] = 1, 2
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 3, 4, 5
for _i, _b in enumerate(b" \n\t\r!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _CLASS[_b] = 6 + _i


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features (passages, DIMS) of all passages of the texts, and how many each text has: one at least."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    buf = LOWER[raw]
    lengths = np.array([len(t) + 1 for t in texts])
    doc_start = np.cumsum(lengths) - lengths
    blank = SPACE[buf]
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    doc_of = np.searchsorted(doc_start, starts, side="right") - 1
    nth = np.arange(len(starts)) - np.searchsorted(starts, doc_start)[doc_of]
    begins = np.union1d(doc_start, starts[(nth % PASSAGE == 0) & (nth > 0)])
    n = len(begins)
    per_text = np.bincount(np.searchsorted(doc_start, begins, side="right") - 1, minlength=len(texts))
    of_byte = np.repeat(np.arange(n), np.diff(np.append(begins, len(buf))))
    size = np.bincount(of_byte, minlength=n).astype(np.float32)
    by_class = np.bincount(of_byte * CLASSES + _CLASS[raw], minlength=n * CLASSES).reshape(n, -1)
    pair = (buf[:-1].astype(np.uint32) * 257 + buf[1:]) * np.uint32(2654435761) >> np.uint32(16)
    by_pair = np.bincount(of_byte[:-1] * PAIRS + pair % PAIRS, minlength=n * PAIRS).reshape(n, -1)
    out = np.zeros((n, DIMS), np.float32)
    out[:, :CLASSES] = np.sqrt(by_class / size[:, None])
    out[:, CLASSES : CLASSES + PAIRS] = np.sqrt(by_pair / size[:, None])
    if len(starts):
        words = mix(np.add.reduceat(BYTE_HASH[buf] * powers(BASE, len(buf)), starts) * powers(BASE_INVERSE, len(buf))[starts])
        of_word = of_byte[starts]
        count = np.bincount(of_word, minlength=n).astype(np.float32)
        by_word = np.bincount(of_word * WORDS + (words >> np.uint64(56)).astype(np.int64), minlength=n * WORDS).reshape(n, -1)
        some = np.maximum(count, 1)
        out[:, CLASSES + PAIRS : -3] = np.sqrt(by_word / some[:, None])
        distinct = np.unique((words & ~np.uint64(0xFFFFFF)) ^ of_word.astype(np.uint64)) & np.uint64(0xFFFFFF)
        out[:, -3] = np.bincount(distinct.astype(np.int64), minlength=n)[:n] / some
        out[:, -2] = np.log1p(size / some)
        out[:, -1] = np.log1p(count)
    return out, per_text


class AttentionMil:
    """Embed each passage, weigh it by gated attention, and score the weighted mean of a document."""

    def __init__(self, seed: int = 3):
        rng = np.random.Generator(np.random.PCG64(seed))
        normal = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"W": normal(DIMS, EMBED), "V": normal(EMBED, ATTEND), "U": normal(EMBED, ATTEND), "w": normal(ATTEND, 1), "c": normal(EMBED, 1)}
        self.p |= {"b": np.zeros(1, np.float32), "d": np.zeros(EMBED, np.float32)}
        self.mean, self.scale = np.zeros(DIMS, np.float32), np.ones(DIMS, np.float32)

    def forward(self, x: np.ndarray, per_text: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        first = np.cumsum(per_text) - per_text
        of = np.repeat(np.arange(len(per_text)), per_text)
        e = np.tanh(x @ p["W"] + p["d"])
        t, g = np.tanh(e @ p["V"]), 1 / (1 + np.exp(-(e @ p["U"])))
        s = (t * g @ p["w"])[:, 0]
        a = np.exp(s - np.maximum.reduceat(s, first)[of])
        a = a / np.add.reduceat(a, first)[of]
        z = np.add.reduceat(a[:, None] * e, first)
        logit = (z @ p["c"])[:, 0] + p["b"][0]
        return {"e": e, "t": t, "g": g, "a": a, "z": z, "y": 1 / (1 + np.exp(-np.clip(logit, -30, 30))), "of": of, "first": first}

    def gradients(self, x: np.ndarray, per_text: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, per_text)
        by_logit = ((f["y"] - label) / len(label)).astype(np.float32)
        by_z = by_logit[:, None] * p["c"][:, 0]
        by_a = (by_z[f["of"]] * f["e"]).sum(1)
        by_s = f["a"] * (by_a - np.add.reduceat(f["a"] * by_a, f["first"])[f["of"]])
        by_gated = by_s[:, None] * p["w"][:, 0]
        by_v, by_u = by_gated * f["g"] * (1 - f["t"] ** 2), by_gated * f["t"] * f["g"] * (1 - f["g"])
        by_e = f["a"][:, None] * by_z[f["of"]] + by_v @ p["V"].T + by_u @ p["U"].T
        by_pre = by_e * (1 - f["e"] ** 2)
        return {
            "W": x.T @ by_pre, "d": by_pre.sum(0), "V": f["e"].T @ by_v, "U": f["e"].T @ by_u,
            "w": (f["t"] * f["g"]).T @ by_s[:, None], "c": f["z"].T @ by_logit[:, None], "b": by_logit.sum(keepdims=True),
        }

    def fit(self, x: np.ndarray, per_text: np.ndarray, label: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.003, decay: float = 1e-4, seed: int = 5) -> AttentionMil:
        self.mean, self.scale = x.mean(0), 1 / (x.std(0) + 0.02)
        x = (x - self.mean) * self.scale
        first = np.cumsum(per_text) - per_text
        rng = np.random.Generator(np.random.PCG64(seed))
        m, v, step = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(label))
            for s in range(0, len(order), batch):
                docs = order[s : s + batch]
                rows = np.concatenate([np.arange(first[d], first[d] + per_text[d]) for d in docs])
                step += 1
                now = rate * (1 - epoch / epochs)
                for k, grad in self.gradients(x[rows], per_text[docs], label[docs]).items():
                    grad = grad + decay * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad**2
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x, per_text = passages(texts)
        return np.round(self.forward((x - self.mean) * self.scale, per_text)["y"].astype(np.float64), 6)

    def to_bytes(self) -> bytes:
        np.savez(out := io.BytesIO(), mean=self.mean, scale=self.scale, **self.p)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> AttentionMil:
        model, found = cls(), np.load(io.BytesIO(data))
        model.mean, model.scale = found["mean"], found["scale"]
        model.p = {k: found[k] for k in model.p}
        return model


def held_out(doc_id: str) -> Column:
    """Rows that training never sees: those whose crc32(doc_id as text) is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def thinned(per_text: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the passages to train on, about ``most`` at most, and how many each text has of them.

    Every text keeps some: those with more passages than an equal share of what shorter ones leave keep that
    many, spread evenly. All stay where there are ``most`` or fewer.
    """
    size = np.sort(per_text)
    rest = most - np.append(0, np.cumsum(size)[:-1])
    share = rest // np.arange(len(size), 0, -1)
    over = np.flatnonzero(size > share)
    keep = np.minimum(per_text, max(1, share[over[0]])) if len(over) else per_text
    begin = np.cumsum(per_text) - per_text
    nth = np.arange(keep.sum()) - np.repeat(np.cumsum(keep) - keep, keep)
    return np.repeat(begin, keep) + nth * np.repeat(per_text, keep) // np.repeat(keep, keep), keep


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_passages: int = TRAIN_PASSAGES) -> AttentionMil | None:
    """A model from at most ``train_docs`` labelled documents, chosen by hash, that aren't held out; None where none has a label.

    Where they have more than ``train_passages`` passages, the longest train on fewer of theirs; see :func:`thinned`.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(train_docs)
    texts = docs.join(F.broadcast(chosen), docs["doc_id"] == F.col("id")).select("id", "label", docs["text"].cast("string").alias("text"))  # train_docs rows at most

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, _ = passages([(batch.column(2)[i].as_py() or "").encode()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([x.astype("<f2").tobytes()], pa.binary())], names=["id", "label", "x"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "x"]).drop_duplicates("id")
        per_text = pdf["x"].map(len).to_numpy() // (2 * DIMS)
        rows, per_text = thinned(per_text, train_passages)
        x = np.frombuffer(b"".join(pdf["x"]), "<f2").reshape(-1, DIMS)[rows].astype(np.float32)
        model = AttentionMil().fit(x, per_text, pdf["label"].to_numpy(np.float32))
        return pd.DataFrame({"model": [model.to_bytes()]})

    made = texts.mapInArrow(features, "id long, label int, x binary").groupBy().applyInPandas(fit, "model binary").collect()
    return AttentionMil.from_bytes(bytes(made[0]["model"])) if made else None


def scores(docs: DataFrame, model: AttentionMil | None) -> DataFrame:
    """``docs`` with a column score of each whole text: 0 to 1, higher where label 1 is likelier; 0.5 without a model."""
    data = model.to_bytes() if model else None
    names = [c for c in docs.columns if c != "score"]
    docs = docs.select(*names)
    at = names.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = AttentionMil.from_bytes(data) if data else None
        for batch in batches:
            found = [own.score(texts) if own else np.full(e - s, 0.5) for s, e, texts in text_chunks(batch, at, most=CHUNK)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())], names=[*names, "score"])

    schema = docs.schema
    return docs.mapInArrow(add, type(schema)([*schema.fields, *type(schema)().add("score", "double").fields]))


def judge(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted (1 where score >= ``least``).

    Only the text is scored. Null text is empty; an empty text is one passage without words. Labels other
    than 0 and 1, or without doc_id, are passed over; of several for a document the larger counts. Rows
    without doc_id aren't held out. Repeated rows are scored each. An empty table gives an empty result.
    """
    out = scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), train(docs, labels))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
