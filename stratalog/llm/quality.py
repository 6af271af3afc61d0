"""Operator 2: document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded by counts that hashing needs no vocabulary for:
bytes, word lengths, hashed words, and how many of its words and word pairs the document had before. A learned layer maps the
encoding to h; gated attention, softmax over the passages of w . (tanh(V h) * sigmoid(U h)), weighs the passages; the weighted
sum of h goes through a logistic unit. All is trained from document labels alone, by Adam on the log loss.

Training is on the driver, from the encodings of at most ``TRAIN`` labelled documents (those with the least hash of their id,
so a rerun takes the same). Scoring runs on every passage of every text in the executors; the model is a few tens of kB.
Labels, lang, source and doc_id are never inputs of a score.

Defined cases: a null or empty text is one passage without words and is scored like any other; a document of any length is
scored on all its passages, in chunks of bounded size; a null doc_id counts as the text '' for the fold; a doc_id with several
labels takes the greatest; null labels are ignored; without labels of both kinds every score is the share of label 1 (0.5
without any); equal texts have equal scores; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import U, mix, text_chunks, word_hashes, words
from .shared import batch, bounded

PASSAGE, TRAIN, EPOCHS, WIDTH, GATE = 128, 4000, 12, 48, 24
BYTES, LENGTHS, HASHED, MORE = 144, 16, 96, 8
FEATURES = BYTES + LENGTHS + HASHED + MORE
ENCODED = pa.schema([("doc_id", pa.int64()), ("quality", pa.int64()), ("passages", pa.int32()), ("encoded", pa.binary())])
SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _seen(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether the document has had the value before."""
    key = mix(value ^ mix(doc.astype(U) + U(1)))
    out = np.ones(len(key), bool)
    out[np.unique(key, return_index=True)[1]] = False
    return out


def encode(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encodings of all passages (rows) and the passages of each document."""
    start, end, first = words(buf, offs)
    n_words = np.diff(first)
    n = np.maximum(1, -(-n_words // PASSAGE))
    base = np.concatenate(([0], np.cumsum(n)))
    doc = np.repeat(np.arange(len(n_words)), n_words)
    own = np.arange(len(start)) - first[doc]
    at = base[doc] + own // PASSAGE
    total, size = int(base[-1]), np.bincount(at, minlength=int(base[-1])).astype(np.float32)
    out = np.zeros((total, FEATURES), np.float32)
    if len(start):
        h, length = word_hashes(buf, start, end), end - start
        pair = np.zeros(len(h), U)
        pair[:-1] = mix(h[:-1] + mix(h[1:]))
        kind = np.where(buf < 128, buf, 128 + (buf & 15)).astype(np.int64)
        of_byte = np.repeat(at, length)
        inner = np.arange(len(of_byte)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(start, length)
        count = lambda rows, what, width: np.bincount(rows * width + what, minlength=total * width).reshape(total, width).astype(np.float32)
        by_byte = count(of_byte, kind[inner], BYTES)
        chars, many = np.maximum(by_byte.sum(1, keepdims=True), 1), np.maximum(size, 1)[:, None]
        out[:, :BYTES] = np.sqrt(by_byte / chars)
        out[:, BYTES : BYTES + LENGTHS] = count(at, np.minimum(length, LENGTHS) - 1, LENGTHS) / many
        out[:, BYTES + LENGTHS : BYTES + LENGTHS + HASHED] = np.sqrt(count(at, (h % U(HASHED)).astype(np.int64), HASHED) / many)
        last = buf[end - 1]
        tail = [
            np.bincount(at, _seen(doc, h), total) / many[:, 0],
            np.bincount(at, _seen(doc, pair) & (own < n_words[doc] - 1), total) / many[:, 0],
            np.bincount(at, (last < 128) & ~np.isin(last, np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,", np.uint8)), total) / many[:, 0],
            np.bincount(at, length == 1, total) / many[:, 0],
            chars[:, 0] / many[:, 0] / 10,
            np.bincount(at, (buf[start] >= 65) & (buf[start] <= 90), total) / many[:, 0],
        ]
        out[:, BYTES + LENGTHS + HASHED :][:, : len(tail)] = np.stack(tail, 1)
    out[:, -2] = np.log1p(size) / 5
    out[:, -1] = np.log1p(np.repeat(n_words, n)) / 10
    return out, n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class GatedAttention:
    """Parameters and their use; rows of x are passages, n the passages of each bag."""

    def __init__(self, features: int = FEATURES, width: int = WIDTH, gate: int = GATE, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        zero = lambda k: np.zeros(k, np.float32)
        self.mean, self.scale, self.share = zero(features), np.ones(features, np.float32), None
        self.p = {"W": draw(features, width), "b": zero(width), "V": draw(width, gate), "v": zero(gate), "G": draw(width, gate), "g": zero(gate), "w": draw(gate, 1)[:, 0], "c": draw(width, 1)[:, 0], "d": zero(1)}

    def forward(self, x: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        p, at = self.p, np.cumsum(n) - n
        h = np.tanh(x @ p["W"] + p["b"])
        a, g = np.tanh(h @ p["V"] + p["v"]), _sigmoid(h @ p["G"] + p["g"])
        e = (a * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), n))
        weight = e / np.repeat(np.add.reduceat(e, at), n)
        bag = np.add.reduceat(weight[:, None] * h, at)
        return {"h": h, "a": a, "g": g, "weight": weight, "bag": bag, "score": _sigmoid(bag @ p["c"] + p["d"][0])}

    def gradients(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f, at = self.p, self.forward(x, n), np.cumsum(n) - n
        d_logit = (f["score"] - y) / len(y)
        d_bag = np.repeat(d_logit[:, None] * p["c"], n, 0)
        d_h, d_weight = f["weight"][:, None] * d_bag, (f["h"] * d_bag).sum(1)
        d_e = f["weight"] * (d_weight - np.repeat(np.add.reduceat(f["weight"] * d_weight, at), n))
        d_gated = d_e[:, None] * p["w"]
        d_a, d_g = d_gated * f["g"] * (1 - f["a"] ** 2), d_gated * f["a"] * f["g"] * (1 - f["g"])
        d_h = (d_h + d_a @ p["V"].T + d_g @ p["G"].T) * (1 - f["h"] ** 2)
        return {"W": x.T @ d_h, "b": d_h.sum(0), "V": f["h"].T @ d_a, "v": d_a.sum(0), "G": f["h"].T @ d_g, "g": d_g.sum(0), "w": (f["a"] * f["g"]).T @ d_e, "c": f["bag"].T @ d_logit, "d": d_logit.sum(keepdims=True)}

    def fit(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 3e-3, group: int = 64, seed: int = 5) -> GatedAttention:
        if len(y) == 0 or y.min() == y.max():
            self.share = float(y.mean()) if len(y) else 0.5
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + np.float32(1e-3)
        x = (x - self.mean) / self.scale
        at, rng, t = np.cumsum(n) - n, np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = rng.permutation(len(n))
            for i in range(0, len(order), group):
                own = order[i : i + group]
                rows = np.concatenate([np.arange(at[k], at[k] + n[k]) for k in own])
                t += 1
                step = rate * (1 - 0.9 * epoch / epochs)
                for k, d in self.gradients(x[rows], n[own], y[own]).items():
                    d = d + np.float32(1e-4) * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                    self.p[k] = (self.p[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def scores(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Rounded, so that what a text is scored beside doesn't show."""
        if self.share is not None:
            return np.full(len(n), self.share)
        return np.round(self.forward((x - self.mean) / self.scale, n)["score"].astype(float), 5)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit(""))) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN) -> GatedAttention:
    """A model from at most most labelled documents outside the held-out fold."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").cast("long").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, buf, offs in text_chunks(b.column("text")):
                x, n = encode(buf, offs)
                cut = np.cumsum(n)
                yield batch(ENCODED, [b.column("doc_id")[a:z].to_pylist(), b.column("quality")[a:z].to_pylist(), n.astype(np.int32), [x[e - k : e].astype(np.float16).tobytes() for e, k in zip(cut, n, strict=True)]])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").mapInArrow(encoded, "doc_id long, quality long, passages int, encoded binary").collect()  # at most `most` documents
    rows.sort(key=lambda r: (r.doc_id, r.passages, r.encoded))
    x = np.concatenate([np.frombuffer(r.encoded, np.float16).reshape(r.passages, FEATURES) for r in rows] or [np.zeros((0, FEATURES), np.float16)]).astype(np.float32)
    return GatedAttention().fit(x, np.array([r.passages for r in rows], int), np.array([r.quality for r in rows], np.float32))


def score(docs: DataFrame, model: GatedAttention, keep: list[str] = ("doc_id",)) -> DataFrame:
    """keep and score for each row of docs (text)."""
    schema = docs.select(*keep).schema.add("score", "double")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.concatenate([model.scores(*encode(buf, offs)) for _, _, buf, offs in text_chunks(b.column("text"))] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.float64())], [*keep, "score"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(scored, schema)


def good(docs: DataFrame, model: GatedAttention, threshold: float = 0.5) -> DataFrame:
    """The rows of docs (text) with a score of threshold or more, with all their columns."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.concatenate([model.scores(*encode(buf, offs)) for _, _, buf, offs in text_chunks(b.column("text"))] or [np.zeros(0)])
            yield b.filter(pa.array(own >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bounded(spark).read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
