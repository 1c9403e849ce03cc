"""Operator 3, quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes; every passage is encoded, whatever the length of the text. An
encoder maps a passage's measures (classes of characters, repetition, word shapes) to a vector h; gated attention
gives it the weight a ~ exp(w . (tanh(V h) * sigmoid(U h))), normalised over the document; the weighted mean of
the vectors is scored by a logistic unit. Labels belong to documents alone; which passages matter is learned.

The model is fitted on the driver from at most about SAMPLE labelled documents and BYTES of their texts, chosen by a
hash of the doc_id from the rows that the caller allows. Scoring reads whole texts; label, lang, source and doc_id are no inputs.

Defined results: null and empty texts have one empty passage and a score like any other; labels that are null,
or of documents that don't exist, are not used; a document with several labels counts by the largest,
one with several texts by the smallest in byte order; no usable labels, or only one kind, make
every score that kind's share (1 without any); repeated rows score alike; an empty table gives no rows; other columns
are not read by the scores and kept by keep_good().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, only, release, slices, texts_of

#: Labelled documents and bytes of texts that training may read, about; bytes of a passage; sizes of vector and attention; passes.
SAMPLE, BYTES, PASSAGE, WIDTH, GATE, PASSES, SEED = 4000, 32 << 20, 320, 16, 8, 250, 20262
LIMIT = 0.7

# classes of bytes: other punctuation, lower, upper, digit, space, newline, . , ! | # $ % & * - and non-ASCII
_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",", b"!?", b"|", b"#", b"$", b"%", b"&", b"*", b"-_=+", b"<>{}[]()/\\", b"\"'`;:", bytes(range(128, 256))], 1):
    _CLASS[list(_chars)] = _i
CLASSES = 19
SIZE = CLASSES + 8


def encode(raw: bytes) -> np.ndarray:
    """Measures of each passage of a text: one row a passage, at least one."""
    n = max(1, -(-len(raw) // PASSAGE))
    x = np.full(n * PASSAGE, 255, np.uint8)
    x[: len(raw)] = _CLASS[np.frombuffer(raw, np.uint8)]
    x = x.reshape(n, PASSAGE)
    length = np.full(n, PASSAGE)
    length[-1] = max(1, len(raw) - PASSAGE * (n - 1))
    out = np.empty((n, SIZE), np.float32)
    for c in range(CLASSES):
        out[:, c] = (x == c).sum(1) / length
    before: set[bytes] = set()
    for i in range(n):
        words = raw[i * PASSAGE : (i + 1) * PASSAGE].split()
        m = max(1, len(words))
        own = set(words)
        lines = raw[i * PASSAGE : (i + 1) * PASSAGE].split(b"\n")
        out[i, CLASSES:] = (
            len(own) / m,
            sum(map(bytes.__eq__, words, words[1:])) / m,
            len(own & before) / max(1, len(own)),
            len(words) / 64,
            sum(map(len, own)) / max(1, len(own)) / 10,
            max(map(len, words), default=0) / 40,
            len(set(lines)) / len(lines),
            length[i] / PASSAGE,
        )
        before = own
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Scaling of the measures and the parameters; without parameters every score is `share`."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray] | None
    share: float = 1.0

    def score(self, bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Score of each bag, and the attention weights of all passages in order."""
        sizes = np.array([len(b) for b in bags])
        if self.p is None:
            return np.full(len(bags), self.share), np.repeat(1 / sizes, sizes)
        x = (np.concatenate(bags) - self.mean) / self.scale
        return _forward(self.p, np.clip(x, -8, 8), sizes)[:2]


def _forward(p: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray) -> tuple:
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    bag = np.repeat(np.arange(len(sizes)), sizes)
    h = np.tanh(x @ p["E"] + p["e"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    s = (t * g) @ p["w"]
    a = np.exp(s - np.maximum.reduceat(s, first)[bag])
    a /= np.add.reduceat(a, first)[bag]
    z = np.add.reduceat(a[:, None] * h, first)
    return _sigmoid(z @ p["c"] + p["d"]), a, z, h, t, g, first, bag


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    score, a, z, h, t, g, first, bag = _forward(p, x, sizes)
    out = weight * (score - y)
    dz = out[:, None] * p["c"]
    da = (dz[bag] * h).sum(1)
    ds = a * (da - np.add.reduceat(a * da, first)[bag])
    dtg = ds[:, None] * p["w"]
    dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
    dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
    return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ out, "d": out.sum()}


def fit(texts: list[bytes], labels: list[int]) -> Model:
    """Parameters by full gradients (Adam)."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(SIZE), np.ones(SIZE), None, float(y.mean()) if len(y) else 1.0)
    bags = [encode(t) for t in texts]
    x = np.concatenate(bags)
    sizes = np.array([len(b) for b in bags])
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = np.clip((x - mean) / scale, -8, 8).astype(np.float64)
    rng = np.random.default_rng(SEED)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    p: dict[str, np.ndarray] = {"E": draw(SIZE, WIDTH), "e": np.zeros(WIDTH), "V": draw(WIDTH, GATE), "U": draw(WIDTH, GATE), "w": draw(GATE), "c": draw(WIDTH), "d": np.float64(0)}
    weight = np.full(len(y), 1 / len(y))
    m, v = ({k: np.zeros_like(q) for k, q in p.items()} for _ in range(2))
    for i in range(1, PASSES + 1):
        for k, q in _gradients(p, x, sizes, y, weight).items():
            q = q + 1e-5 * p[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * q, 0.99 * v[k] + 0.01 * q * q
            p[k] = p[k] - 0.03 * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)
    return Model(mean, scale, p)


def train(docs: DataFrame, labels: DataFrame, allowed: Column, sample: int = SAMPLE) -> Model:
    """A model from at most about `sample` documents with a label among those that `allowed` (over doc_id) admits."""
    marks = labels.where(allowed & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    share = min(1.0, sample / max(1, marks.count()))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(SEED)), F.lit(1 << 20)) / float(1 << 20)
    chosen = marks.where(draw < share).limit(2 * sample)  # twice the sample bounds the side that is broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    rows = materialise(rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")), "labelled")
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    got = sorted((k, q, bytes(t)) for k, q, t in rows.where(draw < share * min(1.0, BYTES / max(1, size))).collect())
    release(rows)
    return fit([t for _, _, t in got], [q for _, q, _ in got])


def _scores(model: Model, batch: pa.RecordBatch) -> np.ndarray:
    out = []
    raw = texts_of(batch)
    for at in range(0, len(raw), 256):
        out.append(model.score([encode(t) for t in raw[at : at + 256]])[0])
    return np.round(np.concatenate(out), 9) if out else np.empty(0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1, higher: better)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in slices(batches, limit=4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(model, batch))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, limit: float = LIMIT) -> DataFrame:
    """The documents that score `limit` or more, with all their columns, in one pass."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in slices(batches, limit=4 << 20):
            texts = pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])
            yield batch.filter(pc.greater_equal(pa.array(_scores(model, texts)), limit))

    return docs.mapInArrow(run, docs.schema)
