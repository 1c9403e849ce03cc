"""Operator 9, language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over hashed byte n-grams predicts whether
the language's bit is set. Decoding adds up, over the bits, the logistic loss between the predicted margin and a
codeword's bit, weighted by how far the bit's classifier beats chance on its training rows; the language of the
least loss is chosen, and the row is flagged as ambiguous when the runner-up is near.

Up to seven languages get the exhaustive code (all splits in two), more get random codewords of
15 * ceil(log2 K) bits with the seed below, redrawn until no two rows are alike.

Training learns every language. It reads at most about SAMPLE rows a language, TOTAL rows (but LEAST a language) and
BYTES of texts, chosen by a hash of the doc_id, from the rows that the caller allows; scoring reads whole texts. Inputs of a prediction are the text's bytes alone.

Defined results: a null text or one without a letter is `und` with score 0; an empty training set makes every
prediction `und`; a single language is always chosen, with score 1; repeated rows score alike; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Rows a language, rows and bytes in all, that training may read, about, and rows that a language has at least;
#: hashed n-gram features; passes; step; seed.
SAMPLE, TOTAL, BYTES, LEAST, BUCKETS, PASSES, STEP, SEED = 1500, 6000, 64 << 20, 8, 1 << 13, 40, 20.0, 20261

#: Bytes that are no letters count as one space: ASCII but for letters, A-Z lower-cased.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1."""
    if k == 1:
        return np.ones((1, 1))
    if k <= 7:
        rest = range(1, k)
        splits = [c for n in range(1, k) for c in combinations(rest, n)]  # those on the other side of language 0
        return np.array([[-1.0 if i in c else 1.0 for c in splits] for i in range(k)])
    rng, bits = np.random.default_rng(SEED), 15 * math.ceil(math.log2(k))
    while True:
        code = rng.choice([-1.0, 1.0], (k, bits))
        if len(np.unique(code, axis=0)) == k and (np.abs(code.sum(0)) < k).all():
            return code


def features(raw: bytes) -> np.ndarray:
    """Square roots of the counts of hashed byte bigrams and trigrams over letters, of length one."""
    x = np.frombuffer(b" " + b" ".join(raw.translate(_LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    two = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] ^ x[2:] * np.uint32(0xC2B2AE35) + np.uint32(0x27D4EB2F)
    half = BUCKETS // 2
    count = np.empty(BUCKETS, np.float32)
    count[:half] = np.bincount((two ^ two >> 15) * np.uint32(0x2C1B3C6D) >> 20, minlength=half)[:half]
    count[half:] = np.bincount((three ^ three >> 15) * np.uint32(0x2C1B3C6D) >> 20, minlength=half)[:half]
    np.sqrt(count, out=count)
    return count / max(float(np.sqrt((count * count).sum())), 1e-9)


@dataclass
class Model:
    """Languages, their code, the bits' classifiers (weights, offsets) and the weights of the bits' losses."""

    langs: list[str]
    code: np.ndarray
    w: np.ndarray
    c: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its probability, its lead over the next."""
        margin = x @ self.w + self.c
        # log(1 + exp(-m)) for a bit that is set; m more for one that is not
        loss = (np.logaddexp(0, -margin) @ self.trust)[:, None] + (margin * self.trust) @ ((1 - self.code) / 2).T
        like = np.exp(loss.min(1, keepdims=True) - loss)
        like /= like.sum(1, keepdims=True)
        order = np.sort(like, 1)
        lead = order[:, -1] - order[:, -2] if like.shape[1] > 1 else np.ones(len(like))
        return loss.argmin(1), like.max(1), lead


def fit(texts: list[bytes], langs: list[str]) -> Model:
    """Logistic regression for each bit, all bits at once, by full gradients with momentum; rows weigh so that each
    language counts alike."""
    names = sorted(set(langs))
    code = codewords(max(1, len(names)))
    if len(names) < 2:
        return Model(names, code, np.zeros((BUCKETS, 1), np.float32), np.zeros(1), np.ones(1))
    x = np.stack([features(t) for t in texts])
    place = {v: i for i, v in enumerate(names)}
    y = np.array([place[v] for v in langs])
    weight = (1 / np.bincount(y)[y] / len(names)).astype(np.float32)
    target = code[y].astype(np.float32)
    w, c = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    speed_w, speed_c = np.zeros_like(w), np.zeros_like(c)
    for _ in range(PASSES):
        pull = weight[:, None] * target / (1 + np.exp(np.clip(target * (x @ w + c), -30, 30)))
        speed_w = 0.9 * speed_w + STEP * (x.T @ pull - 1e-5 * w)
        speed_c = 0.9 * speed_c + 0.1 * STEP * pull.sum(0)
        w, c = w + speed_w, c + speed_c
    right = (weight[:, None] * (np.sign(x @ w + c) == target)).sum(0)
    trust = np.maximum(right - 0.5, 1e-3)
    return Model(names, code, w, c, trust / trust.mean())


def train(docs: DataFrame, allowed: Column, sample: int = SAMPLE) -> Model:
    """A model from at most about `sample` allowed rows a language (rows whose hash falls under sample / rows); of a
    language whose rows all miss their share, the row of the smallest hash."""
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(SEED)), F.lit(1 << 20)) / float(1 << 20)
    rows = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", draw.alias("draw"), F.col("text").cast("binary").alias("text"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"), F.min("draw").alias("low"))
    sizes = sizes.collect()  # a row a language, as the model has
    if not sizes:
        return fit([], [])
    sample = min(sample, max(LEAST, TOTAL // len(sizes)))
    held = sum(min(1.0, sample / s.n) * s.size for s in sizes)
    limits = [(s.lang, max(min(1.0, sample / s.n) * min(1.0, BYTES / max(1, held)), s.low)) for s in sizes]
    limits = docs.sparkSession.createDataFrame(limits, "lang string, most double")
    chosen = rows.join(F.broadcast(limits), "lang").where("draw <= most").select("lang", "text").limit(2 * sample * len(sizes))
    got = sorted((lang, bytes(text)) for lang, text in chosen.collect())
    return fit([t for _, t in got], [v for v, _ in got])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous (the lead over the next language is under 0.2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in slices(batches, limit=8 << 20):
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                known = np.array([bool(model.langs) and any(map(str.isalpha, t)) for t in texts], bool)
                lang, score, lead = [None] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                if known.any():
                    x = np.stack([features(t.encode()) for t, k in zip(texts, known) if k])
                    if len(model.langs) > 1:
                        best, score[known], lead[known] = model.decode(x)
                    else:
                        best, score[known], lead[known] = np.zeros(len(x), int), 1.0, 1.0
                    for i, b in zip(np.flatnonzero(known), best):
                        lang[i] = model.langs[b]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([v or "und" for v in lang], pa.string()), pa.array(np.round(score, 9)), pa.array(lead < 0.2)],
                    names=["doc_id", "lang_pred", "score", "ambiguous"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
