"""Operator 1, packing: concatenate and cut.

Pass one tokenizes every document once and writes the ids with their place inside the partition. The totals of
the partitions, one number each, are summed up to base offsets. Pass two adds base and place, which gives each
document its global offset, and cuts at the multiples of the window; a document over a cut gives one boundary
record a window. No row is shuffled but the partition totals.

Defined results: null text is empty, so its document is the end id alone; an empty table gives no rows; rows
that repeat, also with the same doc_id, are packed each for itself; a very long text spans many windows; other
columns are never read. Order is that of the input files.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keeps, materialise, only, slices

WINDOW, END_ID = 2048, 1

#: A worker keeps the words of its last two generations of so many; a memory bound, results don't depend on it.
KNOWN_WORDS = 400_000

#: Characters on which this module's pattern surely agrees with the tokenizer's; other texts go to it whole.
_odd = re.compile(r"[^\x00-\x1b\x20-\x84\x86-\u024fΑ-ΡΣ-Ωα-ωА-я–-…€]").search
_CONTROLS = "\x1c\x1d\x1e\x1f"
_LETTERS = r"A-Za-zªµºÀ-ÖØ-öø-\u024fΑ-ΡΣ-Ωα-ωА-я"
_DIGITS = "0-9²³¹¼½¾"
#: The byte-level tokenizer's pattern over these characters; alternatives that can't start alike change places.
_split = re.compile(rf" ?[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_DIGITS}]+| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+").findall

_encoders: dict[str, "WordEncoder"] = {}
keeps("packing", _encoders.clear)


class WordEncoder:
    """Ids of a byte-level BPE tokenizer, each distinct pre-token encoded once.

    Merges never cross pre-tokens, so a text's ids are those of its pre-tokens put together.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.dtype = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        (self.newline,) = self.whole("\n")

    def whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned numbers of `dtype`."""
        words: list[list[str] | None] = []
        for text in texts:
            odd = any(c in text for c in _CONTROLS) if text.isascii() else _odd(text)
            words.append(None if odd or any(s in text for s in self.special) else _split(text))
        self.learn(set().union(*filter(None, words)))
        find = self.known.__getitem__
        return [np.array(self.whole(t), self.dtype).tobytes() if ws is None else b"".join(map(find, ws)) for t, ws in zip(texts, words)]

    def learn(self, words: set[str]) -> None:
        """Encode the words that aren't known."""
        if len(self.known) > KNOWN_WORDS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = words - known.keys()
        met = new & older.keys()
        known.update(zip(met, map(older.__getitem__, met)))
        new -= met
        space = set(filter(str.isspace, new))
        known.update((w, np.array(self.whole(w), self.dtype).tobytes()) for w in space)
        # a newline between words is a pre-token of its own, and no other word has its id
        rest = list(new - space)
        runs = [rest[i : i + 500] for i in range(0, len(rest), 500)]
        width = np.dtype(self.dtype).itemsize
        for run, found in zip(runs, self.tok.encode_batch_fast(["\n".join(r) for r in runs], add_special_tokens=False)):
            ids = np.array(found.ids, self.dtype)
            raw, ends = ids.tobytes(), width * np.flatnonzero(ids == self.newline)
            starts = [0, *(ends + width).tolist()]
            known.update(zip(run, [raw[a:b] for a, b in zip(starts, [*ends.tolist(), len(raw)], strict=True)], strict=True))


def encoder(path: str) -> WordEncoder:
    """The worker's encoder, kept from task to task."""
    only("packing")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenise(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, part, place (ids before it in its partition), n_ids, ids (little-endian u2 or u4, end id last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, place = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end, width = np.array([END_ID], encode.dtype).tobytes(), np.dtype(encode.dtype).itemsize
        for batch in slices(batches, limit=4 << 20):
            ids = [x + end for x in encode([t or "" for t in batch.column("text").to_pylist()])]
            n = [len(x) // width for x in ids]
            places = list(accumulate(n, initial=place))
            place = places.pop()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([part] * len(n), pa.int32()), pa.array(places, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "part", "place", "n_ids", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, part int, place long, n_ids long, ids binary")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, checksum: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (u4 little-endian), doc_tokens, sequence_id, offset, sequence_tokens.

    Sequences are gapless; only the last is shorter than the window and would be padded. With `checksum` the ids stay
    behind and ids_crc32 takes their place.
    """
    tokens = materialise(tokenise(docs, tokenizer), "tokens")
    totals = dict(tokens.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # one number a partition
    parts = sorted(totals)
    bases = dict(zip(parts, accumulate((totals[p] for p in parts), initial=0)))
    total = sum(totals.values())
    content, kind, sql = ("ids_crc32", pa.int64(), "long") if checksum else ("ids", pa.binary(), "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", content, "doc_tokens", "sequence_id", "offset", "sequence_tokens"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), kind, *[pa.int64()] * 4]
        give = zlib.crc32 if checksum else bytes
        for batch in slices(batches, "ids", 4 << 20):
            out = []
            for doc_id, part, place, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                ids = memoryview(raw if len(raw) == 4 * n else np.frombuffer(raw, "<u2").astype("<u4").tobytes())
                at, start = bases[part] + place, 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(window - offset, n - start)
                    out.append((doc_id, start, length, give(ids[4 * start : 4 * (start + length)]), n, sequence, offset, min(window, total - sequence * window)))
                    start += length
            columns = zip(*out) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return tokens.mapInArrow(run, f"doc_id long, start long, length long, {content} {sql}, doc_tokens long, sequence_id long, offset long, sequence_tokens long")


def crc_of(ids: list[int]) -> int:
    """What pack(checksum=True) gives for these ids."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())
