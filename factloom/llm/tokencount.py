"""Operator 10, token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a run of non-space characters with a word mark before it. Its tokens are the pieces of the
vocabulary that cover it at the best total score (unigram model: scores add up; a character that no piece covers
is one unknown token at a penalty below all scores). A BPE vocabulary holds the order in which its pieces were merged
and no probabilities: a piece's score is the logarithm of its share by Zipf's law in that order; nothing is trained. The distinct pre-tokens of a run of rows stand in a trie: in
sorted order a word shares its prefix with the one before it, so the forward scores of the prefix are those that
are there already, and only the rest is computed. The count at a word's last character is stored as its terminal.

A text's count is the sum of its pre-tokens' terminals. Words that a worker knows already are not computed again;
it forgets them beyond a bound, which changes no result.

Of two segmentations that score alike the one with fewer tokens counts, so counts don't depend on the order of
words. Defined results: null, empty and blank texts have no
tokens; repeated rows count each for itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keeps, only, slices

MARK = "▁"

#: A worker forgets its known words beyond this many.
KNOWN_WORDS = 400_000

_models: dict[str, "Pieces"] = {}
keeps("tokencount", _models.clear)


class Pieces:
    """Scores of a vocabulary and the counts of words met so far."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        lengths: dict[str, set[int]] = {}
        for p in filter(None, scores):
            lengths.setdefault(p[-1], set()).add(len(p))
        self.lengths = {c: sorted(n) for c, n in lengths.items()}  # of the pieces that end in a character
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.known: dict[str, tuple[int, float]] = {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Ordinary pieces of a sentencepiece BPE model, with the logarithms of their shares by rank."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
        ranked = sorted((-model.get_score(i), model.id_to_piece(i)) for i in ids)
        total = math.fsum(1 / (r + 1) for r in range(len(ranked)))
        return cls({p: -math.log((r + 1) * total) for r, (_, p) in enumerate(ranked)})

    def step(self, word: str, end: int, best: list[tuple[float, int]]) -> tuple[float, int]:
        """Best score and (negative) number of tokens of word[:end], given those of all shorter prefixes."""
        score, tokens = best[end - 1]
        found = score + self.unknown, tokens - 1
        scores = self.scores
        for n in self.lengths.get(word[end - 1], ()):
            if n > end:
                break
            start = end - n
            more = scores.get(word[start:end])
            if more is not None:
                score, tokens = best[start]
                if (new := (score + more, tokens - 1)) > found:
                    found = new
        return found

    def learn(self, words: Iterable[str]) -> None:
        """Compute the counts of words, each shared prefix once."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        best, last = [(0.0, 0)], ""
        for word in sorted({w for w in words if w not in self.known}):
            marked = MARK + word
            shared = 0
            for a, b in zip(marked, last):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :]
            for end in range(shared + 1, len(marked) + 1):
                best.append(self.step(marked, end, best))
            score, tokens = best[-1]
            self.known[word], last = (-tokens, score), marked


def model(path: str) -> Pieces:
    """The worker's model, kept from task to task."""
    only("tokencount")
    if path not in _models:
        _models[path] = Pieces.load(path)
    return _models[path]


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, score (sum of the segmentations' scores, six decimals)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in slices(batches, limit=4 << 20):
            counts = [Counter((t or "").split()) for t in batch.column("text").to_pylist()]
            pieces.learn({w for c in counts for w in c})
            known, out = pieces.known, []
            for c in counts:
                tokens = sum(known[w][0] * n for w, n in c.items())
                score = math.fsum(known[w][1] * n for w, n in c.items())
                out.append((sum(c.values()), tokens, round(score, 6)))
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], names=["doc_id", "n_pretokens", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, score double")
