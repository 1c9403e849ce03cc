"""Naming by an injected callable: prompts, responses, merging and retries (S-21, S-22, V-03 to V-09, G-10).

No network is used: `call` is any function from prompt to text, run in the workers, one chunk at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as X

KEYS = ("domains", "features")


def prompt(instructions: str, columns: list[str]) -> F.Column:
    """Instructions and a row as JSON (V-07)."""
    return F.concat(F.lit(instructions + "\n"), F.to_json(F.struct(*columns)))


def _strings(value: object) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for v in value.values():
            yield from _strings(v)
    elif isinstance(value, list):
        for v in value:
            yield from _strings(v)


def parse_response(text: str | None) -> dict | None:
    """The last object in a response that has `domains` or `features`: plain JSON, JSON lines, fenced text, or such a
    text inside of a string of any of them; null if there is none (S-22)."""

    def tries(raw: str) -> Iterator[object]:
        yield from (m[1] for m in re.finditer(r"```(?:json)?\s*\n(.*?)```", raw, re.S))
        yield raw
        yield from reversed(raw.splitlines())
        first, last = raw.find("{"), raw.rfind("}")
        if 0 <= first < last:
            yield raw[first : last + 1]

    todo, seen = [text or ""], set()
    while todo:
        raw = todo.pop()
        if raw in seen or len(seen) > 1000:
            continue
        seen.add(raw)
        for part in tries(raw):
            try:
                value = json.loads(part)
            except (ValueError, RecursionError):
                continue
            if isinstance(value, dict) and any(k in value for k in KEYS):
                return value
            todo += [s for s in _strings(value) if "{" in s]
    return None


def ask(chunks: DataFrame, call: Callable[[str], str], limit: int = 700_000) -> DataFrame:
    """chunk_id, id, label, summary, canonical, error: suggestions for chunks (chunk_id, prompt).

    A prompt above the limit, a call that raises, and a response that can't be read give an error row.
    """
    schema = "chunk_id string, id string, label string, summary string, canonical string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for chunk, text in zip(pdf["chunk_id"], pdf["prompt"]):
                if len(text.encode()) > limit:
                    rows.append((chunk, None, None, None, None, "the prompt is too long"))
                    continue
                try:
                    found = parse_response(call(text))
                except Exception as e:  # whatever a connector raises is this chunk's error
                    rows.append((chunk, None, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                items = [x for k in KEYS for x in (found or {}).get(k) or [] if isinstance(x, dict) and x.get("id")]
                rows += [(chunk, str(x["id"]), x.get("label"), x.get("summary"), x.get("canonical"), None) for x in items]
                if found is None:
                    rows.append((chunk, None, None, None, None, "no JSON with domains or features"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype(object)

    return chunks.select("chunk_id", "prompt").mapInPandas(run, schema)


def merge(suggestions: DataFrame, known: DataFrame, most: int = 120) -> tuple[DataFrame, DataFrame]:
    """Accepted rows (id, label, summary, canonical), first valid one of each known id, and warnings (V-03 to V-05).

    Labels must be one line of at most `most` characters. Canonical ids are followed to their end; cycles end at their
    smallest id.
    """
    own = known.select(F.col("id").alias("__id")).distinct()
    rows = suggestions.where("id is not null").join(own, F.col("id") == F.col("__id"), "left")
    valid = F.col("label").isNotNull() & (F.length(F.trim("label")) > 0) & (F.length("label") <= most) & ~F.col("label").rlike(r"[\r\n]")
    good = rows.where(F.col("__id").isNotNull() & valid).groupBy("id").agg(F.min_by(F.struct("label", "summary", "canonical"), F.struct("chunk_id", "label")).alias("s")).select("id", "s.*")
    why = F.when(F.col("__id").isNull(), "unknown id").when(~F.coalesce(valid, F.lit(False)), "bad label")
    warnings = rows.withColumn("warning", why).where("warning is not null").select("id", "warning").union(suggestions.where("error is not null").select("chunk_id", "error"))
    targets = good.join(own.select(F.col("__id").alias("t")), F.col("canonical") == F.col("t"), "left").select("id", F.col("t").alias("canonical"))
    ends = X.canonical(targets, "id", "canonical")
    return good.drop("canonical").join(ends, "id"), warnings


def review(chunks: DataFrame, known: DataFrame, call: Callable[[str], str], again: Callable[[DataFrame], DataFrame] | None = None, rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """ask() and merge(), and up to `rounds` more for ids without an answer (V-06, V-09); again: missing ids to chunks."""
    answers = X.cut(ask(chunks, call))
    accepted, warnings = merge(answers, known)
    for _ in range(rounds if again else 0):
        missing = known.join(accepted.select("id"), "id", "left_anti")
        if missing.isEmpty():
            break
        answers = X.cut(answers.unionByName(ask(again(missing), call)))
        accepted, warnings = merge(answers, known)
    return accepted, warnings
