"""Operator 6, license scans by template-markup matching.

A template is license wording with markup: [[ ... ]] may be missing, {{name:a:b}} stands for a to b words of any
kind, {{name:a:b:pattern}} for words that match the pattern. A template compiles into a token automaton whose
transitions read one word each. A text is accepted where a run of its words leads through the automaton: the
mandatory wording must stand there exactly, in order, with nothing between.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Beside the templates, phrases
with plain labels are searched for; their places count as they stand.

Defined results: null and empty texts have no words, no labels and score 0; overlapping places all count; of
several runs from one word the longest counts; repeated rows are treated each for itself; an empty table gives no
rows; other columns are not read. The score is the share of words that lie in a place or in an accepted run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Labels and the wording they ask for.
TEMPLATES = {
    "gpl-notice": "licensed under the [[terms of the]] GNU General Public License [[as published by the Free Software Foundation]] {{version:0:3}}",
    "gpl-version": "GNU General Public License [[as published by the Free Software Foundation either]] version {{version:1:1:[0-9]+}} [[or at your option any later version]]",
    "gpl-or-later": "you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation either version {{version:1:1:[0-9]+}} of the License or at your option any later version",
    "apache-notice": "Licensed under the Apache License Version {{version:1:1:[0-9]+}} [[0]] [[the License]]",
    "apache-header": "Licensed under the Apache License Version 2 0 the License you may not use this file except in compliance with the License [[You may obtain a copy of the License at {{url:1:8}}]] Unless required by applicable law or agreed to in writing software distributed under the License is distributed on an AS IS BASIS WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND either express or implied",
    "cc-by-notice": "licensed under [[a]] [[the]] CC BY [[{{element:1:2:nc|nd|sa}}]] [[{{version:1:1:[0-9]+}} 0]]",
    "cc-by-nc": "CC BY NC [[{{element:1:1:nd|sa}}]] {{version:1:1:[0-9]+}}",
    "cc-by-sa": "CC BY SA {{version:1:1:[0-9]+}}",
    "mit-notice": "[[released]] under the [[terms of the]] MIT License",
    "mit-text": "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the Software to deal in the Software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the Software and to permit persons to whom the Software is furnished to do so subject to the following conditions The above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the Software",
    "isc-text": "Permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-text": "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] Redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] Redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
}

_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased."""
    return raw.translate(_FOLDED).split()


@dataclass
class Automaton:
    """States are numbers; reads[s] are (word or pattern or None for any, next state), skips[s] needs no word."""

    reads: list[list[tuple[bytes | re.Pattern | None, int]]] = field(default_factory=list)
    skips: list[list[int]] = field(default_factory=list)
    last: int = 0

    def new(self) -> int:
        self.reads.append([])
        self.skips.append([])
        return len(self.reads) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def run(self, words: list[bytes], start: int) -> int:
        """The end of the longest accepted run from words[start], or -1."""
        states, best, i = self.closure({0}), -1, start
        while states:
            if self.last in states:
                best = i
            if i == len(words):
                break
            w = words[i]
            states = self.closure({t for s in states for on, t in self.reads[s] if on is None or (on == w if isinstance(on, bytes) else on.fullmatch(w))})
            i += 1
        return best if best > start else -1


_MARK = re.compile(r"\[\[|\]\]|\{\{[^}]*\}\}|[^\s\[\]{}]+")


def compile_template(text: str) -> Automaton:
    """The automaton of a template; ValueError where its markup doesn't close or is not known."""
    made, opened = Automaton(), []
    at = made.new()
    for mark in _MARK.findall(text):
        if mark == "[[":
            opened.append(at)
            inner = made.new()
            made.skips[at].append(inner)
            at = inner
        elif mark == "]]":
            if not opened:
                raise ValueError("]] without [[")
            after = made.new()
            made.skips[at].append(after)
            made.skips[opened.pop()].append(after)
            at = after
        elif mark.startswith("{{"):
            parts = mark[2:-2].split(":", 3)
            if len(parts) < 3:
                raise ValueError(f"{mark}: name, least and most number of words are needed")
            least, most = int(parts[1]), int(parts[2])
            on = re.compile(parts[3].encode()) if len(parts) > 3 else None
            after = made.new()
            for i in range(most):
                if i >= least:
                    made.skips[at].append(after)
                step = made.new()
                made.reads[at].append((on, step))
                at = step
            made.skips[at].append(after)
            at = after
        else:
            for word in words_of(mark.encode()):
                step = made.new()
                made.reads[at].append((word, step))
                at = step
    if opened:
        raise ValueError("[[ without ]]")
    made.last = at
    return made


class Scanner:
    """All templates and phrases; a template is tried only where the longest stretch of its mandatory wording can stand."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> None:
        self.phrases = [(b" %s " % p.encode(), len(p.split()), label) for p, label in phrases.items()]
        self.templates = []
        for label, text in templates.items():
            plain = re.sub(r"\{\{.*?\}\}", " \0 ", text)
            while "[[" in plain:  # innermost first
                plain = re.sub(r"\[\[[^\[\]]*\]\]", " \0 ", plain)
            sure = max((b" ".join(words_of(x.encode())) for x in plain.split("\0")), key=len)
            if not sure:
                raise ValueError(f"{label}: no mandatory wording")
            machine = compile_template(text)
            starts = {on for s in machine.closure({0}) for on, _ in machine.reads[s]}
            self.templates.append((label, b" %s " % sure, machine, starts if all(isinstance(x, bytes) for x in starts) else None))

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Number of words; places of phrases and accepted runs of templates as (first word, end, label)."""
        words = words_of(raw)
        line = b" %s " % b" ".join(words)
        base, runs = [], []
        for phrase, n, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                first = line.count(b" ", 0, at)
                base.append((first, first + n, label))
                at = line.find(phrase, at + 1)
        for label, sure, machine, starts in self.templates:
            if sure in line:
                end = 0
                for i, w in enumerate(words):
                    if i >= end and (starts is None or w in starts) and (stop := machine.run(words, i)) > 0:
                        runs.append((i, stop, label))
                        end = stop
        return len(words), sorted(base), sorted(runs)


_scanners: dict[str, Scanner] = {}
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, base and runs (first word, end, label of each place), score."""
    Scanner(templates, phrases)  # a fault in a template shows here, not in a task
    key = repr((templates, phrases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scanners:
            _scanners[key] = Scanner(templates, phrases)
        scanner = _scanners[key]
        for batch in slices(batches, limit=8 << 20):
            out = []
            for raw in texts_of(batch):
                n, base, runs = scanner.scan(raw)
                covered: set[int] = set()
                for first, end, _ in (*base, *runs):
                    covered.update(range(first, end))
                as_rows = lambda xs: [{"first": a, "end": b, "label": c} for a, b, c in xs]
                out.append((n, as_rows(base), as_rows(runs), len(covered) / n if n else 0.0))
            kinds = (pa.int64(), _SPANS, _SPANS, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], names=["doc_id", "n_words", "base", "runs", "score"])

    span = "array<struct<first:long,end:long,label:string>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, n_words long, base {span}, runs {span}, score double")


def digest(found: DataFrame) -> DataFrame:
    """scan()'s rows as counts, first and last place and joined labels."""
    labels = lambda *cs: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.col(f"{c}.label") for c in cs]))), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.first").alias("first_word"), F.array_max("base.first").alias("last_word"),
        labels("base").alias("base_labels"), labels("base", "runs").alias("labels"), "score",
    )
