"""Operator 8, mixing sources to target weights, by iterative proportional fitting, in DataFrame functions only.

Documents fall into cells of source class x language class x topic. The tokens of the cells are raked: in turn,
each marginal is scaled to its target shares, until all three hold (ITERATIONS rounds, fixed). The ratio of raked
to own tokens is a cell's weight. Probabilities are weights times one scale, 1 at most, and the scale is such that
the expected tokens are KEEP of all; a cell that would have to repeat documents is kept whole instead, and the
scale makes up for it. A document is kept if a hash of its doc_id, spread over [0, 1), lies below its cell's
probability.

Only the table of cells reaches the driver, and is broadcast: its size is bounded by the targets' entries, as every
source or language that has no target of its own counts as `other`. A source that holds a third of all rows costs one
partial sum a task.

Tokens are the words between blanks and the signs on them, counted by what is left without these. The topic is the kind of
marks (licenses, tables, contacts) that a text has most of, if there is one in every RATE tokens, else prose.

Defined results: null source or language counts as `other`; null and empty texts have one token; categories that
no document falls into are left out and the other targets scaled up; if a cell can't reach its targets (the
categories present contradict each other) the last round stands; rows of one doc_id are kept or dropped together;
a null doc_id is hashed as the text `null`; an empty table gives no rows; other columns are not read by weights()
and kept by sample().
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

OTHER = "other"
ITERATIONS = 40

#: Share of all tokens that the sample is to have: a fifth may go to hold down a source that has too many.
KEEP = 0.8

#: Target shares of tokens: one source may have a fifth, the others the same each; half English, the rest to the others
#: alike; little that is no prose. What has no entry counts as `other`.
SOURCES = {"src0": 0.2} | {f"src{i}": 0.04 for i in range(1, 20)} | {OTHER: 0.04}
LANGS = {"en": 0.52, "de": 0.16, "fr": 0.16, "es": 0.15, OTHER: 0.01}
TOPICS = {"prose": 0.94, "table": 0.02, "legal": 0.02, "contact": 0.02}

#: Marks of the topics but prose, and the tokens that one of them may stand for at most.
MARKS = {"legal": ("icens", "opyright", "arrant", " CC BY"), "table": (" | ", "\t"), "contact": ("@", "+1 (", "://")}
RATE = 40

#: Each of these ends a word or is a token of its own.
SIGNS = " \t\n\r.,;:!?()[]{}<>|/\\\"'`*_#@%&=+-$^~"

Targets = tuple[Mapping[str, float], Mapping[str, float], Mapping[str, float]]
TARGETS: Targets = (SOURCES, LANGS, TOPICS)


def _class(value: Column, targets: Mapping[str, float]) -> Column:
    return F.when(value.isin([k for k in targets if k != OTHER]), value).otherwise(F.lit(OTHER))


def topic_of(text: Column) -> Column:
    """The topic whose marks are the most, the first of equals, if they are dense enough; else prose."""
    text = F.coalesce(text, F.lit(""))
    count = lambda m: (F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) / len(m)
    found = {topic: sum((count(m) for m in marks[1:]), count(marks[0])) for topic, marks in MARKS.items()}
    most = F.greatest(*found.values())
    out = F.when(most * RATE < tokens_of(text), "prose")
    for topic, n in found.items():
        out = out.when(n == most, topic)
    return out


def tokens_of(text: Column) -> Column:
    """One token, and one more for each blank or sign."""
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, SIGNS, "")) + 1).cast("long")


def spread(doc_id: Column) -> Column:
    """A number in [0, 1) from a hash of the doc_id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 7), 16, 10).cast("double") / float(1 << 28)


def rake(cells: dict[tuple[str, str, str], float], targets: Targets = TARGETS, rounds: int = ITERATIONS) -> dict[tuple[str, str, str], float]:
    """Shares of the cells after so many rounds over the three marginals."""
    total = sum(cells.values())
    share = {k: v / total for k, v in cells.items()}
    for _ in range(rounds):
        for i, target in enumerate(targets):
            now: dict[str, float] = {}
            for k, v in share.items():
                now[k[i]] = now.get(k[i], 0.0) + v
            there = sum(target.get(c, 0.0) for c in now)
            share = {k: v * (target.get(k[i], 0.0) / there) / now[k[i]] if there and now[k[i]] else 0.0 for k, v in share.items()}
    return share


def calibrate(cells: dict[tuple[str, str, str], float], weight: dict[tuple[str, str, str], float], keep: float = KEEP) -> float:
    """The scale at which the expected tokens, each cell's probability being 1 at most, are `keep` of all."""
    left, rest = keep * sum(cells.values()), sum(n * weight[k] for k, n in cells.items())
    for k in sorted(cells, key=lambda k: (-weight[k], k)):
        scale = left / rest if rest > 0 else 0.0
        if scale * weight[k] <= 1:
            return scale
        left, rest = left - cells[k], rest - cells[k] * weight[k]
    return 1 / min(w for w in weight.values() if w > 0)  # all cells whole


def classed(docs: DataFrame, targets: Targets = TARGETS) -> DataFrame:
    """doc_id, source_class, lang_class, topic, tokens of each document."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _class(F.col("source"), targets[0]).alias("source_class"),
        _class(F.col("lang"), targets[1]).alias("lang_class"), topic_of(text).alias("topic"), tokens_of(text).alias("tokens"),
    )


def probabilities(docs: DataFrame, targets: Targets = TARGETS, keep: float = KEEP) -> dict[tuple[str, str, str], tuple[float, float]]:
    """Weight and probability of each cell that has documents."""
    cells = {(r[0], r[1], r[2]): float(r[3]) for r in classed(docs, targets).groupBy("source_class", "lang_class", "topic").agg(F.sum("tokens")).collect()}
    if not cells:
        return {}
    total, share = sum(cells.values()), rake(cells, targets)
    weight = {k: share[k] * total / v for k, v in cells.items()}
    scale = calibrate(cells, weight, keep)
    return {k: (round(w, 9), round(min(1.0, scale * w), 9)) for k, w in weight.items()}


def _table(spark: SparkSession, found: dict[tuple[str, str, str], tuple[float, float]], names: list[str]) -> DataFrame:
    """The cells as a table of literals, with names for its five columns."""
    rows = ", ".join(f"({', '.join(map(_quoted, k))}, {v[0]!r}D, {v[1]!r}D)" for k, v in sorted(found.items())) or "('', '', '', 0D, 0D)"
    return spark.sql(f"VALUES {rows}").toDF(*names)


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def weights(docs: DataFrame, targets: Targets = TARGETS, keep: float = KEEP) -> DataFrame:
    """classed()'s rows with weight, probability and whether the document is kept."""
    cell = ["source_class", "lang_class", "topic"]
    cells = _table(docs.sparkSession, probabilities(docs, targets, keep), [*cell, "weight", "probability"])
    out = classed(docs, targets).join(F.broadcast(cells), cell).select("doc_id", *cell, "tokens", "weight", "probability")
    return out.withColumn("kept", spread(F.col("doc_id")) < F.col("probability"))


def sample(docs: DataFrame, targets: Targets = TARGETS, keep: float = KEEP) -> DataFrame:
    """The documents that are kept, with all their columns."""
    names = [fresh(docs, x) for x in ("source_class", "lang_class", "topic", "weight", "probability")]
    cells = _table(docs.sparkSession, probabilities(docs, targets, keep), names)
    own = _class(F.col("source"), targets[0]), _class(F.col("lang"), targets[1]), topic_of(F.col("text").cast("string"))
    rows = docs.withColumns(dict(zip(names, own))).join(F.broadcast(cells), names[:3])
    return rows.where(spread(F.col("doc_id").cast("long")) < F.col(names[4])).select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle_sql(targets: Targets = TARGETS, rounds: int = ITERATIONS, keep: float = KEEP) -> str:
    """weights() over `documents` in DuckDB's SQL."""
    names = ("source_class", "lang_class", "topic")
    lists = [", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in t.items()) for t in targets]
    own = lambda c, t: f"CASE WHEN {c} IN ({', '.join(repr(k) for k in t if k != OTHER)}) THEN {c} ELSE '{OTHER}' END"
    step = "SELECT n, source_class, lang_class, topic, w FROM fit WHERE n < " + str(rounds)
    for i, c in enumerate(names):
        step = f"SELECT a.n, a.source_class, a.lang_class, a.topic, a.w * (p.share / (SELECT sum(share) FROM p{i})) / sum(a.w) OVER (PARTITION BY a.{c}) AS w FROM ({step}) a JOIN p{i} p ON p.k = a.{c}"
    count = lambda m: f"(length(t) - length(replace(t, '{m}', ''))) / {len(m)}.0"
    marks = ", ".join(f"{' + '.join(map(count, m))} AS n_{topic}" for topic, m in MARKS.items())
    most = f"greatest({', '.join(f'n_{k}' for k in MARKS)})"
    topic = f"CASE WHEN {most} * {RATE} < tokens THEN 'prose'" + "".join(f" WHEN n_{k} = {most} THEN '{k}'" for k in MARKS) + " END"
    digits = " + ".join(f"(strpos('0123456789abcdef', substr(h, {i + 1}, 1)) - 1) * {16 ** (6 - i)}" for i in range(7))
    present = ", ".join(f"p{i} AS (SELECT t.k, t.share FROM (VALUES {lists[i]}) t(k, share) WHERE t.k IN (SELECT {names[i]} FROM cells))" for i in range(3))
    return f"""
        WITH RECURSIVE counted AS (
            SELECT *, {marks}, CAST(length(t) - length(translate(t, '{SIGNS.replace("'", "''")}', '')) + 1 AS BIGINT) AS tokens
            FROM (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents)),
        d AS (
            SELECT doc_id, {own('source', targets[0])} AS source_class, {own('lang', targets[1])} AS lang_class, {topic} AS topic, tokens,
                md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
            FROM counted),
        cells AS MATERIALIZED (SELECT source_class, lang_class, topic, CAST(sum(tokens) AS DOUBLE) AS own FROM d GROUP BY ALL),
        {present},
        fit AS (
            SELECT 0 AS n, source_class, lang_class, topic, own / sum(own) OVER () AS w FROM cells
            UNION ALL
            SELECT n + 1, source_class, lang_class, topic, w FROM ({step}) s),
        raked AS (SELECT source_class, lang_class, topic, w * (SELECT sum(own) FROM cells) / own AS weight, own FROM fit JOIN cells USING (source_class, lang_class, topic) WHERE n = {rounds}),
        sums AS (SELECT *, {keep!r}::DOUBLE * (SELECT sum(own) FROM cells) - coalesce(sum(own) OVER (ORDER BY weight DESC, source_class, lang_class, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS still,
            sum(own * weight) OVER (ORDER BY weight DESC, source_class, lang_class, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM raked),
        scale AS (SELECT still / rest AS f FROM sums WHERE still / rest * weight <= 1 ORDER BY weight DESC, source_class, lang_class, topic LIMIT 1),
        prob AS (SELECT source_class, lang_class, topic, round(weight, 9) AS weight, round(least(1, (SELECT f FROM scale) * weight), 9) AS probability FROM raked)
        SELECT doc_id, source_class, lang_class, topic, tokens, weight, probability, ({digits}) / {float(1 << 28)} < probability AS kept
        FROM d JOIN prob USING (source_class, lang_class, topic)"""
