"""Aggregations over edges, capabilities, terms, pairs and memberships (A-01 to A-35, W-01, W-08 to W-11, T-03 to T-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import prefix_join

STATUSES = ["confirmed", "candidate", "unknown", "dynamic"]  # from best to worst


def status_rank(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATUSES]), status).cast("int")


def status_of(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATUSES]), rank.cast("int"))


def aggregate_edges(edges: DataFrame, source: str, target: str, kind: str, status: str, evidence: str, most: int = 24) -> DataFrame:
    """Weight, worst status and the first pieces of evidence of each (source, target, kind) (A-01, T-03)."""
    worst = F.max(status_rank(F.col(status)))
    return edges.groupBy(source, target, kind).agg(F.count("*").alias("weight"), status_of(worst).alias("status"), F.slice(F.array_sort(F.collect_set(evidence)), 1, most).alias("evidence"))


def status_counts(edges: DataFrame, by: str, status: str) -> DataFrame:
    """Edges of each status in a column of its own (A-04)."""
    return edges.groupBy(by).agg(*[F.sum(F.when(F.col(status) == s, 1).otherwise(0)).alias(s) for s in STATUSES])


def aggregate_relations(edges: DataFrame, status: str, order: Column, kind: str) -> DataFrame:
    """Weight and first status, in the given order, of relations between groups (A-03)."""
    return edges.groupBy("source_group", "target_group", kind).agg(F.count("*").alias("weight"), F.min_by(status, order).alias("status"))


def project_summary(files: DataFrame, language: str, size: str) -> DataFrame:
    """Files and bytes of each language and, with a null language, of all (A-02)."""
    return files.rollup(language).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))


def coverage(files: DataFrame, facts: DataFrame, file: str, language: str, flag: str) -> DataFrame:
    """Files, files with a fact, and facts with and without a flag, by language (A-05)."""
    by_file = facts.groupBy(file).agg(F.count("*").alias("__n"), F.sum(F.when(F.col(flag) == 1, 1).otherwise(0)).alias("__on"))
    rows = files.select(file, language).join(by_file, file, "left")
    return rows.groupBy(language).agg(F.count("*").alias("detected"), F.count("__n").alias("covered"), F.sum(F.coalesce("__n", F.lit(0))).alias("facts"), F.sum(F.coalesce("__on", F.lit(0))).alias("flagged"))


def capabilities(entrypoints: DataFrame, key: str, sets: dict[str, str]) -> DataFrame:
    """Entrypoints grouped by key into sorted sets (A-06)."""
    return entrypoints.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.array_sort(F.collect_set(c)).alias(name) for name, c in sets.items()])


def most_frequent(rows: DataFrame, by: str, value: str, smallest: bool = True) -> DataFrame:
    """The value that occurs most in each group; ties go to the smallest, or to the greatest (A-07, A-20)."""
    n = rows.groupBy(by, value).agg(F.count("*").alias("votes"))
    pick = F.min_by(value, F.struct(-F.col("votes"), F.col(value))) if smallest else F.max_by(value, F.struct("votes", value))
    return n.groupBy(by).agg(pick.alias(value), F.max("votes").alias("votes"))


def best_key(rows: DataFrame, by: str, key: str, leaf: Column) -> DataFrame:
    """The key with most segments, no leaf word if possible, then the smallest (A-08)."""
    segments = F.size(F.split(key, "/"))
    return rows.groupBy(by).agg(F.min_by(key, F.struct(-segments, F.when(leaf, 1).otherwise(0), F.col(key))).alias(key))


def tf_idf(terms: DataFrame, doc: str, term: str) -> DataFrame:
    """Weights of terms in documents: count over the document's largest count, times ln((N + 1) / (df + 1)) (A-09).

    Sums and maxima combine before the shuffle; N is a one-row aggregate.
    """
    tf = terms.groupBy(doc, term).agg(F.count("*").alias("n"))
    top = tf.groupBy(doc).agg(F.max("n").alias("top"))
    df = tf.groupBy(term).agg(F.count("*").alias("df"))
    total = top.agg(F.count("*").alias("total"))
    idf = df.crossJoin(F.broadcast(total)).select(term, F.log((F.col("total") + 1) / (F.col("df") + 1)).alias("idf"))  # one row
    return tf.join(top, doc).join(idf, term).select(doc, term, (F.col("n") / F.col("top") * F.col("idf")).alias("weight"))


def cosine_pairs(weights: DataFrame, doc: str, term: str, weight: str = "weight") -> DataFrame:
    """Cosine similarity of all pairs that share a term of non-zero weight, through the inverted index (A-10, J-18)."""
    w = weights.where(F.col(weight) != 0)
    norm = w.groupBy(doc).agg(F.sqrt(F.sum(F.col(weight) * F.col(weight))).alias("norm"))
    x = w.select(F.col(doc).alias("left_key"), term, F.col(weight).alias("wx"))
    y = w.select(F.col(doc).alias("right_key"), term, F.col(weight).alias("wy"))
    dot = x.join(y, term).where("left_key < right_key").groupBy("left_key", "right_key").agg(F.sum(F.col("wx") * F.col("wy")).alias("dot"))
    n = lambda k: norm.select(F.col(doc).alias(k), F.col("norm").alias(f"n_{k}"))
    both = dot.join(n("left_key"), "left_key").join(n("right_key"), "right_key")
    cos = F.least(F.greatest(F.col("dot") / (F.col("n_left_key") * F.col("n_right_key")), F.lit(0.0)), F.lit(1.0))
    return both.select("left_key", "right_key", cos.alias("lexical"))


def jaccard_pairs(sets: DataFrame, key: str, item: str) -> DataFrame:
    """Jaccard similarity of all pairs that share an item, through the inverted index (A-13); with a threshold,
    similar.similar_pairs() needs far fewer."""
    own = sets.select(key, item).distinct()
    size = own.groupBy(key).agg(F.count("*").alias("size"))
    x, y = own.select(F.col(key).alias("left_key"), item), own.select(F.col(key).alias("right_key"), item)
    met = x.join(y, item).where("left_key < right_key").groupBy("left_key", "right_key").agg(F.count("*").alias("shared"))
    n = lambda k: size.select(F.col(key).alias(k), F.col("size").alias(f"n_{k}"))
    both = met.join(n("left_key"), "left_key").join(n("right_key"), "right_key")
    return both.select("left_key", "right_key", (F.col("shared") / (F.col("n_left_key") + F.col("n_right_key") - F.col("shared"))).alias("resource"))


def pair_counts(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges between each unordered pair of groups, ends in one group dropped (A-11, A-12)."""
    return edges.where(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias("left_key"), F.greatest(a, b).alias("right_key")).agg(F.count("*").alias("n"))


def path_pairs(paths: DataFrame, key: str, path: str) -> DataFrame:
    """left_key, right_key, path (mean common prefix) and http (share of matching pairs) of all keys whose paths share a
    first segment, without a pair of paths in sight (A-14, A-15). paths: key, path, without repeats.

    Paths that share a prefix of some depth meet on it, counted by key, prefix and length first: a pair's common prefix
    is the number of depths at which it meets.
    """
    parts = F.split(path, "/")
    deep = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    counts = paths.select(F.col(key).alias("key"), F.size(parts).alias("length"), F.explode(deep).alias("prefix")).groupBy("key", "prefix", "length").agg(F.count("*").alias("n"))
    side = lambda df, s: df.select(*[F.col(c).alias(c if c == "prefix" else f"{s}_{c}") for c in df.columns])
    met = side(counts, "left").join(side(counts, "right"), "prefix").where("left_key < right_key")
    common = met.groupBy("left_key", "right_key").agg(F.sum(F.col("left_n") * F.col("right_n") / F.greatest("left_length", "right_length")).alias("common"))
    total = paths.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("all"))
    own = paths.select(F.col(key).alias("key"), F.col(path).alias("p"))
    match = prefix_join(own.select(F.col("key").alias("left_key"), F.col("p").alias("l")), own.select(F.col("key").alias("right_key"), F.col("p").alias("r")), "l", "r").where("left_key < right_key")
    match = match.groupBy("left_key", "right_key").agg(F.count("*").alias("matches"))
    both = common.join(match, ["left_key", "right_key"], "left").join(side(total, "left"), "left_key").join(side(total, "right"), "right_key")
    pairs = F.col("left_all") * F.col("right_all")
    return both.select("left_key", "right_key", (F.col("common") / pairs).alias("path"), (F.coalesce("matches", F.lit(0)) / pairs).alias("http"))


def combine(signals: dict[str, Column], weights: dict[str, float]) -> Column:
    """Signals weighted by weights that are scaled to add up to one (A-16)."""
    total = sum(weights.values())
    out = F.lit(0.0)
    for name, weight in weights.items():
        out = out + signals[name] * (weight / total)
    return out


def cluster_quality(pairs: DataFrame, members: DataFrame, item: str, cluster: str, similarity: str) -> DataFrame:
    """Mean similarity inside each cluster and one less the largest across (A-17); no pair counts as 0."""
    a = members.select(F.col(item).alias("left_key"), F.col(cluster).alias("cx"))
    b = members.select(F.col(item).alias("right_key"), F.col(cluster).alias("cy"))
    both = pairs.join(a, "left_key").join(b, "right_key")
    inside = both.where("cx = cy").groupBy(F.col("cx").alias(cluster)).agg(F.avg(similarity).alias("cohesion"))
    cross = both.where("cx != cy")
    across = cross.select(F.col("cx").alias(cluster), similarity).union(cross.select("cy", similarity)).groupBy(cluster).agg((1 - F.max(similarity)).alias("separation"))
    size = members.groupBy(cluster).agg(F.count("*").alias("members"))
    return size.join(inside, cluster, "left").join(across, cluster, "left").select(cluster, "members", F.coalesce("cohesion", F.lit(0.0)).alias("cohesion"), F.coalesce("separation", F.lit(1.0)).alias("separation"))


def cluster_confidence(members: Column, cohesion: Column, separation: Column, diversity: Column) -> tuple[Column, Column, Column, Column]:
    """overall, status, level and score of a cluster (A-18)."""
    overall = 0.4 * cohesion + 0.3 * separation + 0.3 * diversity
    sure = (members >= 2) & (overall >= 0.6) & (diversity >= 0.4) & (separation >= 0.3)
    status = F.when(sure, "confirmed").when(overall >= 0.3, "candidate").when(overall > 0, "ambiguous").otherwise("unknown")
    level = F.when(sure, "high").when(overall >= 0.3, "medium").when(overall > 0, "low").otherwise("none")
    return overall, status, level, F.round(overall * 100).cast("int")


def bucket_confidence(packets: Column) -> tuple[Column, Column, Column]:
    """status, level and score of a bucket by its packets: three and more, two, one (A-19).

    Two packets score 55 and stay candidates, as only 60 and more confirm; `ambiguous` can't occur.
    """
    status = F.when(packets >= 3, "confirmed").otherwise("candidate")
    level = F.when(packets >= 3, "high").otherwise("medium")
    return status, level, F.when(packets >= 3, 80).when(packets == 2, 55).otherwise(35)


def memberships(rows: DataFrame, unit: str, group: str, order: Column, score: str) -> DataFrame:
    """Per unit its first group, all groups, kind and best score (A-21)."""
    out = rows.groupBy(unit).agg(F.min_by(group, order).alias("domain_id"), F.array_sort(F.collect_set(group)).alias("domain_ids"), F.max(score).alias("score"))
    return out.withColumn("kind", F.when(F.size("domain_ids") > 1, "shared").otherwise("primary"))


def overlap_percent(a: Column, b: Column) -> Column:
    """Shared items in percent of the smaller set, whole numbers (A-24)."""
    less = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(less == 0, 0).otherwise(F.floor(100 * F.size(F.array_intersect(a, b)) / less)).cast("int")


def domain_signal(anchor: Column, confirmed: Column, touching: Column, specific: Column, confidence: Column, weights: tuple[int, int, int, int] = (400, 300, 200, 100)) -> Column:
    """Anchor, share of confirmed edges, share of specific tokens and confidence, weighted to 0 to 1000 (A-23)."""
    density = F.when(touching == 0, 0.0).otherwise(confirmed / touching)
    return F.round(weights[0] * anchor + weights[1] * density + weights[2] * specific + weights[3] * confidence).cast("long")


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group in an order (W-08, W-09, T-04, T-05)."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)


def first_of_group(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One representative a group: the first in an order (W-01, W-07, W-11), without a sort of the group."""
    keys = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(order)])
    return rows.groupBy(*by).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in by]), keys).alias("__row")).select(*by, "__row.*")


def domain_kind(key: Column, operational: Column, cross_cutting: list[str], library: Column) -> Column:
    """crossCutting by key, by operational members or in a library; else business (P-12)."""
    return F.when(key.isin(cross_cutting) | operational | library, "crossCutting").otherwise("business")


def domain_role(kind: Column, tokens: Column, generic: list[str], supported: Column) -> Column:
    """business, crossCutting, external, noise or unknown (P-13): a group of generic words without support is noise."""
    noise = (F.size(tokens) > 0) & F.forall(tokens, lambda t: t.isin(generic)) & ~supported
    return F.when(kind == "business", F.when(noise, "noise").otherwise("business")).when(kind.isin("crossCutting", "external"), kind).otherwise("unknown")


def feature_status(status: Column, unresolved: Column, dynamic: Column) -> Column:
    """A confirmed feature with unresolved or dynamic edges is a candidate; others stay (A-22)."""
    return F.when((status == "confirmed") & ((unresolved > 0) | (dynamic > 0)), "candidate").otherwise(status)
