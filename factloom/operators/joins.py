"""Joins with precedence, spans, nearest and prefix conditions (J-01 to J-31).

All of them are equi joins at heart, so they shuffle by hash and AQE can split hot keys: precedence is a tagged
union, intervals meet through fixed-width bins, prefixes through the exploded shorter paths.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def priority_join(left: DataFrame, rungs: Sequence[tuple[Column, DataFrame, str]], key: str, target: str) -> DataFrame:
    """Candidates of the first rung that has any: key, priority, targets, status (J-01).

    A rung is (expression over left, table, its key column); the table's `target` column is the candidate. One
    target is `confirmed`, several `candidate`, none `unknown`.
    """
    tried = None
    for i, (on, table, column) in enumerate(rungs):
        side = table.select(F.col(column).alias("__on"), F.col(target).alias("__target"))
        found = left.select(F.col(key).alias("__key"), on.alias("__on")).join(side, "__on").select("__key", F.lit(i).alias("priority"), "__target")
        tried = found if tried is None else tried.unionByName(found)
    sets = tried.groupBy("__key", "priority").agg(F.array_sort(F.collect_set("__target")).alias("targets"))
    best = sets.groupBy("__key").agg(F.min(F.struct("priority", "targets")).alias("best"))
    out = left.select(key).join(best, F.col(key) == F.col("__key"), "left")
    n = F.size("best.targets")
    status = F.when(F.col("best").isNull(), "unknown").when(n == 1, "confirmed").otherwise("candidate")
    return out.select(key, F.col("best.priority").alias("priority"), F.coalesce("best.targets", F.array().cast(sets.schema["targets"].dataType)).alias("targets"), status.alias("status"))


def suffixes(name: Column, separator: str = "::", least: int = 2) -> Column:
    """Every proper suffix of a qualified name with at least `least` parts, for names of three parts or more (J-02)."""
    parts = F.split(name, separator)
    n = F.size(parts)
    made = F.transform(F.sequence(F.lit(2), n - least + 1), lambda i: F.array_join(F.slice(parts, i, n), separator))
    return F.when(n >= 3, made).otherwise(F.slice(parts, 1, 0))


def unique_binding(bindings: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Bindings all of whose rows agree on one target (J-03, J-27)."""
    return bindings.groupBy(*keys).agg(F.min(target).alias(target), F.max(target).alias("__other")).where(F.col(target) == F.col("__other")).drop("__other")


def bin_join(points: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with all spans [start, end] of the same `on` that cover them; numbers only.

    Spans are cut into bins of `width`, so each pair meets in exactly one bin and none is compared with the whole
    group.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    cut = spans.withColumn("__bin", F.explode(F.sequence(cell(start), cell(end))))
    return points.withColumn("__bin", cell(at)).join(cut, [*on, "__bin"]).where(F.col(at).between(F.col(start), F.col(end))).drop("__bin")


def latest_stab(points: DataFrame, spans: DataFrame, on: list[str], point: str, at: str, span: str, start: str, end: str, width: int) -> DataFrame:
    """For each point the latest-starting covering span, the smaller end winning ties, then the smaller id (J-06)."""
    pick = F.min_by(span, F.struct(-F.col(start), F.col(end), F.col(span)))
    met = bin_join(points.select(*on, point, at), spans.select(*on, span, start, end), on, at, start, end, width)
    return met.groupBy(*on, point).agg(pick.alias(span))


def _edges(rows: DataFrame, on: list[str], bucket: Column, when: str, first: bool) -> DataFrame:
    """on, __b, __edge: for each bucket of time that has rows, the first time after it, or the last one before it.

    It is computed from one row a bucket, so an owner with very many rows is no single task's work.
    """
    own = rows.groupBy(*on, bucket.alias("__b")).agg((F.min if first else F.max)(when).alias("__t"))
    order = Window.partitionBy(*on).orderBy("__b")
    frame = order.rowsBetween(1, Window.unboundedFollowing) if first else order.rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("__edge", (F.first if first else F.last)("__t", True).over(frame)).drop("__t")


def next_asof(points: DataFrame, marks: DataFrame, on: list[str], at: str, when: str, value: str, tolerance: Column | None = None, width: int = 1 << 10) -> DataFrame:
    """points with the first mark after `at` (strictly), optionally within a tolerance (J-07). Times are numbers.

    One window over both sides within buckets of `width`, and the first mark of a later bucket for points that have none
    in their own: no range join, and the rows of one owner are spread over its buckets.
    """
    cell = F.floor(F.col("__t") / width)
    cols, kind = points.columns, dict(points.dtypes)
    left = points.select(*cols, F.col(at).alias("__t"), F.lit(1).alias("__side"))
    times = marks.select(*on, F.col(when).alias("__t")).distinct()
    right = times.select(*[F.col(c).alias(c) if c in on else F.lit(None).cast(kind[c]).alias(c) for c in cols], "__t", F.lit(0).alias("__side"))
    both = left.unionByName(right).withColumn("__b", cell)
    mark = F.when(F.col("__side") == 0, F.col("__t"))
    # at equal times marks sort first, so a point sees only later ones
    order = Window.partitionBy(*on, "__b").orderBy("__t", "__side").rowsBetween(1, Window.unboundedFollowing)
    inside = both.withColumn("__in", F.first(mark, True).over(order)).where("__side = 1")
    later = _edges(both.withColumn("__m", mark), on, F.col("__b"), "__m", True)
    out = inside.join(later, [*on, "__b"], "left").select(*cols, F.coalesce("__in", "__edge").alias("__next"))
    best = marks.groupBy(*on, F.col(when).alias("__next")).agg(F.min(value).alias(value))
    out = out.join(best, [*on, "__next"], "left").withColumnRenamed("__next", when)
    if tolerance is not None:
        near = (F.col(when) - F.col(at)) <= tolerance
        out = out.withColumn(value, F.when(near, F.col(value))).withColumn(when, F.when(near, F.col(when)))
    return out


def innermost(inner: DataFrame, outer: DataFrame, on: list[str], a: str, b: str, strict: bool = True, width: int | None = None) -> DataFrame:
    """For each row of `inner` the smallest span of `outer` of the same `on` that contains it (J-05, J-08).

    Both have columns id, start, end. What contains a span contains its start, so the spans are found through bins of
    `width` (by default the mean length of the outer spans), never by all pairs of an owner.
    """
    if width is None:
        mean = outer.agg(F.avg(F.col("end") - F.col("start"))).head()[0]
        width = max(1, int(mean or 1))
    x = inner.select(*on, F.col("id").alias(a), F.col("start").alias("__s"), F.col("end").alias("__e"))
    y = outer.select(*on, F.col("id").alias(b), F.col("start").alias("__os"), F.col("end").alias("__oe"))
    held = bin_join(x, y, on, "__s", "__os", "__oe", width).where("__e <= __oe")
    if strict:
        held = held.where("not (__os = __s and __oe = __e)")
    return held.groupBy(*on, a).agg(F.min_by(b, F.struct(F.col("__oe") - F.col("__os"), F.col(b))).alias(b))


def path_prefixes(path: Column) -> Column:
    """The path and all its leading parts, `/a`, `/a/b` and so on."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    n = F.size(parts)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array(path))


def prefix_join(left: DataFrame, right: DataFrame, l: str, r: str) -> DataFrame:
    """Pairs whose paths are equal or one the other's leading segments, as equi joins (J-14, J-17)."""
    up = left.withColumn("__on", F.explode(path_prefixes(F.col(l)))).join(right.withColumn("__on", F.col(r)), "__on")
    down = left.withColumn("__on", F.col(l)).join(right.withColumn("__on", F.explode(path_prefixes(F.col(r)))), "__on")
    return up.unionByName(down.where(F.col(l) != F.col(r))).drop("__on")


def keep_visible(rows: DataFrame, visible: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose owner is visible (J-10)."""
    return rows.join(visible.select(F.col(key).alias(column)).distinct(), column, "left_semi")


def repair(edges: DataFrame, units: DataFrame, target: str, key: str) -> DataFrame:
    """Edges to a target that vanished keep their row, lose the target and become unknown, unless dynamic (J-11).

    Edges whose owner vanished go before, by keep_visible().
    """
    known = units.select(F.col(key).alias("__id")).distinct()
    hit = edges.join(known, F.col(target) == F.col("__id"), "left")
    lost = F.col("__id").isNull() & F.col(target).isNotNull()
    status = F.when(lost & (F.col("status") != "dynamic"), "unknown").otherwise(F.col("status"))
    return hit.withColumn("status", status).withColumn(target, F.when(~lost, F.col(target))).drop("__id")


def unassigned(units: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Units in no group (J-12)."""
    return units.join(members.select(key).distinct(), key, "left_anti")


def nearest(points: DataFrame, marks: DataFrame, on: list[str], point: str, at: str, when: str, value: str, width: int = 1 << 10) -> DataFrame:
    """For each point the mark of the same `on` at the least distance; ties go to the smaller value (J-22).

    Two scans of one window find the mark before and the one after within buckets of `width`; what lies in other buckets
    comes from one row a bucket. No pairs are built, and the rows of one owner are spread over its buckets.
    """
    marks = marks.groupBy(*on, when).agg(F.min(value).alias(value))
    a = points.select(*on, F.col(point).alias("__p"), F.col(at).cast("double").alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(dict(marks.dtypes)[value]).alias("__v"))
    b = marks.select(*on, F.lit(None).cast(dict(points.dtypes)[point]).alias("__p"), F.col(when).cast("double").alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"))
    mark = F.when(F.col("__side") == 0, F.struct(F.col("__t").alias("t"), F.col("__v").alias("v")))
    order = Window.partitionBy(*on, "__b").orderBy("__t", "__side")
    both = a.unionByName(b).withColumn("__b", F.floor(F.col("__t") / width))
    both = both.withColumn("__before", F.last(mark, True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    both = both.withColumn("__after", F.first(mark, True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    marked = both.withColumn("__m", mark)
    back = _edges(marked, on, F.col("__b"), "__m", False).withColumnRenamed("__edge", "__back")
    ahead = _edges(marked, on, F.col("__b"), "__m", True).withColumnRenamed("__edge", "__ahead")
    met = both.where("__side = 1").join(back, [*on, "__b"], "left").join(ahead, [*on, "__b"], "left")
    met = met.withColumn("__before", F.coalesce("__before", "__back")).withColumn("__after", F.coalesce("__after", "__ahead"))
    down, up = F.col("__t") - F.col("__before.t"), F.col("__after.t") - F.col("__t")
    first = up.isNull() | (down < up) | ((down == up) & (F.col("__before.v") <= F.col("__after.v")))
    return met.select(*on, F.col("__p").alias(point), F.when(F.col("__before").isNotNull() & first, F.col("__before.v")).otherwise(F.col("__after.v")).alias(value))


def relation_edges(edges: DataFrame, members: DataFrame, source: str, target: str, unit: str, group: str) -> DataFrame:
    """Edges between groups: both ends replaced by all their groups, pairs within one group dropped (J-13)."""
    a = members.select(F.col(unit).alias(source), F.col(group).alias("source_group"))
    b = members.select(F.col(unit).alias(target), F.col(group).alias("target_group"))
    return edges.join(a, source).join(b, target).where("source_group != target_group")


def relative_module(imports: DataFrame, files: DataFrame, target: str, path: str, endings: Sequence[str]) -> DataFrame:
    """The first existing file among a target's candidates, in the order of `endings` (J-20)."""
    tried = imports.select("*", F.posexplode(F.array(*[F.concat(F.col(target), F.lit(e)) for e in endings])).alias("__ord", "__try"))
    met = tried.join(files.select(F.col(path).alias("__try")).distinct(), "__try")
    return met.groupBy(*imports.columns).agg(F.min_by("__try", "__ord").alias("resolved"))


def applicable(files: DataFrame, detections: DataFrame, file: str, language: str, framework: str) -> DataFrame:
    """A file's framework: the one with evidence in it, else the only one detected for its language (J-21)."""
    local = detections.where(F.col(file).isNotNull()).groupBy(file).agg(F.min(framework).alias("__local"))
    alone = detections.groupBy(language).agg(F.countDistinct(framework).alias("__n"), F.min(framework).alias("__only")).where("__n = 1")
    return files.join(local, file, "left").join(alone, language, "left").select(*files.columns, F.coalesce("__local", "__only").alias(framework))
