"""Closure, bounded search, trees, components and pointers over edge tables (G-01 to G-07, G-10, G-11).

Cyclic graphs are walked semi-naively: each round joins only what is new and drops what is known. The lineage is
cut every round by checkpoint(), in the folder of spark.checkpoint.dir, so lost executors can't undo earlier rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir


def cut(df: DataFrame) -> DataFrame:
    """df, computed and checkpointed."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def _shortcuts(hop: DataFrame, nodes: int) -> DataFrame:
    """Edges with all hops of 2, 4, 8, ... steps, while a level has at most four times the edges (chains and rings)."""
    edges, out, cur, steps = hop.count(), hop, hop, 1
    while 2 * steps < nodes:
        far = cur.select(F.col("mid").alias("to"), F.col("to").alias("far"))
        cur = cut(cur.join(far, "to").select("mid", F.col("far").alias("to")).distinct())
        steps *= 2
        n = cur.count()
        if not 0 < n <= 4 * edges:
            break
        out = out.unionByName(cur)
    return cut(out.distinct())


def reach(edges: DataFrame, source: str, target: str, starts: DataFrame | None = None, patience: int = 6) -> DataFrame:
    """All (source, target) with a path, each node reaching itself (G-01, G-07).

    Only from `starts` (a column named as `source`), else from all nodes. Rounds end when nothing is new. A graph that
    takes more than `patience` rounds gets shortcuts, so long chains and rings take logarithmically many.
    """
    hop = cut(edges.select(F.col(source).alias("mid"), F.col(target).alias("to")).where("mid is not null and to is not null").distinct())
    both = hop.select(F.col("mid").alias("s")).union(hop.select("to")).distinct()
    nodes = both if starts is None else starts.select(F.col(source).alias("s")).distinct()
    seen = cut(nodes.select("s", F.col("s").alias("t")))
    new, rounds = seen, 0
    while True:
        far = new.join(hop, new.t == hop.mid).select("s", F.col("to").alias("t")).distinct()
        new = cut(far.join(seen, ["s", "t"], "left_anti"))
        if new.isEmpty():
            return seen.select(F.col("s").alias(source), F.col("t").alias(target))
        seen = seen.unionByName(new)  # both are checkpointed
        rounds += 1
        if rounds % 8 == 0:
            seen = cut(seen)
        if rounds == patience:
            # nodes that came before the shortcuts must use them too
            hop, new = _shortcuts(hop, both.count()), seen


#: Graphs of up to so many edges are condensed in one task.
SMALL = 1_000_000


def _strong(edges: list[tuple]) -> list[tuple]:
    """(node, part) of the strongly connected parts with two nodes or more, the smallest node naming its part: one walk,
    with the low points of a stack (iterative, so depth is no limit)."""
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    order: dict = {}
    low: dict = {}
    held, path, out = set(), [], []
    for first in after:
        if first in order:
            continue
        order[first] = low[first] = len(order)
        path.append(first)
        held.add(first)
        todo = [(first, iter(after[first]))]
        while todo:
            node, rest = todo[-1]
            for b in rest:
                if b not in order:
                    order[b] = low[b] = len(order)
                    path.append(b)
                    held.add(b)
                    todo.append((b, iter(after.get(b, ()))))
                    break
                if b in held:
                    low[node] = min(low[node], order[b])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
                if low[node] == order[node]:
                    part = []
                    while True:
                        part.append(path.pop())
                        held.discard(part[-1])
                        if part[-1] == node:
                            break
                    if len(part) > 1:
                        name = min(part)
                        out += [(x, name) for x in part]
    return out


def _least(edges: DataFrame, a: str, b: str, salt: int) -> DataFrame:
    """node, least: the node of the smallest salted hash that each node reaches along a -> b, itself included.

    Labels spread and jump to the label of their label, so a chain takes logarithmically many rounds.
    """
    hop = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    key = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("h"), F.col(c).alias("v"))
    label = cut(hop.select("node").union(hop.select("other")).distinct().select("node", key("node").alias("l")))
    while True:
        far = hop.join(label.select(F.col("node").alias("other"), F.col("l").alias("k")), "other").groupBy("node").agg(F.min("k").alias("k"))
        step = label.join(far, "node", "left").select("node", F.col("l").alias("was"), F.least("l", "k").alias("l"))
        jump = label.select(F.col("node").alias("v"), F.col("l").alias("k"))
        step = cut(step.withColumn("v", F.col("l.v")).join(jump, "v").select("node", "was", F.least("l", "k").alias("l")))
        label = step.select("node", "l")
        if step.where("was != l").isEmpty():
            return label.select("node", F.col("l.v").alias("least"))


def _strong_by_labels(hop: DataFrame) -> DataFrame:
    """node, part, for graphs of any size. With hashes anew in each round, nodes whose least node downstream is also the
    least upstream are one part with it; an edge whose ends differ in either can't lie within a part and goes. As with
    random pivots, logarithmically many rounds are expected."""
    alive, done, salt = hop, None, 0
    while not alive.isEmpty():
        down, up = _least(alive, "a", "b", salt), _least(alive, "b", "a", salt)
        both = cut(down.withColumnRenamed("least", "f").join(up.withColumnRenamed("least", "g"), "node"))
        found = both.where("f = g").select("node", F.col("f").alias("part"))
        done = found if done is None else done.unionByName(found)
        side = lambda c, x: both.select(F.col("node").alias(c), F.col("f").alias(f"f{x}"), F.col("g").alias(f"g{x}"))
        alive = cut(alive.join(side("a", 1), "a").join(side("b", 2), "b").where("f1 = f2 and g1 = g2 and f1 != g1").select("a", "b"))
        salt += 1
    if done is None:
        return hop.select(F.col("a").alias("node"), F.col("a").alias("part")).limit(0)
    first = done.groupBy("part").agg(F.min("node").alias("name"), F.count("*").alias("n")).where("n > 1")
    return done.join(first, "part").select("node", F.col("name").alias("part"))


def strong_parts(edges: DataFrame, source: str, target: str, small: int = SMALL) -> DataFrame:
    """node, part of the strongly connected parts with two nodes or more; every other node is a part of its own."""
    hop = cut(edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a is not null and b is not null and a != b").distinct())
    if hop.count() > small:
        return cut(_strong_by_labels(hop))
    kind = hop.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _strong([e for pdf in batches for e in zip(pdf["a"], pdf["b"])])
        yield pd.DataFrame(rows, columns=["node", "part"])

    return cut(hop.coalesce(1).mapInPandas(run, f"node {kind}, part {kind}"))


def reach_parts(edges: DataFrame, source: str, target: str, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What starts reach, by strongly connected parts (G-01, G-07): (source, part) pairs, and (node, part) of the parts
    with two nodes or more; any other part is its node.

    A cycle is one part, so a ring of n nodes gives a row a start and not n.
    """
    own = strong_parts(edges, source, target)
    of = lambda rows, c: rows.join(own.select(F.col("node").alias(c), F.col("part").alias(f"__{c}")), c, "left").withColumn(f"__{c}", F.coalesce(f"__{c}", c))
    plain = edges.select(source, target).where(F.col(source).isNotNull() & F.col(target).isNotNull())
    between = of(of(plain, source), target).select(F.col(f"__{source}").alias("a"), F.col(f"__{target}").alias("b")).where("a != b").distinct()
    first = of(starts.select(source).distinct(), source)
    met = reach(between, "a", "b", starts=first.select(F.col(f"__{source}").alias("a")).distinct())
    pairs = first.join(met.select(F.col("a").alias(f"__{source}"), F.col("b").alias("part")), f"__{source}").select(source, "part")
    return cut(pairs), own


def members(parts: DataFrame, own: DataFrame, node: str) -> DataFrame:
    """Rows with a column `part` (as reach_parts() gives) with the nodes of each part as `node`."""
    return parts.join(own.select("part", F.col("node").alias(f"__{node}")), "part", "left").withColumn(node, F.coalesce(f"__{node}", "part")).drop(f"__{node}")


def within(edges: DataFrame, source: str, target: str, starts: DataFrame, depth: int) -> DataFrame:
    """Nodes up to `depth` hops away from each start, with the least depth; starts themselves are not listed (G-02)."""
    hop = edges.select(F.col(source).alias("mid"), F.col(target).alias("to")).distinct()
    front = starts.select(F.col(source).alias("s")).distinct().select("s", F.col("s").alias("t"))
    out = None
    for d in range(1, depth + 1):
        front = front.join(hop, front.t == hop.mid).select("s", F.col("to").alias("t")).distinct()
        level = front.select("s", "t", F.lit(d).alias("depth"))
        out = level if out is None else out.unionByName(level)
    out = out.where("s != t").groupBy("s", "t").agg(F.min("depth").alias("depth"))
    return out.select(F.col("s").alias(source), F.col("t").alias(target), "depth")


def ancestors(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, ancestor, depth) of a forest, depth 0 for the node itself (G-03, G-04 inverted, J-15), at any depth.

    Pointers double, so a tree of depth d takes log2(d) rounds. Where parents run in a cycle, each node on it or below
    it gets every node of the cycle once, at its least depth.
    """
    up = cut(nodes.select(F.col(node).alias("n"), F.col(parent).alias("a")).where("a is not null").distinct())
    known, jump, steps, most = up.withColumn("depth", F.lit(1)), up, 1, None
    while not jump.isEmpty():
        far = jump.withColumnRenamed("a", "m").join(known.select(F.col("n").alias("m"), "a", "depth"), "m")
        known = known.unionByName(far.select("n", "a", (F.col("depth") + steps).alias("depth")))
        jump = cut(jump.withColumnRenamed("a", "m").join(jump.select(F.col("n").alias("m"), "a"), "m").select("n", "a"))
        steps *= 2
        if steps >= 64:  # only a very deep tree or a cycle comes here
            most = most or up.count()
            known = known.groupBy("n", "a").agg(F.min("depth").alias("depth"))
            if steps > most:
                break
        known = cut(known)
    own = nodes.select(F.col(node), F.col(node).alias("ancestor"), F.lit(0).alias("depth"))
    return own.unionByName(known.where("n != a").select(F.col("n").alias(node), F.col("a").alias("ancestor"), "depth"))


def children(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """Sorted children of each parent (G-05)."""
    return nodes.where(F.col(parent).isNotNull()).groupBy(parent).agg(F.array_sort(F.collect_list(node)).alias("children"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root (the smallest node) of each component: labels spread and jump until none changes (G-06)."""
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(b, a)).where("node is not null and other is not null")
    both = cut(both.distinct())
    label = cut(both.groupBy("node").agg(F.min("other").alias("o")).select("node", F.least("node", "o").alias("root")))
    while True:
        near = both.join(label.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        step = label.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = cut(step.join(jump, "root").select("node", "was", F.least("root", "next").alias("root")))
        label = step.select("node", "root")
        if step.where("was != root").isEmpty():
            return label


def canonical(pointers: DataFrame, node: str, target: str) -> DataFrame:
    """Where each node's pointers end: the last node, or the smallest node of the cycle they run into (G-10).

    Doubling: after k rounds a pointer has gone 2**k steps and carries the smallest node of the last 2**k.
    """
    step = pointers.select(F.col(node).alias("n"), F.coalesce(F.col(target), F.col(node)).alias("to"))
    ends = step.select(F.col("to").alias("n")).distinct().join(step, "n", "left_anti").select("n", F.col("n").alias("to"))
    step = cut(step.unionByName(ends))
    n = step.count()
    cur = step.select("n", "to")
    stops = step.where("n = to").select("to")
    hops = 1
    while hops < n:  # then every pointer stands on an end or a cycle
        nxt = cur.select(F.col("n").alias("to"), F.col("to").alias("far"))
        cur = cut(cur.join(nxt, "to").select("n", F.col("far").alias("to")))
        hops *= 2
        if cur.join(stops, "to", "left_anti").isEmpty():  # all stand on ends, none on a cycle
            return cur.select(F.col("n").alias(node), F.col("to").alias("canonical"))
    ring = cur.select(F.col("to").alias("n")).distinct()
    best = step.join(ring, "n", "left_semi").select("n", "to", F.least("n", "to").alias("low"))
    hops = 1
    while hops < n:
        nxt = best.select(F.col("n").alias("to"), F.col("to").alias("far"), F.col("low").alias("other"))
        best = cut(best.join(nxt, "to").select("n", F.col("far").alias("to"), F.least("low", "other").alias("low")))
        hops *= 2
    return cur.join(best.select(F.col("n").alias("to"), "low"), "to").select(F.col("n").alias(node), F.col("low").alias("canonical"))


def fixpoint_prefixes(mounts: DataFrame, child: str, parent: str, prefix: str, join: Callable[[Column, Column], Column]) -> DataFrame:
    """Full prefixes of nested mounts, however deep: each round adds the parent's prefixes until no mount is left whose
    parent has one above (G-11). A chain that comes back to a router it has passed ends there."""
    own = cut(mounts.select(F.col(child).alias("c"), F.col(parent).alias("p"), F.col(prefix).alias("x")).distinct())
    tops = own.where("p is null").select(F.col("c").alias("p"), F.col("x").alias("up"))
    inner = own.where("p is not null").select(F.col("c").alias("p"), F.col("p").alias("pp"), F.col("x").alias("up"))
    done = own.where("p is null").select("c", "x")
    front = own.where("p is not null").withColumn("seen", F.array("c"))
    while not front.isEmpty():
        done = done.unionByName(front.join(tops, "p").select("c", join(F.col("up"), F.col("x")).alias("x")))
        front = front.where(~F.array_contains("seen", F.col("p"))).join(inner, "p")
        front = cut(front.select("c", F.col("pp").alias("p"), join(F.col("up"), F.col("x")).alias("x"), F.array_append("seen", F.col("p")).alias("seen")))
    return done.distinct().select(F.col("c").alias(child), F.col("x").alias(prefix))


def root_of(nodes: DataFrame, node: str, parent: str, stop: Column) -> DataFrame:
    """The nearest ancestor that satisfies `stop` (over columns of nodes), else the topmost (G-03, operation root)."""
    chain = ancestors(nodes, node, parent)
    marks = nodes.select(F.col(node).alias("ancestor"), stop.alias("__stop"))
    best = F.min_by("ancestor", F.struct(F.when(F.col("__stop"), 0).otherwise(1), F.when(F.col("__stop"), F.col("depth")).otherwise(-F.col("depth"))))
    return chain.join(marks, "ancestor").groupBy(node).agg(best.alias("root"))
