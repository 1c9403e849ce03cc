"""Places of flow nodes for drawing (G-12): columns by longest path without back edges, rows by branch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

PLACES = "flow_id string, node string, column int, lane int"


def places(edges: list[tuple[str, str]], most: int = 24) -> list[tuple[str, int, int]]:
    """(node, column, lane) of the first `most` nodes by breadth from the node without a predecessor, else the first.

    Edges back to a node on the current path are left out; the column is the longest path from the start; nodes of one
    column get lanes in the order in which they were met. Ranks are compact.
    """
    after: dict[str, list[str]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    if not after:
        return []
    targets = {b for _, b in edges}
    start = next((n for n in after if n not in targets), next(iter(after)))
    seen, queue = [start], [start]
    while queue and len(seen) < most:
        for b in after[queue.pop(0)]:
            if b not in seen and len(seen) < most:
                seen.append(b)
                queue.append(b)
    kept, state, order = set(seen), {}, []
    stack = [(start, iter(after[start]))]
    state[start] = 1
    forward: dict[str, list[str]] = {n: [] for n in seen}
    while stack:
        node, rest = stack[-1]
        for b in rest:
            if b not in kept or state.get(b) == 1:
                continue
            forward[node].append(b)
            if b not in state:
                state[b] = 1
                stack.append((b, iter(after[b])))
                break
        else:
            state[node] = 2
            order.append(node)
            stack.pop()
    column = dict.fromkeys(seen, 0)
    for n in reversed(order):
        for b in forward[n]:
            column[b] = max(column[b], column[n] + 1)
    ranks = {c: i for i, c in enumerate(sorted(set(column.values())))}
    lanes: dict[int, int] = {}
    out = []
    for n in seen:
        c = ranks[column[n]]
        out.append((n, c, lanes.setdefault(c, 0)))
        lanes[c] += 1
    return out


def layout(edges: DataFrame, most: int = 24) -> DataFrame:
    """flow_id, node, column, lane for edges (flow_id, source, target), one flow a group; a flow is one function."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *p) for p in places(list(zip(pdf["source"], pdf["target"])), most)], columns=["flow_id", "node", "column", "lane"])

    return edges.select("flow_id", "source", "target").groupBy("flow_id").applyInPandas(run, PLACES)
