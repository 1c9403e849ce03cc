"""Operator 2, near-duplicate groups from SetSketch registers.

A document is the set of its distinct five-word shingles (64-bit hashes). One pass over the texts gives each
document its set size, a 128-bit identity of the whole set and a SetSketch: M registers, each the exponentially
spaced, truncated minimum of the set's hashes under one hash function. Registers of a union are the maxima of
the parts' registers, so sketches merge; equal registers are the likelier the more two sets share.

1. Documents of one set identity are one class, so copies never form pairs.
2. Runs of ROWS registers are band keys. Classes that meet under a key are candidates.
3. In a key's group every member is compared with one pivot, another one for each band, never all with all.
4. Candidates whose sizes or whose joint likelihood estimate can't reach the threshold go; the estimate's margin
   is five standard errors (a pair at the threshold falls below it with probability 3e-7).
5. The rest is confirmed on full shingle sets, recomputed from the texts, in integers: 100 * common >= percent * union.
6. Confirmed links give components. Groups whose members are still in more than one component get their missing
   comparisons: pairs of small groups at once, large groups in cells of two blocks of members each, on full sets in
   memory; a cell gives back only links that join components. So no link is lost to the pivots, and no bucket is cut.

The threshold is the caller's percent. It sets the number of bands: a pair at it shares no band with probability
2.4e-7 at most, (1 - 0.85**5)**26 and (1 - 0.8**5)**39; that and the estimate's margin are the method's only losses.

Defined results: null text, empty text and a text of white space have the empty set, are linked with nothing and
are their own component; fewer than five words make one shingle of the whole sequence; repeated rows are one
class; a null doc_id is smaller than no other and names a component only if all its ids are null; an empty table
gives no rows; other columns are not read, and dedup() keeps them. dedup() keeps one row of each component, by doc_id
and text: rows that share a doc_id, or have none, are lost to none but their own component; rows without a set are one
if doc_id and text are equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import ceil, floor, log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FOLD, fresh, materialise, only, release, slices, texts_of, trim

WORDS, PERCENT = 5, 85
BANDS, ROWS = 26, 5
M = BANDS * ROWS
#: A pair at the threshold may share no band with this probability.
MISS = 2.4e-7
#: Base of the exponential spacing, rate of the exponential hashes, largest register.
BASE, RATE, TOP = 1.001, 20.0, 65534
#: Groups up to SMALL get all their missing pairs at once; larger ones go to blocks of so many members and bytes of sets,
#: which are compared by so many hashes at a time.
SMALL, CELL, CELL_BYTES, SLICE = 24, 256, 8 << 20, 4096
_SEED = np.random.default_rng(20260)
_FACTORS = (_SEED.integers(1, 1 << 32, M, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_SHIFTS = _SEED.integers(0, 1 << 32, M, dtype=np.uint64).astype(np.uint32)
_PLACES = _SEED.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_PIVOTS = [int(x) for x in _SEED.integers(0, 1 << 62, BANDS)]


def bands_for(percent: int) -> int:
    """Bands that a threshold asks for."""
    if not 50 <= percent <= 95:
        raise ValueError(f"a threshold of {percent} % is not in 50 to 95")
    return ceil(log(MISS) / log(1 - (percent / 100) ** ROWS))


def least_for(percent: int) -> float:
    """Candidates stay if the estimate reaches this: the threshold less five standard errors at its registers."""
    j = percent / 100
    return floor(100 * (j - 5 * (j * (1 - j) / (bands_for(percent) * ROWS)) ** 0.5)) / 100


@lru_cache
def _functions(bands: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Factors and shifts of the hash functions and the bands' pivots; all numbers of bands share the first ones."""
    more = np.random.default_rng([20260, bands])
    n = max(0, bands - BANDS)
    factors = (more.integers(1, 1 << 32, n * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    shifts = more.integers(0, 1 << 32, n * ROWS, dtype=np.uint64).astype(np.uint32)
    pivots = [int(x) for x in more.integers(0, 1 << 62, n)]
    m = bands * ROWS
    return np.concatenate([_FACTORS, factors])[:m], np.concatenate([_SHIFTS, shifts])[:m], [*_PIVOTS, *pivots][:bands]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def shingles(raw: bytes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text in UTF-8."""
    words = raw.translate(FOLD).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    s = h[: n - WORDS + 1] * _PLACES[0]
    for i in range(1, WORDS):
        s ^= _mix(s) + h[i : n - WORDS + 1 + i] * _PLACES[i]
    return np.unique(_mix(s))


def minima(own: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """The smallest hash under each function of the bands, as 32-bit numbers."""
    factors, shifts, _ = _functions(bands)
    x = (own >> np.uint64(32)).astype(np.uint32)
    low = np.full(bands * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        part = (x[None, i : i + 1024] ^ shifts[:, None]) * factors[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def registers(low: np.ndarray) -> np.ndarray:
    """SetSketch registers of minima: an exponential variable of rate RATE, floor(1 - log_BASE), truncated."""
    wait = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(wait) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of most joint likelihood, given register matrices (pairs x M) and set sizes.

    With u = n_a / (n_a + n_b) and v = 1 - u the registers compare as a > b with p(u - v j), a < b with p(v - u j)
    and are equal otherwise, where p(x) = -log_b(1 - x (b - 1) / b). The likelihood is concave in j: a golden search.
    """
    a, b = a.astype(np.int32), b.astype(np.int32)
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    p = lambda x: np.clip(-np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)

    def value(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    g = (5**0.5 - 1) / 2
    for _ in range(24):
        x, y = high - g * (high - low), low + g * (high - low)
        right = value(x) < value(y)
        low, high = np.where(right, x, low), np.where(right, high, y)
    return (low + high) / 2


def sketches(docs: DataFrame, bands: int = BANDS, marked: bool = False) -> DataFrame:
    """doc_id, n (set size), head and twin (the halves of the set's identity of 128 bits), regs; n = 0: none of them.

    If marked, also sha, of the text as it is.
    """
    marks = ["sha"] if marked else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in slices(batches, limit=4 << 20):
            sets = [shingles(t) for t in texts_of(batch)]
            n = np.array([len(s) for s in sets], np.int64)
            ids = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2) if sets else np.empty((0, 2), "<i8")
            regs = registers(np.stack([minima(s, bands) for s in sets])) if sets else np.empty((0, bands * ROWS), np.uint16)
            empty = n == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n),
                    pa.array(np.ascontiguousarray(ids[:, 0]), mask=empty),
                    pa.array(np.ascontiguousarray(ids[:, 1]), mask=empty),
                    pa.array([None if e else r.tobytes() for e, r in zip(empty, regs)], pa.binary()),
                    *(batch.column(x) for x in marks),
                ],
                names=["doc_id", "n", "head", "twin", "regs", *marks],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([_sha(docs).alias("sha")] if marked else []))
    return rows.mapInArrow(run, "doc_id long, n long, head long, twin long, regs binary" + ", sha string" * marked)


def _band_rows(nodes: DataFrame, bands: int) -> DataFrame:
    """band key, node, turn (the node's place in the band's own order of pivots)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.array(_functions(bands)[2], np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            node, head = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("node", "head"))
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), "<u2").reshape(-1, bands, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), regs.shape[:2]).copy()
            for i in range(ROWS):
                key = _mix(key ^ (regs[:, :, i] + np.uint64(i + 1)) * np.uint64(0xA0761D6478BD642F))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(np.repeat(node, bands)), pa.array((head[:, None] ^ flips[None, :]).ravel())], names=["key", "node", "turn"])
        trim()

    return nodes.select("node", "head", "regs").mapInArrow(run, "key long, node long, turn long")


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sizes and joint likelihood can reach the threshold."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"r_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    m, least = bands_for(percent) * ROWS, least_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            r_a, r_b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), "<u2").reshape(-1, m) for x in ("r_a", "r_b"))
            n_a, n_b = (batch.column(x).to_numpy() for x in ("n_a", "n_b"))
            keep = likely(r_a, r_b, n_a, n_b) >= least
            yield batch.select(["a", "b"]).filter(pa.array(keep))
        trim()

    return both.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long")


def _common(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Those pairs whose full sets share enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "s_a", 4 << 20):
            keep = []
            for x, y in zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum()) if len(y) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, own: the full shingle set of each wanted node, taken from its text again."""
    own = nodes.select("node", "doc_id", "head", "twin").join(wanted.select("node").distinct(), "node")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a node's text is that of its doc_id; rows that share a doc_id are told apart by the set's identity below
    rows = rows.join(own, rows.doc_id.eqNullSafe(own.doc_id)).select("node", "head", "twin", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=8 << 20):
            out: list[tuple[int, bytes]] = []
            for node, head, twin, raw in zip(*(batch.column(c).to_pylist() for c in ("node", "head", "twin")), texts_of(batch)):
                own = shingles(raw).tobytes()
                if np.frombuffer(xxhash.xxh3_128_digest(own), "<i8").tolist() == [head, twin]:
                    out.append((node, own))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["node", "own"])

    return materialise(rows.mapInArrow(run, "node long, own binary").dropDuplicates(["node"]), "sets")


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that reach the threshold on full shingle sets."""
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), nodes, docs)
    side = lambda x: sets.select(F.col("node").alias(x), F.col("own").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b")
    out = materialise(both.mapInArrow(_common(percent), "a long, b long"), "links")
    release(sets)
    return out


def components(links: DataFrame) -> DataFrame:
    """node, root of the graph of links (a, b): smallest labels spread, with pointer jumps, until none changes."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
    both = materialise(both.distinct(), "edges")
    label = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root"))
    before = label = materialise(label, "labels")
    while True:
        far = both.join(label.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        step = label.join(far, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = materialise(step.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("next", "root")).alias("root")), "labels")
        release(before)
        before, label = step, step.select("node", "root")
        if step.where("was != root").isEmpty():
            release(both)
            return label


def linked_in_cell(sets: list[np.ndarray], root: np.ndarray, block: np.ndarray, one: bool, percent: int) -> list[tuple[int, int]]:
    """Places of the pairs that join different roots, as few as connect all that belongs together.

    All sets are compared at once: hashes that two or more members have become columns, and the products of slices of
    the member-by-hash matrix add up to the sizes of all intersections. Unless `one`, only pairs across blocks count.
    """
    n = np.array([len(s) for s in sets])
    member = np.repeat(np.arange(len(sets)), n)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    member, column = member[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(shared.sum()), SLICE):
        lo, hi = np.searchsorted(column, [start, start + SLICE])
        x = np.zeros((len(sets), SLICE), np.float32)
        x[member[lo:hi], column[lo:hi] - start] = 1
        common += x @ x.T
    fits = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    fits &= root[:, None] != root[None, :]
    if not one:
        fits &= block[:, None] != block[None, :]
    parent = {r: r for r in root.tolist()}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    out = []
    for i, j in np.argwhere(np.triu(fits, 1)).tolist():
        a, b = find(int(root[i])), find(int(root[j]))
        if a != b:
            parent[a] = b
            out.append((i, j))
    return out


def _in_cells(rows: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of large groups: each block of members against each, on full sets.

    A block has at most CELL members and about CELL_BYTES of sets, so a cell fits in memory whatever the group's size;
    a cell gives back only the links that join components, fewer than it has members.
    """
    sets = _sets(rows, nodes, docs)
    size = nodes.select("node", (8 * F.col("n")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("bytes") / CELL_BYTES)).cast("int")
    size = rows.join(size, "node").groupBy("key").agg(blocks.alias("blocks"))
    block = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
    cells = rows.join(size, "key").select("key", "node", "root", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.join(sets, "node").select("key", "node", "root", "own", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        node, root, block = (pdf[x].to_numpy() for x in ("node", "root", "block"))
        sets = [np.frombuffer(x, "<u8") for x in pdf["own"]]
        found = linked_in_cell(sets, root, block, pdf["i"].iat[0] == pdf["j"].iat[0], percent)
        trim()
        return pd.DataFrame({"a": [min(node[i], node[j]) for i, j in found], "b": [max(node[i], node[j]) for i, j in found]}, dtype="int64")

    # cells are heavy for their bytes: deal them out over all partitions
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = materialise(cells.repartition(n, "key", "i", "j").groupBy("key", "i", "j").applyInPandas(run, "a long, b long").distinct(), "cell-links")
    release(sets)
    return out


def link(docs: DataFrame, percent: int = PERCENT, marked: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches (a row per document), nodes (a row per class, numbered) and roots (node, root of each linked class)."""
    bands = bands_for(percent)
    own = materialise(sketches(docs, bands, marked), "sketches")
    first = own.where("n > 0").groupBy("head", "twin").agg(F.min("doc_id").alias("first")).withColumnsRenamed({"head": "h", "twin": "t"})
    nodes = own.select("head", "twin", "doc_id", "n", "regs").join(first, (F.col("head") == F.col("h")) & (F.col("twin") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("first")))
    nodes = nodes.select("head", "twin", "doc_id", "n", "regs").dropDuplicates(["head", "twin"])
    # the numbers are fixed once the table is written
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    rows = _band_rows(nodes, bands)
    pivots = rows.groupBy("key").agg(F.count("*").alias("size"), F.min_by("node", "turn").alias("first")).where("size > 1")
    met = materialise(rows.join(pivots, "key").select("key", "node", (F.col("node") == F.col("first")).alias("pivot"), "size", "first"), "bands")
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    stars = met.where("not pivot").select(*pair("node", "first")).distinct()
    tried = materialise(_estimated(stars, nodes, percent), "candidates")
    links = _confirmed(tried, nodes, docs, percent)
    roots = components(links)

    # groups of three or more that are not yet one component lack the pairs without their pivot
    more = met.where("size > 2").join(roots, "node", "left").select("key", "node", "size", "pivot", F.coalesce("root", "node").alias("root"))
    split = more.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    more = materialise(more.join(split, "key", "left_semi"), "unsettled")
    few = more.where((F.col("size") <= SMALL) & ~F.col("pivot")).select("key", "node", "root")
    other = few.select("key", F.col("node").alias("node2"), F.col("root").alias("root2"))
    near = few.join(other, "key").where("node < node2 and root != root2").select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()
    extra = _in_cells(more.where(F.col("size") > SMALL).select("key", "node", "root"), nodes, docs, percent)
    fresh = materialise(_estimated(near, nodes, percent).join(tried, ["a", "b"], "left_anti"), "candidates-2")
    if not fresh.isEmpty():
        extra = extra.union(_confirmed(fresh, nodes, docs, percent))
    if not extra.isEmpty():
        roots = components(links.union(extra))
    release(met, more)
    return own, nodes, roots


def _rooted(own: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """own with the root of its class (the class itself if it is linked with nothing); none for rows without a set."""
    named = nodes.select(F.col("head").alias("h"), F.col("twin").alias("t"), "node").join(roots, "node", "left").select("h", "t", F.coalesce("root", "node").alias("root"))
    return own.drop("regs").join(named, (F.col("head") == F.col("h")) & (F.col("twin") == F.col("t")), "left").drop("h", "t")


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    # documents without a set stand alone: a group of their own for each doc_id
    named = _rooted(*link(docs, percent)).select("doc_id", "n", "root", F.when(F.col("n") == 0, F.col("doc_id")).alias("alone"))
    least = named.groupBy("root", "alone").agg(F.min("doc_id").alias("component_id"))
    out = named.alias("x").join(least.alias("y"), F.col("x.root").eqNullSafe(F.col("y.root")) & F.col("x.alone").eqNullSafe(F.col("y.alone")))
    return out.select("x.doc_id", F.col("x.n").alias("n_shingles"), "y.component_id", F.col("x.doc_id").eqNullSafe(F.col("y.component_id")).alias("kept"))


def _sha(docs: DataFrame) -> Column:
    return F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"), 256)


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with all its columns.

    Of several texts with that doc_id in one group, the one with the smallest hash stays.
    """
    # one group a root, or a row without a set
    keys = ["root", *(F.when(F.col("n") == 0, F.col(x)).alias(f"alone_{x}") for x in ("doc_id", "sha"))]
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "sha")).alias("best")
    sha, key = fresh(docs, "sha"), fresh(docs, "key")
    kept = _rooted(*link(docs, percent, marked=True)).groupBy(*keys).agg(best)
    kept = kept.select(F.col("best.doc_id").alias(key), F.col("best.sha").alias(f"{sha}2")).distinct()
    rows = docs.withColumn(sha, _sha(docs))
    rows = rows.join(kept, rows["doc_id"].cast("long").eqNullSafe(kept[key]) & (rows[sha] == kept[f"{sha}2"]), "left_semi")
    return rows.dropDuplicates(["doc_id", sha]).select(*[rows[f"`{c}`"] for c in docs.columns])
