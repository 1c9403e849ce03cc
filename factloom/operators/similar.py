"""Pairs of sets of at least some Jaccard similarity (A-13, J-18).

Equal sets are one class; only classes are compared, and pairs of keys are made from them at the end. Items are ordered
from the rarest to the commonest. A set need only be met on its first items, so many that two sets of the similarity
must share one of them, and a pair counts where its first shared item stands. An item of few sets is a join. The sets of
an item that many hold are cut into blocks; each two blocks are one group, whose sets are multiplied as matrices of
their items from that one on, only those long enough from there to share what their sizes ask for. No pair is dropped
but by these bounds, and all that is left is decided by whole counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .graph import cut

#: Sets of an item up to which they meet in a join.
LIST = 64
#: Sets, and items of theirs, in a block.
ROWS, ITEMS = 1 << 15, 1 << 19
#: Columns of a matrix; more items share them, which gives upper bounds, and what reaches them is intersected.
COLUMNS = 512
#: Numbers in a product, and pairs in a batch.
PRODUCT, BATCH = 1 << 20, 1 << 18

_EPS = 1e-9


def similar_pairs(sets: DataFrame, key: str, item: str, least: float) -> DataFrame:
    """left_key, right_key, resource: pairs that share an item and have at least this Jaccard similarity.

    A null item counts in a set's size and is shared with nothing; a null key has no pairs.
    """
    ship(sets.sparkSession)
    own = sets.select(F.col(key).alias("key"), F.col(item).alias("item")).where("key is not null").distinct()
    held = own.where("item is not null").groupBy("item").agg(F.count("*").alias("n")).orderBy("n", "item")
    codes = held.select("item", F.monotonically_increasing_id().alias("code"))
    coded = own.join(codes, "item", "left").groupBy("key").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("code")).alias("items"))
    coded = cut(coded.where(F.size("items") > 0))  # the codes depend on how the sort was dealt
    classes = cut(coded.groupBy("items", "size").agg(F.min("key").alias("rep")))

    needed = F.greatest(F.lit(1), F.ceil(F.col("size") * (least - _EPS) - _EPS))
    first = classes.withColumn("__n", (F.size("items") - needed + 1).cast("int")).where("__n > 0")
    first = first.select("rep", "size", "items", F.posexplode(F.slice("items", F.lit(1), F.col("__n"))).alias("at", "code"))
    lists = first.groupBy("code").agg(F.count("*").alias("n"), F.sum(F.size("items")).alias("total")).where("n > 1")
    few = first.select("rep", "size", "code").join(lists.where(F.col("n") <= LIST), "code")
    many = first.join(lists.where(F.col("n") > LIST), "code")
    found = _joined(few, classes, least).unionByName(_multiplied(many, least))

    value = lambda shared, both: shared / (both - shared)
    found = found.select("left", "right", value(F.col("shared"), F.col("left_size") + F.col("right_size")).alias("resource"))
    members = cut(coded.join(classes, ["items", "size"]).select("key", "rep", "size", F.size("items").alias("shared")))
    one, two = members.select(F.col("key").alias("one"), F.col("rep").alias("left")), members.select(F.col("key").alias("two"), F.col("rep").alias("right"))
    across = found.join(one, "left").join(two, "right").select(F.least("one", "two").alias("left_key"), F.greatest("one", "two").alias("right_key"), "resource")
    alike = members.select("rep", F.col("key").alias("left_key"), value(F.col("shared"), 2 * F.col("size")).alias("resource"))
    inside = alike.join(members.select("rep", F.col("key").alias("right_key")), "rep").where("left_key < right_key")
    return across.unionByName(inside.select("left_key", "right_key", "resource")).where(F.col("resource") >= least - _EPS)


def _joined(few: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """left, right, shared and sizes of the pairs whose first shared item is one of `few` (rep, size, code)."""
    side = lambda s: few.select("code", F.col("rep").alias(s), F.col("size").alias(f"{s}_size"))
    near = F.least("left_size", "right_size") >= F.greatest("left_size", "right_size") * (least - _EPS) - _EPS
    met = side("left").join(side("right"), "code").where("left < right").where(near)
    met = met.groupBy("left", "right").agg(F.min("code").alias("code"))
    whole = lambda s: classes.select(F.col("rep").alias(s), F.col("size").alias(f"{s}_size"), F.col("items").alias(f"{s}_items"))
    both = met.join(whole("left"), "left").join(whole("right"), "right").withColumn("common", F.array_intersect("left_items", "right_items"))
    return both.where(F.array_min("common") == F.col("code")).select("left", "right", F.size("common").cast("long").alias("shared"), "left_size", "right_size")


def _multiplied(many: DataFrame, least: float) -> DataFrame:
    """The same for the items of `many` (rep, size, items, at, code, n, total)."""
    blocks = F.ceil(F.greatest(F.col("n") / ROWS, F.col("total") / ITEMS)).cast("int")
    dealt = many.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep", "code"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("code", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") <= F.col("other")).alias("low"), "rep", "size", "items", (F.size("items") - F.col("at")).alias("rest"))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, x, y = (k.as_py() for k in key)
        rows = pa.Table.from_batches(batches).combine_chunks()
        size = rows["size"].to_numpy()
        for i, j, shared in products(code, rows, x == y, least):
            ends = [rows["rep"].take(pa.array(k)).combine_chunks() for k in (i, j)]
            yield pa.RecordBatch.from_arrays([*ends, pa.array(shared, pa.int64()), pa.array(size[i]), pa.array(size[j])], names=["left", "right", "shared", "left_size", "right_size"])

    kind = dict(many.dtypes)["rep"]
    # else the join's partitions by code would serve, and one task have all blocks of an item
    return dealt.repartition("code", "x", "y").groupBy("code", "x", "y").applyInArrow(run, f"left {kind}, right {kind}, shared long, left_size long, right_size long")


def products(code: int, rows: pa.Table, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of two rows and how many items they share, for the pairs of similar sets (low, size, items, rest) of which
    `code` is the first shared item: each two if `same`, else each that is low with each that isn't."""
    share = (least - _EPS) / (1 + least - _EPS)  # of both sizes
    size, rest, low = rows["size"].to_numpy(), rows["rest"].to_numpy(), rows["low"].to_numpy()
    lists = rows["items"].combine_chunks()
    row = np.repeat(np.arange(len(size)), pc.list_value_length(lists).to_numpy())
    known, column = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    here = int(np.searchsorted(known, code))
    late, whole = column >= here, len(known) <= COLUMNS
    matrix = np.zeros((len(size), min(len(known) - here, COLUMNS)), np.float32)
    if whole:
        matrix[row[late], column[late] - here] = 1
        before = np.zeros((len(size), here), bool)
        before[row[~late], column[~late]] = True
    else:
        np.add.at(matrix, (row[late], (column[late] - here) % COLUMNS), 1)
        own: dict[int, frozenset] = {}

    def exact(i: np.ndarray, j: np.ndarray, shared: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for s in range(0, len(i), BATCH):
            a, b, n = i[s : s + BATCH], j[s : s + BATCH], shared[s : s + BATCH].astype(np.int64)
            if whole:
                ok = ~(before[a] & before[b]).any(axis=1)
            else:
                for k in {*a.tolist(), *b.tolist()}.difference(own):
                    own[k] = frozenset(lists[k].as_py())
                common = [own[p] & own[q] for p, q in zip(a.tolist(), b.tolist())]
                ok, n = np.array([min(c) == code for c in common], bool), np.array([len(c) for c in common], np.int64)
            ok &= n >= share * (size[a] + size[b]) - _EPS
            yield a[ok], b[ok], n[ok]

    def bands(at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, what they have left (falling) and their matrix, by sizes that differ by a twentieth at most."""
        band = np.floor(np.log(size[at]) / math.log(1.05) + _EPS)
        at, band = at[order := np.lexsort((-rest[at], band))], band[order]
        return [(k, rest[k], matrix[k]) for k in np.split(at, np.flatnonzero(np.diff(band)) + 1) if len(k)]

    lefts = bands(np.arange(len(size)) if same else np.flatnonzero(low))
    rights = lefts if same else bands(np.flatnonzero(~low))
    for p, (i, i_rest, m) in enumerate(lefts):
        for j, j_rest, k in rights[p:] if same else rights:
            i_size, j_size = size[i], size[j]
            if min(i_size.max(), j_size.max()) < max(i_size.min(), j_size.min()) * (least - _EPS) - _EPS:
                continue
            need = max(1, math.ceil(share * (i_size.min() + j_size.min()) - _EPS))
            a, b = (int(np.searchsorted(-r, -need, "right")) for r in (i_rest, j_rest))
            step = max(1, PRODUCT // max(b, 1))
            for s in range(0, a if b else 0, step):
                product = m[s : min(s + step, a)] @ k[:b].T
                u, v = np.divmod(np.flatnonzero(product >= need), b)
                if i is j:
                    u, v = u[once := u + s < v], v[once]
                if len(u):
                    yield from exact(i[u + s], j[v], product[u, v])
