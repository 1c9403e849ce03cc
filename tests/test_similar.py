"""Pairs of similar sets, against a plain version; and that common items don't make them slow."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import similar
from factloom.queries import QUERIES


def _alike(sets, least):
    own = {}
    for k, v in set(sets):
        if k is not None:
            own.setdefault(k, set()).add(v)
    out = {}
    for a, b in itertools.combinations(sorted(own), 2):
        n = len((own[a] & own[b]) - {None})
        if n and (value := n / (len(own[a]) + len(own[b]) - n)) >= least - 1e-9:
            out[a, b] = round(value, 9)
    return out


@pytest.mark.parametrize(("items", "most", "least", "bounds"), [(20, 8, 0.4, {}), (30, 10, 0.4, {"LIST": 1, "ROWS": 40}), (3000, 500, 0.3, {"LIST": 2, "ITEMS": 9000}), (40, 9, 0.0, {"LIST": 10}), (60, 20, 1.0, {"LIST": 3, "ITEMS": 300})])
def test_similar_pairs(spark, monkeypatch, items, most, least, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(similar, name, value)
    rng, sets = random.Random(items), []
    for k in range(120):
        own = set(rng.choice(sets)) if sets and rng.random() < 0.4 else set(rng.choices([None, *range(items)], [1 / (i + 3) for i in range(items + 1)], k=rng.randrange(most)))
        sets.append(own ^ {rng.randrange(items)} if rng.random() < 0.3 else own)
    data = [(f"k{k:03}", v) for k, own in enumerate(sets) for v in own]
    got = similar.similar_pairs(spark.createDataFrame([*data, *data[:9], (None, 1)], "k string, v long"), "k", "v", least).collect()
    assert len({tuple(r)[:2] for r in got}) == len(got)
    assert {tuple(r)[:2]: round(r.resource, 9) for r in got} == _alike([*data, (None, 1)], least)


def test_similar_pairs_of_common_months(spark, tmp_path):
    """All customers order in the same 80 months: pairs that aren't similar must not be compared item by item."""
    n = 12000
    month = lambda i: F.pmod(F.xxhash64("id", i), F.lit(80)).cast("int")
    orders = spark.range(n).select(F.col("id").alias("o_custkey"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), month)).alias("m"))
    orders.select("o_custkey", F.add_months(F.lit("1995-01-15").cast("date"), F.col("m")).cast("timestamp").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    began = time.monotonic()
    got = QUERIES["similar_pairs"](spark, str(tmp_path)).collect()
    assert time.monotonic() - began < 60
    held = np.zeros((n, 80), np.float32)
    for k, m in orders.collect():
        held[k, m] = 1
    size = held.sum(axis=1)
    shared = held @ held.T
    wanted = np.argwhere(np.triu(5 * shared >= 2 * (size[:, None] + size - shared), 1))
    assert sorted((r.left_key, r.right_key) for r in got) == [tuple(x) for x in wanted.tolist()]
    assert all(r.resource == pytest.approx(shared[r.left_key, r.right_key] / (size[r.left_key] + size[r.right_key] - shared[r.left_key, r.right_key]), abs=1e-6) for r in got)
