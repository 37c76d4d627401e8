"""Exact top-k inner products against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import top_inner

SCHEMA = "vec_id long, embedding array<float>, row int, tile int, dim string"


def make(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA).repartition(3)


def plain(rows, k, scale=1024):
    usable = [
        (i, [math.floor(scale * float(np.float32(x))) for x in v])
        for i, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, (i, q) in enumerate(usable):
        if i is None or i % 3:
            continue
        found = [
            (-sum(a * b for a, b in zip(q, v)), j is None, j or 0)
            for m, (j, v) in enumerate(usable)
            if m != n and len(v) == len(q)
        ]
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def got(df, **options):
    return sorted((tuple(r) for r in top_inner.top_inner(df, F.col("vec_id") % 3 == 0, **options).collect()), key=str)


@pytest.mark.parametrize("kind", ["even", "steep", "clusters", "copies"])
@pytest.mark.parametrize("tile_values", [64, 1_000, 1 << 19])
def test_equals_all_pairs(spark, kind, tile_values):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 8))
    if kind == "steep":
        x *= np.exp(rng.normal(size=(300, 1)) * 2) * np.array([8, 4, 2, 1, 0.5, 0.2, 0.1, 0.1])
    elif kind == "clusters":
        x = x[rng.integers(0, 12, 300)] + 0.05 * x
    elif kind == "copies":
        x[::2] = x[0]
    rows = list(enumerate(x.astype(np.float32).tolist()))
    assert got(make(spark, rows), k=7, tile_values=tile_values, block_values=200) == plain(rows, 7)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5]), (0, [1.0, 0.5]), (3, [1.0, 0.5]), (None, [2.0, 0.0]), (None, [1.0, 0.5]), (1, None), (6, [nan, 1.0]),
        (9, [inf, 1.0]), (12, [None, 1.0]), (15, [0.0, 0.0]), (18, [-1.0, -2.0]), (21, [1.0, 2.0, 3.0]), (24, []), (27, []),
        (2, [1.0, 0.5]), (-3, [1e-9, -1e-9]),
    ]
    for k in (1, 3, 50):
        assert got(make(spark, rows), k=k, tile_values=6) == plain(rows, k)


def test_whole_numbers_beyond_double_precision(spark):
    rows = [(i, [float(1 << 20) + i / 8, float(i), 0.125 * i]) for i in range(40)]
    assert got(make(spark, rows), k=5) == plain(rows, 5)


def test_scores_beyond_64_bits_are_an_error(spark):
    rows = [(0, [1e12, 1.0]), (1, [1e12, 2.0])]
    with pytest.raises(Exception, match="too large|Overflow"):
        got(make(spark, rows))


def test_empty_table_and_single_row(spark):
    assert got(make(spark, []), k=3) == []
    assert got(make(spark, [(0, [1.0])]), k=3) == []


def test_a_tile_that_cannot_reach_the_score_is_not_read(spark):
    """Queries go on only to tiles that their bound allows."""
    rows = [(i, [100.0 - i, 0.0] if i < 50 else [0.001, 0.0]) for i in range(1_000)]
    result = top_inner.top_inner(make(spark, rows), F.col("vec_id") == 3, k=5, tile_values=200)
    assert [r.vec_id for r in result.orderBy("rank").collect()] == [0, 1, 2, 4, 5]
