"""The pivot index: its parameters follow the table, and no link between different vectors is lost."""

from __future__ import annotations

import numpy as np
import pytest

from ledgerline.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label string"


def test_lists_do_not_grow_with_the_table():
    for n in (0, 1, 5_000, 50_000, 900_000, 10**8, 10**10):
        shape = embeddings.shape_for(n)
        lists = np.prod([(shape.pivots - k) / (k + 1) for k in range(shape.share)])
        keys = np.prod([(shape.leaders - k) / (k + 1) for k in range(shape.share)])
        assert embeddings.LEAST_PIVOTS <= shape.pivots <= embeddings.MOST_PIVOTS
        assert n * keys / lists < 60


@pytest.mark.parametrize("shape", [None, embeddings.Shape(300, *embeddings.MANY), embeddings.Shape(40, *embeddings.FEW)])
def test_links_equal_brute_force_in_a_mixed_table(spark, monkeypatch, shape):
    rng = np.random.default_rng(11)
    seeds = rng.normal(size=(400, 32))
    near = np.concatenate([seeds[k % 100][None] + rng.normal(size=(1, 32)) * 0.22 for k in range(600)])
    rows = [(i, v, "ab"[i % 100 % 2]) for i, v in enumerate(np.concatenate([seeds, near]))]
    rows = [(i, [float(x) for x in np.float32(v)], label) for i, v, label in rows]
    rows += [(5_000 + k, [1.0, 0.01 * k], "a") for k in range(40)]  # another dimension, one crowd: a single pivot
    if shape is not None:
        monkeypatch.setattr(embeddings, "shape_for", lambda n: shape)
    got = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    links = 0
    for size in (32, 2):
        some = [(v, label) for _, v, label in rows if len(v) == size]
        units = np.array([v for v, _ in some])
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        labels = np.array([label for _, label in some])
        close = (units @ units.T >= 0.93) & (labels[:, None] == labels)
        links += int(close.sum()) - len(some)
    found = sum(r.n_links for r in got)
    assert len(got) == len(rows) and links > 2_000
    assert 0.99 * links <= found <= links


def test_integers_very_large_and_very_small_numbers(spark):
    whole = spark.createDataFrame([(1, [3, 4], "a"), (2, [6, 8], "a"), (3, [-3, 4], "a")], "vec_id long, embedding array<int>, label string")
    assert [tuple(r) for r in embeddings.near_duplicates(whole).orderBy("vec_id").collect()] == [
        (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)
    ]
    rows = [(1, [1e300, 1e300], "a"), (2, [1e-300, 1e-300], "a"), (3, [-1e300, 1e300], "a")]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))
    assert [r.n_links for r in got.orderBy("vec_id").collect()] == [1, 1, 0]
