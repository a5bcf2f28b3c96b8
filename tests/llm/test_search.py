"""Exact top-k search against plain Python, and what it moves."""

from __future__ import annotations

import io
import random
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolecall.llm import top_k


def vectors_of(case):
    draw = random.Random(case)
    if case == "crowded":  # nearly all scores are equal, and two rows share an id
        rows = [(i, [3, -2, 1] if i % 7 else [draw.randrange(-3, 4) for _ in range(3)]) for i in range(700)]
        return [*rows, (40, [9, 9, 9]), (41, [3, -2, 1])]
    most = {"small": 40, "wide": 30_000, "huge": 2**28}[case]
    return [(i, [draw.randrange(-most, most) for _ in range(draw.choice([4, 9, 9]))]) for i in draw.sample(range(5000), 900)]


@pytest.mark.parametrize("case", ["small", "wide", "huge", "crowded"])
def test_top_k_against_all_products(spark, monkeypatch, case):
    for name, value in (("ANNULUS", 16), ("RUN", 64), ("TILE", 32), ("QUERIES", 8), ("ROWS", 3), ("PIVOTS", 5)):
        monkeypatch.setattr(top_k, name, value)
    held = vectors_of(case)
    rows = spark.createDataFrame(held, "vec_id long, vector array<long>").withColumn("wanted", F.col("vec_id") % 20 == 0)
    want = []
    for query in {i for i, _ in held if i % 20 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), i) for j, q in held if j == query for i, v in held if i != query)
        want += [(query, n + 1, i, -s) for n, (s, i) in enumerate(scored[:6])]
    assert sorted(map(tuple, top_k.top_k(rows, 6).collect())) == sorted(want)


def test_no_annulus_is_copied_for_the_batches_that_reach_it(spark):
    draw = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(draw.integers(-30, 30, (400, 8)).tolist())], "vec_id long, vector array<long>")
    found = top_k.top_k(rows.withColumn("wanted", F.col("vec_id") % 20 == 0))
    with redirect_stdout(io.StringIO()) as out:
        found.explain()
    assert "Join" not in out.getvalue() and found.count() == 400
