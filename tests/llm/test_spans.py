"""Spans and shared band keys, found among sorted neighbours, against plain Python."""

from __future__ import annotations

import random
from collections import Counter

from rolecall.llm import passages


def test_spans_of_pieces(spark):
    draw = random.Random(5)
    pieces = [(1, 1, at, at + draw.choice([1, 2, 40])) for at in range(0, 3000, 2)]  # one group over many batches
    for _ in range(3000):
        first = draw.randrange(400)
        pieces.append((draw.randrange(2, 30) * 10**12, draw.randrange(4), first, first + draw.randrange(1, 9)))
    want = []
    for group in {p[:2] for p in pieces}:
        opened = None
        for first, end in sorted(p[2:] for p in pieces if p[:2] == group):
            if opened and first <= opened[1]:
                opened[1] = max(opened[1], end)
            else:
                opened = [first, end]
                want.append((*group, opened))
    want = sorted((own, held, first, end - first) for own, held, (first, end) in want)
    rows = spark.createDataFrame(pieces, "_id long, class_id long, first long, end long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (before, "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert sorted(tuple(r) for r in passages.spans(rows).collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(want) > 500 and passages.spans(rows.where("false")).count() == 0


def test_keys_that_are_shared(spark):
    draw = random.Random(6)
    kinds = [(n, *(draw.randrange(4000) * 3 + k for k in range(3))) for n in range(3000)] + [(n, 0, n * 10**9 + 1, n * 10**9 + 2) for n in range(3000, 3100)]
    times = Counter(key for _, *keys in kinds for key in keys)
    want = sorted((n, key) for n, *keys in kinds for key in keys if times[key] > 1)
    rows = spark.createDataFrame(kinds, "id long, key_0 long, key_1 long, key_2 long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (before, "7", "1"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert sorted(tuple(r) for r in passages.shared_keys(rows).collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    sizes = {(r["id"], r["key"]): r["n"] for r in passages.paragraph_buckets(passages.shared_keys(rows)).collect()}
    assert sizes == {(n, key): times[key] for n, key in want} and passages.shared_keys(rows.where("false")).count() == 0
