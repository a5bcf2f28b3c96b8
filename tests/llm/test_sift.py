"""Bulky rows stay where they are unless an exact join may want them."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

import pytest

from rolecall.llm import near_dups
from rolecall.llm.common import sift, stage


@pytest.fixture
def no_small_tables(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    with redirect_stdout(out := io.StringIO()):
        df.explain()
    return out.getvalue()


def test_sift_misses_no_id(spark):
    rows = spark.range(-20_000, 20_000).toDF("key").union(spark.createDataFrame([(None,)], "key long"))
    ids = spark.createDataFrame([(n * 37 - 5_000,) for n in range(500)] + [(1 << 61,)], "id long")
    found = {r["key"]: r["_may"] for r in sift(rows, "key", ids).collect()}
    assert len(found) == 40_001 and all(found[n * 37 - 5_000] for n in range(500))
    assert sum(found.values()) < 500 + 40_000 / 10
    assert not any(r["_may"] for r in sift(rows, "key", ids.where("false")).collect())


def test_keep_one_moves_few_texts(spark, no_small_tables):
    texts = [(n, " ".join(f"w{n}x{k}" for k in range(30))) for n in range(300)]
    docs = stage(spark.createDataFrame(texts + [(300, texts[7][1]), (5, texts[5][1]), (9, "other words")], "doc_id long, text string"), "test-docs")
    kept = near_dups.keep_one(docs)
    assert sorted(map(tuple, kept.collect())) == sorted([*texts, (9, "other words")])
    # rows that are surely neither gone nor repeated meet the bitmap only, without an exchange
    branch = plan_of(kept).split("Union")[1].split("(_n#")[0]
    assert "BroadcastHashJoin" in branch and "Exchange hashpartitioning(_near_id" not in branch
