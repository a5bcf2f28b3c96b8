"""Contexts of paragraphs that meet in one place, against those that are dealt by what they hold."""

from __future__ import annotations

import random

from rolecall.llm import passages
from rolecall.llm.shingles import bucket_links


def test_contexts_met_whole_are_those_dealt_apart(spark):
    draw, kinds = random.Random(11), []
    for paragraph in range(300):
        for _ in range(draw.choice([1, 2, 3, 40])):
            letters, keys = "", []
            for _ in range(draw.randrange(1, 9)):
                letters += draw.choice("ab")
                keys.append(hash((paragraph, letters)) // 2)
            least = draw.randrange(50)
            kinds.append((hash((paragraph, letters, "kind")), least, least + draw.choice([0, 0, 7]), paragraph, len(keys) % 2, keys))
    kinds = list({k[0]: k for k in kinds}.values())
    kinds.append(kinds[0])  # a text that is there twice
    rows = spark.createDataFrame(kinds, "kind long, least long, most long, paragraph long, side long, keys array<long>")
    # keys of the two sides never are equal in a real table
    from pyspark.sql import functions as F

    rows = rows.withColumn("keys", F.transform("keys", lambda k: k + F.col("side"))).withColumn("kind", F.col("kind").bitwiseXOR(F.col("side")))
    got, want = (sorted(tuple(r) for r in f(rows).distinct().collect()) if f is passages.deepest else sorted(map(tuple, f(rows).collect())) for f in (passages.met, passages.deepest))
    assert len(want) > 200 and {tuple(map(str, r)) for r in got} == {tuple(map(str, r)) for r in want}
    assert len(got) == len(want) and passages.met(rows.where("false")).count() == 0


def test_extensions_of_crowded_contexts(spark, monkeypatch):
    common = [f"c{n}" for n in range(60)]
    draw = random.Random(2)
    docs = [(n, " ".join([*(f"l{draw.randrange(2)}" for _ in range(9)), *common, *(f"r{draw.randrange(2)}" for _ in range(9))])) for n in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = []
    for many in (1024, 3):
        monkeypatch.setattr(passages, "MANY", many)
        found.append({tuple(r) for r in passages.repeated_passages(frame).collect()})
    assert found[0] == found[1] and len(found[0]) > 40


def test_settled_links_are_one_a_member(spark):
    buckets = spark.range(12).selectExpr("id", "0 AS band", "5L AS key", "12L AS n", "0L AS first", "1L AS second")
    links = bucket_links(buckets, lambda pairs: pairs, lambda ids: None, 0.8)
    assert {tuple(r) for r in links.collect()} == {(0, n) for n in range(1, 12)}  # not all 66 pairs
