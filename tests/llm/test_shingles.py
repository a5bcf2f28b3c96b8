"""Word hashes, distinct shingles and what near duplicates, passages and classes leave on disk."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rolecall.llm import common, passages
from rolecall.llm.shingles import MOST_ROWS, distinct, sliced, text_words, word_hashes
from rolecall.session import shared_root

DRAW = random.Random(3)
LETTERS = [*"abcdefgh0.", "\u00e9", "\u6f22", "\U0001f600", "\u00a0"]
TEXTS = ["", " \t\n", "a", "a", "b a\x0bb\x0ca\r", "x" * 70_000 + " y"] + [
    DRAW.choice(["", " "]) + " ".join("".join(DRAW.choices(LETTERS, k=DRAW.randrange(1, 90))) for _ in range(DRAW.randrange(40))) for _ in range(80)
]


def test_words_of_texts_hash_as_in_sql(spark):
    want = [r["h"] for r in spark.createDataFrame(list(enumerate(TEXTS)), "n int, text string").orderBy("n").select(word_hashes(F.col("text")).alias("h")).collect()]
    hashes, lengths = text_words(pa.array(["left out", *TEXTS]).slice(1))
    assert lengths.tolist() == list(map(len, want))
    assert hashes.view(np.int64).tolist() == [h for row in want for h in row]


def test_distinct_values_of_rows():
    rows = [[DRAW.randrange(2**64 - 9, 2**64) if DRAW.random() < 0.5 else DRAW.randrange(9) for _ in range(DRAW.choice([0, 1, 5, 30]))] for _ in range(MOST_ROWS + 50)]
    values, times, n = distinct(np.array([v for row in rows for v in row], np.uint64), np.array(list(map(len, rows))))
    want = [sorted(set(row)) for row in rows]
    assert n.tolist() == list(map(len, want)) and values.tolist() == [v for row in want for v in row]
    assert times.tolist() == [row.count(v) for row, some in zip(rows, want, strict=True) for v in some]
    assert sum(len(lengths) for _, _, _, lengths in sliced(pa.array(TEXTS))) == len(TEXTS)


def test_rounds_of_components_leave_the_last_alone(spark):
    links = spark.range(40).selectExpr("id AS a", "id + 1 AS b")
    root = Path(shared_root(spark).removeprefix("file:"))
    before = {p for p in root.rglob("*") if p.is_dir()}
    assert {(r["id"], r["class_id"]) for r in common.components(links).collect()} == {(n, 0) for n in range(41)}
    new = {p for p in root.rglob("*") if p.is_dir() and list(p.glob("*part-*"))} - before
    assert len(new) == 1


def test_passages_write_no_table_of_all_paragraphs(spark, monkeypatch):
    written, call = [], common.Stages.__call__
    monkeypatch.setattr(common.Stages, "__call__", lambda self, df, purpose: written.append(df.columns) or call(self, df, purpose))
    words = [[f"{n}.{k}" for k in range(200)] for n in range(4)]
    words[1][50:150] = words[0][50:150]
    docs = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(words)], "doc_id long, text string")
    spans = {tuple(r) for r in passages.repeated_passages(docs).collect()}
    assert spans == {(0, 0, 50, 100), (1, 0, 50, 100)}
    assert not any({"paragraph", "first", *passages.KEYS} <= set(columns) for columns in written)
