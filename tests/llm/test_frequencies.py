"""Near duplicates weigh every shingle by the number of documents that hold it, however few they are."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa

from rolecall.llm import near_dups
from rolecall.llm.shingles import sliced


def words(name, n):
    return " ".join(f"{name}{k}" for k in range(n))


def test_counts_of_shared_shingles_are_exact(spark, monkeypatch):
    for name, value in (("BLOCK_BYTES", 700), ("ROW_SHINGLES", 16)):
        monkeypatch.setattr(near_dups, name, value)
    texts = [words(f"g{n % 40}x", 9 + n % 23) + f" own{n} " + words(f"h{n % 90}x", 12) for n in range(300)] + ["", "one", "one", words("g1x", 400)]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    own = [values.tolist() for text in texts for _, values, _, _ in sliced(pa.array([text]))]
    want = Counter(h for held in own for h in held)
    for parts in (1, 7):
        held = near_dups.blocks(rows.repartition(3)).localCheckpoint()
        told = {}
        for block, h, n in near_dups.shared_shingles(held, parts).collect():
            told.setdefault(block, []).extend(zip(near_dups.from_planes(h, np.uint64).tolist(), near_dups.from_planes(n, np.int64).tolist(), strict=True))
        docs = [(block, batch) for block, blob in held.collect() for batch in near_dups._opened(blob)]
        assert len({block for block, _ in docs}) > 20 and sum(batch.num_rows for _, batch in docs) == len(texts)
        for block, found in told.items():
            inside = {h for b, batch in docs if b == block for n in batch.column(0).to_pylist() for h in own[n]}
            assert sorted(found) == sorted((h, want[h]) for h in inside if want[h] > 1)
        assert {h for found in told.values() for h, _ in found} == {h for h, n in want.items() if n > 1}


def test_rare_shingles_weigh_by_their_own_documents(spark):
    # of 3,000 documents; a 500th of them are six, and all shingles here are in five at most
    docs = [words(f"other{n}x", 8) for n in range(2974)]
    apart, alike = [], []
    for group in range(4):
        # 196 of 240 shingles are shared, with three documents more: 0.817 by number, below 0.79 by weight
        shared = words(f"s{group}x", 200)
        apart.append((len(docs), len(docs) + 1))
        docs += [f"{shared} {words(f'a{group}x', 22)}", f"{shared} {words(f'b{group}x', 22)}"]
        docs += [f"{shared} {words(f'c{group}y{n}x', 300)}" for n in range(3)]
    # 160 of 202 shingles are shared by these two alone: 0.792 by number, above 0.8 by weight, as the others are in five each
    shared = words("t", 164)
    alike.append((len(docs), len(docs) + 1))
    docs += [f"{shared} {words('u', 21)}", f"{shared} {words('v', 21)}"]
    docs += [f"{words(f'w{n}x', 300)} {words('u', 21)} {words(f'w{n}y', 300)} {words('v', 21)}" for n in range(4)]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(docs)], "doc_id long, text string")
    classes = {r["doc_id"]: r["class_id"] for r in near_dups.near_classes(rows).collect()}
    assert len(docs) == 3000 and len(classes) == 3000
    assert all(classes[a] != classes[b] for a, b in apart)
    assert all(classes[a] == classes[b] for a, b in alike)
