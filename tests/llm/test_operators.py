"""The corpus operators on small odd tables, against brute force, and their queries against SQL."""

from __future__ import annotations

import hashlib
import itertools
import math
import struct
import zlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rolecall.llm import fingerprints, line_dedup, mixing, near_dups, packing, passages, sharding, token_counts, top_k, toxicity
from rolecall.llm.queries import ORACLES, QUERIES
from tests.oracle import TESTDATA, actual, connect, expected

SF_DIR = f"{TESTDATA}/sf0.001"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _id long, place string"
LONG = "alpha beta gamma delta <|endoftext|> don't  X1.\n" * 3000
TEXTS = [
    (1, "One line that is long enough\nshort\n  One Line that is long enough "), (2, "one line THAT is long enough\nother text"),
    (3, None), (4, ""), (5, LONG), (5, LONG), (None, "no id\nOne line that is long enough"), (None, None), (6, "\n\n"), (7, "x" * 70_000),
    (8, " ".join(f"w{n}" for n in range(60))), (9, " ".join(f"w{n}" for n in range(60)) + " end"), (10, "pre " + " ".join(f"w{n}" for n in range(55))),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None if n % 3 else "s", 0, 7, 8, "p") for n, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, TEXTS)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, TEXTS).where("false")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert actual(QUERIES[name](spark, SF_DIR)) == expected(connect(SF_DIR), ORACLES[name])


def test_token_counts(odd, empty):
    tokenizer = Tokenizer.from_file(BYTES)
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(odd, BYTES).collect())
    want = sorted((i or 0, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS)
    assert len(want) > 60 and not got ^ want
    assert token_counts.token_counts(empty, BYTES).count() == 0


def test_packing(odd, empty):
    tokenizer, got = Tokenizer.from_file(WORDS), packing.pack_documents(odd, WORDS).collect()
    want = Counter()
    for i, t in TEXTS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[i, n, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    ends = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048
    assert packing.pack_documents(empty, WORDS).count() == 0


def test_chunks_are_encoded_as_the_library_does():
    ids = packing.ChunkIds(WORDS)
    for chunk in ["Word.", "it's", "a.b.c!!", "<|endoftext|>", "<|ENDOFTEXT|>.", "I'LL.", "á.", "ΑΣ.", "İ!", "é.", "\x1c.", "1.",
                  "dogs'", "it's-", "End.###", "a<b>.", "é&&&", "x'll'?", "s'"]:
        want = ids.tokenizer.encode(chunk, add_special_tokens=False).ids
        assert ids.encode(pa.array([chunk]))[0].tolist() == want, chunk


def test_mixing(odd, empty):
    rows = mixing.mix_counts(odd).collect()
    assert len(rows) == len(TEXTS) and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mix(odd).count() == sum(r["copies"] for r in rows)
    assert mixing.mix(empty).count() == 0


def test_sharding(odd, empty):
    rows = sharding.shard_documents(odd, shards=3).collect()
    for shard in {r["shard"] for r in rows}:
        own = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert own == list(range(len(own)))
    assert sum(r["size"] for r in rows) == sum(len((t or "").encode()) + 1 for _, t in TEXTS)
    assert sharding.shard_documents(empty).count() == 0


def test_growing_a_map_moves_slots_into_the_new_shard_only():
    import numpy as np

    size = np.random.default_rng(1).integers(1, 1000, 4096).astype(float)
    before = sharding.rebalance(sharding.first_map(), size, 16)
    loads = np.bincount(before, weights=size)
    assert loads.max() - loads.min() <= 2


def test_line_dedup(odd, empty):
    rows = line_dedup.dedup_lines(odd).select("doc_id", "text", "_n_lines", "_n_dropped").collect()
    by_id = {r["doc_id"]: (r["text"], r["_n_lines"], r["_n_dropped"]) for r in rows if r["doc_id"] in (1, 2, 3, 6)}
    assert by_id == {1: (TEXTS[0][1], 3, 0), 2: ("other text", 2, 1), 3: ("", 1, 0), 6: ("\n\n", 3, 0)}
    assert sorted(r["text"] for r in rows if r["doc_id"] is None) == ["", "no id"]
    assert [r["text"] for r in rows if r["doc_id"] == 5] == [LONG, LONG]
    assert line_dedup.dedup_lines(empty).count() == 0


def test_fingerprints(odd, empty):
    rows = fingerprints.edited_fingerprints(odd.where("doc_id is not null and doc_id <> 5")).collect()
    order = sorted(((i, t or "") for i, t in TEXTS if i not in (None, 5)), reverse=True)
    want = {i: (t[: len(t) - len(t) // 2] + order[(n + 1) % len(order)][1][: len(t) // 2]) for n, (i, t) in enumerate(order)}
    assert {r["doc_id"]: hashlib.md5(r["edited"].encode()).hexdigest() for r in rows} == {
        i: hashlib.md5(t.encode()).hexdigest() for i, t in want.items()
    }
    same = {r["text"]: tuple(r["parts"]) for r in rows}
    assert all(same[r["text"]] == tuple(r["parts"]) for r in rows)
    assert fingerprints.edited_fingerprints(odd).count() == len(TEXTS)
    assert fingerprints.edited_fingerprints(empty).count() == 0


def test_near_dups(odd, empty):
    rows = near_dups.near_classes(odd).collect()
    classes = {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] is not None}
    assert classes == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8, 10: 8}
    assert near_dups.keep_one(odd).columns == odd.columns
    assert near_dups.keep_one(odd).count() == len(set(r["_class"] for r in rows))
    assert near_dups.near_classes(empty).count() == 0


def test_passages(odd, empty):
    rows = passages.repeated_passages(odd).collect()
    assert {r["_id"] for r in rows} == {8, 9, 10} and {r["class_id"] for r in rows} == {8}
    assert passages.repeated_passages(empty).count() == 0


def test_top_k_of_odd_vectors(spark):
    vectors = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (40, None), (60, [float("nan"), 1.0]), (1, [1.0, None]), (2, [3.0]), (3, []),
               (4, [1e9, -1e9]), (5, [1.0, 2.0]), (6, [1.0, 2.0]), (None, [1.0, 1.0])]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F

    rows = rows.select("vec_id", top_k.quantised(F.col("embedding")).alias("vector"), (F.col("vec_id") % 20 == 0).alias("wanted"))
    got = [tuple(r) for r in top_k.top_k(rows, 3).orderBy("query_id", "rank").collect()]
    whole = {i: [int(64 * x // 1) for x in v] for i, v in vectors if i in (0, 20, 2, 3, 4, 5, 6)}
    want = []
    for q in (0, 20):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=False)), i) for i, v in whole.items() if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:3])]
    assert len(want) > 60 and not got ^ want
    assert top_k.top_k(rows.where("false")).count() == 0


def test_toxicity_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{TESTDATA}/sf0.01/labels.parquet")
    rows = toxicity.op9_toxicity(spark, f"{TESTDATA}/sf0.01").join(labels, "doc_id").where("held_out").collect()
    bad, good = [[r["score"] for r in rows if r["toxic"] == k] for k in (1, 0)]
    assert sum(b > g for b in bad for g in good) / (len(bad) * len(good)) > 0.85
    assert sum(g >= 0.7 for g in good) / len(good) < 0.05


def test_toxicity_on_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.reject_toxic(odd, none).count() == len(TEXTS)
    assert toxicity.reject_toxic(empty, none).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert rows and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near duplicates", "mixing", "packing"]


def components_of(ids, links):
    least = {i: i for i in ids}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        least[b] = a
    return {i: root(i) for i in ids}


def test_a_crowded_bucket_of_paragraphs_keeps_every_link(spark):
    from pyspark.sql import functions as F

    from rolecall.llm.shingles import band_buckets, bucket_links

    sets = {}
    for g in range(60):  # groups of three with a template in common; some sets are smaller
        own = [1000 * g + k for k in range(8)]
        for m, last in enumerate(([1], [2], [])):
            sets[len(sets) * 7919 % 10007] = [*range(-10, 0), *own[: 8 - len(last)], *(1000 * g + 100 + m for _ in last)]
    want = [(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))]
    assert len(want) == 180
    frame = spark.createDataFrame(list(sets.items()), "id long, shingles array<int>")

    def verify(pairs):
        both, either = F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))
        return pairs.join(frame.toDF("a", "x"), "a").join(frame.toDF("b", "y"), "b").where(both >= 0.8 * either).select("a", "b")

    buckets = band_buckets(frame.select("id", F.array(F.lit(5)).cast("array<long>").alias("keys")))
    links = bucket_links(buckets, verify, lambda ids: passages.rare_shingles(frame.join(ids, "id", "left_semi"), 0.8), 0.8)
    got = [tuple(r) for r in links.collect()]
    assert set(got) <= set(want) and components_of(sets, got) == components_of(sets, want)


def test_near_dups_of_a_hot_template(spark):
    template = [f"t{n}" for n in range(1000)]
    texts = {}
    for g in range(200):
        for m in range(2):
            texts[len(texts)] = " ".join([*template, *(f"g{g}.{n}" for n in range(6)), *(f"o{g}.{m}.{n}" for n in range(10))])
    # a text is 0.86 like its twin and 0.79 like all others, weighed by log(1 + 400 / documents)
    classes = {r["doc_id"]: r["class_id"] for r in near_dups.near_classes(frame(spark, list(texts.items()))).collect()}
    assert classes == {i: i - i % 2 for i in texts}


def test_passages_reach_the_ends_of_shared_runs(spark):
    import random

    draw = random.Random(3)
    fresh = lambda n: [f"u{draw.random()}" for _ in range(n)]
    common = [fresh(n) for n in (50, 57, 64, 100, 90)]
    docs = {i: [w for _ in range(2) for part in (fresh(draw.randint(0, 45)), draw.choice(common)[: draw.randint(50, 100)]) for w in part] for i in range(30)}
    docs[30] = docs[29]
    got = passages.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in docs.items()])).collect()
    runs = {}
    for i, w in docs.items():
        for at in range(len(w) - 49):
            runs.setdefault(tuple(w[at : at + 50]), set()).add(i)
    for i, w in docs.items():
        spans = [(r["first_word"], r["first_word"] + r["n_words"], r["class_id"]) for r in got if r["_id"] == i]
        for at in range(len(w) - 49):
            holders = runs[tuple(w[at : at + 50])]
            if len(holders) > 1:
                for n in range(at, at + 50):
                    assert any(a <= n < b for a, b, _ in spans)
                    assert min(holders) == i or any(a <= n < b and c != i for a, b, c in spans)
        seen = " | ".join(" ".join(v) for k, v in docs.items() if k != i)
        whole = {n for at in range(len(w) - 21) if " ".join(w[at : at + 22]) in seen for n in range(at - 2, at + 24)}
        assert {n for a, b, _ in spans for n in range(a, b)} <= whole  # a near paragraph has two other words at most


def test_longest_shared_contexts_match_brute_force(spark):
    """What equal paragraphs reach to, word by word, against all pairs of occurrences."""
    import random

    draw = random.Random(5)
    common = [f"c{n}" for n in range(passages.PARAGRAPH + passages.RUN + 1)]
    side = lambda: [f"w{draw.random() < 0.1}.{n}" for n in range(draw.choice([0, 3, 11, 28, 35]))]
    docs = {i: [*reversed(side()), *common, *side()] for i in range(60)}
    docs[60], docs[61] = docs[7], docs[8]
    texts = frame(spark, [(i, " ".join(w)) for i, w in docs.items()]).select(F.col("doc_id").alias("_id"), F.col("doc_id").alias("place"), "text")
    found = passages.paragraph_rows(texts.select("_id", "place", passages.word_hashes(F.col("text")).alias("words")))
    most = found.groupBy("paragraph").count().orderBy(F.desc("count"), "paragraph").first()["paragraph"]
    held = found.where(F.col("paragraph") == most)
    assert held.count() == len(docs)
    at = {r["_id"]: r["first"] for r in held.collect()}
    words = {i: (list(reversed(docs[i][:f]))[: passages.CONTEXT], docs[i][f + passages.PARAGRAPH :][: passages.CONTEXT]) for i, f in at.items()}
    want = set()
    for i, f in at.items():
        for k in (0, 1):
            own = words[i][k]
            best = {}
            for o in at:
                if o != i:
                    other = words[o][k]
                    best[o] = next((n for n, (a, b) in enumerate(zip(own, other)) if a != b), min(len(own), len(other)))
            kept = max(best.values(), default=0)
            gone = max((n for o, n in best.items() if o < i), default=0)
            first = min((o for o, n in best.items() if o < i and n == gone), default=None)
            for who, near, far in ((first, 0, gone), (i, gone, kept)):
                if near < far:
                    want.add((i, who, f - far, f - near) if k == 0 else (i, who, f + passages.PARAGRAPH + near, f + passages.PARAGRAPH + far))
    got = {tuple(r) for r in passages.extensions(texts, held).collect()}
    assert len(want) > 60 and not got ^ want


CLASHING = ["_id", "_row", "_lines", "drop", "score", "found", "_copy", "_near_id", "_n_lines", "_n_dropped", "_all", "_t1", "class_id", "_place", "batch", "h1"]


@pytest.fixture(scope="module")
def clashing(spark):
    """Columns under the names that operators use inside; each holds its row's number and the name."""
    texts = ["A shared line of some length\nown line one here", "a shared LINE of some length\nown line two here", None, "", "A shared line of some length"]
    rows = [(n, t, "s", 9, *[f"{n} {c}" for c in CLASHING]) for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))


def extras(rows):
    return {r["doc_id"]: tuple(r[c] for c in CLASHING) for r in rows}


def test_extra_columns_come_out_as_they_went_in(spark, clashing):
    whole = {n: tuple(f"{n} {c}" for c in CLASHING) for n in range(5)}
    lines = line_dedup.dedup_lines(clashing)
    assert lines.columns == [*clashing.columns, "_n_lines_", "_n_dropped_"]
    got = {r["doc_id"]: r for r in lines.collect()}
    assert extras(got.values()) == whole
    assert [(got[n]["text"], got[n]["_n_lines_"], got[n]["_n_dropped_"]) for n in range(5)] == [
        ("A shared line of some length\nown line one here", 2, 0), ("own line two here", 2, 1), ("", 1, 0), ("", 1, 0), ("", 1, 1),
    ]
    labels = spark.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int")
    assert extras(toxicity.reject_toxic(clashing, labels).collect()) == whole
    kept = near_dups.keep_one(clashing)
    assert kept.columns == clashing.columns and extras(kept.collect()) == {n: whole[n] for n in (0, 1, 2, 4)}
    mixed = mixing.mix(clashing)
    assert mixed.columns == clashing.columns
    assert all(whole[r["doc_id"]] == tuple(r[c] for c in CLASHING) for r in mixed.collect())
    staged = corpus_pipeline.lines(spark, clashing, SF_DIR)
    assert staged.columns == clashing.columns and extras(staged.collect()) == whole


def test_texts_of_one_id_stay(spark):
    rows = [(1, "one text", "b"), (1, "one text", "a"), (1, "another text", "c"), (2, "one text", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    assert sorted(map(tuple, near_dups.keep_one(docs).collect())) == [(1, "another text", "c"), (1, "one text", "a")]


def test_kernel_matches_listed_subsequences():
    words = ["idiot", "id1ot", "i-diot", "haha", "a", "", "mmmm", "idiocy", "stu pid".replace(" ", ""), "größe"]

    def listed(word):
        marked, found, length = "\x02" + word + "\x03", Counter(), 0.0
        for i, j, k in itertools.combinations(range(len(marked)), 3):
            if k - i <= toxicity.SPAN:
                weight = toxicity.DECAY ** (k - i + 1)
                found[marked[i] + marked[j] + marked[k]] += weight
                length += weight * weight
        return found, length**0.5

    got = toxicity.kernel([w for w in words if w], ["idiot", "haha", "mmmm"])
    for n, word in enumerate(w for w in words if w):
        own, length = listed(word)
        for m, mark in enumerate(["idiot", "haha", "mmmm"]):
            other, other_length = listed(mark)
            want = sum(own[s] * other[s] for s in own) / (length * other_length)
            assert got[n, m] == pytest.approx(want, abs=1e-5), (word, mark)


def test_shards_against_plain_python(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op6_sharding"](spark, SF_DIR).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {
        i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()
    }
    assert len(rows) == len(texts) and {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    loads, slots = Counter(), {}
    for r in rows:
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(loads) == set(range(16))
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    largest = max(r["size"] for r in rows)
    assert max(loads.values()) - min(loads.values()) <= largest


def test_a_grown_map_fills_the_new_shard():
    import numpy as np

    size = np.random.default_rng(2).integers(1, 1000, 4096).astype(float)
    before = sharding.rebalance(sharding.first_map(), size, 16)
    after = sharding.rebalance(before, size, 17)
    loads = np.bincount(after, weights=size, minlength=17)
    assert loads.max() - loads.min() <= 2
    # about a 17th of the bytes has to move, and little more does
    assert size[after != before].sum() <= 2 * size.sum() / 17


def test_fingerprints_against_plain_python(spark):
    xx = lambda data, seed=42: xxhash.xxh64_intdigest(data, seed)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()), reverse=True)

    def terms(text):
        found = regex.split(r"[ \t\n\x0b\f\r\p{P}\p{S}\p{C}]+", text.lower())
        return {signed(xx(t.encode())) for t in found if t}

    frequency = Counter(h for _, t in docs for h in terms(t))
    low = max(fingerprints.LEAST_DOCUMENTS, len(docs) * fingerprints.LEAST_SHARE)
    band = {h for h, n in frequency.items() if low <= n <= max(low, len(docs) * fingerprints.MOST_SHARE)}

    def parts(text):
        own = sorted(terms(text) & band)

        def short(some):
            seed = 42
            for h in some:
                seed = xx(struct.pack("<q", h), seed)
            return seed & 0xFFFFFFFF if some else None

        found = [short(own) if own else xx(text.encode()) & 0xFFFFFFFF]
        for first_bit, values, used in fingerprints.SUBSETS:
            found += [short([h for h in own if (h % (1 << 64) >> first_bit) % values == k]) for k in range(used)]
        return found

    def likeness(a, b):
        told = [x == y for x, y in zip(a, b, strict=True) if x is not None or y is not None]
        return sum(told) / len(told)

    printed = lambda some: ".".join("-" if p is None else f"{p:08x}" for p in some)
    want = {}
    for n, (i, text) in enumerate(docs):
        other, half = docs[(n + 1) % len(docs)][1], len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        a, b, c = parts(text), parts(edited), parts(other)
        want[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), printed(a), printed(b), likeness(a, b), likeness(a, c))
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op4_fingerprints"](spark, SF_DIR).collect()}
    assert got == want


def test_near_dups_against_all_pairs(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}

    def shingles(text):
        words = [w for w in regex.split(r"[ \t\n\x0b\f\r]+", text) if w]
        return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()

    sets = {i: shingles(t) for i, t in docs.items()}
    frequency = Counter(s for own in sets.values() for s in own)
    weighed = {i: {s: n * math.log1p(len(docs) / frequency[s]) for s, n in own.items()} for i, own in sets.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(docs), 2):
        x, y = weighed[a], weighed[b]
        both = sum(min(w, y[s]) for s, w in x.items() if s in y)
        either = sum(x.values()) + sum(y.values()) - both
        if docs[a] == docs[b] or (either and both >= near_dups.SIMILARITY * either):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op5_near_dups"](spark, SF_DIR).collect()}
    want = {i: find(i) for i in docs}
    assert len(set(want.values())) < len(want)
    assert got == want
