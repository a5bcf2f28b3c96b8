"""Token files, periodic runs and the filter audit against brute force; their odd rows."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from rolecall.llm import byte_level, filter_audit, periodic_runs, token_files
from rolecall.llm.queries import QUERIES
from rolecall.session import shared_path
from tests.oracle import TESTDATA

SF_DIR = f"{TESTDATA}/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, runs string, at long, mask int, part string, _text string, _id long"
TEXTS = [
    (5, "to be or not to be"), (1, "ha ha ha ha ha ha ha ha"), (2, None), (3, ""), (9, "x " * 40_000), (9, "x " * 40_000),
    (None, "no key"), (None, None), (7, "\n\t "), (8, "a b\x1c c a b\x1c c a b\x1c c a b\x1c c"), (4, "ha ha ha ha ha ha ha ha"),
    (6, "<|endoftext|> don't  stop\xa0  now \x85 漢字 é…"), (11, "y" * 90_000),
]


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, "en", None if n % 3 else "s", 0, "r", 7, 9, "p", "t", 4) for n, (i, t) in enumerate(rows)], SCHEMA
    )


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, TEXTS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "source").toPandas()


def packed(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


# token files


def test_ids_of_random_texts():
    library, ids_of = Tokenizer.from_file(BYTES), token_files.ByteLevelIds(BYTES)
    signs = ["a", "B", "é", "'s", "'", "12", " ", "  ", "\n", "\t", "\xa0", chr(0x2003), "\x1c", "\x85", chr(0x200B), "<|endoftext|>",
             "<|", "!", "...", "漢", "я", "😀", "e" + chr(0x301), "½", "_", "\x00", "\r\n", chr(0x24F), chr(0x250), "word" * 20]
    draw = random.Random(11)
    texts = ["".join(draw.choices(signs, k=draw.randint(0, 14))) for _ in range(5000)] + ["".join(draw.choices(signs, k=3000))]
    for _ in range(2):  # the second time from what is kept
        ids, sizes = ids_of.encode(pa.array(["unseen", *texts, ""]).slice(1))
        got = [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == [e.ids for e in library.encode_batch([*texts, ""], add_special_tokens=False)]


def test_byte_slices():
    texts = pa.array(["a" * n for n in (3, 3, 50, 0, 2, 9)]).slice(1)
    assert list(byte_level.byte_slices(texts, 10)) == [(0, 1), (1, 2), (2, 4), (4, 5)]
    assert list(byte_level.byte_slices(texts.slice(0, 0))) == []


def expected_documents(rows):
    """``doc_id, start, n_tokens, crc32`` of rows in order, by the library alone."""
    library, start, want = Tokenizer.from_file(BYTES), 0, []
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, token_files.END]
        want.append((key, start, len(ids), packed(ids)))
        start += len(ids)
    return want


def test_token_file_query(spark, documents):
    got = QUERIES["op11_token_files"](spark, SF_DIR)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = sorted(zip(documents["doc_id"], documents["text"], strict=True))
    assert sorted(map(tuple, got.collect())) == expected_documents(rows)


def test_token_files_of_odd_rows(spark, odd):
    path = shared_path(spark, "odd-tokens")
    token_files.write_tokens(odd, path, BYTES)
    got = token_files.with_crc32(token_files.read_documents(spark, path)).collect()
    assert len(got) == len(TEXTS)
    place = lambda r: (r["start"],)
    got = sorted(map(lambda r: r.asDict(), got), key=place)
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))  # null keys first, then ascending
    ends = [r["start"] + r["n_tokens"] for r in got]
    assert [r["start"] for r in got] == [0, *ends[:-1]]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(
        (k, n, c) for k, _, n, c in expected_documents(TEXTS)
    )


def test_token_files_of_no_rows(spark, odd):
    path = shared_path(spark, "no-tokens")
    token_files.write_tokens(odd.where("false"), path, BYTES)
    assert token_files.with_crc32(token_files.read_documents(spark, path)).collect() == []


def test_token_file_layout(spark, tmp_path):
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('word', id % 50, ' and more ') AS text")
    token_files.write_tokens(docs, str(tmp_path), BYTES)
    files = sorted((tmp_path / "tokens").glob("*.parquet"))
    columns = defaultdict(set)
    for file in files:
        group = pq.ParquetFile(file).metadata.row_group(0)
        for n in range(group.num_columns):
            column = group.column(n)
            columns[column.path_in_schema].update(column.encodings)
            assert column.has_column_index and column.has_offset_index
    assert "DELTA_BINARY_PACKED" in columns["doc_id"] & columns["at"] & columns["n_tokens"]
    assert "RLE_DICTIONARY" in columns["ids.list.element"]
    # keys ascend over the files, and the index knows their bounds
    index = [r.asDict() for r in spark.read.parquet(f"{tmp_path}/index").orderBy("file").collect()]
    assert [r["file"] for r in index] == [file.name for file in files if pq.read_metadata(file).num_rows]
    assert all(a["greatest"] <= b["least"] for a, b in zip(index, index[1:]))
    assert [r["first"] for r in index] == list(np.cumsum([0, *(r["n_tokens"] for r in index)])[:-1])


def test_selective_reads(spark, tmp_path):
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('word', id % 50, ' and more ') AS text")
    token_files.write_tokens(docs, str(tmp_path), BYTES)
    library = Tokenizer.from_file(BYTES)
    lengths = token_files.read_documents(spark, str(tmp_path)).select("doc_id", "n_tokens")
    plan = lengths._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema", 1)[1]
    one = token_files.read_documents(spark, str(tmp_path)).where("doc_id = 4321")
    assert "EqualTo(doc_id,4321)" in one._jdf.queryExecution().executedPlan().toString()
    (row,) = one.collect()
    assert row["ids"] == [*library.encode("word21 and more ").ids, token_files.END]
    assert row["start"] == sum(len(library.encode(f"word{n % 50} and more ").ids) + 1 for n in range(4321))


# periodic runs


def runs_by_hand(words, exponent=4, length=6):
    """Every lag over every word."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(length, exponent * q):
                found.setdefault((i - q, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def test_runs_of_random_words():
    draw, seen = random.Random(3), 0
    for _ in range(1500):
        words = []
        while len(words) < draw.randint(0, 80):
            words += [draw.randrange(3) for _ in range(draw.randint(1, 12))] * draw.randint(1, 7)
            words += words[-draw.randint(1, 20) :] * draw.randint(0, 5)
        for exponent in (3, 4):
            want = runs_by_hand(words, exponent)
            assert periodic_runs.find_runs(np.array(words, int), len(words) // exponent, exponent) == want
            seen += len(want)
    assert seen > 1500


@pytest.mark.parametrize("words", [[1] * 50_000, ([1] * 100 + [2]) * 400, [n % 997 for n in range(50_000)]])
def test_runs_of_common_words(words):
    runs = periodic_runs.find_runs(np.array(words), len(words) // 4)
    assert runs[0] in [(0, 50_000, 1), (0, 100, 1), (0, 50_000, 997)]
    assert len(runs) in (1, 401)


def test_runs_stay_within_texts():
    texts = [b"a b a b a b a", b"b a b a b a b a", b"", b"c c c c c c d"]
    got = list(periodic_runs.collapse([t.split() for t in texts]))
    assert got == [([], texts[0]), ([(0, 8, 2)], b"b a"), ([], b""), ([(0, 6, 1)], b"c d")]


def collapsed_by_hand(words):
    runs = runs_by_hand(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return runs, " ".join(w.decode() for i, w in enumerate(words) if i not in dropped)


def test_runs_of_odd_rows(spark, odd):
    small = [(i, t) for i, t in TEXTS if len(t or "") < 1000]
    got = periodic_runs.periodic_runs(odd).collect()
    assert len(got) == len(TEXTS)
    shape = lambda runs: tuple(tuple(r) for r in runs)
    want = Counter()
    for key, text in small:
        runs, collapsed = collapsed_by_hand((text or "").encode().split())
        want[key, shape(runs), collapsed] += 1
    want[9, ((0, 40_000, 1),), "x"] += 2
    want[11, (), "y" * 90_000] += 1
    assert Counter((r["doc_id"], shape(r["runs"]), r["collapsed"]) for r in got) == want
    assert periodic_runs.periodic_runs(odd.where("false")).collect() == []


def test_run_query(spark, documents):
    want = {}
    for key, text in zip(documents["doc_id"], documents["text"], strict=True):
        words, h = (text or "").encode().split(), zlib.crc32(str(key).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n <= 2000:  # every lag over every word takes long beyond that
            runs, collapsed = collapsed_by_hand(words)
            best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
            place = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
            want[key] = (len(runs), *place, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed)))
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, SF_DIR).collect()}
    assert len(got) == len(documents)
    assert {key: got[key] for key in want} == want
    assert sum(row[0] > 0 for row in want.values()) > 5


# filter audit


def audited(rows, filters, losses=0):
    """Counts by going through every order for every document ``(part, mask, *losses)``."""
    counts = defaultdict(Counter)
    for part, mask, *lost in rows:
        for order in permutations(range(len(filters))):
            name = "".join(filters[f] for f in order)
            gone = next((n for n, f in enumerate(order, 1) if mask >> f & 1), None)
            for step, f in enumerate(order, 1):
                row = counts[part, name, step]
                row["kept"] += gone is None or gone > step
                row["removed"] += gone == step
                row["redundant"] += bool(mask >> f & 1) and gone < step
                row["unique_fails"] += mask == 1 << f
                for n, value in enumerate(lost):
                    row[n] += (gone == step) * (value or 0)
            if gone:
                for other in permutations(range(len(filters))):
                    counts[part, "".join(filters[x] for x in other), other.index(order[gone - 1]) + 1]["shapley"] += 1
    names = ["kept", "removed", "redundant", "unique_fails", *range(losses), "shapley"]
    return {key: tuple(row[n] for n in names) for key, row in counts.items()}


@pytest.mark.parametrize("filters", ["A", "AB", "XYZ", "ABCD"])
def test_audit_of_random_masks(spark, filters):
    draw = random.Random(len(filters))
    rows = [(draw.choice(["p", "q", ""]), draw.randrange(1 << len(filters)), draw.choice([0, 1, None])) for _ in range(60)]
    masks = spark.createDataFrame(rows, "part string, mask int, bad int")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.audit(masks, filters, losses=["bad"]).collect()}
    assert got == audited(rows, filters, 1)
    assert filter_audit.audit(masks.where("false"), filters).collect() == []


def test_audit_of_odd_rows(spark):
    many, marked = " ".join(f"w{n}" for n in range(60)), " ".join(f"w{n}" for n in range(60)) + " #"
    rows = [(3, many), (1, many), (1, many), (2, marked), (None, many), (4, None), (5, ""), (6, many.upper()), (7, "a " * 60_000), (8, "a\x1cb " * 49)]
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (4, 0, 1), (None, 1, 1), (5, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit.failures(frame(spark, rows), labels).select("part", "mask", "good", "toxic").collect()
    # the text of 1 is first twice, that of 3 is its copy; 5 copies the missing text of 4; no key, no copy
    want = [("s", 16, 1, 1), ("", 0, None, None), ("", 0, None, None), ("s", 8, None, None), ("", 0, None, None), ("", 1, 0, 1),
            ("s", 17, None, None), ("", 4, None, None), ("", 2, None, None), ("s", 3, None, None)]
    assert Counter(map(tuple, got)) == Counter(want)
    assert filter_audit.failures(frame(spark, rows).where("false"), labels).collect() == []


def test_only_texts_that_may_be_unusual_become_strings():
    from rolecall.llm.token_files import DOUBTFUL, WHITE, ByteLevelIds

    ids = ByteLevelIds(public_tokenizers.path("byte_bpe_50k.json"))
    odd = [f"a{c}b" for c in WHITE[4:] + "\x1c\x1d\x1e\x1f\u180e\u200b\ufeff"] + ["<|endoftext|>", "a <| b"]
    assert all(DOUBTFUL.search(text) or ids._unusual(text) for text in odd)
    texts = ["", "plain text", "", "caf\u00e9 na\u00efve", "<", "| <", *odd, "a < b | c", ""]
    seen, unusual = [], ids._unusual
    ids._unusual = lambda text: seen.append(text) or unusual(text)
    got, sizes = ids.encode(pa.array(["left out", *texts]).slice(1))
    want = [ids.tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    assert got.tolist() == [i for row in want for i in row] and sizes.tolist() == list(map(len, want))
    assert set(odd) <= set(seen) and not set(seen) & {"plain text", "caf\u00e9 na\u00efve", "a < b | c"}
