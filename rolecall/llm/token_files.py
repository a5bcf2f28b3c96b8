"""Operator 11, token files: ids as Parquet list columns, laid out so that few bytes answer a narrow question.

``tokens/`` holds one row per document in order of its key: the key, the place of its ids in the file, their number
and the ids. Ids are dictionary encoded, the ascending columns delta encoded; row groups and pages are small and
page indexes tell which page holds which keys. ``index/`` holds one row per file, so that a document's place among
all ids is known without reading any.
"""

from __future__ import annotations

import re
import string
import sys
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolecall.llm.byte_level import DistinctIds, LineModel, byte_letters, byte_slices
from rolecall.llm.common import keep_in_worker, table
from rolecall.llm.registry import query
from rolecall.session import shared_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END = 2
CACHED_CHUNKS = 1_000_000

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 1000

#: The characters of the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Characters that some tables count as white space and others do not; texts that hold any are not split.
DOUBTFUL = re.compile("[\x1c-\x1f" + "".join(map(chr, (0x180E, 0x200B, 0xFEFF))) + "]")
#: White space beyond ASCII.
UNUSUAL = re.compile(f"[{WHITE[4:]}]")
#: Bytes that begin any of these characters beyond ASCII, or that are one of them.
TELLING = np.isin(np.arange(256), list(b"\x1c\x1d\x1e\x1f") + [c.encode("utf-8")[0] for c in WHITE[4:] + "\u180e\u200b\ufeff"])
#: What stands before a run of white space never joins it.
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Chunks whose letters and signs every Unicode table agrees on, without the marks of special tokens.
PLAIN = re.compile(f"[\x00-\x1b !-;=-{chr(0x24F)}]*").fullmatch
#: Signs that make one piece behind a word, whatever the word.
SIGNS = string.punctuation


class ByteLevelIds(DistinctIds):
    """Ids of whole texts by one byte-level BPE file of the tokenizers library.

    A text splits before each run of white space and between a letter and a sign, a plain chunk further into
    the pieces that the file's pattern makes, which go through the library's model. Chunks that are not plain go
    through the whole library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__(CACHED_CHUNKS)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = LineModel(self.tokenizer)
        self.letter = byte_letters().__getitem__
        self.pattern = regex.compile(public_tokenizers.PATTERN).findall

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, chunk: str) -> str:
        """The pieces of a plain chunk in the model's letters, one a line."""
        word = chunk.rstrip(SIGNS)
        if word[:1] == " " and word[1:].isalpha():
            first = self.letter(" ") + (word[1:] if word.isascii() else "".join(map(self.letter, word[1:])))
            return f"{first}\n{chunk[len(word) :]}" if len(word) < len(chunk) else first
        return "\n".join("".join(map(self.letter, piece)) for piece in self.pattern(chunk))

    def _by_model(self, chunks: list[str]) -> list[bytes]:
        return self.model.encode(list(map(self._lines, chunks)))

    def _learn(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk, as little-endian 32-bit numbers."""
        texts = [c.decode("utf-8") for c in chunks]
        plain = [t for t in texts if PLAIN(t)]
        if len(plain) == len(texts):
            return self._by_model(plain)
        found = dict(zip(plain, self._by_model(plain), strict=True))
        other = [t for t in texts if t not in found]
        found.update(zip(other, self._whole(other), strict=True))
        return [found[t] for t in texts]

    def _suspects(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        telling = TELLING[data]
        telling[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        return np.unique(np.searchsorted(bounds, np.flatnonzero(telling), "right") - 1)

    def _unusual(self, text: str) -> list[str] | None:
        if DOUBTFUL.search(text):
            return [text]
        return CHUNK.findall(text) if "<|" in text or not text.isascii() and UNUSUAL.search(text) else None


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, end: int = END, key: str = "doc_id", text: str = "text"
) -> None:
    """Write ``tokens/`` and ``index/`` below ``path``.

    ``tokens``: ``key, at, n_tokens, ids`` in ascending order of the key, null keys first, rows of one key by the
    hash of their text; ``at`` counts the ids before it in its file. ``index``: per file its name, least and
    greatest key, rows, ids and ``first``, the ids in all files before it. A null text is the empty one and has
    the end id alone; every row gives one row, repeated rows too; other columns are left out. An empty table
    gives tables without rows. Rows are sorted as texts, so that ids are made where they are written.
    """
    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # equal rows are told apart by their place in the scan, so that many copies of one row still spread
    placed = narrow.orderBy("_key", F.xxhash64("_text"), F.monotonically_increasing_id())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = keep_in_worker(f"files {tokenizer_path}", lambda: ByteLevelIds(tokenizer_path))
        at = 0

        def record(keys: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
            nonlocal at
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.view(np.int32)))
            columns = [keys, pa.array(at + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), lists]
            at += int(ends[-1])
            return pa.RecordBatch.from_arrays(columns, names=["_key", "at", "n_tokens", "ids"])

        for batch in batches:
            texts = batch.column(1)
            for row, to in byte_slices(texts):
                ids, sizes = ids_of.encode(texts.slice(row, to - row))
                ends = np.cumsum(sizes)
                yield record(batch.column(0).slice(row, to - row), np.insert(ids, ends, end), sizes + 1)

    encoded = placed.mapInArrow(encode, f"_key {kind}, at long, n_tokens long, ids array<int>").withColumnRenamed("_key", key)
    writer = encoded.write.option("parquet.writer.version", "v2").option("parquet.block.size", ROW_GROUP_BYTES)
    writer = writer.option("parquet.page.size", PAGE_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS)
    for ascending in (key, "at", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{ascending}", "false")
    writer.option("maxRecordsPerFile", 0).parquet(f"{path}/tokens")
    _write_index(docs.sparkSession, path, key, encoded)


def _write_index(spark: SparkSession, path: str, key: str, written: DataFrame) -> None:
    rows = spark.read.schema(written.schema).parquet(f"{path}/tokens")
    files = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min(key).alias("least"), F.max(key).alias("greatest"), F.count("*").alias("rows"), F.sum("n_tokens").alias("n_tokens")
    )
    # one row per file; files are named in the order of their parts
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/index")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``tokens`` with ``start``, the ids of all documents before each. What is not selected is not read.

    A filter on the key reaches the row groups and pages that can hold it; without ``ids`` in the result none is read.
    """
    files = spark.read.parquet(f"{path}/index").select(F.col("file").alias("_file"), "first")
    rows = spark.read.parquet(f"{path}/tokens")
    # one small row per file
    joined = rows.withColumn("_file", F.col("_metadata.file_name")).join(F.broadcast(files), "_file")
    return joined.withColumn("start", F.col("first") + F.col("at")).drop("_file", "first", "at")


def with_crc32(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, start, n_tokens, ids_crc32`` of rows of ``read_documents``: the checksum of the ids as 32-bit numbers."""
    kind = documents.schema[key].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            ids = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            sizes = pa.array(np.diff(ends).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), sizes, pa.array(sums, pa.int64())], names=["_key", "start", "n_tokens", "ids_crc32"]
            )

    narrow = documents.select(F.col(key).alias("_key"), "start", "ids")
    checked = narrow.mapInArrow(check, f"_key {kind}, start long, n_tokens long, ids_crc32 long")
    return checked.withColumnRenamed("_key", key)


@query("op11_token_files")
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return with_crc32(read_documents(spark, path))
