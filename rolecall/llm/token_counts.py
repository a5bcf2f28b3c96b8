"""Operator 1, token counts: Arrow batches of about equal bytes go through the tokenizer, only lengths come back."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from itertools import chain, filterfalse

import public_tokenizers
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm.common import keep_in_worker, table
from rolecall.llm.registry import query

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_BYTES = 1 << 20
PIECE_CHARS = 1 << 16
CACHED_CHUNKS = 600_000
LONGEST_CACHED = 64

#: White space on which tokenizers and Python may differ; texts that hold any are not split at blanks.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class ChunkCounter:
    """Token counts of whole texts by one byte-level BPE tokenizer.

    Such a tokenizer never joins a character that is not white space with white space after it, so
    a text splits before each run of blanks without changing its tokens. Counts of short chunks are
    kept, up to a bound; the library encodes what is not known yet, in one batch.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, int] = {}
        self.chunks = re.compile(r"\s*\S+|\s+").findall

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def split(self, text: str) -> list[str]:
        return [text] if ODD_SPACE.search(text) else self.chunks(text)

    def count(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece."""
        split = [self.split(p) for p in pieces]
        unknown = set(filterfalse(self.known.__contains__, chain.from_iterable(split)))
        long = [c for c in unknown if len(c) > LONGEST_CACHED]
        once = dict(zip(long, self._lengths(long), strict=True))
        short = [c for c in unknown if len(c) <= LONGEST_CACHED]
        if len(self.known) + len(short) > CACHED_CHUNKS:
            self.known.clear()
            short = list({c for chunks in split for c in chunks if len(c) <= LONGEST_CACHED})
        self.known.update(zip(short, self._lengths(short), strict=True))
        if once:
            look = lambda c: once[c] if len(c) > LONGEST_CACHED else self.known[c]
        else:
            look = self.known.__getitem__
        return [sum(map(look, chunks)) for chunks in split]


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a long text before a run of blanks that follows another character, about every ``size`` characters.

    A text without such a place, or with unusual white space, stays whole.
    """
    if len(text) <= size or ODD_SPACE.search(text):
        yield text
        return
    start, boundary = 0, re.compile(r"(?<!\s)\s")
    while len(text) - start > size:
        found = boundary.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def byte_batches(texts: Iterator[str], size: int = BATCH_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """Pieces of consecutive texts with the texts' numbers, about ``size`` characters a batch."""
    rows, pieces, held = [], [], 0
    for row, text in enumerate(texts):
        for piece in safe_pieces(text):
            rows.append(row)
            pieces.append(piece)
            held += len(piece)
            if held >= size:
                yield rows, pieces
                rows, pieces, held = [], [], 0
    if pieces:
        yield rows, pieces


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    keys: list[str] | None = None,
    text: str = "text",
) -> DataFrame:
    """``keys``, ``n_bytes`` and ``n_tokens`` of each row's whole text.

    A null text counts as empty: 0 bytes, 0 tokens. Every row gives one row, repeated rows too;
    other columns are ignored; an empty table gives an empty one. ``tokenizer_path`` names a
    byte-level BPE file of the tokenizers library that every executor can open.
    """
    keys = ["doc_id"] if keys is None else keys
    narrow = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_text")).select(
        *keys, F.octet_length("_text").cast("long").alias("n_bytes"), "_text"
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = keep_in_worker(f"counter {tokenizer_path}", lambda: ChunkCounter(tokenizer_path))
        for batch in batches:
            totals = [0] * batch.num_rows
            column = batch.column(batch.num_columns - 1)
            for rows, pieces in byte_batches(value.as_py() for value in column):
                for row, n in zip(rows, counter.count(pieces), strict=True):
                    totals[row] += n
            columns = [*batch.columns[:-1], pa.array(totals, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_tokens"])

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in narrow.dtypes[:-1])
    return narrow.mapInArrow(count, f"{kinds}, n_tokens long")


LIMIT = 1024


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
