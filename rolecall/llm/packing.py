"""Operator 8, best-fit packing: plan on a histogram of lengths, then give documents their planned slots by rank."""

from __future__ import annotations

import re
import string
import struct
import sys
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm.byte_level import DistinctIds, LineModel, byte_letters, byte_slices
from rolecall.llm.common import batches_of, give_back, keep_in_worker, places, stage, table
from rolecall.llm.registry import query

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2048
RANK_BUCKETS = 256
#: About 200 bytes each in every Python worker.
CACHED_CHUNKS = 600_000
#: Bytes of texts that are encoded at a time, and texts that a worker reads at a time.
SLICE_BYTES = 2 << 20
BATCH_TEXTS = 1000

BLANKS = " \t\n\r\x0b\x0c"
CHUNK = re.compile(f"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+")

#: A run of these after a letter is one piece to the tokenizer, whatever the letter's word.
STOPS = string.punctuation
#: Letters whose lower case hangs on their place or is more than one character.
CASED_APART = re.compile("[\u0130\u03a3]")


#: Words that the tokenizer takes as they are and whole: lower-case letters that every Unicode table agrees on.
SMALL_LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c.lower() == c)
SIMPLE = re.compile(f"[{SMALL_LETTERS}]+").fullmatch


class ChunkIds(DistinctIds):
    """Ids of whole texts by a tokenizer that drops white space.

    Its tokens never reach over white space, nor from a letter to a sign, so the ids of a text are those of its
    chunks. New words go through the library, simple ones through its model alone.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__(CACHED_CHUNKS)
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letter = LineModel(self.tokenizer), byte_letters().__getitem__

    def _ids(self, chunks: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in encoded)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Simple words go through the model alone, many in one call."""
        simple = list(filter(SIMPLE, words))
        found = dict(zip(simple, self.model.encode([w if w.isascii() else "".join(map(self.letter, w)) for w in simple]), strict=True))
        other = [w for w in words if w not in found]
        found.update(zip(other, self._ids(other), strict=True))
        return [found[w] for w in words]

    def _learn(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks: those of the lower-case word, then those of the stops that end it.

        The tokenizer lower-cases and parts letters from signs itself, so both come from the library.
        """
        apart = [self._word_and_stops(c.decode("utf-8").lstrip(BLANKS)) for c in chunks]
        distinct = list(set(chain.from_iterable(apart)))
        ids = dict(zip(distinct, self._word_ids(distinct), strict=True))
        return [ids[word] + ids[stops] for word, stops in apart]

    def _unusual(self, text: str) -> list[str] | None:
        return CHUNK.findall(text) if "<|" in text else None

    @staticmethod
    def _word_and_stops(chunk: str) -> tuple[str, str]:
        word = chunk.rstrip(STOPS)
        if not word or not word[-1].isalpha():
            return chunk, ""
        if not chunk.isascii() and (CASED_APART.search(chunk) or not is_normalized("NFC", chunk)) or "<|" in chunk:
            return chunk, ""
        return word.lower(), chunk[len(word) :]


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of each document's ids followed by id 0: ``key, piece, start, length, ids_crc32``.

    A null text counts as empty and gives the one-token piece of id 0. Documents of up to
    ``capacity`` ids are one piece; longer ones are cut into full pieces and a rest.
    """
    narrow = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = keep_in_worker(f"ids {tokenizer_path}", lambda: ChunkIds(tokenizer_path))
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            texts = batch.column(1)
            for first, to in byte_slices(texts, SLICE_BYTES):
                ids, sizes = ids_of.encode(texts.slice(first, to - first))
                ends = np.cumsum(sizes)
                data = memoryview(np.insert(ids, ends, 0)).cast("B")
                for row, size, end in zip(range(first, to), (sizes + 1).tolist(), np.cumsum(sizes + 1).tolist(), strict=True):
                    for n, at in enumerate(range(0, size, capacity)):
                        part = data[4 * (end - size + at) : 4 * min(end, end - size + at + capacity)]
                        rows.append(row)
                        piece.append(n)
                        start.append(at)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["_key", "piece", "start", "length", "ids_crc32"],
            )
        give_back()

    pieces = narrow.mapInArrow(cut, f"_key {kind}, piece int, start long, length long, ids_crc32 long")
    return pieces.withColumnRenamed("_key", key)


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram: rows ``(length, from_rank, to_rank, first_sequence, offset)``.

    Ranks ``from_rank`` up to before ``to_rank`` of a length go to consecutive sequences from
    ``first_sequence`` on, all at ``offset``. Sequences with equal room are handled as one run, so
    the work grows with the number of lengths and not with the number of documents.
    """
    room: dict[int, list[list[int]]] = defaultdict(list)  # room left: runs of [first sequence, how many]
    plan, fresh = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fit = min((r for r, runs in room.items() if r >= length and runs), default=None)
            if fit is None:
                fit, need = capacity, -(-left // (capacity // length))
                room[capacity].append([fresh, need])
                fresh += need
            first, have = room[fit].pop()
            each = fit // length
            full = min(have, left // each)
            if full:
                for k in range(each):
                    plan.append((length, rank, rank + full, first, capacity - fit + k * length))
                    rank += full
                left -= full * each
                room[fit - each * length].append([first, full])
            if left and full < have:  # fewer than fill a sequence are left
                for k in range(left):
                    plan.append((length, rank, rank + 1, first + full, capacity - fit + k * length))
                    rank += 1
                room[fit - left * length].append([first + full, 1])
                full, left = full + 1, 0
            if full < have:
                room[fit].append([first + full, have - full])
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY, order_by: list[str] | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    The histogram has at most ``capacity`` rows, so it may go to the driver; the plan made from it
    grows with the number of lengths alone and is broadcast. Ranks within a length are taken in
    buckets, so that one common length does not meet in one task. Rows that are equal in
    ``order_by`` (all columns by default) are interchangeable. An empty table stays empty.
    """
    order_by = order_by or [c for c in pieces.columns if c != "length"]
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = pieces.sparkSession.createDataFrame(
        best_fit_plan(counts, capacity),
        "_length long, _from long, _to long, _first long, offset long",
    )
    ranked = places(pieces, ["length"], F.xxhash64(*order_by), RANK_BUCKETS, order_by, "_rank")
    slot = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return ranked.join(F.broadcast(plan), slot).select(
        *pieces.columns, (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset"
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack ``doc_id, text``: one row per piece with its sequence and place.

    Null and repeated ids are packed row by row; other columns are ignored.
    """
    with batches_of(docs.sparkSession, BATCH_TEXTS):
        pieces = stage(token_pieces(docs, tokenizer_path, capacity), "pieces")
    return pack(pieces, capacity)


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
