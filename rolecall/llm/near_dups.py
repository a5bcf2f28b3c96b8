"""Operator 5, MinHash near-dedup: consistent weighted sampling over TF-IDF shingles, banded, then verified."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolecall.llm.byte_level import byte_slices
from rolecall.llm.common import Stages, batches_of, components, give_back, packed_row, sift, stage, table
from rolecall.llm.registry import query
from rolecall.llm.shingles import SLICE_BYTES, band_buckets, bucket_links, distinct, mix, shingled, sliced, starts_of, text_words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIMILARITY = 0.8
#: 8 bands of 3 samples: a pair at 0.8 shares a band with probability 0.997.
BANDS, ROWS = 8, 3
#: Pairs that agree in fewer of the 24 samples are not verified; a pair at 0.8 does with probability 0.0004.
LEAST_AGREEMENT = 13
#: Bytes of texts of a block, and of those whose shingles are counted in one place, about.
BLOCK_BYTES, PART_BYTES = 4 << 20, 8 << 20
#: Shingles of a row on its way to be counted, and such rows or blocks that a task is handed at a time.
ROW_SHINGLES, ROWS_A_TIME = 1 << 14, 8
#: Texts that a task is handed at a time.
TEXTS_A_TIME = 1000
#: Pairs of texts that are compared at a time.
PAIRS_A_TIME = 64
NO_ID = 1 << 62


def planes(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte: all first bytes, all second ones and so on. The upper ones of sorted numbers compress well."""
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _opened(blob: bytes) -> pa.RecordBatchStreamReader:
    return pa.ipc.open_stream(pa.BufferReader(blob))


def _columns(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(column.to_pylist() for column in batch.columns), strict=True)


def blocks(rows: DataFrame) -> DataFrame:
    """``block, blob``: rows whose last column is a text, of about ``BLOCK_BYTES`` of texts each, compressed."""

    def packed(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for part in held:
                out.write_batch(part)
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "blob"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for row, to in byte_slices(texts, BLOCK_BYTES):
                own = pc.sum(pc.binary_length(texts.slice(row, to - row))).as_py()
                if held and size + own > BLOCK_BYTES:
                    yield packed(number, held)
                    number, held, size = number + 1, [], 0
                held.append(batch.slice(row, to - row))
                size += own
        if held:
            yield packed(number, held)
        give_back()

    return rows.mapInArrow(pack, "block long, blob binary")


def shared_shingles(held: DataFrame, parts: int) -> DataFrame:
    """``block, h, n``: each block's shingles that several documents hold, with the number of all documents that do.

    ``held`` has blocks of documents. The distinct shingles of a block meet those of all others, each
    in one of ``parts`` ranges of hashes, so a very common one is there once a block. Every count is
    exact; a shingle that a block has and that is not told is in one document.
    """
    limits = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in _columns(batch):
                each = [x[1] for texts in _opened(blob) for x in sliced(texts.column(texts.num_columns - 1))]
                values = np.sort(np.concatenate(each))
                at = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
                n = np.diff(np.append(at, len(values))).astype(np.int32)
                values = values[at]
                bounds = [0, *np.searchsorted(values, limits).tolist(), len(values)]
                rows = [(part, x, min(x + ROW_SHINGLES, to)) for part, (at, to) in enumerate(pairwise(bounds)) for x in range(at, to, ROW_SHINGLES)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(rows), pa.int64()), pa.array([x[0] for x in rows], pa.int32()),
                     pa.array([planes(values[x:to]) for _, x, to in rows], pa.binary()), pa.array([planes(n[x:to]) for _, x, to in rows], pa.binary())],
                    names=["block", "part", "h", "n"],
                )
        give_back()

    def several(rows: list[tuple]) -> pa.RecordBatch:
        """Of all rows of a part."""
        values = [from_planes(h, np.uint64) for _, h, _ in rows]
        every, n = np.concatenate(values), np.concatenate([from_planes(x, np.int32) for _, _, x in rows])
        order = np.sort(every)
        often = np.unique(np.concatenate([order[1:][order[1:] == order[:-1]], every[n > 1]]))
        del order
        at = np.searchsorted(often, every)
        at[at == len(often)] = 0
        same = often[at] == every if len(often) else np.zeros(len(every), bool)
        total = np.bincount(at[same], weights=n[same], minlength=len(often)).astype(np.int64)
        ends = np.cumsum([len(x) for x in values])
        out = [(block, planes(every[some]), planes(total[at[some]]))
               for (block, _, _), start, end in zip(rows, [0, *ends], ends, strict=False) if len(some := start + np.flatnonzero(same[start:end]))]
        return pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["block", "h", "n"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now = [], None
        for batch in batches:
            for block, part, h, n in _columns(batch):
                if rows and part != now:
                    yield several(rows)
                    rows = []
                now = part
                rows.append((block, h, n))
        if rows:
            yield several(rows)
        rows.clear()
        give_back()

    each = held.select("block", "blob").mapInArrow(cut, "block long, part int, h binary, n binary")
    together = each.repartition(_partitions(held), "part").sortWithinPartitions("part")
    return together.mapInArrow(count, "block long, h binary, n binary")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def frequencies(values: np.ndarray, often: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many documents hold each of ``values``: ``n`` for those in ``often``, which is sorted, else one."""
    if not len(often):
        return np.ones(len(values), np.int32)
    at = np.searchsorted(often, values)
    at[at == len(often)] = 0
    return np.where(often[at] == values, n[at], 1).astype(np.int32)


def weigh(times: np.ndarray, n: np.ndarray, documents: int) -> np.ndarray:
    """TF-IDF: times in the text, times the logarithm of one plus documents over documents with the shingle."""
    return times * np.log1p(documents / n).astype(np.float32)


def samples(values: np.ndarray, weights: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Improved consistent weighted sampling: ``n`` samples of each row, equal with the rows' weighted Jaccard as chance.

    For each shingle and sample the gamma and uniform variates come from hashes of both; the sample is
    the shingle with the least a = c / (y e^r) and its level t. A row without shingles has zeros.
    """
    full = np.flatnonzero(lengths)
    out = np.zeros((len(lengths), n), np.uint64)
    if not len(full):
        return out
    starts, own = starts_of(lengths)[full], np.repeat(np.arange(len(full)), lengths[full])
    log_weight = np.log(weights.astype(np.float32))
    unit = np.float32(2**-32)
    half = np.float32(2**-33)
    for k in range(n):
        a = mix(values + np.uint64(0x632BE59BD9B4E019 * (2 * k + 1) % 2**64))
        b = mix(a ^ np.uint64(0x9FB21C651E98DF25))
        low = np.uint64(0xFFFFFFFF)
        c_1, c_2 = (a & low).astype(np.float32) * unit + half, (a >> np.uint64(32)).astype(np.float32) * unit + half
        r_1 = (b & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2**-24) + np.float32(2**-25)
        r_2 = ((b >> np.uint64(24)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2**-24) + np.float32(2**-25)
        beta = (b >> np.uint64(48)).astype(np.float32) * np.float32(2**-16)
        r = -np.log(r_1 * r_2)
        t = np.floor(log_weight / r + beta)
        log_a = np.log(np.maximum(-np.log(np.minimum(c_1 * c_2, np.float32(1 - 1e-7))), np.float32(1e-30))) - r * (t - beta + 1)
        least = np.minimum.reduceat(log_a, starts)
        picked = np.where(log_a == least[own], mix(a ^ t.astype(np.int64).view(np.uint64)), np.uint64(2**64 - 1))
        out[full, k] = np.minimum.reduceat(picked, starts)
    return out


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``_id, doc_id, class_id`` of each row of ``docs``: classes of near-duplicate texts.

    Equal texts are one text from the start. Texts whose TF-IDF weighted Jaccard over five-word
    shingles is at least ``similarity`` are linked, and a class is a component of links; its id is its
    smallest ``doc_id``. Null texts are empty, and empty texts are equal. Rows of one id count as one
    document. Rows without id have an id of their text's hash above all others, and null as
    ``class_id`` where a class has no other. Other columns are ignored; an empty table stays empty.
    Ids lie below 2^62.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    own = F.coalesce(F.col(key).cast("long"), F.xxhash64(whole).bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID))
    rows = docs.select(F.col(key).alias("doc_id"), own.alias("_id"), whole.alias("text"))
    documents, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()

    def signed_rows(batches: Iterator[pa.RecordBatch], often: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, values, times, lengths in sliced(batch.column(batch.num_columns - 1)):
                n = frequencies(values, often, counts)
                drawn = samples(values, weigh(times, n, documents), lengths, BANDS * ROWS)
                keys = np.zeros((len(lengths), BANDS), np.uint64)
                for band in range(BANDS):
                    for k in range(ROWS):
                        keys[:, band] = mix(keys[:, band] + drawn[:, band * ROWS + k] + np.uint64(band + 1))
                keys[lengths == 0] = 0
                columns = [column.slice(row, len(lengths)) for column in batch.columns[:-1]]
                for found, kind in ((keys.view(np.int64), pa.int64()), ((drawn & np.uint64(0x7FFFFFFF)).astype(np.int32), pa.int32())):
                    offsets = np.arange(len(lengths) + 1, dtype=np.int32) * found.shape[1]
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel(), kind)))
                ends = pa.array(np.append(0, np.cumsum(lengths * n.itemsize)).astype(np.int32))
                columns.append(pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, ends.buffers()[1], pa.py_buffer(n.tobytes())]))
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "keys", "drawn", "n"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a block come after what its shingles count."""
        now, often, counts = None, [], []
        for batch in batches:
            for block, h, n, blob in _columns(batch):
                if block != now:
                    now, often, counts = block, [], []
                if blob is None:
                    often.append(from_planes(h, np.uint64))
                    counts.append(from_planes(n, np.int64))
                    continue
                known, known_n = np.concatenate([np.zeros(0, np.uint64), *often]), np.concatenate([np.zeros(0, np.int64), *counts])
                order = np.argsort(known)
                yield from signed_rows(_opened(blob), known[order], known_n[order])
        give_back()

    staged = Stages(spark)
    with batches_of(spark, TEXTS_A_TIME):
        held = staged(blocks(rows.select("doc_id", "_id", F.xxhash64("text").alias("t1"), F.hash("text").alias("t2"), "text")), "near-blocks")
    with batches_of(spark, ROWS_A_TIME):
        often = staged(shared_shingles(held, max(1, -(-size // PART_BYTES))), "near-often")
        both = often.withColumn("blob", F.lit(None).cast("binary")).unionByName(held, allowMissingColumns=True)
        signed = stage(
            both.repartition(_partitions(held), "block").sortWithinPartitions("block", F.col("blob").isNotNull())
            .mapInArrow(sign, "doc_id long, _id long, t1 long, t2 int, keys array<long>, drawn array<int>, n binary"),
            "near-signed",
        )
    staged.drop("near-blocks", "near-often")
    texts = stage(
        signed.groupBy("t1", "t2").agg(F.min("_id").alias("id"), F.any_value("keys").alias("keys"), F.any_value("drawn").alias("drawn")),
        "near-texts",
    )
    drawn = texts.select("id", "drawn")
    agree = F.size(F.filter(F.zip_with("drawn_a", "drawn_b", lambda x, y: x == y), lambda same: same))

    def texts_of(ids: DataFrame) -> DataFrame:
        # with the counts of each text's shingles, in the order that ``distinct`` gives them
        ids, own = stage(ids.select(F.col("id").alias("_id")), "near-wanted"), ["_id", "t1", "t2"]
        counts = sift(signed.select(*own, "n"), "_id", ids).where("_may").join(ids, "_id", "left_semi").dropDuplicates(["_id"])
        wanted = sift(rows.select("_id", "text"), "_id", ids).where("_may").drop("_may")
        wanted = wanted.withColumns({"t1": F.xxhash64("text"), "t2": F.hash("text")}).dropDuplicates(own)
        return stage(wanted.join(counts, own).select(F.col("_id").alias("id"), "text", "n"), "near-sets")

    def weighed(texts: pa.StringArray, n: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values, times, lengths = distinct(*shingled(*text_words(texts)))
        return values, weigh(times, np.frombuffer(b"".join(n.to_pylist()), np.int32), documents), lengths

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PAIRS_A_TIME):
                batch, sides = whole.slice(at, PAIRS_A_TIME), []
                for column in (2, 4):
                    values, weights, lengths = weighed(batch.column(column), batch.column(column + 1))
                    sides.append((values, weights, np.append(0, np.cumsum(lengths))))
                (x, v, of_x), (y, w, of_y) = sides
                close = []
                for n in range(batch.num_rows):
                    one, other = slice(of_x[n], of_x[n + 1]), slice(of_y[n], of_y[n + 1])
                    _, i, j = np.intersect1d(x[one], y[other], assume_unique=True, return_indices=True)
                    both = float(np.minimum(v[one][i], w[other][j]).sum(dtype=np.float64))
                    either = float(v[one].sum(dtype=np.float64) + w[other].sum(dtype=np.float64)) - both
                    close.append(both >= similarity * either * (1 - 1e-6))
                yield batch.select([0, 1]).filter(pa.array(close, pa.bool_()))
        give_back()

    def verify(pairs: DataFrame) -> DataFrame:
        hopeful = stage(
            pairs.join(drawn.toDF("a", "drawn_a"), "a").join(drawn.toDF("b", "drawn_b"), "b")
            .where(agree >= LEAST_AGREEMENT).select("a", "b"),
            "near-pairs",
        )
        sets = texts_of(hopeful.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        sides = hopeful.join(sets.toDF("a", "text_a", "n_a"), "a").join(sets.toDF("b", "text_b", "n_b"), "b")
        return sides.select("a", "b", "text_a", "n_a", "text_b", "n_b").mapInArrow(compare, "a long, b long")

    def weigh_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to in byte_slices(batch.column(1), SLICE_BYTES):
                values, weights, lengths = weighed(batch.column(1).slice(row, to - row), batch.column(2).slice(row, to - row))
                own = batch.column(0).take(pa.array(np.repeat(np.arange(row, to), lengths)))
                weight = pa.array(weights.astype(np.float64))
                yield pa.RecordBatch.from_arrays([own, pa.array(values.view(np.int64)), weight], names=["id", "h", "w"])

    def rare_shingles(ids: DataFrame) -> DataFrame:
        # what is left after these shingles weighs less than similar texts share, so similar texts have one of them in common
        each = stage(texts_of(ids).mapInArrow(weigh_each, "id long, h long, w double"), "near-weights")
        often = each.groupBy("h").agg(F.count("*").alias("n"))
        rarest = Window.partitionBy("id").orderBy("n", "h")
        before = F.coalesce(F.sum("w").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        whole = F.sum("w").over(Window.partitionBy("id"))
        placed = each.join(often, "h").select("id", "h", "n", (whole - before).alias("rest"), whole.alias("whole"))
        needed = placed.where((F.col("rest") >= F.col("whole") * similarity * (1 - 1e-5)) & (F.col("n") > 1))
        return needed.select("id", F.col("h").alias("group"), "rest", "whole")

    buckets = stage(band_buckets(texts.where(F.get("keys", F.lit(0)) != 0).select("id", "keys")), "near-buckets")
    links = bucket_links(buckets, verify, rare_shingles, similarity)
    # rows of one id and rows of one text are linked without a look at their words
    alike = signed.join(texts.select("t1", "t2", "id"), ["t1", "t2"]).where("id <> _id").select(F.col("id").alias("a"), F.col("_id").alias("b"))
    classes = components(links.union(alike))
    found = signed.select("doc_id", "_id").join(classes.withColumnRenamed("id", "_id"), "_id", "left")
    smallest = F.coalesce("class_id", "_id")
    return found.select("_id", "doc_id", F.when(smallest < NO_ID, smallest).alias("class_id"), smallest.alias("_class"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of one document of each class: that with the smallest id.

    Rows of that id that hold different texts all stay; of rows that also share the text one does, the first in the
    order of their JSON. Extra columns come out as they went in, whatever their names.
    """
    found = stage(near_classes(docs, key, text).select("_id", "_class"), "near-classes")
    own = F.coalesce(F.col(key).cast("long"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID))
    whole = F.coalesce(F.col("_row")[text], F.lit(""))
    states = found.groupBy("_id").agg(F.max(F.col("_id") != F.col("_class")).alias("gone"), F.count("*").alias("n"))
    marked = stage(states.where("gone or n > 1").select(F.col("_id").alias("_near_id"), "gone"), "near-marked")
    # most rows are neither gone nor repeated and stay where they are
    rows = sift(docs.select(packed_row(docs), own.alias("_near_id")), "_near_id", marked.select("_near_id"))
    kept = rows.where("_may").join(marked.where("gone"), "_near_id", "left_anti")
    # the first of the copies in the order of all they hold
    order = Window.partitionBy("_near_id", "_t1", "_t2").orderBy(F.to_json("_row"))
    told = kept.withColumn("_t1", F.xxhash64(whole)).withColumn("_t2", F.hash(whole))
    several = told.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return rows.where("not _may").select("_row.*").union(several.select("_row.*"))


@query("op5_near_dups")
def op5_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
