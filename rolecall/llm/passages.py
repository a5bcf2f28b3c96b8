"""Operator 7, substring dedup: MinHash banding over paragraphs that start at content-chosen words."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolecall.llm.common import Stages, components, stage, table
from rolecall.llm.registry import query
from rolecall.llm.byte_level import byte_slices
from rolecall.llm.shingles import FEW, ODD, SLICE_BYTES, WORDS, bucket_links, mix, shingled, starts_of, text_words, uneven, word_hashes  # noqa: F401

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A paragraph is this many words from its anchor; an anchor is the least shingle of some run of this many shingles.
#: Together they are under 52, so of any passage of 50 words two copies have a whole paragraph in common.
PARAGRAPH, RUN = 22, 29
SIMILARITY = 0.8
#: 3 bands of 2 hashes: a pair at 0.8 shares a band with probability 0.953, equal paragraphs always do.
BANDS, ROWS = 3, 2
KEYS = [f"key_{k}" for k in range(BANDS)]
#: So many words are looked at on each side of a paragraph; further on the next paragraph covers a shared run.
CONTEXT = RUN - 1
#: So many contexts of a paragraph and side meet in one place at most; more are dealt by what they hold.
MANY = 1024
NO_ID = 1 << 62


def anchors(shingles: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Positions of the least shingle, the leftmost of equal ones, of every ``RUN`` consecutive shingles of a row.

    They depend on the words around them alone, so a passage has the same anchors wherever it
    stands. A row of fewer shingles is one run.
    """
    rows = np.flatnonzero(runs)
    if not len(rows):
        return np.zeros(0, np.int64)
    n = len(shingles)
    least, at, span = shingles.copy(), np.arange(n), 1
    while span < RUN:  # least of the next ``span`` shingles, doubled up to RUN; ends of rows are set right below
        step = min(span, RUN - span)
        other, other_at = least[step:], at[step:]
        less = other < least[: n - step]
        least[: n - step] = np.where(less, other, least[: n - step])
        at[: n - step] = np.where(less, other_at, at[: n - step])
        span += step
    starts, ends = starts_of(runs)[rows], np.cumsum(runs)[rows]
    whole = np.maximum(runs[rows] - RUN + 1, 0)
    inside = np.arange(int(whole.sum())) + np.repeat(starts - starts_of(whole), whole)
    short = [s + int(np.argmin(shingles[s:e])) for s, e in zip(starts[whole == 0], ends[whole == 0], strict=True)]
    return np.unique(np.concatenate([at[inside], np.array(short, np.int64)]))


def paragraphs(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, first word, shingle hashes)`` of each paragraph, one line of ``PARAGRAPH - WORDS + 1`` shingles each.

    A paragraph that would pass its text's end starts earlier; texts of fewer words have none.
    """
    long = lengths >= PARAGRAPH
    shingles, runs = shingled(words[np.repeat(long, lengths)], np.where(long, lengths, 0))
    each = PARAGRAPH - WORDS + 1
    found = anchors(shingles, runs)
    row = np.searchsorted(np.cumsum(runs), found, side="right")
    first = starts_of(runs)[row]
    start = np.unique(np.minimum(found, first + runs[row] - each))
    row = np.searchsorted(np.cumsum(runs), start, side="right")
    return row, start - starts_of(runs)[row], shingles[start[:, None] + np.arange(each)[None, :]] if len(start) else np.zeros((0, each), np.uint64)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of a batch with the hashes of their words, about a megabyte of text or a million words at a time.

    The last column holds texts, or lists of the hashes of their words.
    """
    column, at = batch.column(batch.num_columns - 1), 0
    if pa.types.is_string(column.type):
        for row, to in byte_slices(column, 2 * SLICE_BYTES):
            yield row, *text_words(column.slice(row, to - row))
        return
    words, lengths = uneven(column)
    ends = np.cumsum(lengths)
    while at < len(lengths):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + 1_000_000)))
        yield at, words[before : ends[to - 1]], lengths[at:to]
        at = to


def _whole(shingles: np.ndarray) -> np.ndarray:
    """A hash of each paragraph."""
    whole = np.zeros(len(shingles), np.uint64)
    for k in range(shingles.shape[1]):
        whole = mix(whole + shingles[:, k])
    return whole


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2^64."""
    both = []
    for base in (int(ODD[0]), pow(int(ODD[0]), -1, 1 << 64)):
        factors = np.full(n, base, np.uint64)
        factors[:1] = 1
        both.append(np.cumprod(factors, dtype=np.uint64))
    return both[0], both[1]


class Contexts:
    """Hashes of any run of words of a block, from sums over its words."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray) -> None:
        up, self.down = powers(len(words) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:-1], dtype=np.uint64)])
        self.starts, self.lengths = starts_of(lengths), lengths

    def room(self, row: np.ndarray, first: np.ndarray, side: np.ndarray) -> np.ndarray:
        """How many words, up to ``CONTEXT``, stand before a paragraph (side 0) or after it (side 1)."""
        return np.minimum(np.where(side == 0, first, self.lengths[row] - first - PARAGRAPH), CONTEXT)

    def keys(self, row: np.ndarray, first: np.ndarray, paragraph: np.ndarray, side: np.ndarray, j: np.ndarray) -> np.ndarray:
        """A hash of the paragraph and the ``j`` words next to it on that side."""
        at = self.starts[row] + np.where(side == 0, first - j, first + PARAGRAPH)
        run = (self.sums[at + j] - self.sums[at]) * self.down[at]
        return mix(mix(run + j.astype(np.uint64) * ODD[1]) ^ mix(paragraph + ODD[2] * (side + 1).astype(np.uint64)))


def paragraph_rows(rows: DataFrame, bands: bool = True, contexts: bool = True) -> DataFrame:
    """``_id, place, first, paragraph, key_0, ..., room_0, room_1, kind_0, kind_1`` from rows ``_id, place, text``.

    ``paragraph`` is a hash of its words, ``key_0`` to the last are its bands, ``kind_0`` and ``kind_1`` hashes of it
    with the ``room_0`` words before it and the ``room_1`` words after it. Without ``bands`` or ``contexts`` those
    columns are left out.
    """
    names = ["_id", "place", "first", "paragraph", *(KEYS if bands else []), *(["room_0", "room_1", "kind_0", "kind_1"] if contexts else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, words, lengths in _blocks(batch):
                row, first, shingles = paragraphs(words, lengths)
                whole = _whole(shingles)
                columns = [
                    batch.column(0).take(pa.array(row + at)),
                    batch.column(1).take(pa.array(row + at)),
                    pa.array(first.astype(np.int64)),
                    pa.array(whole.view(np.int64)),
                ]
                if bands:
                    keys = np.zeros((BANDS, len(row)), np.uint64)
                    for k in range(BANDS * ROWS):
                        least = mix(shingles ^ mix(np.array([k + 1], np.uint64))).min(axis=1) if len(row) else whole
                        keys[k // ROWS] = mix(keys[k // ROWS] + least + np.uint64(k))
                    columns += [pa.array(key) for key in keys.view(np.int64)]
                if contexts:
                    found = Contexts(words, lengths)
                    sides = [np.full(len(row), side, np.int64) for side in (0, 1)]
                    rooms = [found.room(row, first, side) for side in sides]
                    columns += [pa.array(room.astype(np.int32)) for room in rooms]
                    for side, room in zip(sides, rooms, strict=True):
                        columns.append(pa.array(found.keys(row, first, whole, side, room).view(np.int64)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = {"room_0": "int", "room_1": "int"}
    return rows.mapInArrow(cut, ", ".join(f"{name} {kinds.get(name, 'long')}" for name in names))


def shared_keys(kinds: DataFrame) -> DataFrame:
    """``id, key`` of paragraphs ``(id, key_0, ...)`` that share a band key with others.

    Most keys have one paragraph. Sorted rows tell by the keys next to them, so what is alone goes before anything is
    counted or joined; a task holds one row between two batches.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda ids, keys: pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys)], names=["id", "key"])
        ids = keys = np.empty(0, np.int64)
        met = np.empty(0, bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, keys = np.append(ids[-1:], batch.column(0).to_numpy()), np.append(keys[-1:], batch.column(1).to_numpy())
            same = keys[1:] == keys[:-1]
            met = np.append(met[-1:], np.zeros(batch.num_rows, bool))
            met[1:] |= same
            met[:-1] |= same
            yield rows(ids[:-1][met[:-1]], keys[:-1][met[:-1]])
        yield rows(ids[-1:][met[-1:]], keys[-1:][met[-1:]])

    members = kinds.select("id", F.explode(F.array(*KEYS)).alias("key"))
    return members.repartition("key").sortWithinPartitions("key").mapInArrow(search, "id long, key long")


def paragraph_buckets(members: DataFrame) -> DataFrame:
    """``id, key, n, band`` of what ``shared_keys`` gives.

    Keys differ from band to band, so the band does not travel.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    return members.join(sizes.where("n > 1"), "key").withColumn("band", F.lit(0))


def with_leaders(buckets: DataFrame) -> DataFrame:
    """``buckets`` with two leaders, ``first`` and ``second``, of each that is too crowded for all its pairs."""
    led = buckets.where(F.col("n") > FEW).groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("second"))
    return buckets.join(led, "key", "left")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """``id, shingles``, distinct ones, of those paragraphs of rows ``ids, text`` that ``ids`` asks for.

    32 bits of each shingle's hash: two of the at most 36 shingles of a pair are taken for one
    with probability under 2e-7, and sets are half as large where they are joined.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, words, lengths in _blocks(batch):
                asked, _ = uneven(batch.column(0).slice(at, len(lengths)))
                _, _, shingles = paragraphs(words, lengths)
                whole, once = np.unique(_whole(shingles), return_index=True)
                wanted = np.isin(whole, asked)
                whole, low = whole[wanted], np.sort(shingles[once[wanted]].astype(np.uint32), axis=1)
                new = np.ones(low.shape, bool)
                new[:, 1:] = low[:, 1:] != low[:, :-1]
                offsets = pa.array(np.append(0, np.cumsum(new.sum(axis=1))).astype(np.int32))
                sets = pa.ListArray.from_arrays(offsets, pa.array(low[new].view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), sets], names=["id", "shingles"])

    return rows.mapInArrow(cut, "id long, shingles array<int>")


def context_keys(rows: DataFrame) -> DataFrame:
    """``kind, least, most, n, paragraph, side, keys`` of rows ``kinds, leasts, mosts, sides, firsts, paragraphs, ns, text``.

    A text is a row. ``keys`` are hashes of the paragraph with 1, 2, ... words next to it, up to what the text has or ``CONTEXT``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, words, lengths in _blocks(batch):
                kinds, n = uneven(batch.column(0).slice(at, len(lengths)))
                side, first, held = (uneven(batch.column(c).slice(at, len(lengths)))[0] for c in (3, 4, 5))
                holders = [uneven(batch.column(c).slice(at, len(lengths)))[0] for c in (1, 2, 6, 5, 3)]
                side, first, row = side.astype(np.int64), first.astype(np.int64), np.repeat(np.arange(len(lengths)), n)
                contexts = Contexts(words, lengths)
                room = contexts.room(row, first, side)
                each = np.repeat(np.arange(len(row)), room)
                j = np.arange(len(each)) - starts_of(room)[each] + 1
                keys = contexts.keys(row[each], first[each], held[each], side[each], j)
                offsets = pa.array(np.append(starts_of(room), len(each)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array(c.view(np.int64)) for c in (kinds, *holders)],
                        pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64))),
                    ],
                    names=["kind", "least", "most", "n", "paragraph", "side", "keys"],
                )

    return rows.mapInArrow(cut, "kind long, least long, most long, n long, paragraph long, side long, keys array<long>")


def _shared(table: pa.Table) -> pa.RecordBatch:
    """What ``deepest`` says of the kinds of whole groups."""
    table = table.combine_chunks()
    kind, least, most = (table.column(c).to_numpy() for c in ("kind", "least", "most"))
    column = table.column("keys").combine_chunks()
    keys, room = uneven(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
    own, starts = np.repeat(np.arange(len(kind)), room), starts_of(room)
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    first, key = np.flatnonzero(new), np.empty(len(keys), np.int64)
    key[order] = np.cumsum(new) - 1
    low = np.minimum.reduceat(least[own[order]], first)[key]
    both = low < np.maximum.reduceat(most[own[order]], first)[key]
    # who has a context has all shorter ones, so counts are lengths
    kept = np.add.reduceat(both, starts, dtype=np.int64)
    gone = np.add.reduceat(both & (low < least[own]), starts, dtype=np.int64)
    _, once = np.unique(kind, return_index=True)
    once = once[kept[once] > 0]
    kind, room, starts, kept, gone = (x[once] for x in (kind, room, starts, kept, gone))
    columns = [
        pa.array(kind), pa.array(low[starts + room - 1], mask=kept < room), pa.array(gone, mask=gone == 0),
        pa.array(low[starts + np.maximum(gone, 1) - 1], mask=gone == 0), pa.array(kept),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "low", "gone", "gone_id", "kept"])


def met(kinds: DataFrame) -> DataFrame:
    """What ``deepest`` gives, of kinds ``(kind, least, most, paragraph, side, keys)`` that are at most ``MANY`` of a paragraph and side.

    Kinds travel once, with all their contexts; groups are met whole, many at a time.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            paragraph, side = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("paragraph", "side"))
            changes = np.flatnonzero((paragraph[1:] != paragraph[:-1]) | (side[1:] != side[:-1])) + 1
            to = int(changes[-1]) if len(changes) else 0  # the last group may go on, and the first may be what is held
            if to:
                yield _shared(pa.Table.from_batches([*held, batch.slice(0, to)]))
                held = []
            held.append(batch.slice(to))
        if held:
            yield _shared(pa.Table.from_batches(held))

    rows = kinds.select("kind", "least", "most", "paragraph", "side", "keys").repartition("paragraph", "side")
    return rows.sortWithinPartitions("paragraph", "side").mapInArrow(search, "kind long, low long, gone long, gone_id long, kept long")


def deepest(kinds: DataFrame) -> DataFrame:
    """``kind, low, gone, gone_id, kept`` of ``kinds`` ``(kind, least, most, keys)``.

    ``kept`` is the longest context that documents of several ids have, ``gone`` the longest that one of an id
    below ``least`` has, ``gone_id`` the smallest such id and ``low`` the smallest id that has the whole of it.
    """
    each = kinds.select("kind", "least", "most", F.size("keys").alias("room"), F.posexplode("keys").alias("j", "key")).withColumn("j", F.col("j") + 1)
    both = each.groupBy("key").agg(F.min("least").alias("low"), F.max("most").alias("high")).where("low < high")
    below = F.when(F.col("low") < F.col("least"), F.col("j"))
    return each.join(both.select("key", "low"), "key").groupBy("kind").agg(
        F.min(F.when(F.col("j") == F.col("room"), F.col("low"))).alias("low"),
        F.max(below).alias("gone"), F.max_by("low", below).alias("gone_id"), F.max("j").alias("kept"),
    )


def extensions(texts: DataFrame, caught: DataFrame) -> DataFrame:
    """``_id, class_id, first, end``: words next to ``caught`` occurrences that another document has there too.

    What a document of smaller id has is a piece whose ``class_id`` is that document; what only later
    ones have beyond it is a piece of the own id. Occurrences with one whole context are one kind, counted
    before anything moves. Only where a paragraph has several kinds on a side the text of one holder of each
    kind is read again, and the kinds meet at each length of their contexts.
    """
    sides = F.array(*[F.struct(F.lit(k).alias("side"), F.col(f"room_{k}").alias("room"), F.col(f"kind_{k}").alias("kind")) for k in (0, 1)])
    each = caught.select("_id", "place", "first", "paragraph", F.explode(sides).alias("s")).select("*", "s.*").drop("s").where("room > 0")
    kinds = stage(
        each.groupBy("kind").agg(
            F.any_value("paragraph").alias("paragraph"), F.any_value("side").alias("side"), F.any_value("room").alias("room"),
            F.min("_id").alias("least"), F.max("_id").alias("most"), F.min("place").alias("place"), F.min_by("first", "place").alias("first"),
        ),
        "passage-kinds",
    )
    several = kinds.groupBy("paragraph", "side").agg(F.count("*").alias("n")).where("n > 1")
    told = ["kind", "least", "most", "side", "first", "paragraph", "n"]
    asked = kinds.join(several, ["paragraph", "side"]).withColumn("side", F.col("side").cast("long")).select("place", *told)
    asked = asked.groupBy("place").agg(F.collect_list(F.struct(*told)).alias("o")).select("place", *[F.col(f"o.{c}").alias(c) for c in told])
    # a text that is there twice tells its kinds twice, which changes no minimum or maximum
    read = context_keys(texts.join(asked, "place").select(*told, "text"))
    read = stage(read, "passage-contexts")
    crowded = read.where(F.col("n") > MANY)
    searched = met(read.where(F.col("n") <= MANY)).union(deepest(crowded))
    settled = stage(
        kinds.join(searched, "kind", "left").select(
            "kind", "least", F.coalesce("low", "least").alias("low"), F.coalesce("gone", F.lit(0)).alias("gone"), "gone_id",
            F.greatest(F.coalesce("kept", F.lit(0)), F.when(F.col("least") < F.col("most"), F.col("room"))).alias("kept"),
        ),
        "passage-settled",
    )
    later = F.col("_id") > F.col("least")  # a document of smaller id has the whole context
    rows = each.join(settled, "kind").select(
        "_id", "first", "side", F.when(later, F.col("room")).otherwise(F.col("gone")).alias("gone"),
        F.when(later, F.col("low")).otherwise(F.col("gone_id")).alias("least"), F.when(later, F.col("room")).otherwise(F.col("kept")).alias("kept"),
    )
    piece = lambda i, near, far: F.struct(
        F.col(i).alias("class_id"),
        F.when(F.col("side") == 0, F.col("first") - F.col(far)).otherwise(F.col("first") + PARAGRAPH + near).alias("first"),
        F.when(F.col("side") == 0, F.col("first") - near).otherwise(F.col("first") + PARAGRAPH + F.col(far)).alias("end"),
    )
    pieces = F.array(piece("least", F.lit(0), "gone"), piece("_id", F.col("gone"), "kept"))
    return rows.select("_id", F.explode(pieces).alias("p")).select("_id", "p.*").where("class_id is not null and first < end")


def rare_shingles(sets: DataFrame, similarity: float) -> DataFrame:
    """``id, group, rest, whole`` of the rarest shingles of ``sets`` ``(id, shingles)``.

    A set like this one shares ``similarity`` of it at least, so one of the others and one more.
    """
    each = sets.select("id", F.size("shingles").cast("double").alias("whole"), F.explode("shingles").alias("h"))
    often = each.groupBy("h").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("n", "h"))
    placed = each.join(often, "h").withColumn("rest", F.col("whole") - place + 1)
    needed = placed.where((F.col("rest") >= F.col("whole") * similarity * (1 - 1e-5)) & (F.col("n") > 1))
    return needed.select("id", F.col("h").cast("long").alias("group"), "rest", "whole")


def spans(pieces: DataFrame) -> DataFrame:
    """``_id, class_id, first_word, n_words`` of pieces ``(_id, class_id, first, end)``: overlapping and touching ones are one.

    A task holds the span that is open between two batches, as a piece before those that follow.
    """
    names = ["_id", "class_id", "first", "end"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda own, held, first, end: pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (own, held, first, end - first)], names=["_id", "class_id", "first_word", "n_words"]
        )
        last = [np.empty(0, np.int64)] * 4
        for batch in batches:
            if not batch.num_rows:
                continue
            own, held, first, end = (np.append(x, batch.column(k).to_numpy()) for k, x in enumerate(last))
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (held[1:] != held[:-1])
            base = np.cumsum(new) << 32  # no text has so many words
            new[1:] |= (base + first)[1:] > np.maximum.accumulate(base + end)[:-1]
            at = np.flatnonzero(new)
            found = [own[at], held[at], first[at], np.maximum.reduceat(end, at)]
            last = [c[-1:] for c in found]
            yield rows(*(c[:-1] for c in found))
        yield rows(*last)

    sorted_ = pieces.select(names).repartition("_id", "class_id").sortWithinPartitions("_id", "class_id", "first")
    return sorted_.mapInArrow(merge, "_id long, class_id long, first_word long, n_words long")


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``_id, class_id, first_word, n_words``: the spans of words that several documents have.

    Equal paragraphs are one from the start; others that share a band are linked where the Jaccard
    similarity of their five-word shingles is at least ``similarity``; a class is a component of
    links and its ``class_id`` the smallest id of a document with it. A class that documents of at
    least two ids hold is repeated. Equal paragraphs reach on to both sides, word by word, as far as
    another document has the same words. Overlapping and touching pieces of a document that have one
    first holder make up a span. Null and short texts (under ``PARAGRAPH`` words) have no
    paragraph, rows of one id are one document, rows without id have an id of their text's hash.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    own = F.coalesce(F.col(key).cast("long"), F.xxhash64(whole).bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID))
    staged = Stages(docs.sparkSession)
    texts = docs.select(own.alias("_id"), F.xxhash64(own, whole).alias("place"), whole.alias("text"))
    # texts are cut twice, for the kinds of paragraphs and for where they stand, so that all paragraphs never lie written
    cut = lambda **columns: paragraph_rows(texts.select("_id", "place", "text"), **columns)
    # one text gives the set of a paragraph, however many have it; what is asked of a text is bounded by its length
    kinds = cut(contexts=False).groupBy(F.col("paragraph").alias("id")).agg(
        F.min("_id").alias("least"), F.max("_id").alias("most"), F.min("place").alias("place"), *[F.min(k).alias(k) for k in KEYS]
    )
    kinds = staged(kinds, "paragraph-kinds")
    buckets = staged(paragraph_buckets(staged(shared_keys(kinds), "paragraph-shared")), "paragraph-buckets")
    staged.drop("paragraph-shared")
    asked = kinds.select("id", "place").join(buckets.select("id"), "id", "left_semi").groupBy("place").agg(F.collect_list("id").alias("ids"))
    # a text is read once for its sets; rows of one id and text are told by their places, before any text moves
    alone = texts.groupBy("place").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    once = texts.select("place", "text") if alone else texts.groupBy("place").agg(F.first("text").alias("text"))
    sets = staged(shingle_sets(once.join(asked, "place").select("ids", "text")), "paragraph-sets")

    def verify(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        # what the two have in common is counted once: it is this share of both sizes where it is ``similarity`` of their union
        needed = F.ceil((F.size("x") + F.size("y")) * (similarity / (1 + similarity)) - 1e-9)
        return sides.where(F.size(F.array_intersect("x", "y")) >= needed).select("a", "b")

    def divided(ids: DataFrame) -> DataFrame:
        some = sets.join(ids, "id", "left_semi")
        return rare_shingles(staged(some, "divided-sets"), similarity)

    links = bucket_links(with_leaders(buckets), verify, divided, similarity)
    classes = components(links)
    named = kinds.select("id", "least", "most").join(classes, "id", "left").where("class_id is not null or least < most")
    named = named.select("id", "least", "most", F.coalesce("class_id", "id").alias("class"))
    repeated = named.groupBy("class").agg(F.min("least").alias("class_id"), F.max("most").alias("most")).where("class_id < most")
    exact = (F.col("least") < F.col("most")).alias("exact")
    repeated = stage(named.join(repeated.select("class", "class_id"), "class").select(F.col("id").alias("paragraph"), "class_id", exact), "repeated")
    staged.drop("paragraph-kinds", "paragraph-buckets", "paragraph-sets")  # classes are settled
    caught = stage(cut(bands=False).join(repeated, "paragraph"), "passage-caught")
    pieces = caught.select("_id", "class_id", "first", (F.col("first") + PARAGRAPH).alias("end")).union(extensions(texts, caught.where("exact")))
    return spans(pieces)


@query("op7_repeated_passages")
def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each repeated span; all but those in the first holder are to be removed."""
    spans = repeated_passages(table(spark, sf_dir, "documents"))
    known = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return spans.select(
        known("_id").alias("doc_id"), known("class_id").alias("class_id"), "first_word", "n_words",
        (F.col("_id") != F.col("class_id")).alias("removed"),
    )
