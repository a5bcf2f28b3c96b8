"""Word shingles of Arrow batches, and links between rows that share a band of their signatures."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.llm.byte_level import byte_slices
from rolecall.llm.common import components, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 5
ODD = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def word_hashes(text: Column) -> Column:
    """64-bit hashes of a text's words, white space apart; an empty array where it has none."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
PRIMES = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)
#: Spark's.
SEED = np.array([42], np.uint64)
#: Bytes of texts whose shingles are worked out at a time.
SLICE_BYTES = 1 << 19


def uneven(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and the number of values of each row."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lengths


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxhash64(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What the SQL function ``xxhash64`` gives for each stretch of bytes, for many at a time."""
    one, two, three, four, five = PRIMES
    eights, fours = (np.ndarray(max(0, len(data) - n + 1), f"<u{n}", data, strides=(1,)) for n in (8, 4))
    take = lambda x: _turned(x * two, 31) * one
    hashes = np.full(len(starts), SEED + five, np.uint64)
    long = np.flatnonzero(sizes >= 32)
    if len(long):
        lanes = [np.full(len(long), start, np.uint64) for start in (SEED + one + two, SEED + two, SEED, SEED - one)]
        rounds, live, at = sizes[long] // 32, np.arange(len(long)), 0
        while len(live := live[rounds[live] > at]):
            for k, lane in enumerate(lanes):
                lane[live] = _turned(lane[live] + eights[starts[long[live]] + (32 * at + 8 * k)] * two, 31) * one
            at += 1
        whole = sum(_turned(lane, bits) for lane, bits in zip(lanes, (1, 7, 12, 18), strict=True))
        for lane in lanes:
            whole = (whole ^ take(lane)) * one + four
        hashes[long] = whole
    hashes += sizes.astype(np.uint64)
    rest = (sizes & 31).astype(np.uint8)
    order = np.argsort(rest, kind="stable")
    ends = np.cumsum(np.bincount(rest, minlength=32))
    for left in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
        some = order[ends[left - 1] if left else 0 : ends[left]]
        h, at = hashes[some], starts[some] + (sizes[some] - left)
        for _ in range(left // 8):
            h = _turned(h ^ take(eights[at]), 27) * one + four
            at = at + 8
        if left & 4:
            h = _turned(h ^ fours[at].astype(np.uint64) * one, 23) * two + three
            at = at + 4
        for k in range(left & 3):
            h = _turned(h ^ data[at + k].astype(np.uint64) * five, 11) * one
        hashes[some] = h
    hashes = (hashes ^ (hashes >> np.uint64(33))) * two
    hashes = (hashes ^ (hashes >> np.uint64(29))) * three
    return hashes ^ (hashes >> np.uint64(32))


def text_words(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """What ``word_hashes`` gives: hashes of all words of a column of texts, and the number of words of each row."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    bounds = offsets - offsets[0]
    if not bounds[-1]:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    inside = ~BLANK[data]
    apart = np.ones(len(data) + 2, bool)  # no word holds the byte before this one
    apart[1:-1] = ~inside
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(inside & (apart[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside & (apart[2:] | edge[1:])) + 1
    return xxhash64(data, starts, ends - starts), np.diff(np.searchsorted(starts, bounds))


def shingled(words: np.ndarray, lengths: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words, and the number of runs of each row.

    A row of fewer words has one run of what it has; a row without words has none.
    """
    padded = np.where(lengths > 0, np.maximum(lengths, size), 0)
    flat = np.zeros(int(padded.sum()), np.uint64)
    flat[np.arange(len(words)) + np.repeat(starts_of(padded) - starts_of(lengths), lengths)] = words
    runs = np.where(lengths > 0, padded - size + 1, 0)
    at = np.arange(int(runs.sum())) + np.repeat(starts_of(padded) - starts_of(runs), runs)
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        total += mix(flat[at + k] + ODD[k]) * ODD[k]
    return mix(total), runs


#: Bits that tell the row in ``row_keys``, and rows that they tell.
ROW_BITS = np.uint64(16)
MOST_ROWS = 1 << 16


def row_keys(row: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Numbers in the order of row and value as far as a value's upper bits tell."""
    return (row.astype(np.uint64) << (np.uint64(64) - ROW_BITS)) | (values >> ROW_BITS)


def distinct(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each row in order, how often the row has each, and how many there are."""
    if len(lengths) > MOST_ROWS:
        at = int(lengths[:MOST_ROWS].sum())
        parts = zip(distinct(values[:at], lengths[:MOST_ROWS]), distinct(values[at:], lengths[MOST_ROWS:]), strict=True)
        return tuple(map(np.concatenate, parts))
    row = np.repeat(np.arange(len(lengths)), lengths)
    keys = row_keys(row, values)
    order = np.argsort(keys)
    if np.any((values[order][1:] < values[order][:-1]) & (keys[order][1:] == keys[order][:-1])):
        order = np.lexsort((values, row))
    row, values = row[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(values)))
    return values[at], times, np.bincount(row[at], minlength=len(lengths))


def sliced(column: pa.StringArray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row and distinct shingles, as ``distinct`` gives them, of some rows of a column of texts at a time."""
    for row, to in byte_slices(column, SLICE_BYTES):
        yield row, *distinct(*shingled(*text_words(column.slice(row, to - row))))


#: In buckets of at most this many members all pairs are candidates at once.
FEW = 16


def _ordered(pairs: DataFrame, one: str, other: str) -> DataFrame:
    return pairs.where(F.col(one) != F.col(other)).select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()


def band_buckets(rows: DataFrame) -> DataFrame:
    """``id, band, key, n, first, second`` of rows ``(id, keys)`` whose buckets have several members, with two leaders a bucket."""
    members = rows.select("id", F.posexplode("keys").alias("band", "key"))
    sizes = members.groupBy("band", "key").agg(
        F.count("*").alias("n"),
        F.min_by("id", F.struct(F.xxhash64("id"), F.col("id"))).alias("first"),
        F.min_by("id", F.struct(F.xxhash64("id", "band"), F.col("id"))).alias("second"),
    )
    return members.join(sizes.where("n > 1"), ["band", "key"])


def reaching(prefixes: DataFrame, similarity: float) -> DataFrame:
    """Members that can meet another one of their group, with ``reach``: the weight that the other's set has at most.

    Where a group's element is the first that two sets have in common, they share at most what is
    left of either from there on, ``rest``; at ``similarity`` that bounds the sum of their weights.
    """
    reach = F.col("rest") * ((1 + similarity) / similarity * (1 + 1e-5)) - F.col("whole")
    rows = prefixes.withColumn("reach", reach)
    least = rows.groupBy("group").agg(F.min("whole").alias("least"), F.count("*").alias("n")).where("n > 1")
    return rows.join(least, "group").where("reach >= least").select("id", "group", "whole", "reach")


def bucket_links(
    buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], prefixes: Callable[[DataFrame], DataFrame], similarity: float
) -> DataFrame:
    """Links ``(a, b)``, one a member where it does, with the components of all verified pairs that share one of ``buckets``; no partner is capped.

    All pairs of small buckets are verified; members of crowded ones meet two leaders first. Where a
    crowded bucket is then in several classes, its members are dealt anew by ``prefixes``, rows
    ``(id, group, rest, whole)`` of the rarest elements of each set: sets that are alike have a group
    in common. Groups meet their leader, and what is in different classes still is verified pair by pair.
    """
    few = buckets.where(F.col("n") <= FEW).groupBy("band", "key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    each = F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice("ids", i + 2, F.lit(FEW)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    crowded = buckets.where(F.col("n") > FEW)
    led = crowded.select(F.col("id").alias("a"), F.explode(F.array("first", "second")).alias("b"))
    links = stage(verify(_ordered(few.select(F.explode(each).alias("p")).select("p.*").union(led), "a", "b")), "bucket-links")

    def classes_of(links: DataFrame) -> DataFrame:
        return stage(components(links), "bucket-classes")

    def stars(classes: DataFrame) -> DataFrame:
        # links of the same components, one a member
        return classes.where("id <> class_id").select(F.col("class_id").alias("a"), F.col("id").alias("b"))

    def classed(rows: DataFrame, classes: DataFrame) -> DataFrame:
        return rows.join(classes, "id", "left").withColumn("class", F.coalesce("class_id", "id")).drop("class_id")

    def divided(rows: DataFrame, by: list[str]) -> DataFrame:
        several = rows.groupBy(*by).agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high")
        return rows.join(several.select(*by), by, "left_semi")

    classes = classes_of(links)
    ids = stage(divided(classed(crowded.select("id", "band", "key"), classes), ["band", "key"]).select("id").distinct(), "bucket-divided")
    if ids.isEmpty():
        return stars(classes)
    groups = stage(reaching(prefixes(ids), similarity), "bucket-reaching")
    leaders = groups.groupBy("group").agg(
        F.max_by("id", F.struct("reach", F.xxhash64("id"), F.col("id"))).alias("leader"), F.count("*").alias("n")
    )
    groups = stage(groups.join(leaders.where("n > 1"), "group"), "bucket-groups")
    classes = classes_of(stars(classes).union(verify(_ordered(groups, "id", "leader"))))
    open_ = stage(divided(classed(groups.select("id", "group", "whole", "reach"), classes), ["group"]), "bucket-open")
    one, other = (open_.select("group", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "whole", "reach", "class"))) for x in "ab")
    met = one.join(other, "group").where("id_a < id_b and class_a <> class_b and reach_a >= whole_b and reach_b >= whole_a")
    rest = met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    return stars(classes).union(verify(_ordered(rest, "a", "b")))
