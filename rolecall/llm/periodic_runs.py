"""Operator 12, periodic runs: stretches of words that repeat with a short period, by sparse diagonals.

A word that equals the one ``lag`` words before it lies on the diagonal of that lag. Going through a text, each
earlier occurrence of a word either makes the match length of its lag one longer or starts that diagonal anew; a
diagonal that ends with enough matches is a run. Only diagonals that can become runs are kept active: the matches
of a run of period ``q`` go on for several times ``q`` words, so its diagonal is opened where a whole window of
1, 2, 4, ... words, the greatest power of two up to ``q``, came ``q`` words before. Windows that repeat themselves
within half their length belong to a shorter period and open none; of the others at most three came within twice
their length. So the work grows as ``n log n``, also where one word fills the text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm.common import table
from rolecall.llm.registry import query

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_WORDS = 1 << 19
MIN_EXPONENT = 4
MIN_LENGTH = 6
#: Occurrences of a window that can lie less than twice its length back, each further by over half its length.
BACK = 3


def _end(words: np.ndarray, at: int, lag: int) -> int:
    """First place from ``at`` on whose word differs from the one ``lag`` before."""
    width = 16
    while at < len(words):
        stop = min(len(words), at + width)
        differs = np.flatnonzero(words[at:stop] != words[at - lag : stop - lag])
        if len(differs):
            return at + int(differs[0])
        at, width = stop, 2 * width
    return at


def _begin(words: np.ndarray, at: int, lag: int) -> int:
    """First place of the matches that go on up to before ``at``."""
    width = 16
    while at > lag:
        start = max(lag, at - width)
        differs = np.flatnonzero(words[start:at] != words[start - lag : at - lag])
        if len(differs):
            return start + int(differs[-1]) + 1
        at, width = start, 2 * width
    return at


def _openings(words: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Places and lags at which diagonals open, with the window that matches there; lags up to ``longest``.

    Windows are named exactly: a name of ``2 w`` words stands for the names of its halves. Windows that
    occur once take no further part.
    """
    width, names, alive = 1, words, np.arange(len(words))
    while width <= longest and len(alive):
        order = np.argsort(names[alive], kind="stable")
        at, name = alive[order], names[alive][order]
        same = name[1:] == name[:-1]
        # places next to an equal window stay; the rest occur once
        repeated = np.zeros(len(at), bool)
        repeated[1:] |= same
        repeated[:-1] |= same
        before = np.full(len(at), -1)
        before[1:][same] = at[:-1][same]
        own = (before < 0) | (2 * (at - before) > width)  # not of a shorter period
        for back in range(1, min(BACK, len(at) - 1) + 1):
            lag = at[back:] - at[:-back]
            fits = (name[back:] == name[:-back]) & (lag >= width) & (lag < 2 * width) & (lag <= longest) & own[back:]
            yield at[back:][fits], lag[fits], width
        dense = np.full(len(words) + width, -1)
        dense[at[repeated]] = np.cumsum(np.append(True, ~same))[repeated]
        alive = np.sort(at[repeated])
        alive = alive[dense[alive + width] >= 0]
        names = dense[: len(words)].copy()
        names[alive] = dense[alive] * (len(words) + 1) + dense[alive + width]
        width *= 2


def find_runs(words: np.ndarray, longest: int, exponent: int = MIN_EXPONENT, length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """Runs ``(start, length, period)`` by start and period: maximal stretches of at least ``exponent`` smallest periods.

    ``words`` are numbers, equal for equal words; several texts may follow one another if their numbers differ.
    """
    if exponent < 3:
        raise ValueError("an exponent of 3 or more")
    opened = [(at, lag, np.full(len(at), width)) for at, lag, width in _openings(words, longest)]
    if not any(len(at) for at, _, _ in opened):
        return []
    at, lag, width = (np.concatenate(column) for column in zip(*opened, strict=True))
    order = np.lexsort((at, lag))
    at, lag, width = at[order], lag[order], width[order]
    # places in a row on one diagonal are one stretch
    new = np.ones(len(at), bool)
    new[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:], len(at)) - 1
    smallest: dict[tuple[int, int], int] = {}
    open_lag, open_end = -1, -1
    for i, q, last in zip(at[firsts].tolist(), lag[firsts].tolist(), (at[lasts] + width[lasts]).tolist(), strict=True):
        if q == open_lag and i < open_end:
            continue
        open_lag, open_end = q, _end(words, last, q)
        start = _begin(words, i, q) - q
        if open_end - start >= max(length, exponent * q):
            # lags ascend, so the first one of a stretch is its smallest period
            smallest.setdefault((start, open_end), q)
    return sorted((start, end - start, q) for (start, end), q in smallest.items())


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """One number per word, different in different texts, and where each text starts."""
    lengths = np.array([len(words) for words in texts])
    starts = np.append(0, np.cumsum(lengths))
    flat = pa.array([w for words in texts for w in words], pa.binary()).dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes + np.repeat(np.arange(len(texts)), lengths) * len(flat.dictionary), starts


def collapse(texts: list[list[bytes]], exponent: int = MIN_EXPONENT, length: int = MIN_LENGTH) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Runs of each text, and its words without what repeats in a run, joined by single blanks."""
    words, starts = _numbered(texts)
    longest = int(np.diff(starts).max(initial=0)) // exponent
    runs = find_runs(words, longest, exponent, length)
    owner = np.searchsorted(starts, [start for start, _, _ in runs], "right") - 1
    grouped: dict[int, list[tuple[int, int, int]]] = {}
    for text, (start, size, period) in zip(owner.tolist(), runs, strict=True):
        grouped.setdefault(text, []).append((start - int(starts[text]), size, period))
    for text, own in enumerate(texts):
        found = grouped.get(text, [])
        if found:
            change = np.zeros(len(own) + 1, int)
            for start, size, period in found:
                change[start + period] += 1
                change[start + size] -= 1
            kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
            own = [own[i] for i in kept.tolist()]
        yield found, b" ".join(own)


def _bundles(texts: Iterator[bytes], size: int) -> Iterator[list[list[bytes]]]:
    held, n = [], 0
    for text in texts:
        held.append(text.split())  # ASCII white space
        n += len(held[-1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", exponent: int = MIN_EXPONENT, length: int = MIN_LENGTH) -> DataFrame:
    """``key``, its ``runs`` and the ``collapsed`` text of each row.

    Words are what stands between ASCII white space. A run is a maximal stretch of at least ``exponent`` of its
    smallest period and ``length`` words; ``runs`` holds ``start, length, period`` in words, by start and period.
    A null or empty text has no runs and collapses to the empty text. Every row gives one row, repeated rows and
    null keys too; other columns are ignored, an empty table gives an empty one. A text is handled whole, in one task.
    """
    narrow = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    place = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for texts in _bundles((v.as_buffer().to_pybytes() for v in batch.column(1)), BATCH_WORDS):
                results = list(collapse(texts, exponent, length))
                runs = [[{"start": s, "length": n, "period": p} for s, n, p in found] for found, _ in results]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(texts)),
                        pa.array(runs, place),
                        pa.array([whole.decode("utf-8") for _, whole in results], pa.string()),
                    ],
                    names=["_key", "runs", "collapsed"],
                )
                row += len(texts)

    kind = docs.schema[key].dataType.simpleString()
    found = narrow.mapInArrow(find, f"_key {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return found.select(F.col("_key").alias(key), "runs", "collapsed")


def _repeating(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with the words of every tenth document, by a hash of its id, repeating from a place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    g = F.floor(h / 10)
    counted = docs.select("doc_id", "text", words.alias("_words"), g.alias("_g")).withColumn("_n", F.size("_words").cast("long"))
    placed = counted.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    placed = placed.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    whole = lambda value: F.col(value).cast("int")
    tail = F.col("_n") - F.col("_a")
    again = F.flatten(F.array_repeat(F.slice("_words", whole("_a") + 1, whole("_p")), F.ceil(tail / F.col("_p")).cast("int")))
    changed = F.concat(F.slice("_words", F.lit(1), whole("_a")), F.slice(again, F.lit(1), tail.cast("int")))
    return placed.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_repeating(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    # the greatest length, then the smallest start and period
    by_length = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    best = found.withColumn("_best", F.array_min(by_length))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.s").alias("start"),
        (-F.col("_best.l")).alias("length"),
        F.col("_best.p").alias("period"),
        F.floor(-1000 * F.col("_best.l") / F.col("_best.p")).alias("exponent_milli"),
        _digest(listed).alias("runs_sha256"),
        _digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
