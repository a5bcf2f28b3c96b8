"""Operator 13, filter interaction audit: what each filter of a chain removes, in every order of the chain.

A document fails some set of filters, its mask. With a matrix of masks (0 where a mask fails a filter, infinite
where it passes) and one of the filters' places in each order, the min-plus product holds the step that removes
the documents of a mask in an order. That table is a constant of the number of filters; the documents only weigh
its rows, by their counts per part and mask.
"""

from __future__ import annotations

import hashlib
import string
import sys
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm.common import table
from rolecall.llm.registry import query

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_FILTERS = 6
CAPITALS = string.ascii_uppercase.encode()
MARKUP = "#$%&*|"


def removal_steps(filters: int) -> np.ndarray:
    """Step from 1 that removes each mask (rows) in each order (columns); infinite where none does.

    Orders are those of ``itertools.permutations``; bit ``f`` of a mask says that filter ``f`` fails.
    """
    orders = np.array(list(permutations(range(filters))))
    places = np.argsort(orders, axis=1) + 1.0  # the inverse permutation: where each filter stands
    fails = (np.arange(1 << filters)[:, None] >> np.arange(filters)) & 1
    masks = np.where(fails == 1, 0.0, np.inf)
    return (masks[:, None, :] + places[None, :, :]).min(axis=2)


def step_table(spark: SparkSession, filters: Sequence[str]) -> DataFrame:
    """What one document of a mask adds to the counts of each order and step.

    ``2^k * k! * k`` rows for ``k`` filters, whatever the documents: 19,200 for five.
    """
    if not 1 <= len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    k = len(filters)
    removal = removal_steps(k)
    orders = list(permutations(range(k)))
    names = ["".join(filters[f] for f in order) for order in orders]
    # how many orders remove a mask by a filter
    shares = np.zeros((1 << k, k), int)
    for o, order in enumerate(orders):
        hit = np.isfinite(removal[:, o])
        steps = removal[hit, o].astype(int) - 1
        np.add.at(shares, (np.flatnonzero(hit), np.array(order)[steps]), 1)
    rows = [
        (
            mask, names[o], step,
            int(removal[mask, o] > step), int(removal[mask, o] == step),
            int(mask >> f & 1 and removal[mask, o] < step), int(mask == 1 << f), int(shares[mask, f]),
        )
        for mask in range(1 << k)
        for o, order in enumerate(orders)
        for step, f in enumerate(order, 1)
    ]
    return spark.createDataFrame(
        rows, "_mask int, filter_order string, step int, _kept int, _removed int, _redundant int, _unique int, _share int"
    )


def audit(masks: DataFrame, filters: Sequence[str], part: str = "part", losses: Sequence[str] = ()) -> DataFrame:
    """Counts per part, order and step of documents ``(part, mask, *losses)``.

    ``mask`` holds bit ``f`` where filter ``f`` fails; ``losses`` are 0/1 columns whose removed sum is wanted as
    ``<name>_lost``. Documents are counted per part and mask before anything is joined, so a part that holds
    most of them costs ``2^k`` rows a split. A part without a failing document gives its rows too, an empty
    table gives none; null in ``losses`` counts as 0.
    """
    weights = masks.groupBy(F.col(part).alias("part"), F.col("mask").alias("_mask")).agg(
        F.count("*").alias("_n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"_{c}") for c in losses]
    )
    joined = weights.join(F.broadcast(step_table(masks.sparkSession, filters)), "_mask")  # of constant size
    total = lambda count, of="_n": F.sum(F.col(of) * F.col(count)).cast("long")
    return joined.groupBy("part", "filter_order", "step").agg(
        total("_kept").alias("kept"),
        total("_removed").alias("removed"),
        total("_redundant").alias("redundant"),
        total("_unique").alias("unique_fails"),
        *[total("_removed", f"_{c}").alias(f"{c}_lost") for c in losses],
        total("_share").alias("shapley"),
    )


def text_facts(docs: DataFrame, key: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """``_id, _part, _mask, _hash`` of each row: failures of filters A to D (bits 0 to 3) and the text's SHA-256.

    A: fewer than 50 words; B: fewer than 65 distinct words in a hundred; C: more than 5 capitals of A-Z in a
    hundred code points; D: any of ``#$%&*|``. Words are parted by ASCII white space. A null text is empty.
    """
    narrow = docs.select(
        F.col(key).alias("_id"), F.coalesce(F.col(part), F.lit("")).alias("_part"), F.coalesce(F.col(text), F.lit("")).alias("_text")
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, hashes = [], []
            for value in batch.column(2):
                whole = value.as_py()
                data = whole.encode("utf-8")
                words = data.split()  # ASCII white space, as in the filters
                capitals = len(data) - len(data.translate(None, CAPITALS))
                masks.append(
                    (len(words) < 50)
                    | (100 * len(set(words)) < 65 * len(words)) << 1
                    | (100 * capitals > 5 * len(whole)) << 2
                    | any(sign in whole for sign in MARKUP) << 3
                )
                hashes.append(hashlib.sha256(data).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(hashes, pa.binary())],
                names=["_id", "_part", "_mask", "_hash"],
            )

    kind = narrow.schema["_id"].dataType.simpleString()
    return narrow.mapInArrow(judge, f"_id {kind}, _part string, _mask int, _hash binary")


def failures(docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """``part, mask, good, toxic`` of each document, with filter E (bit 4): the text of a smaller id.

    The smallest id of each text is found by an aggregate that starts before its shuffle; documents meet it by
    text and id together, so the copies of one text spread over all tasks. Rows of one id and text are all
    first or none. A null id is never a copy and makes none. Labels of a repeated id count if any row says so.
    """
    facts = text_facts(docs, key, part, text)
    firsts = facts.groupBy("_hash").agg(F.min("_id").alias("_id")).select("_id", "_hash", F.lit(True).alias("_first"))
    marked = labels.groupBy(F.col(key).alias("_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    joined = facts.join(firsts, ["_id", "_hash"], "left").join(marked, "_id", "left")
    copy = F.col("_id").isNotNull() & F.col("_first").isNull()
    return joined.select(
        F.col("_part").alias("part"), F.col("_mask").bitwiseOR(F.when(copy, F.lit(16)).otherwise(F.lit(0))).alias("mask"),
        "good", "toxic",
    )


_SQL = r"""
WITH letters(f, bit) AS (VALUES ('A', 0), ('B', 1), ('C', 2), ('D', 3), ('E', 4)),
texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM texts),
marked AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
judged AS (SELECT part, (len(words) < 50) AS fa, (100 * len(list_distinct(words)) < 65 * len(words)) AS fb,
 (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text)) AS fc, regexp_matches(text, '[#$%&*|]') AS fd,
 coalesce(worded.doc_id > first, false) AS fe, good, toxic FROM worded LEFT JOIN marked ON marked.doc_id = worded.doc_id),
masked AS (SELECT part, fa::INT + 2 * fb::INT + 4 * fc::INT + 8 * fd::INT + 16 * fe::INT AS mask, count(*) AS n,
 coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM judged GROUP BY 1, 2),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
 WHERE b.f <> a.f AND c.f NOT IN (a.f, b.f) AND d.f NOT IN (a.f, b.f, c.f) AND e.f NOT IN (a.f, b.f, c.f, d.f)),
places AS (SELECT filter_order, step::INT AS step, f, bit FROM orders, range(1, 6) r(step), letters WHERE filter_order[step] = f),
every AS (SELECT part, mask, n, good, toxic, filter_order, step, f, (mask >> bit) & 1 = 1 AS fails, mask = (1 << bit) AS alone,
 coalesce(min(CASE WHEN (mask >> bit) & 1 = 1 THEN step END) OVER (PARTITION BY part, mask, filter_order), 6) AS gone FROM masked, places),
counted AS (SELECT part, filter_order, step, any_value(f) AS f, sum(CASE WHEN gone > step THEN n ELSE 0 END)::BIGINT AS kept,
 sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN fails AND gone < step THEN n ELSE 0 END)::BIGINT AS redundant,
 sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN gone = step THEN good ELSE 0 END)::BIGINT AS good_lost,
 sum(CASE WHEN gone = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM every GROUP BY 1, 2, 3)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
 (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counted
"""


@query("op13_filter_audit", _SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(masks, "ABCDE", losses=["good", "toxic"])
