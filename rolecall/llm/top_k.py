"""Operator 3, exact top-k search: vectors keyed by nearest pivot and distance, annuli expanded until the triangle inequality stops."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rolecall.llm.common import conf_set, share, stage, table
from rolecall.llm.registry import query

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 20
#: Pivots are picked from this many vectors at most; the index itself holds every vector.
SAMPLE, PIVOTS = 2048, 64
#: Vectors of an annulus at most, of the annuli that lie in a row of the index, and of those that are compared at a time.
ANNULUS, RUN, TILE = 512, 8192, 1024
#: Queries of a batch at most, and of those that are compared at a time.
QUERIES, ROWS = 2048, 512
#: No floor yet, and an id above all others.
NONE, LAST = -(2**63), 2**63 - 1
SLACK = 1e-6


def quantised(vectors: Column, factor: int = 64) -> Column:
    """``floor(factor * x)`` of each component, or null for a vector that is null or holds null, NaN or infinity."""
    odd = F.exists(vectors, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vectors.isNotNull() & ~odd, F.transform(vectors, lambda x: F.floor(x.cast("double") * factor).cast("long")))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors end in zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def kind_of(most: int) -> str:
    """The narrowest type that holds whole numbers up to ``most`` on either side of 0."""
    return next(t for t in ("<i1", "<i2", "<i4", "<i8") if most <= np.iinfo(t).max)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products, exact: in floating point where every partial sum is below 2^24 or 2^53, else in whole numbers."""
    bound = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    return left.astype(kind, copy=False) @ right.T.astype(kind, copy=False)


class Pivots:
    """Distances after one more coordinate makes all stored vectors equally long.

    With queries at 0 and vectors at sqrt(longest - |v|^2) there, the square of a distance is
    |q|^2 + longest - 2 q.v, so the nearest vectors have the highest inner products.
    """

    def __init__(self, sample: np.ndarray, longest: float, n: int = PIVOTS) -> None:
        self.longest = longest
        points = self.lifted(sample.astype(np.float64))
        chosen = [0]
        gap = ((points - points[0]) ** 2).sum(1)
        while len(chosen) < min(n, len(points)) and gap.max() > 0:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(1))
        self.points = points[chosen]

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        return np.c_[rows, np.sqrt(np.maximum(self.longest - (rows**2).sum(1), 0))]

    def distances(self, points: np.ndarray) -> np.ndarray:
        squared = (points**2).sum(1)[:, None] + (self.points**2).sum(1)[None, :] - 2 * points @ self.points.T
        return np.sqrt(np.maximum(squared, 0))


def radius(squared: np.ndarray, longest: float, floor: np.ndarray) -> np.ndarray:
    """How far vectors of at least ``floor`` can be from each query."""
    inside = np.sqrt(np.maximum(squared + longest - 2 * floor, 0)) * (1 + SLACK) + SLACK
    return np.where(np.isneginf(floor), np.inf, inside)


def between(columns: dict[str, np.ndarray], start: int, to: int | None) -> dict[str, np.ndarray]:
    return {name: x[start:to] for name, x in columns.items()}


def floors(rows: np.ndarray, ids: np.ndarray, wanted: np.ndarray, k: int) -> np.ndarray:
    """Each wanted row's k-th highest product with the others, or ``NONE``."""
    out = np.full(len(wanted), NONE, np.int64)
    for at in range(0, len(wanted), TILE) if len(rows) >= k else ():
        some = wanted[at : at + TILE]
        found = products(rows[some], rows)
        found[ids[some][:, None] == ids[None, :]] = NONE
        out[at : at + TILE] = np.partition(found, -k, axis=1)[:, -k].astype(np.int64)
    return out


def annuli(rows: DataFrame, pivots, width: int, kind: str, k: int) -> DataFrame:
    """The index: annuli of at most ``ANNULUS`` vectors of one pivot in order of distance, ``RUN`` vectors to a row, and
    between them the queries of some rows in a row of their own.

    Sorted by pivot, distance and id over all partitions, so neither a dense cell nor equal vectors
    meet in one task. A query's floor is its k-th score among the vectors of its own row.
    """

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column(1), width)
            far = pivots().distances(pivots().lifted(vectors.astype(np.float64)))
            nearest = far.argmin(1)
            data = pa.py_buffer(vectors.astype(kind).tobytes())
            ends = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * (width * np.dtype(kind).itemsize))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.BinaryArray.from_buffers(pa.binary(), len(vectors), [None, ends.buffers()[1], data]), batch.column(2),
                 pa.array(nearest.astype(np.int32)), pa.array(far[np.arange(len(far)), nearest])],
                names=["vec_id", "vector", "wanted", "pivot", "distance"],
            )

    def shown(row: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{n: x.tobytes() if isinstance(x, np.ndarray) else x for n, x in row.items()}], schema=shape)

    def run_of(own: dict[str, np.ndarray]) -> dict:
        cuts = np.flatnonzero(np.diff(own["pivot"])) + 1
        starts = np.array([x for s, t in zip([0, *cuts], [*cuts, len(own["pivot"])], strict=True) for x in range(s, t, ANNULUS)])
        ends = np.append(starts[1:], len(own["pivot"]))
        return {"pivots": own["pivot"][starts].astype("<i4"), "lows": own["distance"][starts], "highs": own["distance"][ends - 1],
                "starts": starts.astype("<i4"), "ids": own["vec_id"], "vectors": own["vector"]}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asked = None, []

        def asked_of() -> dict:
            ids, rows, least = (np.concatenate(x) for x in zip(*asked, strict=True))
            return {"query_ids": ids, "queries": rows, "floors": least}

        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                vectors = np.frombuffer(b"".join(batch.column(1).to_pylist()), kind).reshape(-1, width)
                part = {"vec_id": batch.column(0).to_numpy(), "vector": vectors, "wanted": batch.column(2).to_numpy(zero_copy_only=False),
                        "pivot": batch.column(3).to_numpy(), "distance": batch.column(4).to_numpy()}
                held = {n: np.concatenate([x, part[n]]) for n, x in held.items()} if held else part
            while held and len(held["pivot"]) >= (RUN if batch is not None else 1):
                own, held = between(held, 0, RUN), between(held, RUN, None)
                wanted = np.flatnonzero(own["wanted"])
                yield shown(run_of(own))
                for at in range(0, len(wanted), QUERIES):
                    some = wanted[at : at + QUERIES]
                    if asked and sum(len(x[0]) for x in asked) + len(some) > QUERIES:
                        yield shown(asked_of())
                        asked = []
                    asked.append((own["vec_id"][some], own["vector"][some], floors(own["vector"], own["vec_id"], some, k)))
        if asked:
            yield shown(asked_of())

    names = ["pivots", "lows", "highs", "starts", "ids", "vectors", "query_ids", "queries", "floors"]
    shape = pa.schema([(name, pa.binary()) for name in names])
    assigned = rows.mapInArrow(assign, "vec_id long, vector binary, wanted boolean, pivot int, distance double")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = assigned.repartitionByRange(n, "pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")
    return ordered.mapInArrow(build, ", ".join(f"{name} binary" for name in names))


class Search:
    """A batch of queries that the runs of the index pass one by one: each raises the floors, and what is out of reach is passed over."""

    def __init__(self, row: dict, pivots: Pivots, width: int, kind: str, k: int) -> None:
        self.pivots, self.k = pivots, k
        self.ids = np.frombuffer(row["query_ids"], np.int64)
        whole = np.frombuffer(row["queries"], kind).reshape(-1, width).astype(np.int64)
        exact = whole.astype(np.float64)
        # every vector has as many bits, so one type does for all products
        self.rows = whole.astype(np.float32) if kind == "<i1" and width <= 1024 else whole
        self.squared, self.far = (exact**2).sum(1), pivots.distances(np.c_[exact, np.zeros(len(exact))])
        self.nearest = self.far.min(1)
        # a vector counts where its score is above the floor, or is the floor and the id is below ``last``
        self.floor, self.last = np.frombuffer(row["floors"], np.int64).copy(), np.full(len(exact), LAST)
        self.kept = [np.zeros(0, np.int64)] * 3
        self.new, self.n_new = [], 0
        self.reach()

    def reach(self) -> None:
        self.radius = radius(self.squared, self.pivots.longest, np.where(self.floor == NONE, -np.inf, self.floor.astype(np.float64)))

    def settle(self) -> None:
        """Of all that was found the ``k`` highest scores of each query stay, ties to smaller ids."""
        if not self.new:
            return
        query, ids, scores = (np.concatenate([x, *y]) for x, y in zip(self.kept, zip(*self.new, strict=True), strict=True))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        first = np.searchsorted(query, np.arange(len(self.ids)))
        some = np.arange(len(query)) - first[query] < self.k
        self.kept, self.new, self.n_new = [query[some], ids[some], scores[some]], [], 0
        ends = first + self.k - 1
        full = np.flatnonzero(ends < np.append(first[1:], len(query)))
        raised = full[scores[ends[full]] >= self.floor[full]]
        self.floor[raised], self.last[raised] = scores[ends[raised]], ids[ends[raised]]
        self.reach()

    def meet(self, run: dict) -> None:
        pivot, start = (np.frombuffer(run[name], "<i4") for name in ("pivots", "starts"))
        low, high = (np.frombuffer(run[name]) for name in ("lows", "highs"))
        far, r = self.far[:, pivot], self.radius[:, None]
        near = (far - high <= r) & (low - far <= r) & ((far - self.nearest[:, None]) / 2 <= r)  # the last: else on the other side
        if not near.any():
            return
        ids = np.frombuffer(run["ids"], np.int64)
        vectors = np.frombuffer(run["vectors"], run["kind"]).reshape(len(ids), -1)
        end = np.append(start[1:], len(ids))
        reached = np.flatnonzero(near.any(0))
        tile = np.cumsum(end[reached] - start[reached]) // TILE
        for some in np.split(reached, np.flatnonzero(np.diff(tile)) + 1):
            asked = np.flatnonzero(near[:, some].any(1))
            places = np.concatenate([np.arange(start[n], end[n]) for n in some])
            there = vectors[places].astype(self.rows.dtype)
            for row in range(0, len(asked), ROWS):
                self.compare(asked[row : row + ROWS], ids[places], there)

    def compare(self, asked: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = products(self.rows[asked], vectors)
        limit = self.floor[asked] + ((self.last[asked] <= ids.min()) & (self.floor[asked] != NONE))
        hit = np.flatnonzero(scores.max(1) >= limit.astype(scores.dtype))
        if not len(hit):
            return
        query = asked[hit]
        floor = self.floor[query]
        q, v = np.nonzero(scores[hit] >= floor.astype(scores.dtype)[:, None])
        found, whose = scores[hit[q], v].astype(np.int64), query[q]
        counts = (ids[v] != self.ids[whose]) & ((found > floor[q]) | (ids[v] < self.last[whose]))
        self.new.append((whose[counts], ids[v[counts]], found[counts]))
        self.n_new += int(counts.sum())
        if self.n_new > 4 * self.k * len(self.ids):
            self.settle()


def top_k(rows: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each wanted row the ``k`` rows of highest inner product, ties to smaller ids.

    ``rows`` has ``vec_id``, ``vector`` of whole numbers and ``wanted``. Rows without id or vector
    take no part; rows that share the query's id are not its results; a shorter vector ends in
    zeros. The result is exact. Products must fit 64 bits.

    A task holds a batch of queries and reads the whole index past it, row by row: vectors are moved
    by no shuffle but that which sorts them, and a batch leaves ``k`` rows a query.
    """
    spark = rows.sparkSession
    rows = stage(rows.where("vec_id is not null and vector is not null").select("vec_id", "vector", "wanted"), "vectors")
    squared = F.aggregate("vector", F.lit(0.0), lambda n, x: n + x.cast("double") * x)
    most = F.greatest(F.max(F.array_max("vector")), -F.min(F.array_min("vector")))
    width, longest, most = rows.agg(F.max(F.size("vector")), F.max(squared), most).first()
    if not width:
        width, longest = 1, longest or 0.0
    kind = kind_of(most or 0)
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    sample = matrix(some.column(0).combine_chunks(), width) if some.num_rows else np.zeros((1, width), np.int64)
    pivots = share(spark, Pivots(sample, longest))
    index = stage(annuli(rows, pivots, width, kind, k), "annuli")
    with conf_set(spark, "spark.sql.parquet.columnarReaderBatchSize", 16):
        runs = index.where("ids is not null").select("pivots", "lows", "highs", "starts", "ids", "vectors").coalesce(1).rdd
        asked = index.where("query_ids is not null").select("query_ids", "queries", "floors").rdd.zipWithIndex()
    n = max(1, asked.count())

    def search(pairs: Iterator[tuple]) -> Iterator[tuple]:
        own, batches = pivots(), {}
        for (number, row), run in pairs:
            if number not in batches:
                batches[number] = Search(row.asDict(), own, width, kind, k)
            batches[number].meet(run.asDict() | {"kind": kind})
        for batch in batches.values():
            batch.settle()
            query, ids, scores = batch.kept
            yield tuple(bytearray(x.astype(np.int64).tobytes()) for x in (batch.ids[query], ids, scores))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in row], names=["query_id", "vec_id", "score"])

    # one batch a partition, so each partition of pairs reads the index once
    dealt = asked.map(lambda x: (x[1], x[0])).partitionBy(n, int)
    held = spark.createDataFrame(dealt.cartesian(runs).mapPartitions(search), "q binary, v binary, s binary", verifySchema=False)
    found = held.mapInArrow(told, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query(
    "op3_top_k",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vector
      FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.vector, c.vector) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY rank <= 20
    """,
)
def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("vector"), (F.col("vec_id") % 20 == 0).alias("wanted"))
    return top_k(rows)
