"""Vector functions in double precision, one Arrow batch at a time."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# the function travels to the workers by value: nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def batch_cosine(left: pa.Array, right: pa.Array) -> pa.Array:
    """Cosine of each pair of vectors; NULL where one is missing, empty or zero."""
    sizes = pc.fill_null(pc.list_value_length(left), 0).to_numpy(zero_copy_only=False)
    others = pc.fill_null(pc.list_value_length(right), 0).to_numpy(zero_copy_only=False)
    usable = (sizes > 0) & (others > 0)
    if (sizes[usable] != others[usable]).any():
        raise ValueError("cosine similarity of vectors of different length")
    result = np.full(len(left), np.nan)
    if usable.any():
        kept = pa.array(usable)
        a = pc.list_flatten(left.filter(kept)).to_numpy(zero_copy_only=False).astype(np.float64)
        b = pc.list_flatten(right.filter(kept)).to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.concatenate(([0], np.cumsum(sizes[usable])[:-1]))
        dot, aa, bb = (np.add.reduceat(product, starts) for product in (a * b, a * a, b * b))
        norms = np.sqrt(aa) * np.sqrt(bb)
        result[usable] = np.divide(dot, norms, out=np.full(len(dot), np.nan), where=norms > 0)
    return pa.array(result, mask=np.isnan(result))


# marked so that a filter on the score does not compute it a second time
_cosine = F.arrow_udf(batch_cosine, T.DoubleType()).asNondeterministic()


def cosine(left: Column, right: Column, zero_is_error: bool = False) -> Column:
    """Cosine similarity; a zero vector gives NULL, or fails the query on request."""
    score = _cosine(left, right)
    if not zero_is_error:
        return score
    failure = F.raise_error(F.lit("cosine similarity of a zero vector")).cast("double")
    return F.when(score.isNull() & left.isNotNull() & right.isNotNull(), failure).otherwise(score)
