"""What both vector searches share: the rows that take part, bounded samples, packing rows into blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import stored

QUERY_STEP = 20


def valid(table: DataFrame, vector: str, value: Callable[[Column], Column], zeros: bool) -> DataFrame:
    """uid, vec_id, v (array<double>): the different rows that can take part, each with a number of its own.

    Left out: null ids and vectors, empty vectors, vectors with a null or non-finite component,
    and with ``zeros`` False those of zeros alone.  Equal vectors of one vec_id count once,
    different ones are different rows.
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    fine = fine if zeros else fine.where(F.exists("v", lambda x: x != 0))
    return stored(fine.select("vec_id", F.transform("v", value).alias("v")).distinct().select(F.monotonically_increasing_id().alias("uid"), "*"))


def by_length(rows: DataFrame, step: int) -> list[tuple[DataFrame, int, float, int]]:
    """(rows, how many, largest squared length, components) per vector length that has queries: only such vectors can be multiplied."""
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    sizes = (rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(square).alias("reach"), F.count_if(F.col("vec_id") % step == 0).alias("asked"))
             .where("asked > 0").orderBy("d").collect())   # one row per length
    return [(rows.where(F.size("v") == s["d"]), s["n"], float(s["reach"]), s["d"]) for s in sizes]


def sample(rows: DataFrame, size: int) -> np.ndarray:
    """Matrix of at most ``size`` rows, the first by a hash of their vec_id."""
    found = rows.orderBy(F.xxhash64(F.lit("sample"), "vec_id"), "vec_id", "v").limit(size).select("v").toArrow()
    return np.array(found["v"].to_pylist(), np.float64).reshape(len(found), -1)


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def packed(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def best(hits: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest scores of each query (uid, query_id), ties to the smaller id."""
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def cut(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id, best first."""
    if len(ids) > k > 0 and scores.dtype != object:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))[:k]
