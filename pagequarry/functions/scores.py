"""Score arithmetic: BM25 weights, reciprocal ranks, blends, vector products."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequarry import fixed_values as fv


def bm25_idf(n_rows: Column, n_with_term: Column) -> Column:
    return F.greatest(F.log((n_rows - n_with_term + 0.5) / (n_with_term + 0.5)), F.lit(fv.BM25_IDF_FLOOR))


def bm25_weight(idf: Column, tf: Column, length: Column, mean_length: Column) -> Column:
    damp = fv.BM25_K1 * (1 - fv.BM25_B + fv.BM25_B * length / mean_length)
    return idf * tf * (fv.BM25_K1 + 1) / (tf + damp)


def reciprocal_rank(rank: Column) -> Column:
    """Contribution of a hit at 0-based ``rank``, with a bonus for the leaders."""
    bonus = (F.when(rank == 0, fv.RRF_BONUS_FIRST)
             .when(rank <= 2, fv.RRF_BONUS_NEXT_TWO).otherwise(0.0))
    return 1.0 / (rank + (fv.RRF_K + 1)) + bonus


def blend_weight(rank: Column) -> Column:
    """Share of the second score at 0-based fused ``rank``."""
    below_3, below_10 = fv.RERANK_TIERS
    return (F.when(rank < below_3[0], below_3[1])
            .when(rank < below_10[0], below_10[1]).otherwise(fv.RERANK_TAIL_WEIGHT))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Position between ``low`` and ``high``; a flat range gives one half."""
    return F.when(high - low < 1e-9, F.lit(0.5)).otherwise((value - low) / (high - low))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    """Length of a vector; 1 for the zero vector, which then stays zero when scaled."""
    length = F.sqrt(dot(vector, vector))
    return F.when(length == 0, F.lit(1.0)).otherwise(length)


def unit(vector: Column) -> Column:
    """L2-normalised vector (for short work; see dense.embed for the staged form)."""
    scale = norm(vector)
    return F.transform(vector, lambda x: x.cast("double") / scale)
