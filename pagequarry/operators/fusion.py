"""Fusion of two ranked lists and position-aware blending with a second score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pagequarry import fixed_values as fv
from pagequarry.functions import scores as sc
from pagequarry.functions import text as tx
from pagequarry.operators import dense, lexical
from pagequarry.session import cut_lineage

Scorer = Callable[[Column, Column], Column]
_KEYS = ("query_id", "db", "chunk_id")


def shared_words(query: Column, text: Column) -> Column:
    """Default second score: share of the distinct query words that occur in the text."""
    asked = F.array_distinct(tx.words(query))
    return F.size(F.array_intersect(asked, F.array_distinct(tx.words(text)))) / F.greatest(F.size(asked), F.lit(1))


def fuse(lexical_hits: DataFrame, dense_hits: DataFrame, k: int = 10) -> DataFrame:
    """Weighted reciprocal-rank fusion of two hit lists on (query, chunk).

    Both lists are short per query, so they are stacked and summed rather than outer-joined.
    A query without dense hits keeps its lexical list and BM25 scores.
    """
    lex = lexical_hits.select(*_KEYS, "scope", "source", "rank", F.col("score").alias("bm25"), "matched_terms",
                              (fv.WEIGHT_LEXICAL * sc.reciprocal_rank(F.col("rank"))).alias("share"))
    # Of dense hits that share a chunk id the best one counts.
    once = dense_hits.groupBy(*_KEYS).agg(F.min(F.struct("rank", "source", "scope")).alias("_hit")).select(*_KEYS, "_hit.*")
    sem = once.select(*_KEYS, "scope", "source", "rank", F.lit(None).cast("double").alias("bm25"),
                            F.array().cast("array<string>").alias("matched_terms"),
                            (fv.WEIGHT_DENSE * sc.reciprocal_rank(F.col("rank"))).alias("share"))
    arms = lex.withColumn("arm", F.lit(0)).unionByName(sem.withColumn("arm", F.lit(1)))
    lead = F.struct("arm", "source", "scope", "bm25", "matched_terms", "rank")
    fused = arms.groupBy(*_KEYS).agg(F.sum("share").alias("rrf"), F.min(lead).alias("lead"),
                                     F.max("arm").alias("last_arm"))
    per_query = W.partitionBy("query_id", "db")
    fused = fused.withColumn("dense_ran", F.max("last_arm").over(per_query) == 1)
    order = per_query.orderBy(F.when(F.col("dense_ran"), -F.round("rrf", 12)), F.when(~F.col("dense_ran"), F.col("lead.rank")),
                              "chunk_id")
    return (fused.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)
            .select("query_id", "db", "rank", "chunk_id", "lead.source", "lead.scope",
                    F.when(F.col("dense_ran"), F.round("rrf", 4)).otherwise(F.col("lead.bm25")).alias("score"),
                    "lead.matched_terms"))


def rerank(hits: DataFrame, k: int = 10, scorer: Scorer = shared_words, depth: int = fv.RERANK_DEPTH,
           query_text: str = "query_text", text: str = "text") -> DataFrame:
    """Blend the fused score with a second score; rows beyond ``depth`` follow unchanged.

    A query with fewer than two candidates, or with a candidate the scorer could not score,
    keeps its fused order.
    """
    per_query = W.partitionBy("query_id", "db")
    inside = F.col("rank") < depth
    second = F.when(inside, scorer(F.col(query_text), F.left(F.col(text), F.lit(fv.RERANK_DOC_CHARS))))
    scored = hits.withColumn("_second", second)
    usable = ((F.count(F.when(inside, 1)).over(per_query) >= 2)
              & (F.count(F.when(inside & F.col("_second").isNull(), 1)).over(per_query) == 0))

    def position(name: str) -> Column:
        value = F.when(inside, F.col(name))
        return sc.min_max(F.col(name), F.min(value).over(per_query), F.max(value).over(per_query))

    weight = sc.blend_weight(F.col("rank"))
    mixed = F.round((1 - weight) * position("score") + weight * position("_second"), 4)
    blended = scored.withColumn("_blend", usable & inside).withColumn("_mixed", mixed)
    order = per_query.orderBy(F.when(F.col("_blend"), 0).otherwise(1),
                              F.when(F.col("_blend"), -F.col("_mixed")), "rank")
    return (blended.withColumn("_rank", F.row_number().over(order) - 1).where(F.col("_rank") < k)
            .withColumn("score", F.when(F.col("_blend"), F.col("_mixed")).otherwise(F.col("score")))
            .withColumn("rerank_score", F.when(F.col("_blend"), F.round("_second", 4)))
            .withColumn("rank", F.col("_rank")).drop("_rank", "_second", "_mixed", "_blend"))


def hybrid(chunks: DataFrame, queries: DataFrame, k: int = 10, vectors: DataFrame | None = None,
           model: dense.Model | None = dense.letter_model, scorer: Scorer | None = None) -> DataFrame:
    """Lexical and dense arm, fused, and with a scorer re-ranked.

    No model and no vectors: the dense arm is not in the plan at all.
    """
    depth = max(k, fv.RERANK_DEPTH) if scorer else k
    lex = lexical.search(chunks, queries, fv.ARM_DEPTH)
    if vectors is None and model is None:
        hits = lex.where(F.col("rank") < depth).select(
            "query_id", "db", "rank", "chunk_id", "source", "scope", "score", "matched_terms")
    else:
        vectors = dense.embed(chunks, model) if vectors is None else vectors
        asked = dense.embed(queries.where(~tx.is_blank(F.col("text"))), model or dense.letter_model)
        hits = fuse(lex, dense.nearest(vectors, asked, fv.ARM_DEPTH), depth)
    if scorer is None:
        return hits
    hits = cut_lineage(hits)     # read twice below: to pick texts and to be joined to them
    texts = lexical.with_text(hits, chunks)
    asked_text = queries.select("query_id", "db", F.col("text").alias("query_text")).distinct()
    return rerank(texts.join(asked_text, ["query_id", "db"]), k, scorer).drop("query_text", "text")
