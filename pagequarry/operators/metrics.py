"""Retrieval quality: precision@5, recall@10 and reciprocal rank per query, slice and overall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry import fixed_values as fv
from pagequarry.functions import text as tx


def matches(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """Hits that satisfy an expected token (query_id, token).

    A token is a chunk id, a source, or ``source#fragment`` with the fragment in the
    anchor or heading path: three equi-joins, one for each kind.
    """
    hash_at = F.locate("#", F.col("token"))
    wanted = expected.select("query_id", "token", F.when(hash_at > 0, tx.strip(F.left("token", hash_at - 1))).alias("base"),
                             F.lower(tx.strip(F.substring("token", hash_at + 1, F.length("token")))).alias("fragment"))
    hay = F.lower(F.concat_ws(" ", "anchor", F.array_join("heading_path", " ")))
    by_id = hits.join(wanted.withColumnRenamed("token", "chunk_id"), ["query_id", "chunk_id"]).withColumn("token", F.col("chunk_id"))
    by_source = hits.join(wanted.withColumnRenamed("token", "source"), ["query_id", "source"]).withColumn("token", F.col("source"))
    by_section = hits.join(wanted.where("base IS NOT NULL").withColumnRenamed("base", "source"), ["query_id", "source"]).where(hay.contains(F.col("fragment")))
    columns = [*hits.columns, "token"]
    # A hit and a token meet in one row, whichever way they match.
    return by_id.select(*columns).unionByName(by_source.select(*columns)).unionByName(by_section.select(*columns)).dropDuplicates(["query_id", "rank", "token"])


def per_query(cases: DataFrame, hits: DataFrame, expected: DataFrame) -> DataFrame:
    """cases: query_id, slice; hits carry 0-based ranks."""
    top = hits.where(F.col("rank") < fv.RECALL_AT)
    found = matches(top, expected).groupBy("query_id").agg(
        F.count_distinct(F.when(F.col("rank") < fv.PRECISION_AT, F.col("rank"))).alias("n5"),
        F.count_distinct("token").alias("found"), F.min("rank").alias("first"))
    wanted = expected.groupBy("query_id").agg(F.count_distinct("token").alias("wanted"))
    rows = cases.join(found, "query_id", "left").join(wanted, "query_id", "left")
    zero = F.lit(0.0)
    return rows.select("query_id", "slice",
                       F.coalesce(F.col("n5") / fv.PRECISION_AT, zero).alias("precision"),
                       F.coalesce(F.col("found") / F.col("wanted"), zero).alias("recall"),
                       F.coalesce(1.0 / (F.col("first") + 1), zero).alias("mrr"))


def by_slice(scored: DataFrame) -> DataFrame:
    """Mean of each measure per slice, and over all queries as slice ALL."""
    return (scored.rollup("slice").agg(F.count("*").alias("n"), F.avg("precision").alias("precision"),
                                       F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"))
            .withColumn("slice", F.coalesce("slice", F.lit("ALL"))))
