"""Streaming ingest: each micro-batch replaces the sources it brings.

The store keeps the version of every source, so an older version in a later batch changes
nothing: the end state equals one batch build of the latest version of every source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagequarry.session import cut_lineage
from pagequarry.sources.tables import KnowledgeStore


def newest_per_source(batch: DataFrame) -> DataFrame:
    """The last version (by ``version``) of each source in a batch, pre-aggregated."""
    return (batch.groupBy("db", "source").agg(F.max(F.struct("version", "text")).alias("_d"))
            .select("db", "source", "_d.version", "_d.text"))


def not_older(latest: DataFrame, store: KnowledgeStore) -> DataFrame:
    """The sources whose version is at least the stored one (an equal one is a repeated batch)."""
    if not store.versions.exists():
        return latest
    known = store.versions.read().select("db", "source", F.col("version").alias("_known"))
    return (latest.join(known, ["db", "source"], "left")
            .where(F.col("_known").isNull() | (F.col("version") >= F.col("_known"))).drop("_known"))


def ingest_stream(documents: DataFrame, store: KnowledgeStore, checkpoint: str) -> StreamingQuery:
    """Start ingesting a stream of (db, source, version, text).

    Replacing is idempotent, so a batch repeated after a failure changes nothing.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        latest = cut_lineage(not_older(newest_per_source(batch), store))
        if not latest.isEmpty():
            store.replace(latest.select("db", "source", "text"))
            store.versions.replace(latest.select("db", "source"), latest.select("db", "source", "version"))

    return (documents.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
